"""Units of text -> overlapping chunks.

Cutting a unit is an expression over its own row (no shuffle, no Python); numbering chunks within a file
and packing sheet rows use the order operators, which stay parallel inside one huge file.
"""

from __future__ import annotations

import html.parser
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import PY_BLANK, SECTION_LIMIT, clean_text, strip_blank
from tallyglass.operators import row_packing
from tallyglass.operators.ordered import running_sum
from tallyglass.scale import staged

# Separators from coarse to fine, and default parameters.
SEPARATORS = ("\n\n", "\n", ". ", " ")
STRATEGIES = ("recursive", "fixed", "by_paragraph", "by_page")
CHUNK_SIZE, CHUNK_OVERLAP = 800, 120

# Pieces of a text that are packed in one go.
BLOCK_PIECES = 512

_MARK = "\x00"  # cleaned text holds no NUL, so it can mark the places to cut


def clamp_overlap(size: int, overlap: int) -> int:
    return max(0, min(overlap, size // 2))


def chunk_fixed(text: Column, size: int, overlap: int) -> Column:
    """Slices of ``size`` characters, each starting ``size - overlap`` after the one before."""
    step = max(1, size - overlap)
    last = F.greatest(F.length(text) - overlap, F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))


def chunk_by_page(text: Column, size: int, overlap: int) -> Column:
    return F.when(F.length(text) <= 2 * size, F.array(text)).otherwise(chunk_fixed(text, 2 * size, overlap))


def _cut_after(text: Column, separator: str) -> Column:
    marked = F.replace(text, F.lit(separator), F.lit(separator + _MARK))
    return F.split(marked, _MARK, -1)


def _cut_long(pieces: Column, size: int, cutter) -> Column:
    """Keep pieces that fit, replace the others by their cuts."""
    return F.flatten(F.transform(
        pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cutter(p))
    ))


def _pieces(text: Column, size: int) -> Column:
    """Cut by the coarsest separator; what is still too long is cut by the next one, at last by length."""
    pieces = F.array(text)
    for separator in SEPARATORS:
        pieces = _cut_long(pieces, size, partial(_cut_after, separator=separator))
    return _cut_long(pieces, size, partial(chunk_fixed, size=size, overlap=0))


def _overlap_tail(text: Column, overlap: int) -> Column:
    """Last ``overlap`` characters, from the first word boundary in them on."""
    if not overlap:
        return F.lit("")
    return F.regexp_replace(F.right(text, F.lit(overlap)), r"(?s)^[^ ]* ", "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def chunk_recursive(text: Column, size: int, overlap: int) -> Column:
    """Pack pieces up to ``size``; a chunk starts with the tail of the one before, so it may exceed ``size``
    by at most the overlap.  A fold over the row's own pieces.

    Spark copies the state of a fold at every step, so the chunks found so far must not ride along: pieces are folded in
    blocks of ``BLOCK_PIECES``, and only once per block its chunks are put aside.
    """
    none = F.array().cast("array<string>")

    def add(acc: Column, piece: Column) -> Column:
        cur = acc["cur"]
        full = (cur != "") & (F.length(cur) + F.length(piece) > size)
        return F.struct(
            F.when(full, F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.concat(_overlap_tail(cur, overlap), piece)).otherwise(F.concat(cur, piece)).alias("cur"),
        )

    def add_block(acc: Column, block: Column) -> Column:
        inside = F.aggregate(block, F.struct(none.alias("out"), acc["cur"].alias("cur")), add)
        return _bound(inside, lambda x: F.struct(F.array_append(acc["out"], x["out"]).alias("out"), x["cur"].alias("cur")))

    def close(acc: Column) -> Column:
        last = F.when(strip_blank(acc["cur"]) == "", none).otherwise(F.array(acc["cur"]))
        return F.concat(F.flatten(acc["out"]), last)

    def fold(pieces: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(BLOCK_PIECES))
        blocks = F.transform(starts, lambda i: F.slice(pieces, i, BLOCK_PIECES))
        return F.aggregate(blocks, F.struct(F.array().cast("array<array<string>>").alias("out"), F.lit("").alias("cur")), add_block, close)

    # A text that fits is its own single chunk; only longer ones enter the fold.
    fits = F.length(text) <= size
    short = F.when(strip_blank(text) == "", none).otherwise(F.array(text))
    return F.when(fits, short).otherwise(_bound(_pieces(text, size), fold))


def chunk_by_paragraph(text: Column, size: int, overlap: int) -> Column:
    paragraphs = F.split(text, rf"\n[{PY_BLANK}]*\n", -1)
    return F.flatten(F.transform(
        paragraphs,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(chunk_recursive(p, size, overlap)),
    ))


_CUTTERS = {
    "recursive": chunk_recursive, "fixed": chunk_fixed,
    "by_paragraph": chunk_by_paragraph, "by_page": chunk_by_page,
}


def cut(text: Column, strategy: str = "recursive", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces of one unit, trimmed, blank ones dropped."""
    pieces = _CUTTERS[strategy](text, size, clamp_overlap(size, overlap))
    return F.filter(F.transform(pieces, lambda p: strip_blank(p)), lambda p: p != "")


def chunk_units(units: DataFrame, strategy: str = "recursive", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """units(file_id, unit_pos, text, ...) -> chunks(file_id, chunk_index, ..., text).

    A unit's first chunk number is the count of chunks in the file's earlier units.  Texts are read and cut once; the
    pieces are written to the shared folder with a number of their own, of which the count reads narrow columns and
    which brings the count back.  Units with a null file or place, and units that share a place, keep their chunks:
    null is a file of its own, a null place comes first, and units of one place follow in the order they were read.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    kept = [c for c in units.columns if c not in ("file_id", "unit_pos", "text")]
    pieces = staged(units.select(
        "file_id", "unit_pos", *kept, cut(F.col("text"), strategy, size, overlap).alias("_pieces")
    ).withColumns({"_n": F.size("_pieces"), "_row": F.monotonically_increasing_id()}), "pieces")
    counts = pieces.select("_row", "file_id", "unit_pos", "_n").where("_n > 0")
    before = running_sum(counts, ["file_id"], ["unit_pos", "_row"], F.col("_n"), "_before").select("_row", "_before")
    return pieces.join(before, "_row").select(
        "file_id", "unit_pos", *kept, "_before", F.posexplode("_pieces").alias("_i", "text")
    ).select(
        "file_id", (F.col("_before") + F.col("_i")).alias("chunk_index"), "unit_pos", *kept, "text"
    )


def pack_rows(units: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Consecutive sheet rows as chunks of up to ``size``, with their row ranges; see ``row_packing``."""
    return row_packing.pack_rows(units, size)


def chunk_files(units: DataFrame, strategy: str = "recursive", size: int = CHUNK_SIZE,
                overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of all files: sheet rows are packed whatever the strategy, other units are cut by it.

    ``units(file_id, unit_pos, text, page, section, sheet, row)``.
    """
    cut_up = chunk_units(units.where(F.col("sheet").isNull()).drop("sheet", "row"), strategy, size, overlap)
    packed = pack_rows(units.where(F.col("sheet").isNotNull()), size)
    columns = ["file_id", "chunk_index", "page", "section", "sheet", "row_start", "row_end", "text"]
    return cut_up.unionByName(packed, allowMissingColumns=True).select(*columns)


def check_params(saved: DataFrame, params: dict) -> DataFrame:
    """Distinct saved parameters that differ from ``params``: any row means the index must be rebuilt."""
    differs = [~F.col(k).eqNullSafe(F.lit(v)) for k, v in params.items()]
    test = differs[0]
    for d in differs[1:]:
        test = test | d
    return saved.where(test).select(*params).distinct()


def reindex(units: DataFrame, strategy: str, size: int, overlap: int) -> DataFrame:
    """Re-chunk stored units under new parameters and stamp the chunks with them."""
    return chunk_units(units, strategy, size, overlap).withColumns({
        "chunk_strategy": F.lit(strategy), "chunk_size": F.lit(size),
        "chunk_overlap": F.lit(clamp_overlap(size, overlap)),
    })


# ---------------------------------------------------------------- HTML


class _Walk(html.parser.HTMLParser):
    """The blocks of a page as (kind, text) in order.

    Open elements form a stack.  Containers are looked through; a heading, paragraph, list or table outside any other block is
    a block of its own, whatever it holds; text beside them in a container is a block too.  Only elements count as blocks of
    the body itself, so bare text there is left out.
    """

    VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col", "source", "area", "base", "embed", "track"}
    HIDDEN = {"head", "title", "style", "script", "template", "noscript"}
    PAGE = {"html", "body"}
    CONTAINERS = PAGE | {"div", "article", "section", "main", "header", "footer", "nav", "aside", "form", "fieldset",
                  "figure", "details", "center", "blockquote"}
    HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
    BLOCKS = HEADINGS | {"p", "pre", "ul", "ol", "dl", "table", "address", "figcaption", "summary", "legend"}
    ENDS_P = CONTAINERS | BLOCKS | {"hr"}
    # What an opening tag closes, up to the block it stands in.
    SIBLINGS = {"li": {"li"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[str] = []
        self.block: int | None = None  # place of the open block in the stack
        self.hidden = 0
        self.text: list[str] = []
        self.items: list[str] = []
        self.cells: list[str] = []

    def _flush(self) -> str:
        text, self.text = "".join(self.text).strip(), []
        return text

    def _loose(self) -> None:
        """Text that stands in a container beside the blocks."""
        if text := self._flush():
            self.blocks.append(("text", text))

    def _in_body(self) -> bool:
        return not self.stack or self.stack[-1] in self.PAGE

    def _end_block(self, kind: str) -> None:
        text = self._flush()
        if kind in ("ul", "ol", "table"):
            self.blocks += [("text", item) for item in self.items]
        elif text:
            self.blocks.append(("heading" if kind in self.HEADINGS else "text", text))
        self.block, self.items = None, []

    def _pop(self) -> None:
        tag = self.stack.pop()
        if tag in self.HIDDEN:
            self.hidden -= 1
        elif self.block is None:
            if tag in self.CONTAINERS or self._in_body():
                self._loose()
        elif self.block == len(self.stack):
            self._end_block(tag)
        elif self.stack[self.block] == "table" and tag in ("td", "th"):
            self.cells.append(self._flush())
        elif self.stack[self.block] == "table" and tag == "tr":
            if any(self.cells):
                self.items.append(" | ".join(self.cells))
            self.cells = []
        elif self.stack[self.block] in ("ul", "ol") and tag == "li":
            if text := self._flush():
                self.items.append("- " + text)

    def handle_starttag(self, tag, attrs):
        if tag in self.ENDS_P and "p" in self.stack:
            while "p" in self.stack:
                self._pop()
        if tag in self.VOID:
            return
        if self.block is not None:
            while len(self.stack) > self.block + 1 and self.stack[-1] in self.SIBLINGS.get(tag, ()):
                self._pop()
        elif tag in self.CONTAINERS:
            self._loose()
        elif tag in self.BLOCKS:
            self._loose()
            self.block = len(self.stack)
        self.hidden += tag in self.HIDDEN
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack[-1] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.hidden and not self._in_body():
            self.text.append(data)

    def finish(self) -> list[tuple[str, str]]:
        # A page that ends inside a tag ends before it.
        if (at := self.rawdata.rfind("<")) >= 0 and ">" not in self.rawdata[at:]:
            self.rawdata = self.rawdata[:at]
        self.close()
        while self.stack:
            self._pop()
        self._loose()
        return self.blocks


@F.udtf(returnType="unit_pos int, section string, text string", useArrow=True)
class PageSections:
    """HTML has no built-in parser; a page yields its sections: a heading opens one, what stands before the first has none."""

    def eval(self, page: str):
        walk = _Walk()
        walk.feed(page or "")
        number, section, texts = 0, None, []
        for kind, text in [*walk.finish(), ("heading", "")]:
            if kind == "text":
                texts.append(text)
                continue
            if texts:
                yield number, section, "\n\n".join(texts)
            number, section, texts = number + 1, text[:SECTION_LIMIT], []


def html_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Whole pages -> (id, unit_pos, section, text): one row per section with text, numbered by the headings before it.

    Each page is walked once in the task that reads it; nothing is shuffled.  Null and empty pages give no row; unclosed
    elements end with what holds them.
    """
    read = pages.select(F.col(id_col), F.col(html_col).alias("_html"))
    found = read.lateralJoin(PageSections(F.col("_html").outer()))
    texts = found.select(id_col, "unit_pos", "section", clean_text(F.col("text")).alias("text"))
    return texts.where(F.col("text") != "")
