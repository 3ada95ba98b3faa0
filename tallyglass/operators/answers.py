"""Answers, citations and quoted figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import JS_BLANK, JS_BLANK_CHARS, cited_numbers, is_not_found, source_label, strip_blank

CITATION_COLUMNS = ("file_id", "name", "folder", "page", "section", "sheet", "row_start", "row_end")


def hit_sources(hits: DataFrame) -> DataFrame:
    """Numbered hits -> flat source records: citation label, score to three decimals, the text as snippet."""
    label = source_label(*(F.col(c) for c in ("folder", "name", "sheet", "row_start", "row_end", "page", "section")))
    return hits.select(
        "query_id", "n", *CITATION_COLUMNS, label.alias("label"), F.round("score", 3).alias("score"),
        F.col("text").alias("snippet"),
    )


def answer_records(answers: DataFrame, hits: Column, has_chart: Column | None = None,
                   n_tables: Column | None = None) -> DataFrame:
    """answers(text, ...) -> ``kind`` (chart, notfound, answer) and the ``cited`` numbers."""
    chart = F.lit(False) if has_chart is None else has_chart
    tables = F.lit(0) if n_tables is None else n_tables
    kind = F.when(chart, "chart").when(is_not_found(F.col("text")) & (tables == 0), "notfound").otherwise("answer")
    return answers.withColumn("kind", kind).withColumn("cited", cited_numbers(F.col("text"), hits))


def cite_sources(answers: DataFrame, hits: DataFrame, full: bool = False, answer_id: str = "answer_id") -> DataFrame:
    """Cited hits of each answer; in passages mode an answer that cites nothing lists every hit."""
    explicit = answers.select(answer_id, F.explode("cited").alias("n"))
    cited = explicit.join(hits, [answer_id, "n"])
    if full:
        return cited
    silent = answers.where(F.size("cited") == 0).select(answer_id)
    return cited.unionByName(silent.join(hits, answer_id).select(cited.columns))


def union_citations(cited: Column, refs: Column) -> Column:
    return F.array_sort(F.array_union(cited, refs))


def excerpt_chart(proposals: DataFrame) -> DataFrame:
    """Quoted figures -> (proposal_id, category_pos, category, series, value, ref), or one error per proposal.

    ``proposals(proposal_id, n_hits, categories, series ARRAY<STRUCT<name, values, refs>>)``.  A series whose
    lengths differ from the categories, or a reference outside 1..n_hits, rejects the whole proposal.
    """
    size = F.size("categories")
    uneven = F.exists("series", lambda s: (F.size(s["values"]) != size) | (F.size(s["refs"]) != size))
    astray = F.exists("series", lambda s: F.exists(
        s["refs"], lambda r: F.coalesce((r < 1) | (r > F.col("n_hits")), F.lit(True))))
    error = F.when(uneven, "the quoted figures did not line up with the categories").when(
        astray, "a figure pointed at an excerpt that does not exist")
    checked = proposals.withColumn("error", error)
    sound = F.when(F.col("error").isNull(), F.col("series"))
    rows = checked.select("proposal_id", "categories", "error", F.explode_outer(sound).alias("s"))
    cells = rows.select(
        "proposal_id", "error", F.col("s.name").alias("series"),
        F.posexplode_outer(F.arrays_zip(
            F.when(F.col("s").isNotNull(), F.col("categories")).alias("category"),
            F.col("s.values").alias("value"), F.col("s.refs").alias("ref"),
        )).alias("category_pos", "c"),
    )
    finite = F.when(~F.isnan("c.value") & (F.abs("c.value") < float("inf")), F.col("c.value"))
    return cells.select(
        "proposal_id", "error", "category_pos", F.substring("c.category", 1, 80).alias("category"),
        F.substring("series", 1, 60).alias("series"), finite.alias("value"), F.col("c.ref").alias("ref"),
    )


def excerpt_refs(cells: DataFrame, hits: DataFrame) -> DataFrame:
    """Figures joined to the numbered hit they quote."""
    numbered = hits.select("proposal_id", F.col("n").alias("ref"), "label")
    return cells.where(F.col("error").isNull()).join(numbered, ["proposal_id", "ref"])


# ---------------------------------------------------------------- Markdown answers

# What rules of tables and items of lists look like.
_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$"
_BULLET = r"^\s*([-*•]|\d+\.)\s+"


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(strip_blank(line, JS_BLANK_CHARS), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: strip_blank(c, JS_BLANK_CHARS))


def markdown_blocks(answers: DataFrame, id_col: str = "answer_id", text: str = "text") -> DataFrame:
    """Answer text -> (id, block, kind, row, col, text): paragraphs, bullet items, table cells.

    A table is a rule line under a line with bars; short rows are padded, long ones cut to the header.
    """
    paragraphs = F.split(strip_blank(F.col(text), JS_BLANK_CHARS), rf"\n[{JS_BLANK}]*\n", -1)
    blocks = answers.select(id_col, F.posexplode_outer(paragraphs).alias("block", "_p")).where(F.col("_p").isNotNull())
    lines = blocks.withColumn("_l", F.split("_p", "\n", -1))
    is_rule = F.transform("_l", lambda l, i: (i > 0) & l.rlike(_RULE) & F.get("_l", i - 1).contains("|"))
    placed = lines.withColumn("_rule", F.array_position(is_rule, True).cast("int") - 1)
    table = F.col("_rule") > 0
    bullets = F.forall("_l", lambda l: l.rlike(_BULLET))
    before = strip_blank(F.array_join(F.slice("_l", F.lit(1), F.greatest(F.col("_rule") - 1, F.lit(0))), "\n"), JS_BLANK_CHARS)
    body = F.filter(F.slice("_l", F.col("_rule") + 2, F.size("_l")), lambda l: l.contains("|"))
    grid = F.concat(F.array(_cells(F.get("_l", F.col("_rule") - 1))), F.transform(body, lambda line: _cells(line)))
    shaped = placed.select(
        id_col, "block", "_p", "_l",
        F.when(table, "table").when(bullets, "item").otherwise("paragraph").alias("kind"),
        F.when(table, before).alias("_before"), F.when(table, grid).alias("_grid"),
    )
    none = F.lit(None).cast("int")
    lead = shaped.where(F.col("_before") != "").select(
        id_col, "block", F.lit("paragraph").alias("kind"), none.alias("row"), none.alias("col"),
        F.col("_before").alias("text"))
    plain = shaped.where(F.col("kind") == "paragraph").select(
        id_col, "block", "kind", none.alias("row"), none.alias("col"), F.col("_p").alias("text"))
    items = shaped.where(F.col("kind") == "item").select(
        id_col, "block", "kind", F.posexplode("_l").alias("row", "_i")).select(
        id_col, "block", "kind", "row", none.alias("col"), F.regexp_replace("_i", _BULLET, "").alias("text"))
    width = F.size(F.get("_grid", F.lit(0)))
    rows = shaped.where(F.col("kind") == "table").select(
        id_col, "block", "kind", width.alias("_w"), F.posexplode("_grid").alias("row", "_r"))
    table_cells = rows.select(
        id_col, "block", "kind", "row", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("col"), "_r").select(
        id_col, "block", "kind", "row", "col", F.coalesce(F.get("_r", F.col("col")), F.lit("")).alias("text"))
    return lead.unionByName(plain).unionByName(items).unionByName(table_cells)
