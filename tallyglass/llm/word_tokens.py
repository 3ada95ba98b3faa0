"""Token ids of whole texts by a word-level BPE file, through the ids of their distinct words."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import whole_text
from tallyglass.llm.pretoken import BEYOND_LATIN, splitter

# Words a worker remembers in each of two generations, so its memory does not grow with the corpus.
REMEMBERED = 500_000
ID_BYTES = 4
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


class _Words(dict):
    """Ids of words as bytes.  When full, all words become the older generation; those met again come back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self[word] = self.older.get(word) or self.encode(word)
        return ids


def byte_characters() -> dict[int, str]:
    """How byte-level files spell bytes: printable Latin-1 as it is, the rest from U+0100 on in order."""
    printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (unsigned 32-bit, little-endian), as the library's ``encode(text, add_special_tokens=False)``.

    Texts of Latin letters are lower-cased and split here, which gives the same words as the file's own normaliser and
    splitter, and the library's model encodes word by word.  Any other text, or one with a special token's opening,
    goes to the library whole.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        shape = json.load(file)
    split = splitter(shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    marks = {t["content"][:2] for t in shape["added_tokens"]}
    spelling, merge = byte_characters(), whole.model.tokenize

    def by_model(word: str) -> bytes:
        return array("I", [t.id for t in merge(word.encode().decode("latin-1").translate(spelling))]).tobytes()

    words = _Words(by_model)

    def encode(text: str) -> bytes:
        if BEYOND_LATIN.search(text) or any(m in text for m in marks):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(words.__getitem__, split(text.lower())))

    _ENCODERS[path] = encode
    return encode


def token_pieces(docs: DataFrame, path: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and ``end_id``, cut into pieces of ``most`` ids.

    A null text counts as empty and is the end id alone.  ``ids`` is binary, unsigned 32-bit little-endian.
    """
    end, step = end_id.to_bytes(ID_BYTES, "little"), most * ID_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for column, value in zip(out, (i, piece, at // ID_BYTES, len(part) // ID_BYTES, part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")
