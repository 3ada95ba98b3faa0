"""What several text operators share: column names that cannot clash, blanks, names of fixed bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks of the contracts, U+0020 and U+0009 to U+000D, as a Java character class and as text.
BLANKS = r"[ \t-\r]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

ROW = "__row"


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row whole in one struct, beside named working columns, so that no column of the caller can clash."""
    return docs.select(F.struct("*").alias(ROW), *[c.alias(f"__{name}") for name, c in keys.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The caller's rows with the caller's columns."""
    return rows.select([F.col(ROW)[name].alias(name) for name in docs.columns])


def whole_text(text_col: str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def let(value: Column, use) -> Column:
    """Bind ``value`` once inside an expression: ``use`` gets a variable, so nothing is evaluated again."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """The runs of non-blank characters, in order; none for an empty or blank text."""
    bare = F.btrim(text, F.lit(BLANK_CHARS))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANKS)))
