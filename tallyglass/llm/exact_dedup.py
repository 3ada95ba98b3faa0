"""Exact duplicates: combine locally, then salted, then globally, with the whole text in every grouping key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import packed, unpacked, whole_text
from tallyglass.scale import staged


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                   digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per digest: ``digest, variants, keep_id, group_size``.

    Three rounds, each grouping by digest *and* text: inside every task (the map side of the first aggregate), in
    ``salts`` parts by the task that read the row, and over the parts.  A text that fills a third of the corpus
    leaves every task as one row, and a part merges only the tasks of its salt.  ``variants`` counts the different
    texts behind a digest; the other columns hold for digests of one text.  The result is a written table
    without texts.
    """
    text = whole_text(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"),
                        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    parts = keyed.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    texts = parts.groupBy("digest", "text").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    classes = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("variants"), F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return staged(classes, "exact-classes")


def _decided(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Give ``rows`` (with ``__digest, __text``) their ``__keep, __size``; nothing else changes."""
    found = classes.select(F.col("digest").alias("__digest"), F.col("variants").alias("__variants"),
                           F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    clear = rows.join(found.where("__variants = 1").drop("__variants"), "__digest")
    clashes = found.where("__variants > 1").select("__digest")
    if clashes.isEmpty():
        return clear.drop("__text")
    # Only the few digests that several texts share need their texts side by side once more.
    odd = rows.join(clashes, "__digest", "left_semi")
    groups = odd.groupBy("__digest", "__text").agg(
        F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    return clear.unionByName(odd.join(groups, ["__digest", "__text"])).drop("__text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id stays.  A null
    id is smaller than any other, so it stays only where all ids of its group are null.  Rows that repeat both id
    and text count towards ``group_size`` and share one decision.  An empty table gives an empty result.
    """
    text = whole_text(text_col)
    classes = digest_classes(docs, id_col, text_col, salts, digest)
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), digest(text).alias("__digest"))
    return _decided(rows, classes).select(
        F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__digest").alias("digest"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                      digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are."""
    text = whole_text(text_col)
    classes = digest_classes(docs, id_col, text_col, salts, digest)
    rows = packed(docs, id=F.col(id_col), text=text, digest=digest(text))
    return unpacked(_decided(rows, classes).where(F.col("__id").eqNullSafe(F.col("__keep"))), docs)
