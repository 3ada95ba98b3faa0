"""Documents to packed training sequences: quality rules, exact and near copies, personal data, packing."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from tallyglass.llm import exact_dedup, near_copies, pii, quality_rules
from tallyglass.llm.queries import packed_digest, trusted_ids
from tallyglass.scale import staged

# The session setting that holds the secret key of the pseudonyms.  Without one, a run draws a key of its own: values stay
# linked across its documents, and nobody can turn them back.
KEY_SETTING = "spark.tallyglass.pseudonymKey"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_poor(docs, trusted_ids(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = spark.conf.get(KEY_SETTING, None)
    return pii.pseudonymise(docs, named.encode() if named else secrets.token_bytes(32))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", hide_personal_data),
    ("packing", pack),
]

# Fingerprints, keyed permutations and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
