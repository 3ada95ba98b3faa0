"""MinHash near-duplicates: SuperMinHash signatures in bands, exact Jaccard of whole shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import whole_text
from tallyglass.llm.fingerprints import shingle_hashes
from tallyglass.llm.similar_sets import similar_roots
from tallyglass.llm.superminhash import band_keys, codes, signatures
from tallyglass.scale import broadcast_if_small, staged

# A pair of Jaccard 0.8 shares one of 32 bands of 5 slots with a chance of 1 - (1 - 0.8 ** 5) ** 32 = 1 - 3e-6; 42 bands of 6
# give the same for a third more bucket rows.  The other slots sharpen the signature alone.
SLOTS, BANDS, DEPTH = 256, 32, 5
# Slots that must agree before sets are compared: 4.5 standard deviations below the share at the wanted similarity.
SIGMAS = 4.5
# Sets whose signatures are made together.
TOGETHER = 64
# Keys of members (three numbers each) that are broadcast at most.
MEMBERS = 1_000_000


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of ``width`` words; of the whole sequence if there are fewer."""
    return np.unique(shingle_hashes(text, width))


def cut_of(percent: int, slots: int = SLOTS) -> int:
    j = percent / 100
    return int(slots * j - SIGMAS * (slots * j * (1 - j)) ** 0.5)


def _text_key(text):
    """128 bits of a text, so that a row can be found again without carrying or numbering texts."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.length(text), F.lit("again"), text).alias("t2")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """``id, t1, t2, size, digest, keys, codes`` of rows ``id, t1, t2, text``."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [shingle_set(t.as_py(), width) for t in part.column(3)]
                signs = signatures(sets, SLOTS)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                keys = [band_keys(row, BANDS, DEPTH).tolist() for row in signs]
                bytes_ = [row.tobytes() for row in codes(signs)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], names)

    names = ["id", "t1", "t2", "size", "digest", "keys", "codes"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"id {kind}, t1 bigint, t2 bigint, size bigint, digest binary, keys array<bigint>, codes binary")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["n", "hashes"])

    return texts.mapInArrow(hashes, "n bigint, hashes binary")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    A document's set holds its distinct runs of ``width`` words (A-Z lower-cased, blanks U+0020 and U+0009 to U+000D), the
    whole sequence if there are fewer.  Two sets are linked when ``100 * intersection >= percent * union``, decided on the
    whole sets of 64-bit hashes.  Documents with equal sets share one node, so a text copied very often costs one
    comparison.  ``component_id`` is the smallest id reachable; ``kept`` tells that it is the row's own.  Null and blank texts
    have an empty set and are linked with nothing.  Null ids keep their rows and are never the smallest; a component of
    null ids alone has a null component and its rows are kept.  Repeated rows repeat in the result.  An empty table
    gives an empty result.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", *_text_key(F.col("text")), F.col("text").cast("binary").alias("text"))
    sketches = staged(_sketches(rows, width).withColumn("n", F.monotonically_increasing_id()), "similar-sketches")
    # One node per distinct set; any of its rows can give the set again.
    filled = sketches.where("size > 0")
    nodes = staged(filled.groupBy("digest").agg(F.min("n").alias("n"), F.min("id").alias("low")), "similar-nodes")
    own = filled.join(nodes.select("n"), "n", "left_semi")
    sketched = staged(own.select("n", "size", "keys", "codes"), "similar-signatures")

    def fetch(members: DataFrame) -> DataFrame:
        wanted = own.join(members, "n", "left_semi").select("n", "id", "t1", "t2")
        wanted = broadcast_if_small(staged(wanted, "similar-members").withColumnRenamed("id", "wanted"), MEMBERS)
        found = rows.join(wanted, ["t1", "t2"]).where(F.col("id").eqNullSafe(F.col("wanted")))
        # Rows repeated with their id give the same set.
        return _sets(found.select("n", "text"), width).dropDuplicates(["n"])

    roots = similar_roots(sketched, fetch, percent, cut_of(percent))
    placed = nodes.join(roots.select(F.col("a").alias("n"), F.col("b").alias("root")), "n", "left")
    placed = placed.select("digest", "low", F.coalesce("root", "n").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    groups = placed.join(lows, "root").select("digest", "component")
    linked = filled.select("id", "size", "digest").join(groups, "digest").select("id", "size", "component")
    every = linked.union(sketches.where("size = 0").select("id", "size", F.col("id").alias("component")))
    return every.select("id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
