"""Line duplicates: a sharded perfect hash over all distinct lines, probed by the documents' line hashes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import BLANK_CHARS, whole_text
from tallyglass.llm.perfect_hash import pack, unpack
from tallyglass.scale import broadcast_if_small, staged

_STRIP = BLANK_CHARS.encode()
NO_ID = -(1 << 63)  # a null id counts as the smallest


def line_key(line: bytes, least: int) -> bytes | None:
    """The 16-byte hash of a line's key; None if the key has fewer than ``least`` code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(docs: DataFrame, least: int) -> DataFrame:
    """``id, high, low`` for every distinct line key of every document."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {k for line in (text.as_py() or b"").split(b"\n") if (k := line_key(line, least))}
                ids.extend([i] * len(own))
                keys.extend(own)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["id", "high", "low"])

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(split, "id bigint, high bigint, low bigint")


def _shards(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its perfect hash with fingerprints, counts and smallest ids."""
    def build(key: tuple, group: pa.Table) -> pa.Table:
        high, low, counts, first = (group.column(c).to_numpy() for c in ("high", "low", "n", "first"))
        order = np.lexsort((low, high))
        high, low, counts, first = high[order], low[order], counts[order], first[order]
        # Lines that agree in the first half of their hash cannot share an index; later ones go to further rows.
        layer = np.arange(len(high)) - np.searchsorted(high, high)
        blobs = []
        for k in range(int(layer.max()) + 1):
            at = layer == k
            blobs.append(pack(high[at].view(np.uint64), low[at].view(np.uint64), counts[at], first[at]))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def _shard(shards: int):
    return F.pmod(F.col("low"), F.lit(shards)).cast("int")


def _salts(hashes: DataFrame, shards: int, even: float) -> DataFrame:
    """``shard, salts`` for the shards that over twice the ``even`` load goes to: how many such parts they need; written once."""
    loads = hashes.groupBy(_shard(shards).alias("shard")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * even)
    return staged(loads.select("shard", F.ceil(F.col("n") / even).cast("int").alias("salts")), "crowded-shards")


def _lost(hashes: DataFrame, index: DataFrame, shards: int, even: float) -> DataFrame:
    """``id, keys``: the keys (16-byte hashes in one binary) whose lines each document loses.

    Hashes travel to their shard; a crowded shard is dealt by document into parts of about the ``even`` load, so that a
    line found in every document is probed by as many tasks as it needs.  The shard's arrays go to each part.  Rows
    stream past the arrays, one batch at a time.
    """
    none, crowded = F.lit(None), broadcast_if_small(_salts(hashes, shards, even))
    salts = F.coalesce("salts", F.lit(1))
    salted = index.join(crowded, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
        "blob", none.cast("bigint").alias("id"), none.cast("bigint").alias("high"), none.cast("bigint").alias("low"))
    probes = hashes.withColumn("shard", _shard(shards)).join(crowded, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"),
        none.cast("binary").alias("blob"), "id", "high", "low")
    dealt = salted.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, []
        for batch in batches:
            shard, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            place = shard.astype(np.int64) << 32 | salt
            ids, high, low = (pc.fill_null(batch.column(i), 0).to_numpy() for i in (4, 5, 6))
            out = []
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] == 0) | (kind[1:] != kind[:-1])) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if place[a] != at:
                    at, arrays = place[a], []
                if kind[a] == 0:
                    arrays.append(unpack(batch.column(3)[a].as_py()))
                    continue
                h, v = high[a:b].view(np.uint64), low[a:b].view(np.uint64)
                drop = np.zeros(b - a, bool)
                for index_, prints, counts, first in arrays:
                    n = index_.number(h)
                    hit = np.flatnonzero(n >= 0)
                    hit = hit[prints[n[hit]] == v[hit]]
                    drop[hit] |= (counts[n[hit]] >= 2) & (first[n[hit]] != ids[a:b][hit])
                out.append(np.flatnonzero(drop) + a)
            rows = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (ids, high, low)], names=["id", "high", "low"])

    dropped = dealt.mapInArrow(probe, "id bigint, high bigint, low bigint")
    return dropped.groupBy("id").agg(F.collect_set(F.struct("high", "low")).alias("keys"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10,
               part_rows: int = 1 << 20, shard_lines: int = 1 << 16) -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_dropped``.

    Texts are split at ``\\n``; a null or empty text is one empty line.  A line's key is the line without blanks at
    both ends, A-Z lower-cased.  Keys of at least ``least`` code points that at least two documents hold lose all
    their lines except in the smallest id; all other lines stay, joined by ``\\n``.  A text may become empty.  Rows that
    repeat an id are one document; a null id counts as the smallest and rows with it as one document.

    The lines' 128-bit hashes are counted map-side.  All distinct ones fill shards of at most about ``shard_lines`` lines: a
    minimal perfect hash over one half of the hash indexes arrays of the other half (the fingerprint), of counts and
    of smallest ids (25 bytes a line).  Documents send their hashes, never their lines, past the arrays, where count and smallest id
    decide; there are enough shards for an even load of at most ``part_rows`` hashes.
    """
    held = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), F.col(id_col).alias("own_id"),
                       whole_text(text_col).alias("text"))
    hashes = staged(_hashes(held, least), "line-hashes")
    counted = hashes.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    total = max(1, hashes.count())
    shards = 1 << max(6, math.ceil(math.log2(total / min(shard_lines, part_rows))))
    lost = _lost(hashes, _shards(counted, shards), shards, total / shards)
    joined = held.join(lost, "id", "left").select(F.col("own_id"), F.col("text").cast("binary"), "keys")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, keys in zip(batch.column(1), batch.column(2)):
                lines = (text.as_py() or b"").split(b"\n")
                keys = keys.as_py()
                kept = lines
                if keys:
                    out = {np.array([k["high"], k["low"]], np.int64).tobytes() for k in keys}
                    kept = [line for line in lines if line_key(line, least) not in out]
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(drop, "doc_id bigint, text string, n_lines bigint, n_dropped bigint")
