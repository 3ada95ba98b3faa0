"""SimHash fingerprints of word shingles, computed on Arrow batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
BITS = 64
# Hashes whose bits are counted at a time, so that a very long text needs no more memory than this.
STEP = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, A-Z lower-cased, joined by one blank; one run if there are fewer words.

    ``bytes.lower`` and ``bytes.split`` know exactly A-Z and the blanks U+0020 and U+0009 to U+000D.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    first = np.concatenate(([0], ends[: len(words) - width])).tolist()
    last = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        part = np.ascontiguousarray(hashes[at:at + STEP]).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def with_fingerprint(rows: DataFrame, text: Column, width: int = 3, name: str = "__print") -> DataFrame:
    """``rows`` (some columns that Arrow can carry) with the fingerprint of ``text`` as a long; null texts count as empty."""
    prepared = rows.withColumn(name, text.cast("binary"))

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = [majority(shingle_hashes(t.as_py() or b"", width)) for t in texts]
            columns = [*batch.columns[:-1], pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], name])

    schema = rows.select("*", F.lit(0).cast("bigint").alias(name)).schema
    return prepared.mapInArrow(fingerprints, schema)
