"""Vector expressions on ARRAY columns and the bag-of-words embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED_DIM = 512  # fixed value: width of the hashed bag of words


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    scale = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    # The scale rides along as a one-element array, so it is computed once per row and not per element.
    return F.flatten(F.transform(F.array(scale), lambda s: F.transform(v, lambda x: x.cast("double") / s)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def unit_rows(column: pa.Array | pa.ChunkedArray, count: int) -> np.ndarray:
    """A list column of ``count`` vectors as a matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(count, -1)) if count else np.zeros((0, 0))


def blend_query(question: Column, previous: Column) -> Column:
    """Three quarters of the question, one quarter of the question before; no previous -> unchanged."""
    mixed = F.zip_with(question, previous, lambda q, p: q * 0.75 + p * 0.25)
    return F.when(previous.isNull(), question).otherwise(l2_normalize(mixed))


def word_buckets(text: Column, dim: int = EMBED_DIM) -> Column:
    """Bucket of every word longer than two letters: md5 of the word modulo ``dim`` (a power of two up to 2^32)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    return F.transform(words, lambda w: F.conv(F.right(F.md5(w), F.lit(8)), 16, 10).cast("bigint") % dim)


def _dense(dim: int):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense(buckets: pa.Array) -> pa.Array:
        rows = len(buckets)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(buckets), 0))
        at = np.repeat(np.arange(rows), lengths) * dim + np.asarray(buckets.flatten())
        counts = np.bincount(at, minlength=rows * dim).reshape(rows, dim).astype(float)
        return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * dim, unit(counts).ravel())

    return dense


def hash_embed(text: Column, dim: int = EMBED_DIM) -> Column:
    """Deterministic unit vector per text; narrow, so embedding never shuffles.

    Words are cut and hashed in the JVM; the counts of a whole Arrow batch are made by one numpy call.
    """
    return _dense(dim)(word_buckets(text, dim))
