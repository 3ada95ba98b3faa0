"""Whitening of embeddings: exact integer moments from Spark, eigenvectors refined on the driver, projection in tasks.

Entries become whole numbers first, so counts, sums and products are exact whatever the order in which tasks
deliver them: the covariance is centred without rounding and is the same after a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.eigen import LONG, eigenvectors
from tallyglass.scale import staged

STEP = 64
# Entries whose whole number exceeds this count as not finite: beyond it neighbours cannot be told apart.
LARGEST = 1 << 52
# Products of limbs of 20 bits, summed over so many rows, are exact in doubles.
LIMB, ROWS = 20, 1 << 12
WIDTHS = (1, 2, 4, 8)


@dataclass(frozen=True)
class Whitening:
    """What is learnt from the distinct vectors: their number, sums, principal directions and shares of the variance."""

    step: int
    count: int
    sums: list[int]
    directions: np.ndarray  # one column per component, already divided by the standard deviation
    explained: np.ndarray
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def lattice(column: pa.ListArray, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, whole numbers)`` per length of the usable vectors of a column of doubles: ``floor(step * entry)``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)  # a null entry reads as NaN
    starts = column.offsets.to_numpy()[:-1]
    found = []
    for length in np.unique(lengths[there]):
        if length == 0:
            continue
        rows = np.flatnonzero(there & (lengths == length))
        entries = np.floor(values[starts[rows][:, None] + np.arange(length)] * float(step))
        good = (np.abs(entries) <= LARGEST).all(axis=1)
        found.append((rows[good], entries[good].astype(np.int64)))
    return found


def pack_vector(row: np.ndarray) -> bytes:
    """Equal vectors and only they have equal bytes: the smallest width that holds all entries, then the entries."""
    size = int(max(row.max(), -row.min() - 1))
    width = next(w for w in WIDTHS if size < 1 << (8 * w - 1))
    return bytes([width]) + row.astype(f"<i{width}").tobytes()


def unpack_vectors(keys: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in keys.to_pylist()])


def distinct_vectors(rows: DataFrame, vector_col: str, step: int = STEP) -> DataFrame:
    """The written fit list: each distinct whole-number vector once, as ``key, dimension``, of the commonest dimension.

    Duplicates go inside the tasks first, so a vector that fills a third of the table leaves each task once.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, sizes = [], []
            for _, whole in lattice(batch.column(0), step):
                once = {pack_vector(row) for row in whole}
                packed.extend(once)
                sizes.extend([whole.shape[1]] * len(once))
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], ["key", "dimension"])

    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    every = staged(vectors.mapInArrow(keys, "key binary, dimension int").distinct(), "whitening-keys")
    common = every.groupBy("dimension").count().orderBy(F.desc("count"), F.desc("dimension")).first()
    return every.where(F.col("dimension") == (common.dimension if common else 0))


def _totals(fit: DataFrame, work, schema: str, keys: list[str]) -> DataFrame:
    """Sum what ``work(matrix)`` yields per task over all tasks: one row per key and task is shuffled."""
    names = [*keys, "value"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = work(unpack_vectors(batch.column(0).slice(at, ROWS)))
                total = part if total is None else total + part
        if total is not None:
            places = np.indices(total.shape).reshape(len(keys), -1)
            kind = pa.decimal128(38, 0) if total.dtype == object else pa.float64()
            value = [int(v) for v in total.ravel()] if total.dtype == object else total.ravel()
            columns = [*(pa.array(p, pa.int32()) for p in places), pa.array(value, kind)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return fit.select("key").mapInArrow(task, schema).groupBy(*keys).agg(F.sum("value").alias("value"))


def exact_sums(whole: np.ndarray) -> np.ndarray:
    """Column sums and, last, the number of rows, as Python numbers."""
    high, low = whole >> 26, whole & ((1 << 26) - 1)
    sums = high.sum(axis=0).astype(object) * (1 << 26) + low.sum(axis=0).astype(object)
    return np.append(sums, len(whole))


def exact_products(whole: np.ndarray) -> np.ndarray:
    """``whole.T @ whole`` as Python numbers: products of short limbs in doubles, at most ``ROWS`` rows at once."""
    limbs = [whole]
    while np.abs(limbs[-1]).max(initial=0) >= 1 << LIMB:
        limbs[-1:] = [limbs[-1] & ((1 << LIMB) - 1), limbs[-1] >> LIMB]
    floats = [limb.astype(np.float64) for limb in limbs]
    total = np.zeros((whole.shape[1],) * 2, object)
    for i, a in enumerate(floats):
        for j, b in enumerate(floats):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def long_ratio(top: int, bottom: int) -> np.longdouble:
    """``top / bottom`` with the 64 bits of a long double."""
    if top == 0:
        return LONG(0)
    shift = 66 - abs(top).bit_length() + bottom.bit_length()
    q = (abs(top) << shift) // bottom if shift >= 0 else abs(top) // (bottom << -shift)
    value = np.ldexp(LONG(q >> 32), 32) + LONG(q & 0xFFFFFFFF)
    return np.copysign(np.ldexp(value, -shift), LONG(top))


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Number, column sums and covariance (divisor ``n``, long doubles) of the fit list.

    Vectors are centred on the whole number next to the mean before they are multiplied, and what is left of the mean is
    taken out of the exact sums of products.
    """
    sums = {r.i: int(r.value) for r in _totals(fit, exact_sums, "i int, value decimal(38,0)", ["i"]).collect()}
    if not sums:
        return 0, [], np.zeros((0, 0), LONG)
    d = len(sums) - 1
    n, sums = sums[d], [sums[i] for i in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    shift = np.array(middle, np.int64)
    found = _totals(fit, lambda w: exact_products(w - shift), "i int, j int, value decimal(38,0)", ["i", "j"]).where("i <= j")
    rest = [s - n * m for s, m in zip(sums, middle)]
    v = np.zeros((d, d), LONG)
    for r in found.collect():
        v[r.i, r.j] = v[r.j, r.i] = long_ratio(n * int(r.value) - rest[r.i] * rest[r.j], n * n)
    return n, sums, v


def _project(whole: np.ndarray, n: int, sums: list[int], directions: np.ndarray) -> np.ndarray:
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    return ((whole - np.array(middle, np.int64)) - rest) @ directions


def _deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum of ``(n * x - S) ** 2``; null where it does not fit a long."""
    s = np.array(sums, np.float64)
    if (np.abs(whole).max(initial=0) + 1.0) * n < 2.0 ** 61 and ((n * whole.astype(np.float64) - s) ** 2).sum(axis=1).max(initial=0) < 2.0 ** 62:
        apart = n * whole - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * x - t) ** 2 for x, t in zip(row, sums)) for row in whole.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def fit_whitening(rows: DataFrame, vector_col: str = "embedding", components: int = 16, step: int = STEP) -> Whitening:
    """Learn from each distinct vector once.

    Null vectors, vectors with a null or non-finite entry (or one beyond ``LARGEST`` steps), empty vectors and vectors of
    another than the commonest dimension are left out.  The driver holds the moments, whose size is the square of the
    dimension and does not grow with the rows.  Components without variance (eigenvalue at most dimension x 2**-52 of the
    largest) have no direction and are left out; one distinct vector or none gives no component.
    """
    fit = distinct_vectors(rows, vector_col, step)
    n, sums, v = covariance(fit)
    values, vectors = eigenvectors(v)
    real = int((values > (values[0] if len(values) else 0) * len(values) * 2.0 ** -52).sum())
    k = min(components, real)
    directions = (vectors[:, :k] / np.sqrt(values[:k])).astype(np.float64)
    explained = (values[:k] / np.trace(v)).astype(np.float64) if k else np.zeros(0)
    error = 0.0
    if k:
        def moments(whole: np.ndarray) -> np.ndarray:
            # The column of ones beside the projections gives their sums along with their products.
            z = np.column_stack((_project(whole, n, sums, directions), np.ones(len(whole))))
            return z.T @ z

        total = np.zeros((k + 1, k + 1))
        for r in _totals(fit, moments, "i int, j int, value double", ["i", "j"]).collect():
            total[r.i, r.j] = r.value
        mean = total[:k, k] / n
        error = float(np.abs(total[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return Whitening(step, n, sums, directions, explained, error)


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row per usable vector and component from 1.

    ``deviation`` is the sum over dimensions of ``(n * x - S) ** 2``, null beyond a long.  Repeated rows and null ids
    keep their rows; other columns of ``rows`` are not looked at.
    """
    k = len(model.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, whole in lattice(batch.column(1), model.step):
                if whole.shape[1] != model.dimension or not k or not len(places):
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(places, k)))
                white = _project(whole, model.count, model.sums, model.directions)
                deviation = _deviations(whole, model.count, model.sums)
                m = len(places)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.count)),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))], names)

    taken = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(project, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
                                     "identity_error double")
