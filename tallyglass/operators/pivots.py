"""Blocks of vectors that queries can reach: rows lie by their nearest pivot, and angles rule out the blocks beyond.

Angles between unit vectors obey the triangle inequality: a query at angle ``a`` from a pivot meets no vector within ``r`` of
that pivot at an angle below ``a - r``, and all of them within ``a + r``.  The first bound is held against the threshold, the
second against the k-th best score that the query is sure to find.  Nothing is approximate, and the choice of pivots decides
the work alone.  A zero vector counts as a right angle from everything, and both bounds hold for its score of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.vectors import unit_rows
from tallyglass.scale import staged

PIVOTS = 64     # pivots, and so cells on either side; their pairs are a table of at most 4096 rows
MARGIN = 1e-6   # well above the rounding of cosines and angles


def pivot_rows(vectors: DataFrame, id_col: str, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors of the ``count`` rows with the least hashes of their ids; all rows where there are fewer."""
    few = vectors.select(F.xxhash64(id_col).alias("_h"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = few.orderBy("_h").limit(count).toArrow()
    return unit_rows(chosen.column("embedding"), chosen.num_rows)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def by_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``_cell``, the number of the nearest pivot, and ``_angle``, the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    names = [*rows.columns, "_cell", "_angle"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(unit_rows(batch.column("embedding"), batch.num_rows), shared.value)
            cell = angles.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(angles[np.arange(len(cell)), cell])], names=names)

    fields = [T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())]
    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, *fields]))


def reached(angles: np.ndarray, radii: np.ndarray, counts: np.ndarray, threshold: float, k: int | None) -> np.ndarray:
    """Which cells (columns) each query (rows) may find a wanted vector in, by its angles to their pivots."""
    at_best = np.cos(np.maximum(angles - radii, 0))
    wanted = at_best >= threshold - MARGIN
    if k is not None and counts.sum() >= k:
        at_worst = np.cos(np.minimum(angles + radii, np.pi))
        order = np.argsort(-at_worst, axis=1)
        enough = (np.cumsum(counts[order], axis=1) >= k).argmax(axis=1)
        every = np.arange(len(angles))
        wanted &= at_best >= at_worst[every, order[every, enough]][:, None] - MARGIN
    return wanted


def meeting_blocks(vectors: DataFrame, queries: DataFrame, id_col: str, query_col: str, threshold: float, k: int | None,
                   block_rows: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides laid out so that equal values of the returned columns bring each reachable pair together exactly once.

    Vectors are cut by cell and, within it, by a hash of their id into blocks of about ``block_rows``; the queries that reach
    a cell are cut likewise by their own nearest pivot.  Only blocks with a query that reaches them are copied.
    """
    chosen = pivot_rows(vectors, id_col, pivots)
    placed = staged(by_pivot(vectors, chosen), "placed-vectors")
    # At most one row a pivot.
    cells = sorted(placed.groupBy("_cell").agg(F.count(F.lit(1)), F.max("_angle")).collect())
    numbers, counts, radii = (np.array([c[i] for c in cells], t) for i, t in enumerate((np.int32, np.int64, np.float64)))
    shared = vectors.sparkSession.sparkContext.broadcast((chosen, numbers, counts, radii))
    near = by_pivot(queries, chosen) if cells else queries.withColumns({"_cell": F.lit(0), "_angle": F.lit(0.0)})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, numbers, counts, radii = shared.value
        for batch in batches:
            if not len(numbers):
                continue
            angles = _angles(unit_rows(batch.column("embedding"), batch.num_rows), chosen)[:, numbers]
            found = [numbers[row] for row in reached(angles, radii, counts, threshold, k)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=["embedding", query_col, "_own", "_cells"])

    near = near.select("embedding", query_col, F.col("_cell").alias("_own"))
    asked = near.mapInArrow(reach, T.StructType([*near.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))]))
    asked = staged(asked, "placed-queries").withColumn("_cell", F.explode("_cells")).drop("_cells")
    # At most a row for each pair of pivots.
    blocks = {int(n): -(-int(c) // block_rows) for n, c in zip(numbers, counts)}
    met = [(r["_cell"], r["_own"], blocks[r["_cell"]], -(-r["count"] // block_rows))
           for r in asked.groupBy("_cell", "_own").count().collect()]
    meets = F.broadcast(vectors.sparkSession.createDataFrame(met, "_cell int, _own int, _n_v int, _n_q int"))

    def part(column: str, blocks: str):
        return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")

    def all_parts(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = placed.join(meets, "_cell").withColumn("_part", part(id_col, "_n_v")).withColumn("_own_part", all_parts("_n_q"))
    right = asked.join(meets, ["_cell", "_own"]).withColumn("_own_part", part(query_col, "_n_q")).withColumn("_part", all_parts("_n_v"))
    keys = ["_cell", "_part", "_own", "_own_part"]
    return left.select(id_col, "embedding", *keys), right.select(query_col, "embedding", *keys), keys
