"""Order-dependent work that stays parallel when one key holds a large share of the rows.

* ``first_per_key``: a row-number bound, which Spark applies map-side before its shuffle.
* ``running_sum`` / ``running_last``: prefixes within range partitions, and over one row per partition and key.
* ``fold_ordered``: a state carried along the order, over range partitions that may cut through a key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.scale import durable

# Spark applies a row-number bound before the shuffle only up to this many rows per key (its default setting).
MAP_SIDE_BOUND = 1000
SALTS = 64


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "n") -> DataFrame:
    """Number the first ``n`` rows of each key; Spark keeps only ``n`` per key and task before the shuffle.

    A larger ``n`` is first bounded within salted parts of each key, so a hot key never sorts in one task.
    """
    if n > MAP_SIDE_BOUND:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= n).drop("_salt", "_part")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def _in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Rows range-partitioned by (keys, order), with ``_value`` and the partition's number ``_part``.

    Partitions follow the ranks of the rows and not the values of the order columns, so a hot key is cut into even
    parts however sparse its places are.  The checkpoint keeps the parts the same for all later readings.
    """
    laid = df.withColumn("_value", value).repartitionByRange(*keys, *order)
    return durable(laid.withColumn("_part", F.spark_partition_id()))


def _carried(parts: DataFrame, keys: Sequence[str], order: Sequence[str], reduced: Column, gather) -> DataFrame:
    """``parts`` with ``_offset``, from the key's earlier parts, and ``_inside``, from earlier rows of the same part.

    The window over a key's parts sees one row per part.  Null keys form a key of their own.
    """
    reductions = parts.groupBy(*keys, "_part").agg(reduced.alias("_reduced"))
    over_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = reductions.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"),
        gather("_reduced").over(over_parts).alias("_offset"))
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    in_part = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(offsets, same).drop("_at", *[f"_key{i}" for i in range(len(keys))])
    return joined.withColumn("_inside", gather("_value").over(in_part))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key, the row itself excluded; null values count as nothing.

    ``df`` is written once to the shared folder: give it no more columns than the result needs.
    """
    carried = _carried(_in_parts(df, keys, order, value), keys, order, F.sum("_value"), F.sum)
    total = F.coalesce("_offset", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return carried.withColumn(name, total).drop("_part", "_value", "_offset", "_inside")


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Last non-null ``value`` among the earlier rows of the key; written once, as in ``running_sum``."""
    def last(column: str) -> Column:
        return F.last(column, ignorenulls=True)

    places = F.when(F.col("_value").isNotNull(), F.struct(*order))
    carried = _carried(_in_parts(df, keys, order, value), keys, order, F.max_by("_value", places), last)
    return carried.withColumn(name, F.coalesce("_inside", "_offset")).drop("_part", "_value", "_offset", "_inside")


class Fold:
    """A rule that walks the rows of one key in order, carrying a small state.

    ``start`` is the state before a key's first row.  ``step`` gets the state and the columns of a run of
    rows of one key and returns the new state and one output value per row.  A state for which ``final``
    holds never changes again.
    """

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, rows: dict[str, np.ndarray]) -> tuple[Any, np.ndarray]:
        raise NotImplementedError

    def final(self, state: Any) -> bool:
        return False


def _cuts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Places where a sorted batch changes its key, the start included."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[:1] = True
    for key in keys:
        column, null = pdf[key].to_numpy(), pdf[key].isna().to_numpy()
        changed[1:] |= (column[1:] != column[:-1]) & ~(null[1:] & null[:-1])
    return np.flatnonzero(changed)


def _key_at(pdf: pd.DataFrame, keys: Sequence[str], row: int) -> tuple:
    """The key of a row; null is a key like any other and equals itself."""
    values = (pdf[k].iloc[row] for k in keys)
    return tuple(None if pd.isna(v) else v for v in values)


def _runs(pdf: pd.DataFrame, keys: Sequence[str], last_only: bool = False) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Cut a sorted batch into runs of one key."""
    columns = {name: pdf[name].to_numpy() for name in pdf.columns}
    cuts = [*_cuts(pdf, keys), len(pdf)]
    if last_only:
        cuts = cuts[-2:]
    for begin, end in zip(cuts, cuts[1:]):
        yield _key_at(pdf, keys, begin), {n: c[begin:end] for n, c in columns.items()}


def fold_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
                 name: str, output: T.DataType) -> DataFrame:
    """Add column ``name`` computed by ``fold`` along ``order`` within ``keys``.

    Rows are range-partitioned on (keys, order), so a hot key spans many balanced tasks instead of
    filling one.  Each task first reports the state in which its last key leaves it; the states that
    cross a boundary (one per partition) are chained until they agree with what the next task assumed,
    and a last pass writes the rows.  Only partitions filled by one key can need a second look, and
    every round settles at least one more of them, so the result is exact.
    """
    staged = durable(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
    )
    edges = _edges(staged, keys, fold, {}, None)
    assumed: dict[int, tuple] = {}
    before = None
    while True:
        wanted = _carry(edges, fold)
        stale = [
            p for p, carry in sorted(wanted.items())
            if edges[p]["single"] and assumed.get(p) != carry and not fold.final(carry[1])
        ]
        if not stale:
            break
        # The first stale partition of a key has its true state.  The later ones are tried as well while
        # states keep agreeing early; once each round settles only one, the rest would be tried in vain.
        first = list({edges[p]["first"]: p for p in reversed(stale)}.values())
        again = stale if before is None or before - len(stale) > len(first) else first
        before = len(stale)
        tried = {p: wanted[p] for p in again}
        edges.update(_edges(staged, keys, fold, tried, again))
        assumed.update(tried)
    schema = T.StructType([*staged.schema.fields, T.StructField(name, output)])
    states = wanted

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            if current is None and int(pdf["_pid"].iloc[0]) in states:
                current, state = states[int(pdf["_pid"].iloc[0])]
            outputs = []
            for key, rows in _runs(pdf, keys):
                if key != current:
                    current, state = key, fold.start()
                state, values = fold.step(state, rows)
                outputs.append(values)
            pdf[name] = np.concatenate(outputs)
            yield pdf

    return staged.mapInPandas(write, schema).drop("_pid")


def _edges(staged: DataFrame, keys: Sequence[str], fold: Fold, carried: dict, only: list[int] | None) -> dict:
    """First key, last key and leaving state of every partition, or of some: one small row each."""
    states = dict(carried)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, current, state, pid = None, None, None, -1
        for pdf in batches:
            if not len(pdf):
                continue
            pid = int(pdf["_pid"].iloc[0])
            if first is None and pid in states:
                current, state = states[pid]
            first = first or _key_at(pdf, keys, 0)
            # Only the last key leaves the partition, and it can only reach back to the previous batch
            # when the whole batch is one run.
            key, rows = next(_runs(pdf, keys, last_only=True))
            if key != current:
                current, state = key, fold.start()
            state, _ = fold.step(state, rows)
        if first is not None:
            yield pd.DataFrame({"pid": [pid], "edge": [pickle.dumps((first, current, state))]})

    reports = staged.mapInPandas(report, "pid int, edge binary")
    if only is None:
        found = reports.collect()
    else:
        # Read nothing but the partitions asked for; a filter would still open all of them.
        found = staged.sparkSession.sparkContext.runJob(reports.rdd, list, only)
    edges = {}
    for row in found:
        first, last, state = pickle.loads(bytes(row["edge"]))
        edges[row["pid"]] = {"first": first, "last": last, "state": state, "single": first == last}
    return edges


def _carry(edges: dict, fold: Fold) -> dict[int, tuple]:
    """State entering each partition whose first key began in an earlier one."""
    carry, last, state = {}, None, None
    for pid in sorted(edges):
        edge = edges[pid]
        if last is not None and edge["first"] == last:
            carry[pid] = (last, state)
            if edge["single"] and fold.final(state):
                edge["state"] = state
        last, state = edge["last"], edge["state"]
    return carry
