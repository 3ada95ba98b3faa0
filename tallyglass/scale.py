"""Helpers that keep plans safe when a side, a key or a lineage grows with the data."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when a count that stops at this many rows proves it is smaller.
BROADCAST_ROWS = 200_000
# Scans of this many splits are not spread over more cores.
SPREAD_SPLITS = 64


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast when the side is proven small, else leave the join to Catalyst and AQE.

    The check reads at most ``max_rows + 1`` rows, of ``counted`` where the side itself is derived from it row by
    row.  Past the bound the same join runs as a shuffled join, where AQE splits skewed partitions, so the
    result never depends on the check.
    """
    return F.broadcast(df) if is_small(df if counted is None else counted, max_rows) else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count that stops at ``max_rows`` proves that the table is no larger."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(scan: DataFrame, *ids: str) -> DataFrame:
    """Give every core a share of a scan too small to be split by file size; a larger scan stays as it lies.

    Spread by row id, so the layout is the same whenever a task is run again.  A scan of ``SPREAD_SPLITS`` splits (8 GB
    at the usual split size) is never shuffled for this, however many cores there are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *ids) if scan.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS) else scan


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session of one process (tests) gets a folder of its own; a cluster must name one, since
    its executors do not share the driver's disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyglass-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, so later passes see the very same partitions."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a costly intermediate once as a table in the shared folder and go on from there, column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_by_id(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id no other row has, and those that share theirs; None where there are none.

    Only ids are counted in a shuffle.  Null counts as an id like any other.
    """
    ids = df.groupBy(F.col(id_col).alias("_shared")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_shared")
    ids = durable(ids)
    if ids.isEmpty():
        return df, None
    ids, same = broadcast_if_small(ids), F.col(id_col).eqNullSafe(F.col("_shared"))
    return df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")


def only_if(df: DataFrame, problem: DataFrame) -> DataFrame:
    """Return ``df``, or fail when the one-row ``problem(message)`` frame carries a message.

    The check is a scalar subquery of the same plan, so nothing is pulled to the driver.
    """
    message = problem.select("message").scalar()
    guard = F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return df.where(guard)
