"""The event counters on a stream: same rules, state kept per key and dropped when it can no longer matter.

A micro-batch's events of one key are put in order before they are applied, so its size is what bounds the
memory of a hot key; limit it at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).  Events later
than the watermark are dropped, which is the stream's own choice: the batch operators know no lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.events import SESSION_TTL_MINUTES, SlidingWindow


def idle_sessions_stream(events: DataFrame, key: str = "user_id", ts: str = "ts",
                         ttl_minutes: int = SESSION_TTL_MINUTES) -> DataFrame:
    """Closed sessions, each emitted once the watermark has passed its end (append mode)."""
    ttl = f"{ttl_minutes} minutes"
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", ttl)
    return timed.groupBy(F.col(key), F.session_window("_ts", ttl).alias("_w")).agg(
        F.max("_ts").alias("last_used"), F.count(F.lit(1)).alias("n_events"),
    ).select(key, F.col("_w.start").alias("session_start"), "last_used", "n_events")


def _timed(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    instant = F.col(ts).cast("timestamp")
    return events.withColumn("_ts", instant).withColumn("_micros", F.unix_micros(instant)).withWatermark("_ts", lateness)


def _ordered(batches: Iterator[pd.DataFrame], tie: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["_micros", tie], kind="stable")


def rate_limit_stream(events: DataFrame, limit: int, window_seconds: int, key: str = "user_id", ts: str = "ts",
                      tie: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """(key, tie, allowed): state = times of the last ``limit`` allowed events, dropped when they all have left."""
    rule = SlidingWindow(limit, window_seconds * 1_000_000)
    timed = _timed(events.select(key, tie, ts), ts, lateness).drop(ts)
    out = T.StructType([timed.schema[key], timed.schema[tie], T.StructField("allowed", T.BooleanType())])

    def apply(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches, tie)
        recent = tuple(state.get[0]) if state.exists else rule.start()
        if limit <= 0:
            yield pd.DataFrame({key: group[0], tie: rows[tie].to_numpy(), "allowed": False})
            return
        recent, allowed = rule.step(recent, {"_micros": rows["_micros"].to_numpy()})
        state.update((list(recent),))
        if recent:
            leaves = recent[-1] // 1000 + window_seconds * 1000 + 1
            state.setTimeoutTimestamp(max(leaves, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], tie: rows[tie].to_numpy(), "allowed": allowed})

    return timed.groupBy(key).applyInPandasWithState(apply, out, "recent array<bigint>", "append", "EventTimeTimeout")


def daily_quota_stream(events: DataFrame, cap: int, success: str, key: str = "user_id", ts: str = "ts",
                       tie: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """(key, day, tie, allowed): state = successes of one key on one UTC day, dropped after the day.

    ``success`` names a boolean column.
    """
    timed = _timed(events.select(key, tie, ts, success), ts, lateness).drop(ts).withColumn("day", F.to_date("_ts"))
    out = T.StructType([
        timed.schema[key], timed.schema["day"], timed.schema[tie], T.StructField("allowed", T.BooleanType())])
    day_ms = 24 * 3600 * 1000

    def apply(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches, tie)
        done = state.get[0] if state.exists else 0
        wins = rows[success].to_numpy(dtype=bool)
        before = done + np.cumsum(wins) - wins
        allowed = np.ones(len(rows), dtype=bool) if cap <= 0 else before < cap
        state.update((int(done + wins.sum()),))
        midnight = int(rows["_micros"].iloc[0]) // 1000 // day_ms * day_ms + day_ms
        state.setTimeoutTimestamp(max(midnight, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], "day": group[1], tie: rows[tie].to_numpy(), "allowed": allowed})

    return timed.groupBy(key, "day").applyInPandasWithState(apply, out, "done bigint", "append", "EventTimeTimeout")
