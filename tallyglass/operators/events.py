"""Time-based counters over an event table: sessions, daily quotas, sliding-window limits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.ordered import Fold, first_per_key, fold_ordered

# Minutes of inactivity that end a session.
SESSION_TTL_MINUTES = 60


def idle_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts",
                  ttl_minutes: int = SESSION_TTL_MINUTES) -> DataFrame:
    """Sessions end after more than the TTL without an event; a gap of exactly the TTL keeps them alive.

    Events of one key within one TTL-wide slot always share a session, so slots are merged map-side first
    and the window per key walks over slots of the clock, however many events they held.
    """
    ttl = ttl_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = (
        events.groupBy(F.col(key), F.floor(micros / ttl).alias("_slot"))
        .agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n"))
    )
    order = Window.partitionBy(key).orderBy("_slot")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("_first") - F.lag("_last").over(order) <= ttl, 0).otherwise(1)
    numbered = slots.withColumn("_open", opened).withColumn("session", F.sum("_open").over(running))
    return numbered.groupBy(key, "session").agg(
        F.timestamp_micros(F.min("_first")).alias("session_start"),
        F.timestamp_micros(F.max("_last")).alias("last_used"),
        F.sum("_n").alias("n_events"),
    )


def daily_quota(events: DataFrame, cap: int, success: Column, key: str = "user_id", ts: str = "ts",
                tie: str = "event_id") -> DataFrame:
    """Allowed while fewer than ``cap`` successes came earlier on the same UTC day; cap 0 allows all.

    Only the cap-th success of a day matters: it is found by a bounded ranking that runs map-side, and every
    event is compared with it.  No day is ever sorted as a whole.
    """
    if cap <= 0:
        return events.withColumn("allowed", F.lit(True))
    # ``success`` marks what would succeed if tried; refused tries are not counted, and the first cap
    # successes are exactly those not refused.
    day = F.to_date(F.col(ts))
    dated = events.withColumn("_day", day)
    done = dated.where(success).select(key, "_day", ts, tie)
    last = (
        first_per_key(done, [key, "_day"], [F.col(ts), F.col(tie)], cap, "_n").where(F.col("_n") == cap)
        .select(key, "_day", F.col(ts).alias("_ts"), F.col(tie).alias("_tie"))
    )
    before = (F.col(ts) < F.col("_ts")) | ((F.col(ts) == F.col("_ts")) & (F.col(tie) <= F.col("_tie")))
    return dated.join(last, [key, "_day"], "left").withColumn(
        "allowed", F.col("_ts").isNull() | before
    ).drop("_day", "_ts", "_tie")


class SlidingWindow(Fold):
    """Times of the last ``limit`` allowed events; blocked stretches are skipped by binary search."""

    def __init__(self, limit: int, window_micros: int):
        self.limit, self.window = limit, window_micros

    def start(self):
        return ()

    def step(self, state, rows):
        times = rows["_micros"]
        recent = list(state)
        allowed = np.zeros(len(times), dtype=bool)
        i = 0
        while i < len(times):
            if len(recent) >= self.limit:
                opens = recent[-self.limit] + self.window
                if times[i] < opens:
                    i = int(np.searchsorted(times, opens, side="left"))
                    continue
            allowed[i] = True
            recent.append(int(times[i]))
            if len(recent) > self.limit:
                recent.pop(0)
            i += 1
        return tuple(recent), allowed


def rate_limit(events: DataFrame, limit: int, window_seconds: int, key: str = "user_id", ts: str = "ts",
               tie: str = "event_id") -> DataFrame:
    """(key, ts, tie, allowed): allow an event iff fewer than ``limit`` allowed ones lie in the last
    ``window_seconds``.  Denied events do not count; one exactly a window old has left.

    Only the ordering columns are staged; join the verdict to the events by ``tie`` where more is wanted.
    """
    if limit <= 0:
        return events.select(key, ts, tie, F.lit(False).alias("allowed"))
    timed = events.select(key, ts, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"))
    rule = SlidingWindow(limit, window_seconds * 1_000_000)
    return fold_ordered(timed, [key], ["_micros", tie], rule, "allowed", T.BooleanType()).drop("_micros")
