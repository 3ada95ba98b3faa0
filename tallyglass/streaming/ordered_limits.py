"""Sliding-window limits on a stream in the order of event time, whatever the order of arrival.

Events wait in state, by slots of the clock, until the watermark has passed their slot; a timer then settles whole slots in order.
So verdicts equal those of the batch operator however files and micro-batches cut the events, and a hot key is taken
slot by slot: a step holds one slot of one key, not a micro-batch of it.  The price is that a verdict comes ``lateness``
after its event; ``counters.rate_limit_stream`` decides at once, in the order of arrival between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyglass.operators.events import SlidingWindow

# The state store that holds lists, maps and timers.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedLimit(StatefulProcessor):
    """Waiting events by slot (a map), times of the last allowed events (a list), one timer per open slot."""

    def __init__(self, limit: int, window_micros: int, slot_ms: int, key: str, tie: T.StructField):
        self.rule, self.slot_ms, self.key, self.tie = SlidingWindow(limit, window_micros), slot_ms, key, tie
        self.waiting_schema = T.StructType([
            T.StructField("micros", T.ArrayType(T.LongType())), T.StructField("ties", T.ArrayType(tie.dataType))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("slot", T.LongType())]), self.waiting_schema)
        self.recent = handle.getListState("recent", T.StructType([T.StructField("micros", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            # By place: Spark renames columns that are no Python identifiers, or begin with an underscore, on the way here.
            frame = frame.set_axis(["key", "tie", "ts", "micros"], axis=1)
            slots = frame["micros"] // (self.slot_ms * 1000)
            for slot, own in frame.groupby(slots, sort=False):
                slot, ends = int(slot), (int(slot) + 1) * self.slot_ms
                if ends <= watermark:
                    continue  # its slot is settled: too late
                micros, ties = own["micros"].tolist(), own["tie"].tolist()
                if self.waiting.containsKey((slot,)):
                    before = self.waiting.getValue((slot,))
                    micros, ties = [*before[0], *micros], [*before[1], *ties]
                else:
                    self.handle.registerTimer(ends)
                self.waiting.updateValue((slot,), (micros, ties))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms
        recent = tuple(row[0] for row in self.recent.get())
        for slot in sorted(s for (s,) in self.waiting.keys() if s < settled):
            micros, ties = self.waiting.getValue((slot,))
            rows = pd.DataFrame({"_micros": micros, self.tie.name: ties}).sort_values(["_micros", self.tie.name], kind="stable")
            recent, allowed = self.rule.step(recent, {"_micros": rows["_micros"].to_numpy()})
            self.waiting.removeKey((slot,))
            yield pd.DataFrame({self.key: key[0], self.tie.name: rows[self.tie.name].to_numpy(), "allowed": allowed})
        if recent:
            self.recent.put([(t,) for t in recent])

    def close(self) -> None:
        pass


def rate_limit_in_order(events: DataFrame, limit: int, window_seconds: int, key: str = "user_id", ts: str = "ts",
                        tie: str = "event_id", lateness: str = "10 minutes", slot_ms: int = 1000) -> DataFrame:
    """(key, tie, allowed) of a stream, as ``operators.events.rate_limit`` gives for all its events in order of ``ts, tie``.

    An event is out once the watermark has passed its slot of ``slot_ms``; events whose slot is settled when they arrive
    are dropped.  Repeated events count each time, as in the batch operator; events without a time are dropped.  A limit of
    0 or less allows none.  The session must keep its state in RocksDB (``STORE_SETTING``).  The state of a key is its waiting slots and at most ``limit`` times.
    """
    instant = F.col(ts).cast("timestamp")
    timed = events.where(F.col(ts).isNotNull()).withColumn("_ts", instant).withWatermark("_ts", lateness)
    if limit <= 0:
        return timed.select(key, tie, F.lit(False).alias("allowed"))
    timed = timed.select(key, tie, "_ts", F.unix_micros("_ts").alias("_micros"))
    if events.sparkSession.conf.get(STORE_SETTING) != STORE:
        raise ValueError(f"set {STORE_SETTING} to {STORE}: lists, maps and timers need it")
    out = T.StructType([timed.schema[key], timed.schema[tie], T.StructField("allowed", T.BooleanType())])
    rule = OrderedLimit(limit, window_seconds * 1_000_000, slot_ms, key, timed.schema[tie])
    return timed.groupBy(key).transformWithStateInPandas(rule, out, "Append", "EventTime")
