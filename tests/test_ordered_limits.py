"""Limits in event time on a stream: files out of order, late and repeated events, a hot key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import events as E
from tallyglass.streaming.ordered_limits import STORE, STORE_SETTING, rate_limit_in_order

START = datetime(2024, 5, 1)
SCHEMA = "user_id bigint, event_id bigint, ts timestamp, noise int"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)
    yield
    spark.conf.set(STORE_SETTING, before)


def test_another_store_is_refused(spark, tmp_path):
    spark.conf.set(STORE_SETTING, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match=STORE_SETTING):
        rate_limit_in_order(stream, 1, 1)


def drained(spark, files, tmp_path, name, **options):
    """The verdicts on ``files`` (lists of rows), one file per micro-batch."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/f{i:02d}")
        (tmp_path / "in" / f"f{i:02d}" / "_SUCCESS").unlink(missing_ok=True)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = rate_limit_in_order(stream, **options).writeStream.format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return sorted((r.user_id, r.event_id, r.allowed) for r in spark.table(name).collect())


def at(seconds):
    return START + timedelta(seconds=seconds)


def batch(spark, rows, limit, window):
    want = E.rate_limit(spark.createDataFrame(rows, SCHEMA), limit, window)
    return sorted((r.user_id, r.event_id, r.allowed) for r in want.collect())


def test_any_order_of_arrival_gives_the_verdicts_of_the_batch(spark, tmp_path):
    # A hot key with several events a second beside sparse ones; each file holds a stretch of time, shuffled and overlapping.
    rows = [(1 if i % 4 else 2 + i % 3, i, at(i * 0.3), i) for i in range(400)]
    rows += [(1, 17, at(17 * 0.3), 0), (1, 17, at(17 * 0.3), 0)]  # repeated
    files = [[r for r in rows if (r[1] // 40 + r[1] % 2) == f][::-1] for f in range(11)]
    closing = [(9, 10_000, at(4000), 0)]
    got = drained(spark, [*files, closing, [(9, 10_001, at(9000), 0)]], tmp_path, "ordered", limit=3, window_seconds=5, lateness="60 seconds")
    want = batch(spark, [r for f in files for r in f], 3, 5)
    assert [g for g in got if g[0] != 9] == want
    assert any(g[2] for g in want) and not all(g[2] for g in want)


def test_late_events_are_dropped_and_do_not_count(spark, tmp_path):
    on_time = [(1, i, at(i), 0) for i in range(10)]
    files = [on_time, [(1, 50, at(500), 0)], [(1, 99, at(3), 0), (1, 51, at(501), 0)], [(1, 60, at(2000), 0)], [(1, 61, at(3000), 0)]]
    got = drained(spark, files, tmp_path, "late", limit=2, window_seconds=4, lateness="10 seconds")
    want = batch(spark, on_time + [(1, 50, at(500), 0), (1, 51, at(501), 0)], 2, 4)
    assert [g for g in got if g[1] < 60] == want


@pytest.mark.parametrize("limit", [0, -1])
def test_a_limit_of_none(spark, tmp_path, limit):
    rows = [(1, 1, at(0), 0), (1, 2, None, 0), (-1, 3, at(1), 0)]
    got = drained(spark, [rows], tmp_path, f"none{abs(limit)}", limit=limit, window_seconds=5)
    assert got == [(-1, 3, False), (1, 1, False)]
