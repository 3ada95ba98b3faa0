"""Order operators against plain loops, with one key holding most rows and partitions cutting through it."""

import random

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import chunking, events, files
from tallyglass.operators.ordered import first_per_key, running_last, running_sum


def skewed(n, seed):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(12)}") for _ in range(n)]


def allowed_by_loop(times, limit, window):
    recent, out = [], []
    for t in times:
        recent = [x for x in recent if x > t - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


@pytest.mark.parametrize("limit,window,spacing", [(1, 10, 1), (3, 40, 7), (5, 1000, 3), (2, 1, 5)])
def test_rate_limit_matches_a_loop(spark, many_partitions, limit, window, spacing):
    rng = random.Random(limit * 31 + window)
    keys, at, rows = skewed(700, limit), 0, []
    for i, k in enumerate(keys):
        at += rng.randrange(spacing)
        rows.append((i, k, at))
    df = spark.createDataFrame(rows, "event_id long, user_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in events.rate_limit(df, limit, window).collect()}
    for key in set(keys):
        mine = [r for r in rows if r[1] == key]
        assert [got[r[0]] for r in mine] == allowed_by_loop([r[2] for r in mine], limit, window)


def test_rate_limit_edge_a_window_old_event_has_left(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 1, 9), (3, 1, 10)], "event_id long, user_id long, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.allowed for r in events.rate_limit(df, 1, 10).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_rate_limit_result_survives_a_union(spark, many_partitions):
    keys = skewed(300, 5)
    df = spark.createDataFrame([(i, k, i) for i, k in enumerate(keys)], "event_id long, user_id string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    out = events.rate_limit(df, 2, 50)
    twice = out.unionByName(out).groupBy("event_id").agg(F.countDistinct("allowed").alias("n"), F.count("*").alias("c"))
    assert twice.where("n <> 1 or c <> 2").count() == 0


def test_file_quota_refused_files_use_nothing(spark, many_partitions):
    rng = random.Random(3)
    keys = skewed(400, 9)
    rows = [(k, i, rng.randrange(1, 60)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "session string, pos long, page_equivalent int")
    got = {r.pos: r.verdict for r in files.file_quota(df, "session", "pos", 8, 150).collect()}
    for key in set(keys):
        count = total = 0
        for _, pos, pages in [r for r in rows if r[0] == key]:
            if count >= 8:
                want = "file limit reached (8 per session)"
            elif total + pages > 150:
                want = "would exceed the 150-page limit for this session"
            else:
                want, count, total = "ready", count + 1, total + pages
            assert got[pos] == want


def test_pack_rows_keeps_every_row_once(spark, many_partitions):
    rng = random.Random(4)
    rows = []
    for file, n in (("hot", 300), ("b", 20), ("c", 1)):
        for i in range(n):
            rows.append((file, i, f"s{i * 3 // n}", i + 2, "x" * rng.randrange(1, 90)))
    df = spark.createDataFrame(rows, "file_id string, unit_pos long, sheet string, row int, text string")
    got = sorted(chunking.pack_rows(df, 200).collect(), key=lambda r: (r.file_id, r.chunk_index))
    want = []
    for file in ("b", "c", "hot"):
        group, used, index = [], 0, 0
        for _, _, sheet, row, text in [r for r in rows if r[0] == file] + [(file, -1, None, -1, "")]:
            if group and (sheet != group[0][0] or used + len(text) > 200):
                body = f"Sheet {group[0][0]}:\n" + "\n".join(g[2] for g in group)
                want.append((file, index, group[0][0], group[0][1], group[-1][1], body))
                group, used, index = [], 0, index + 1
            group.append((sheet, row, text))
            used += len(text) + 1
    assert [tuple(r) for r in got] == want


def packed_by_loop(rows, size):
    """(file, chunk, sheet, first, last, text) of sorted rows (file, place, sheet, row, text)."""
    want, file, sheet, used, group = [], object(), None, 0, []
    for f, _, s, row, text in rows:
        if f != file or s != sheet or used + len(text) > size:
            index = 0 if f != file else index + 1  # noqa: F821
            file, sheet, used, group = f, s, 0, []
            want.append((f, index, s, row, group))
        group.append((row, text))
        used += len(text) + 1
    return [(f, i, s, first, g[-1][0], f"Sheet {s}:\n" + "\n".join(t for _, t in g)) for f, i, s, first, g in want]


@pytest.mark.parametrize("size,parts", [(1, 7), (60, 7), (200, 50), (5000, 50)])
def test_pack_rows_across_many_parts(spark, many_partitions, size, parts):
    """Chunks that span several parts, rows without text, rows longer than a chunk, sheets that end at a border."""
    rng = random.Random(size)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rows = [(f, i, f"s{i * n_sheets // n}", i + 2, "x" * rng.choice([0, 0, 1, 5, 30, 70, 250]))
            for f, n, n_sheets in (("a", 30, 2), ("hot", 900, 3), ("z", 1, 1)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "file_id string, unit_pos long, sheet string, row int, text string")
    got = sorted((tuple(r) for r in chunking.pack_rows(df, size).collect()), key=lambda r: r[:2])
    assert got == packed_by_loop(rows, size)


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    work()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "rest")
    return found


def test_folds_run_a_fixed_number_of_jobs(spark, many_partitions):
    """One key over 7 or 50 parts, whose borders all depend on each other, takes as many jobs."""
    rows = [("hot", i, "s", i, "x" * (3 + i % 7)) for i in range(1500)]
    sheet = spark.createDataFrame(rows, "file_id string, unit_pos long, sheet string, row int, text string")
    listed = sheet.selectExpr("file_id AS session", "unit_pos AS pos", "int(1 + unit_pos % 90) AS page_equivalent")
    counts = {}
    for parts in (7, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        counts[parts] = (jobs_of(spark, f"pack{parts}", lambda: chunking.pack_rows(sheet, 997).collect()),
                         jobs_of(spark, f"quota{parts}", lambda: files.file_quota(listed, "session", "pos", 40, 900).collect()))
    assert counts[7] == counts[50] and max(counts[50]) < 12


@pytest.mark.parametrize("max_files,max_pages", [(0, 10), (3, 0), (5, 1000), (500, 60)])
def test_file_quota_of_odd_files(spark, many_partitions, max_files, max_pages):
    rng = random.Random(max_files)
    rows = [(rng.choice([None, "a", "a", "b"]), i, rng.choice([None, 0, -3, 1, 2, 7, 50, 61, 2000])) for i in range(300)]
    df = spark.createDataFrame(rows, "session string, pos long, page_equivalent int")
    got = {r.pos: (r.session, r.page_equivalent, r.verdict) for r in files.file_quota(df, "session", "pos", max_files, max_pages).collect()}
    state = {}
    for key, pos, pages in rows:
        count, total = state.get(key, (0, 0))
        size = max(pages or 0, 0)
        if count >= max_files:
            want = f"file limit reached ({max_files} per session)"
        elif total + size > max_pages:
            want = f"would exceed the {max_pages}-page limit for this session"
        else:
            want, state[key] = "ready", (count + 1, total + size)
        assert got[pos] == (key, pages, want)


def test_running_sum_and_last(spark, many_partitions):
    rng = random.Random(8)
    keys = skewed(500, 2)
    rows = [(None if k == "k0" else k, i * 10 ** 9, rng.randrange(9), rng.choice([None, f"v{i}"])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, pos long, n int, v string")
    sums = {r.pos: r.s for r in running_sum(df, ["k"], ["pos"], F.col("n"), "s").collect()}
    lasts = {r.pos: r.b for r in running_last(df, ["k"], ["pos"], F.col("v"), "b").collect()}
    seen, last = {}, {}
    for k, pos, n, v in rows:
        assert sums[pos] == seen.get(k, 0)
        assert lasts[pos] == last.get(k)
        seen[k] = seen.get(k, 0) + n
        last[k] = v if v is not None else last.get(k)


def test_units_without_ids_or_with_one_place_keep_their_chunks(spark, many_partitions):
    units = [("f", 0, "aa"), ("f", None, "bb"), ("f", 0, "cc dd"), (None, 1, "ee"), (None, None, "ff"), ("f", 5, None), ("f", 6, " ")]
    cut = chunking.chunk_units(spark.createDataFrame(units, "file_id string, unit_pos long, text string"), "fixed", 3, 0)
    got = sorted(((r.file_id or "", r.chunk_index, r.text) for r in cut.collect()))
    assert got == [("", 0, "ff"), ("", 1, "ee"), ("f", 0, "bb"), ("f", 1, "aa"), ("f", 2, "cc"), ("f", 3, "dd")]
    rows = [(f, p, "s", i, t) for i, (f, p, t) in enumerate(units)]
    packed = chunking.pack_rows(spark.createDataFrame(rows, "file_id string, unit_pos long, sheet string, row int, text string"), 1)
    got = sorted((r.file_id or "", r.chunk_index, r.row_start, r.text[9:]) for r in packed.collect())
    assert got == [("", 0, 4, "ff"), ("", 1, 3, "ee"), ("f", 0, 1, "bb"), ("f", 1, 0, "aa"), ("f", 2, 2, "cc dd"), ("f", 3, 5, ""),
                   ("f", 4, 6, " ")]


def test_first_per_key_beyond_the_map_side_bound(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = first_per_key(df, ["k"], [F.col("v")], 1500)
    assert got.groupBy("k").agg(F.count("*").alias("c"), F.max("v").alias("m")).orderBy("k").collect() == [
        (0, 1500, 2998), (1, 1500, 2999)]


def test_row_number_bound_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = first_per_key(df, ["k"], [F.col("v")], 12)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_daily_quota_zero_is_unlimited_and_failures_do_not_count(spark):
    rows = [(1, 1, "2024-01-01 10:00:00", False), (2, 1, "2024-01-01 11:00:00", True), (3, 1, "2024-01-01 12:00:00", True),
            (4, 1, "2024-01-01 13:00:00", False), (5, 1, "2024-01-02 00:00:00", True)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string, ok boolean").withColumn("ts", F.to_timestamp("t"))
    got = {r.event_id: r.allowed for r in events.daily_quota(df, 2, F.col("ok")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert events.daily_quota(df, 0, F.col("ok")).where("not allowed").count() == 0


def test_session_gap_of_exactly_the_ttl_stays_alive(spark):
    df = spark.createDataFrame([(1, 0), (1, 3600), (1, 7201), (2, 5)], "user_id long, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = sorted((r.user_id, r.session, r.n_events) for r in events.idle_sessions(df).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
