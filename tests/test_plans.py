"""The plans that must hold at scale: what is pushed down, what combines before a shuffle, what never appears."""

import os
import subprocess
import sys

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tallyglass.operators import chunking, events, files, prices, sheets
from tallyglass.plans import load

QUERIES, _ = load()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "polarity_scores", "stock_summary", "search", "vector_topk", "mmr_topk", "similarity_join", "resolve_sheet", "align_series",
    "suggest_symbols", "find_symbol", "archive_entries", "chunk_recursive", "daily_quota", "cite_sources", "build_prompts"])
def test_no_pair_joins(spark, key):
    plan = plan_of(QUERIES[key](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_two_columns(tables):
    plan = plan_of(sheets.sheet_aggregate(tables.sheet(), "l_returnflag", ["l_quantity"], "sum"))
    scan = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert scan.count(":") == 5 and "l_quantity" in scan and "l_comment" not in scan


def test_aggregates_combine_map_side(tables):
    plan = plan_of(prices.daily_close(tables.price_points()))
    assert "partial_max_by" in plan and "SortAggregate" not in plan


def test_bounded_rankings_run_before_the_shuffle(tables):
    quota = plan_of(events.daily_quota(tables.events, 5, F.col("event_type") != "error"))
    assert "WindowGroupLimit" in quota
    orders = tables.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"))
    assert "WindowGroupLimit" in plan_of(files.file_limit(orders, "k", "pos", 5))


def test_sessions_window_over_slots_not_events(tables):
    plan = plan_of(events.idle_sessions(tables.events))
    assert plan.index("Window") < plan.rindex("partial_min")


def test_workers_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from tallyglass.session import local_session\n"
        "from tallyglass.plans import load\n"
        f"s = local_session(2); q = load()[0]; print(q['rate_limit'](s, {SMALL!r}).count(), q['html_sections'](s, {SMALL!r}).count())"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and int(done.stdout.split()[0]) == 1000, done.stderr[-500:]


@pytest.mark.parametrize("strategy", ["fixed", "by_page", "recursive", "by_paragraph"])
def test_chunking_reads_its_texts_once(tables, strategy):
    """The texts are cut while they are written; what follows reads the written pieces."""
    chunks = chunking.chunk_units(tables.units(), strategy, 300, 60)
    assert not [f for f in chunks.inputFiles() if "documents" in f]


def test_segments_and_last_points_make_no_grid(tables):
    points = tables.price_points()
    for df in (prices.line_segments(points), prices.last_point(points)):
        assert "explode" not in plan_of(df)


def test_files_without_a_key_share_the_limit(spark):
    rows = [(None, 1), (None, 2), (None, 3), ("a", 1)]
    got = files.file_limit(spark.createDataFrame(rows, "k string, pos long"), "k", "pos", 2).collect()
    assert sorted((r.k or "", r.pos) for r in got if r.reason is None) == [("", 1), ("", 2), ("a", 1)] and len(got) == 4
