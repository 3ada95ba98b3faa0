"""From feed items and price points to scored headlines and annotated rows, on small tables worked out by hand."""

import datetime as dt

import pytest

from tallyglass.operators import news_report as N
from tallyglass.operators import sentiment

ITEMS = "symbol string, feed string, pos int, title string, source string, link string, pub_date string, error string"
POINTS = "symbol string, pos int, date date, close double, error string"


def day(n):
    return dt.date(2024, 1, n)


def item(symbol, pos, title, published, feed="f"):
    return (symbol, feed, pos, title, "s", "#", published, None)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 2.0), ("bad", -2.5)], "token string, valence double")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([
        item("A", 0, "a good day", "2024-01-24 20:00:00"),                   # the 25th in the exchange's zone
        item("A", 1, "a bad day", "Thu, 25 Jan 2024 01:00:00 GMT"),
        item("A", 2, "a good day", "2024-01-26 10:00:00", "g"),              # a repeated title
        item("A", 3, "a good day", "2024-01-02 10:00:00"),                   # before the horizon
        item("A", 4, "a bad day", "soon"),                                    # no date
        item("B", 0, None, "2024-01-25 01:00:00"),
        ("B", "g", None, None, None, None, None, "quota"),                    # another feed of B answered
        ("C", "f", None, None, None, None, None, "quota"),
    ], ITEMS)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(
        [("A", 0, day(25), 100.0, None), ("A", 1, day(26), 110.0, None), ("A", 2, day(29), 99.0, None),
         ("B", None, None, None, "Empty price series"), ("C", 0, day(25), 5.0, None), ("C", 1, day(26), 6.0, None)], POINTS)


def test_headlines_of_the_horizon_get_date_score_and_tone(spark, items, lexicon):
    got = {(r.symbol, r.pos): (r.date, r.score, r.tone) for r in N.scored_headlines(items, lexicon, "2024-01-31", 14).collect()}
    plain = spark.createDataFrame([(1, "a good day"), (2, "a bad day")], "doc_id long, text string")
    good, bad = (r.compound for r in sentiment.polarity_scores(plain, lexicon).orderBy("doc_id").collect())
    assert good > 0.05 and bad < -0.05
    assert got == {("A", 0): (day(25), good, "positive"), ("A", 1): (day(25), bad, "negative"),
                   ("A", 2): (day(26), good, "positive"), ("B", 0): (day(25), 0.0, "neutral")}


def test_a_failed_side_leaves_the_other_and_is_named(spark, items, points, lexicon):
    symbols = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("A",)], "symbol string")
    rows = {r.symbol: r for r in N.feed_report(symbols, items, points, lexicon, "2024-01-31", 14).collect()}
    assert {s: (r.news_error, r.price_error) for s, r in rows.items()} == {
        "A": (False, False), "B": (False, True), "C": (True, False), "D": (True, True)}
    a, c = rows["A"], rows["C"]
    assert (a.headline_count, a.date_count, a.next_day_sample_size) == (3, 2, 2) and a.notes == ""
    assert a.movement_pct == pytest.approx(-1.0) and a.next_day_avg_pct == pytest.approx((10 - 10) / 2)
    assert (c.headline_count, c.net_sentiment) == (0, None) and c.movement_pct == pytest.approx(20)
    assert c.notes == "C: couldn't fetch news right now." and rows["B"].notes.endswith("price data is unavailable right now.")


def test_report_of_empty_tables(spark, items, points, lexicon):
    symbols = spark.createDataFrame([("A",)], "symbol string")
    row, = N.feed_report(symbols, items.limit(0), points.limit(0), lexicon, "2024-01-31", 14).collect()
    assert row.news_error and row.price_error and row.headline_count == 0 and row.movement_pct is None
    assert N.feed_report(symbols.limit(0), items, points, lexicon, "2024-01-31", 14).count() == 0


def test_report_plans_no_pair_join(spark, items, points, lexicon):
    symbols = items.select("symbol")
    plan = N.feed_report(symbols, items, points, lexicon, "2024-01-31", 14)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
