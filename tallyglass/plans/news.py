"""Headlines, sentiment and price movement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import dates, text
from tallyglass.operators import news_report as N
from tallyglass.operators import prices as P
from tallyglass.operators import sentiment as S
from tallyglass.plans.base import (
    FETCHED_SQL, HEADLINES_SQL, MARKET_SQL, POLARITY_SQL, PRICES_SQL, TODAY, TOKENS_SQL, _boost, _is_up, _neg, query,
)
from tallyglass.scale import durable
from tallyglass.sources import readers

# ---------------------------------------------------------------- prices


@query("ist_date", """
SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date,
  CAST(date_trunc('second', ts) + INTERVAL 330 MINUTE AS DATE) AS date_of_seconds,
  CAST(date_trunc('second', ts) + INTERVAL 330 MINUTE AS DATE) AS date_of_text FROM events""")
def _(t):
    ts = F.col("ts")
    seconds = F.unix_timestamp(ts)
    written = F.when(F.col("event_type") == "view", F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return t.events.select(
        "event_id", dates.ist_date(ts).alias("date"), dates.ist_date_of_seconds(seconds).alias("date_of_seconds"),
        dates.ist_date(dates.parse_published(written)).alias("date_of_text"),
    )


@query("add_days", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate AS DATE) - 7 AS earlier FROM orders""")
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.add_days(day, 30).alias("later"), dates.add_days(day, -7).alias("earlier"))


@query("daily_close", f"WITH {PRICES_SQL} SELECT * FROM prices")
def _(t):
    return t.prices()


@query("next_close", f"""WITH {PRICES_SQL}
SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next_close FROM prices""")
def _(t):
    return P.next_close(t.prices())


@query("price_on_or_after", f"""WITH {MARKET_SQL}
SELECT h.symbol, h.date, p.date AS price_date, p.close FROM hdates h ASOF JOIN prices p
ON h.symbol = p.symbol AND h.date <= p.date""")
def _(t):
    return P.price_on_or_after(t.headline_dates(), t.prices(weekends=False))


_RETURNS = f"""{MARKET_SQL},
series AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next_close FROM prices),
returns AS (SELECT h.symbol, h.date, p.date AS price_date, p.close, p.next_close,
  (p.next_close - p.close) / p.close * 100 AS next_day_pct
  FROM hdates h ASOF JOIN series p ON h.symbol = p.symbol AND h.date <= p.date WHERE p.next_close IS NOT NULL)"""


@query("next_day_return", f"WITH {_RETURNS} SELECT * REPLACE (round(next_day_pct, 6) AS next_day_pct) FROM returns")
def _(t):
    returns = P.next_day_return(t.headline_dates(), t.prices(weekends=False))
    return returns.withColumn("next_day_pct", F.round("next_day_pct", 6))


@query("next_day_avg", f"""WITH {_RETURNS} SELECT symbol, round(avg(next_day_pct), 6) AS next_day_avg_pct,
count(next_day_pct) AS next_day_sample_size FROM returns GROUP BY 1""")
def _(t):
    out = P.next_day_avg(P.next_day_return(t.headline_dates(), t.prices(weekends=False)))
    return out.withColumn("next_day_avg_pct", F.round("next_day_avg_pct", 6))


@query("horizon_move", f"""WITH {PRICES_SQL},
ends AS (SELECT symbol, arg_min(close, date) FILTER (date >= DATE '2024-01-01') AS first_close,
  arg_max(close, date) AS last_close FROM prices GROUP BY 1)
SELECT *, round(CASE WHEN first_close <> 0 AND last_close <> 0 THEN (last_close - first_close) / first_close * 100 END, 6)
  AS movement_pct FROM ends""")
def _(t):
    return P.horizon_move(t.prices(), TODAY, 30).withColumn("movement_pct", F.round("movement_pct", 6))


@query("horizon_filter", """
SELECT event_id, event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, d AS days
FROM events, (VALUES (7), (14), (30)) v(d) WHERE CAST(ts + INTERVAL 330 MINUTE AS DATE) >= DATE '2024-01-31' - d""")
def _(t):
    dated = t.events.select("event_id", "event_type", dates.ist_date(F.col("ts")).alias("date"))
    parts = [P.horizon_filter(dated, TODAY, d).withColumn("days", F.lit(d)) for d in (7, 14, 30)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("union_dates", f"WITH {PRICES_SQL} SELECT DISTINCT date FROM prices")
def _(t):
    return P.union_dates(t.prices())


# Users as series: most have no event on some day, so the grid has gaps.
_USER_POINTS_SQL = """
points AS (SELECT user_id AS symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, arg_max(value, event_id) AS close
  FROM events GROUP BY 1, 2),
dates AS (SELECT DISTINCT date FROM points), names AS (SELECT DISTINCT symbol FROM points),
grid AS (SELECT n.symbol, d.date, p.close FROM names n CROSS JOIN dates d
  LEFT JOIN points p ON p.symbol = n.symbol AND p.date = d.date)"""


def _user_points(t):
    return P.daily_close(t.events.select(
        F.col("user_id").alias("symbol"), dates.ist_date(F.col("ts")).alias("date"), F.col("value").alias("close"),
        F.col("event_id").alias("pos")))


@query("align_series", f"WITH {_USER_POINTS_SQL} SELECT * FROM grid")
def _(t):
    return P.align_series(_user_points(t))


@query("rebase_pct", f"""WITH {_USER_POINTS_SQL}
SELECT symbol, date, close, round((close - f) / f * 100, 6) AS pct FROM (
  SELECT *, first(close) OVER (PARTITION BY symbol ORDER BY date) AS f, count(*) OVER (PARTITION BY symbol) AS n
  FROM points) WHERE n >= 2""")
def _(t):
    return P.rebase_pct(_user_points(t)).withColumn("pct", F.round("pct", 6))


@query("last_point", f"""WITH {_USER_POINTS_SQL}
SELECT symbol, max(date) AS last_date, arg_max(close, date) AS last_value FROM grid WHERE close IS NOT NULL GROUP BY 1""")
def _(t):
    return P.last_point(_user_points(t))


@query("line_segments", f"""WITH {_USER_POINTS_SQL}
SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS points FROM (
  SELECT *, count(*) FILTER (close IS NULL) OVER (PARTITION BY symbol ORDER BY date) AS gap FROM grid)
WHERE close IS NOT NULL GROUP BY symbol, gap""")
def _(t):
    return P.line_segments(_user_points(t))


@query("series_extent", f"""WITH {PRICES_SQL},
e AS (SELECT min(close) AS low, max(close) AS high FROM prices),
s AS (SELECT *, CASE WHEN high <> low THEN high - low WHEN high * 0.01 <> 0 THEN high * 0.01 ELSE 1 END AS span FROM e),
c AS (SELECT least(min(close), 0) AS low, greatest(max(close), 0) AS high FROM prices)
SELECT 'price' AS chart, low, high, round(low - span * 0.1, 6) AS axis_min, round(high + span * 0.1, 6) AS axis_max FROM s
UNION ALL SELECT 'comparison', low, high, round(low - (high - low) * 0.15, 6), round(high + (high - low) * 0.15, 6) FROM c""")
def _(t):
    prices = t.prices()
    both = [
        P.series_extent(prices, comparison=c).select(
            F.lit(name).alias("chart"), "low", "high", F.round("axis_min", 6).alias("axis_min"),
            F.round("axis_max", 6).alias("axis_max"))
        for name, c in (("price", False), ("comparison", True))
    ]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- tokens and rules


@query("strip_punct_token", f"WITH {TOKENS_SQL} SELECT token, count(*) AS n FROM tk GROUP BY 1")
def _(t):
    return S.token_rows(t.documents).select("token").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"))


@query("first_occurrence", f"WITH {TOKENS_SQL} SELECT doc_id, token, min(pos)::INT AS first_pos, count(*) AS n FROM tk GROUP BY 1, 2")
def _(t):
    return S.first_occurrences(t.documents)


@query("token_context", f"""WITH {TOKENS_SQL}
SELECT doc_id, pos::INT AS pos, token, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2, lag(token, 3) OVER w AS p3,
  lead(token, 1) OVER w AS n1, lead(token, 2) OVER w AS n2 FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def _(t):
    rows = S.token_table(t.documents).where(F.col("token").isNotNull())
    return rows.select("doc_id", "pos", "token", "p1", "p2", "p3", "n1", "n2")


@query("but_position", f"""WITH {POLARITY_SQL} SELECT doc_id, but_pos::INT AS but_pos, n::INT AS n_tokens FROM stat""")
def _(t):
    words = t.documents.select("doc_id", S.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", S.but_position(F.col("w")).alias("but_pos"), F.size("w").alias("n_tokens"))


@query("is_upper", f"""WITH {TOKENS_SQL} SELECT token, bool_and({_is_up('token')}) AS upper FROM tk GROUP BY 1""")
def _(t):
    words = S.token_rows(t.documents).select("token").distinct()
    return words.select("token", S.is_upper(F.col("token")).alias("upper"))


@query("cap_diff", f"WITH {POLARITY_SQL} SELECT doc_id, ups > 0 AND ups < n AS caps FROM stat")
def _(t):
    words = t.documents.select("doc_id", S.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", S.cap_diff(F.col("w")).alias("caps"))


@query("negated", f"""WITH {TOKENS_SQL} SELECT token, {_neg('token')} AS negated FROM (SELECT DISTINCT token FROM tk)""")
def _(t):
    words = S.token_rows(t.documents).select("token").distinct()
    return words.select("token", S.negated(F.col("token")).alias("negated"))


@query("booster_scalar", f"""WITH {TOKENS_SQL} SELECT token, v, {_boost('token')} AS scalar
FROM (SELECT DISTINCT token, true AS caps FROM tk) CROSS JOIN (VALUES (1.5::DOUBLE), (-1.5::DOUBLE)) x(v)""")
def _(t):
    words = S.token_rows(t.documents).select("token").distinct()
    both = words.select("token", F.explode(F.array(F.lit(1.5), F.lit(-1.5))).alias("v"))
    return both.withColumn("scalar", S.booster_scalar(F.col("token"), F.col("v"), F.lit(True)))


@query("punct_emphasis", f"WITH {POLARITY_SQL} SELECT doc_id, round(e, 6) AS emphasis FROM emph")
def _(t):
    return t.documents.select("doc_id", F.round(S.punct_emphasis(F.col("text")), 6).alias("emphasis"))


@query("normalize_score", "SELECT event_id, round(value / sqrt(value * value + 15), 6) AS score FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.normalize_score(F.col("value")), 6).alias("score"))


@query("js_round", """SELECT event_id, floor((value - 100) / 7 * 1000.0::DOUBLE + 0.5) / 1000 AS r3,
floor((value - 100) / 7 * 10000.0::DOUBLE + 0.5) / 10000 AS r4 FROM events""")
def _(t):
    x = (F.col("value") - 100) / 7
    return t.events.select("event_id", text.half_up(x, 3).alias("r3"), text.half_up(x, 4).alias("r4"))


@query("lexicon_lookup", f"""WITH {TOKENS_SQL}
SELECT t.doc_id, count(*) AS n, count(l.valence) AS scored, round(sum(l.valence), 6) AS total
FROM tk t LEFT JOIN lex l ON l.token = lower(t.token) GROUP BY 1""")
def _(t):
    found = S.valence_sums(t.documents, durable(t.lexicon()))
    return found.withColumn("total", F.round("total", 6))


@query("merge_lexicons", f"""WITH {TOKENS_SQL},
fin AS (SELECT DISTINCT lower(p_name) AS token, (p_partkey % 9 - 4)::DOUBLE AS v, p_partkey FROM part
  UNION ALL SELECT token, 3.0, -1 FROM lex WHERE valence > 2),
f AS (SELECT token, arg_min(v, p_partkey) AS v FROM fin GROUP BY 1)
SELECT coalesce(l.token, f.token) AS token, round(coalesce(f.v * 0.1, l.valence), 6) AS valence
FROM lex l FULL JOIN f ON f.token = l.token""")
def _(t):
    base = durable(t.lexicon())
    named = t.part.select(
        F.lower("p_name").alias("token"), (F.col("p_partkey") % 9 - 4).cast("double").alias("v"), "p_partkey")
    shared = base.where("valence > 2").select("token", F.lit(3.0).alias("v"), F.lit(-1).alias("p_partkey"))
    finance = named.unionByName(shared).groupBy("token").agg(F.min_by("v", "p_partkey").alias("valence"))
    return S.merge_lexicons(base, finance).withColumn("valence", F.round("valence", 6))


@query("sentence_sums", f"""WITH {POLARITY_SQL} SELECT doc_id, n_tokens, round(emphasis, 4) AS emphasis,
round(total, 4) + 0.0 AS total, round(pos_sum, 4) AS pos_sum, round(neg_sum, 4) + 0.0 AS neg_sum,
CASE WHEN n_tokens = 0 THEN 0 ELSE neu_count END AS neu_count FROM sums""")
def _(t):
    sums = S.sentence_sums(S.token_valences(t.documents, durable(t.lexicon())))
    return sums.select("doc_id", "n_tokens", "neu_count",
                       *[(F.round(c, 4) + 0.0).alias(c) for c in ("emphasis", "total", "pos_sum", "neg_sum")])


@query("polarity_scores", f"WITH {POLARITY_SQL} SELECT * FROM polarity")
def _(t):
    return t.scores()


@query("tone", f"""WITH {POLARITY_SQL} SELECT doc_id, CASE WHEN compound >= 0.05 THEN 'positive'
WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS tone,
CASE WHEN compound >= 0.5 THEN 'Strongly Positive' WHEN compound >= 0.05 THEN 'Positive'
WHEN compound <= -0.5 THEN 'Strongly Negative' WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label
FROM polarity""")
def _(t):
    c = F.col("compound")
    return t.scores().select("doc_id", text.tone(c).alias("tone"), text.sentiment_label(c).alias("label"))


@query("sentiment_label", """SELECT event_id, CASE WHEN s >= 0.5 THEN 'Strongly Positive' WHEN s >= 0.05 THEN 'Positive'
WHEN s <= -0.5 THEN 'Strongly Negative' WHEN s <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label
FROM (SELECT event_id, (value - 20) / 20 AS s FROM events)""")
def _(t):
    return t.events.select("event_id", text.sentiment_label((F.col("value") - 20) / 20).alias("label"))


# ---------------------------------------------------------------- headline roll-ups


@query("headlines_sorted", f"""WITH {HEADLINES_SQL} SELECT symbol, pos, date, doc_id, score FROM headlines
ORDER BY date DESC, pos""")
def _(t):
    rows = t.headlines().select("symbol", "pos", "date", "doc_id", "score")
    return rows.orderBy(F.col("date").desc(), "pos")


@query("daily_sentiment", f"""WITH {HEADLINES_SQL}
SELECT symbol, date, round(avg(score), 10) + 0.0 AS avg_score, count(*) AS n_headlines FROM headlines GROUP BY 1, 2""")
def _(t):
    return P.daily_sentiment(t.headlines()).withColumn("avg_score", F.round("avg_score", 10) + 0.0)


@query("net_sentiment", f"""WITH {HEADLINES_SQL},
d AS (SELECT symbol, date, avg(score) AS s, count(*) AS n FROM headlines GROUP BY 1, 2)
SELECT symbol, round(avg(s), 10) + 0.0 AS net_sentiment, CAST(sum(n) AS BIGINT) AS headline_count, count(*) AS date_count
FROM d GROUP BY 1""")
def _(t):
    out = P.net_sentiment(P.daily_sentiment(t.headlines()))
    return out.withColumn("net_sentiment", F.round("net_sentiment", 10) + 0.0)


@query("headline_count", "SELECT event_type AS symbol, count(*) AS headline_count FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("headline_count"))


@query("date_count", """SELECT event_type AS symbol, count(DISTINCT CAST(ts + INTERVAL 330 MINUTE AS DATE)) AS date_count
FROM events GROUP BY 1""")
def _(t):
    dated = t.events.select(F.col("event_type").alias("symbol"), dates.ist_date(F.col("ts")).alias("date"))
    return dated.groupBy("symbol").agg(F.countDistinct("date").alias("date_count"))


_SUMS_SQL = """
recent AS (SELECT symbol, date, avg(score) AS s, count(*) AS n FROM headlines WHERE date >= DATE '2024-01-17' GROUP BY 1, 2),
net AS (SELECT symbol, avg(s) AS net_sentiment, sum(n) AS hc, count(*) AS dc FROM recent GROUP BY 1),
series AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS next_close FROM prices),
ret AS (SELECT h.symbol, (p.next_close - p.close) / p.close * 100 AS r FROM recent h ASOF JOIN series p
  ON h.symbol = p.symbol AND h.date <= p.date WHERE p.next_close IS NOT NULL),
nd AS (SELECT symbol, avg(r) AS a, count(r) AS k FROM ret GROUP BY 1),
mv AS (SELECT symbol, arg_min(close, date) FILTER (date >= DATE '2024-01-17') AS f, arg_max(close, date) AS l
  FROM prices GROUP BY 1),
listed AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT r_name FROM region),
summary AS (SELECT y.symbol, coalesce(CAST(net.hc AS BIGINT), 0) AS headline_count,
  round(net.net_sentiment, 10) + 0.0 AS net_sentiment,
  round(CASE WHEN mv.f <> 0 AND mv.l <> 0 THEN (mv.l - mv.f) / mv.f * 100 END, 6) AS movement_pct,
  round(nd.a, 6) AS next_day_avg_pct, coalesce(nd.k, 0) AS next_day_sample_size, coalesce(net.dc, 0) AS date_count
  FROM listed y LEFT JOIN net ON net.symbol = y.symbol
  LEFT JOIN mv ON mv.symbol = y.symbol LEFT JOIN nd ON nd.symbol = y.symbol)"""
_SUMMARY_SQL = f"{HEADLINES_SQL}, {MARKET_SQL}, {_SUMS_SQL}"


# Regions are symbols without news or prices, some because a side could not be fetched: their rows must survive.
_FAILED_SQL = """failed AS (SELECT y.*, coalesce(r_regionkey % 2 = 0, false) AS news_error,
  coalesce(r_regionkey % 3 = 0, false) AS price_error FROM summary y LEFT JOIN region ON r_name = y.symbol)"""


def _summary(t):
    failed = t.region.select(
        F.col("r_name").alias("symbol"), (F.col("r_regionkey") % 2 == 0).alias("news_error"),
        (F.col("r_regionkey") % 3 == 0).alias("price_error"))
    listed = t.symbols().unionByName(t.region.select(F.col("r_name").alias("symbol")))
    return _in_places(P.stock_summary(listed, t.headlines(), t.prices(weekends=False), TODAY, 14, failed))


def _in_places(summary):
    return summary.withColumns({
        "net_sentiment": F.round("net_sentiment", 10) + 0.0, "movement_pct": F.round("movement_pct", 6),
        "next_day_avg_pct": F.round("next_day_avg_pct", 6)})


@query("stock_summary", f"WITH {_SUMMARY_SQL}, {_FAILED_SQL} SELECT * FROM failed")
def _(t):
    return _summary(t)


_NOTES_SQL = """SELECT *, concat_ws(' ',
CASE WHEN news_error THEN symbol || ': couldn''t fetch news right now.'
  WHEN headline_count = 0 THEN symbol || ': no headlines found within the last 14 days.'
  WHEN next_day_sample_size < date_count
  THEN symbol || ': next-day figure only covers dates with a following trading day so far.' END,
CASE WHEN price_error THEN symbol || ': price data is unavailable right now.'
  WHEN NOT news_error AND movement_pct IS NULL THEN symbol || ': no trading data found within the last 14 days.' END) AS notes
FROM failed"""


@query("status_notes", f"WITH {_SUMMARY_SQL}, {_FAILED_SQL} {_NOTES_SQL}")
def _(t):
    return P.status_notes(_summary(t), 14, F.col("news_error"), F.col("price_error"))


# ---------------------------------------------------------------- feeds

# A feed title per event: type and user as words, some entities, a source behind the last dash.
_TITLE_SQL = """titled AS (SELECT event_id, event_type, user_id,
  event_type || ' &amp; user - ' || user_id || CASE WHEN value > 10 THEN ' - Desk ' || (user_id % 7) ELSE '' END AS raw,
  CASE WHEN value > 40 THEN 'Wire ' || (user_id % 3) ELSE '' END AS tag,
  'https://www.host' || (user_id % 5) || '.example.com/a?id=' || event_id AS link FROM events)"""


def _titles(t):
    user = F.col("user_id")
    part = lambda c, n: (c % n).cast("string")
    return t.events.select(
        "event_id", "event_type", "user_id",
        F.concat("event_type", F.lit(" &amp; user - "), user.cast("string"), F.when(
            F.col("value") > 10, F.concat(F.lit(" - Desk "), part(user, 7))).otherwise("")).alias("raw"),
        F.when(F.col("value") > 40, F.concat(F.lit("Wire "), part(user, 3))).otherwise("").alias("tag"),
        F.concat(F.lit("https://www.host"), part(user, 5), F.lit(".example.com/a?id="),
                 F.col("event_id").cast("string")).alias("link"),
    )


@query("strip_source", f"""WITH {_TITLE_SQL} SELECT event_id, trim(regexp_extract(raw, '^(.*) - (.*)$', 1)) AS title,
trim(regexp_extract(raw, '^(.*) - (.*)$', 2)) AS source FROM titled""")
def _(t):
    title, source = text.strip_source(F.col("raw"))
    return _titles(t).select("event_id", title.alias("title"), source.alias("source"))


@query("strip_source_xml", f"""WITH {_TITLE_SQL} SELECT event_id,
CASE WHEN tag <> '' THEN raw ELSE regexp_extract(raw, '^(.*) - (.*)$', 1) END AS title,
CASE WHEN tag <> '' THEN tag ELSE regexp_extract(raw, '^(.*) - (.*)$', 2) END AS source FROM titled""")
def _(t):
    title, source = text.strip_source_tagged(F.col("raw"), F.col("tag"))
    return _titles(t).select("event_id", title.alias("title"), source.alias("source"))


@query("host_of_link", """SELECT page_id, coalesce(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', ''), '')
AS host FROM pages""")
def _(t):
    return t.pages.select("page_id", text.host_of_link(F.col("url")).alias("host"))


@query("source_fallback", f"""WITH {_TITLE_SQL} SELECT event_id, CASE WHEN tag <> '' THEN tag
WHEN event_type IN ('view', 'click') THEN 'host' || (user_id % 5) || '.example.com'
ELSE regexp_extract(raw, '^(.*) - (.*)$', 2) END AS source FROM titled""")
def _(t):
    _, parsed = text.strip_source(F.col("raw"))
    parsed = F.when(F.col("event_type").isin("view", "click"), "").otherwise(parsed)
    return _titles(t).select("event_id", text.source_fallback(F.col("tag"), parsed, F.col("link")).alias("source"))


@query("decode_entities", f"""WITH {_TITLE_SQL} SELECT event_id, replace(raw, '&amp;', '&') AS title FROM titled""")
def _(t):
    return _titles(t).select("event_id", text.decode_entities(F.col("raw")).alias("title"))


@query("feed_top12", """SELECT user_id, event_id, event_type, rn::INT AS n FROM (SELECT *, row_number() OVER
(PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 12""")
def _(t):
    from tallyglass.operators.ordered import first_per_key

    items = t.events.select("user_id", "event_id", "event_type")
    return first_per_key(items, ["user_id"], [F.col("event_id")], readers.FEED_ITEMS)


@query("read_feed_json", f"""WITH {_TITLE_SQL}, ranked AS (
  SELECT *, 'user' || user_id || '-' || (event_id // 500) AS feed,
    row_number() OVER (PARTITION BY user_id, event_id // 500 ORDER BY event_id) - 1 AS k FROM titled)
SELECT feed, k::INT AS pos, replace(regexp_extract(raw, '^(.*) - (.*)$', 1), '&amp;', '&') AS title,
  CASE WHEN tag <> '' THEN tag ELSE regexp_extract(raw, '^(.*) - (.*)$', 2) END AS source, link,
  NULL::VARCHAR AS error FROM ranked WHERE k < 12 AND user_id % 10 <> 3
UNION ALL SELECT DISTINCT feed, NULL, NULL, NULL, NULL, 'quota' FROM ranked WHERE user_id % 10 = 3""")
def _(t):
    # One landed feed per user and five hundred events; the feeds of every tenth user answer with an error.
    user = F.col("user_id")
    page = F.floor(F.col("event_id") / 500)
    item = F.struct("event_id", F.struct(F.col("raw").alias("title"), F.col("tag").alias("author"), "link",
                                  F.lit("2024-01-05 10:00:00").alias("pubDate")).alias("i"))
    feeds = _titles(t).groupBy("user_id", page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    ok = user % 10 != 3
    document = F.to_json(F.struct(
        F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, "quota").alias("message"), "items"))
    landed = feeds.select(F.concat(F.lit("user"), user.cast("string"), F.lit("-"), F.col("page").cast("string")).alias("feed"), document.alias("value"))
    return readers.parse_feed_json(landed).drop("pub_date")


def _payloads(prices):
    """A payload per symbol: parallel arrays behind a line of preamble; at most one point per calendar day."""
    point = F.struct("date", F.unix_timestamp(F.col("date").cast("timestamp")).alias("s"), "close")
    series = prices.groupBy("symbol").agg(F.array_sort(F.collect_list(point)).alias("p"))
    quote = F.array(F.struct(F.transform("p", lambda x: x["close"]).alias("close")))
    result = F.struct(
        F.transform("p", lambda x: x["s"] + 3600).alias("timestamp"),
        F.struct(quote.alias("quote")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return series.select("symbol", F.concat(F.lit("Title: quotes\n\n"), body).alias("value"))


@query("read_price_payload", f"""WITH {PRICES_SQL}
SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1)::INT AS pos, date, close, NULL::VARCHAR AS error
FROM prices""")
def _(t):
    return readers.parse_price_payload(_payloads(t.prices()))


@query("unwrap_json_preamble", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL
ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    wrapped = F.when(F.col("event_id") % 4 == 0, "no payload").otherwise(F.concat(F.lit("Markdown: "), F.col("props")))
    body = readers.unwrap_json_preamble(wrapped)
    return t.events.select("event_id", F.from_json(body, "k bigint")["k"].alias("k"))


# ---------------------------------------------------------------- from feeds to scored headlines and the report

# A landed feed per conversation, for the symbol of the event of its number: a turn is an item, the role its source.  Some
# feeds fail, for one symbol all of them; the payload of another cannot be read.
_FEEDS_SQL = f"""landed AS (SELECT c.*, e.event_type AS symbol, e.event_type || '/' || conv_id AS feed,
    CAST(date_trunc('second', e.ts) + turn * INTERVAL 1 HOUR + INTERVAL 330 MINUTE AS DATE) AS date,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
  FROM conversations c JOIN events e ON e.event_id = conv_id WHERE conv_id % 10 <> 3 AND e.event_type <> 'signup'),
items AS (SELECT feed || '#' || place AS doc_id, * FROM landed WHERE place < 12),
documents AS (SELECT doc_id, coalesce(text, '') AS text FROM items),
{POLARITY_SQL},
headlines AS (SELECT symbol, feed, place::INT AS pos, date, p.compound AS score FROM items JOIN polarity p USING (doc_id))"""


def _feed_items(t):
    talks = t.conversations.join(t.events.select(F.col("event_id").alias("conv_id"), "event_type", "ts"), "conv_id")
    at = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("turn"))
    stamp = F.when(F.col("conv_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    title = F.concat(F.coalesce("text", F.lit("")), F.lit(" - "), "role")
    item = F.struct("turn", F.struct(title.alias("title"), stamp.alias("pubDate")).alias("i"))
    feeds = talks.groupBy("conv_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    ok = (F.col("conv_id") % 10 != 3) & (F.col("event_type") != "signup")
    document = F.to_json(F.struct(F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, "quota").alias("message"), "items"))
    named = F.concat("event_type", F.lit("/"), F.col("conv_id").cast("string"))
    return readers.parse_feed_json(feeds.select(named.alias("feed"), document.alias("value"))).withColumn(
        "symbol", F.substring_index("feed", "/", 1))


def _feed_lexicon(t, items):
    return durable(t.lexicon(items.where("error IS NULL").select(F.col("title").alias("text"))))


@query("feed_headlines", f"""WITH {_FEEDS_SQL} SELECT *, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative'
ELSE 'neutral' END AS tone FROM headlines WHERE date >= DATE '2024-01-17'""")
def _(t):
    items = _feed_items(t)
    return N.scored_headlines(items, _feed_lexicon(t, items), TODAY, 14).select("symbol", "feed", "pos", "date", "score", "tone")


@query("feed_report", f"""WITH {_FEEDS_SQL}, {FETCHED_SQL}, {_SUMS_SQL},
failed AS (SELECT *, symbol NOT IN (SELECT symbol FROM headlines) AS news_error, symbol NOT IN (SELECT symbol FROM prices) AS price_error
  FROM summary) {_NOTES_SQL}""")
def _(t):
    items = _feed_items(t)
    landed = _payloads(t.prices(weekends=False)).withColumn("value", F.when(F.col("symbol") != "error", F.col("value")).otherwise("busy"))
    listed = t.symbols().unionByName(t.region.select(F.col("r_name").alias("symbol")))
    return _in_places(N.feed_report(listed, items, readers.parse_price_payload(landed), _feed_lexicon(t, items), TODAY, 14))
