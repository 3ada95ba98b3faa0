"""Registry of named queries and the roles the shared test tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.dates import ist_date
from tallyglass.functions.text import JS_BLANK
from tallyglass.operators import prices as price_ops
from tallyglass.operators import sentiment
from tallyglass.scale import durable, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TODAY = "2024-01-31"

# Tables whose rows cost real work (whole texts), with the column that tells their rows apart.
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and the SQL that must give the same rows."""
    def register(fn: Callable[["Tables"], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Tables:
    """The parquet tables of one scale, and the roles built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        # Days and instants are read in UTC, whatever the machine's own zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table, *TEXT_TABLES[name]) if name in TEXT_TABLES else table

    def price_points(self, weekends: bool = True) -> DataFrame:
        """symbol = event type, day = IST date, close = value, payload order = event id.

        Without weekends the days have gaps, as markets do: what looks for the next day with a price needs some.
        """
        day = ist_date(F.col("ts"))
        points = self.events.select(
            F.col("event_type").alias("symbol"), day.alias("date"), F.col("value").alias("close"),
            F.col("event_id").alias("pos"),
        )
        return points if weekends else points.where(~F.dayofweek("date").isin(1, 7))

    def prices(self, weekends: bool = True) -> DataFrame:
        return price_ops.daily_close(self.price_points(weekends))

    def symbols(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("symbol")).distinct()

    def lexicon(self, texts: DataFrame | None = None) -> DataFrame:
        """Lower-case words of the documents, or other texts(text); the last byte of a word's md5 says whether it carries a
        valence (a quarter of the words do) and which one.
        """
        words = sentiment.token_rows(self.documents if texts is None else texts)
        byte = F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("int")
        return (
            words.select(F.lower("token").alias("token")).distinct().withColumn("b", byte).where(F.col("b") >= 192)
            .select("token", ((F.col("b") % 33 - 16) / 4.0).alias("valence"))
        )

    def scores(self) -> DataFrame:
        """Polarity of every document."""
        return sentiment.polarity_scores(self.documents, durable(self.lexicon()))

    def headlines(self) -> DataFrame:
        """One headline per event: symbol = event type, text = the document the event id points at."""
        n = self.documents.agg(F.count(F.lit(1))).scalar()
        linked = self.events.select(
            F.col("event_type").alias("symbol"), F.col("event_id").alias("pos"), F.col("ts").alias("pub_ts"),
            ist_date(F.col("ts")).alias("date"), (F.col("event_id") % n).alias("doc_id"),
        )
        # Scored once, however often a plan reads the headlines.
        scores = durable(self.scores().select("doc_id", F.col("compound").alias("score")))
        return linked.join(scores, "doc_id")

    def headline_dates(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("symbol"), ist_date(F.col("ts")).alias("date")).distinct()

    def units(self) -> DataFrame:
        """Documents as the units of one file per source, in document order."""
        return self.documents.select(
            F.col("source").alias("file_id"), F.col("doc_id").alias("unit_pos"), F.col("lang").alias("section"), "text"
        )

    def sheet(self) -> DataFrame:
        """Line items as sheet rows."""
        row = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row")
        return self.lineitem.select(row, "*")


# ---------------------------------------------------------------- SQL of the same roles

_POINTS_SQL = """
price_points AS (
  SELECT event_type AS symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date, value AS close, event_id AS pos
  FROM events WHERE {days}),
prices AS (SELECT symbol, date, arg_max(close, pos) AS close FROM price_points GROUP BY 1, 2),
hdates AS (SELECT DISTINCT event_type AS symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS date FROM events)"""
_MARKET_DAYS = "dayofweek(CAST(ts + INTERVAL 330 MINUTE AS DATE)) NOT IN (0, 6)"
PRICES_SQL = _POINTS_SQL.format(days="true")
MARKET_SQL = _POINTS_SQL.format(days=_MARKET_DAYS)
# Without the prices of the symbol whose payload cannot be read.
FETCHED_SQL = _POINTS_SQL.format(days=_MARKET_DAYS + " AND event_type <> 'error'")

_P = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_WORD = rf"([^{_P}{JS_BLANK}]{{2,}}|[\x{{10000}}-\x{{10FFFF}}])"
_STRIP = rf"^{sentiment.AFFIX}{_WORD}$|^{_WORD}{sentiment.AFFIX}$"

TOKENS_SQL = f"""
split AS (
  SELECT doc_id, text, list_transform(
    list_filter(regexp_split_to_array(text, '[{JS_BLANK}]+'), lambda x: length(x) > 1 OR unicode(x) > 65535),
    lambda x: regexp_replace(x, {text_literal(_STRIP)}, '\\1\\2')) AS w
  FROM documents),
tk AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM split),
lex AS (
  SELECT token, ((b % 33) - 16) / 4.0 AS valence
  FROM (SELECT token, CAST('0x' || right(md5(token), 2) AS INT) AS b
        FROM (SELECT DISTINCT lower(token) AS token FROM tk)) WHERE b >= 192)"""


def _in(words) -> str:
    return "(" + ", ".join(text_literal(w) for w in words) + ")"


def _is_up(c: str) -> str:
    return f"({c} = upper({c}) AND {c} <> lower({c}))"


def _neg(c: str) -> str:
    return f"(lower({c}) IN {_in(sentiment.NEGATIONS)} OR contains(lower({c}), 'n''t'))"


def _boost(c: str) -> str:
    s, w = _in(sentiment.STRONGER), _in(sentiment.WEAKER)
    return (
        f"(CASE WHEN lower({c}) IN {s} OR lower({c}) IN {w} THEN "
        f"(CASE WHEN lower({c}) IN {s} THEN 0.293::DOUBLE ELSE -0.293::DOUBLE END) * (CASE WHEN v < 0 THEN -1 ELSE 1 END)"
        f" + (CASE WHEN {_is_up(c)} AND caps THEN (CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END) "
        f"ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END)"
    )


def _idioms(expr: str) -> str:
    return " ".join(f"WHEN {text_literal(k)} THEN {v}::DOUBLE" for k, v in sentiment.IDIOMS.items()).join(
        [f"CASE {expr} ", " END"])


_BACK = ["p1||' '||token", "p2||' '||p1||' '||token", "p2||' '||p1", "p3||' '||p2||' '||p1", "p3||' '||p2"]
_WEAK = _in(sentiment.WEAKER_PHRASES)

POLARITY_SQL = f"""{TOKENS_SQL},
stat AS (
  SELECT d.doc_id, count(t.token) AS n,
    count(*) FILTER ({_is_up('t.token')}) AS ups, min(t.pos) FILTER (lower(t.token) = 'but') AS but_pos
  FROM documents d LEFT JOIN tk t ON t.doc_id = d.doc_id GROUP BY 1),
emph AS (
  SELECT doc_id, least(len(regexp_extract_all(text, '!')), 4) * 0.292::DOUBLE
    + CASE WHEN q > 3 THEN 0.96::DOUBLE WHEN q > 1 THEN q * 0.18::DOUBLE ELSE 0.0::DOUBLE END AS e
  FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\?')) AS q FROM documents)),
ctx AS (
  SELECT doc_id, token, pos, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2, lag(token, 3) OVER w AS p3,
    lead(token, 1) OVER w AS n1, lead(token, 2) OVER w AS n2
  FROM tk WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
first_at AS (SELECT doc_id, token, min(pos) AS pos FROM tk GROUP BY 1, 2),
hit AS (
  SELECT c.*, l.valence::DOUBLE AS valence, s.ups > 0 AND s.ups < s.n AS caps,
    c.p1 IS NOT NULL AND a.token IS NULL AS f1, c.p2 IS NOT NULL AND b.token IS NULL AS f2,
    c.p3 IS NOT NULL AND d.token IS NULL AS f3
  FROM ctx c JOIN first_at f ON f.doc_id = c.doc_id AND f.token = c.token AND f.pos = c.pos
  JOIN stat s ON s.doc_id = c.doc_id JOIN lex l ON l.token = lower(c.token)
  LEFT JOIN lex a ON a.token = lower(c.p1) LEFT JOIN lex b ON b.token = lower(c.p2)
  LEFT JOIN lex d ON d.token = lower(c.p3)),
s0 AS (SELECT * EXCLUDE (valence), CASE WHEN {_is_up('token')} AND caps
  THEN valence + CASE WHEN valence > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END ELSE valence END AS v FROM hit),
s1 AS (SELECT * REPLACE (CASE WHEN f1 THEN v + {_boost('p1')} ELSE v END AS v) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN f1 AND {_neg('p1')} THEN v * -0.74::DOUBLE ELSE v END AS v) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN f2 THEN v + {_boost('p2')} * 0.95::DOUBLE ELSE v END AS v) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN f2 AND p2 = 'never' AND p1 IN ('so', 'this') THEN v * 1.5::DOUBLE
  WHEN f2 AND {_neg('p2')} THEN v * -0.74::DOUBLE ELSE v END AS v) FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN f3 THEN v + {_boost('p3')} * 0.9::DOUBLE ELSE v END AS v) FROM s4),
s6 AS (SELECT * REPLACE (CASE WHEN f3 AND ((p3 = 'never' AND p2 IN ('so', 'this')) OR p1 IN ('so', 'this'))
  THEN v * 1.25::DOUBLE WHEN f3 AND {_neg('p3')} THEN v * -0.74::DOUBLE ELSE v END AS v) FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN f3 THEN coalesce({_idioms("token||' '||n1||' '||n2")}, {_idioms("token||' '||n1")},
  {', '.join(_idioms(b) for b in _BACK)}, v)
  - CASE WHEN (p3||' '||p2) IN {_WEAK} OR (p2||' '||p1) IN {_WEAK} THEN 0.293::DOUBLE ELSE 0.0::DOUBLE END
  ELSE v END AS v) FROM s6),
s8 AS (SELECT * REPLACE (CASE WHEN f1 AND lower(p1) = 'least' AND NOT coalesce(lower(p2) IN ('at', 'very'), false)
  THEN v * -0.74::DOUBLE ELSE v END AS v) FROM s7),
valued AS (SELECT doc_id, token, CASE WHEN lower(token) IN {_in(sentiment.STRONGER + sentiment.WEAKER)}
  OR coalesce(lower(token) = 'kind' AND lower(n1) = 'of', false) THEN 0.0::DOUBLE ELSE v END AS v FROM s8),
each_token AS (
  SELECT t.doc_id, coalesce(x.v, 0.0::DOUBLE) * CASE WHEN t.pos < s.but_pos THEN 0.5::DOUBLE WHEN t.pos > s.but_pos
    THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS s
  FROM tk t JOIN stat s ON s.doc_id = t.doc_id LEFT JOIN valued x ON x.doc_id = t.doc_id AND x.token = t.token),
sums AS (
  SELECT s.doc_id, s.n AS n_tokens, e.e AS emphasis, coalesce(sum(t.s), 0.0) AS total,
    coalesce(sum(t.s + 1) FILTER (t.s > 0), 0.0) AS pos_sum, coalesce(sum(t.s - 1) FILTER (t.s < 0), 0.0) AS neg_sum,
    count(*) FILTER (t.s = 0) AS neu_count
  FROM stat s JOIN emph e ON e.doc_id = s.doc_id LEFT JOIN each_token t ON t.doc_id = s.doc_id
  GROUP BY s.doc_id, s.n, e.e),
loud AS (
  SELECT doc_id, n_tokens, neu_count, CASE WHEN total > 1e-9 THEN total + emphasis WHEN total < -1e-9 THEN total - emphasis
    ELSE 0.0 END AS total, pos_sum + CASE WHEN pos_sum - abs(neg_sum) > 1e-9 THEN emphasis ELSE 0 END AS p,
    abs(neg_sum - CASE WHEN pos_sum - abs(neg_sum) < -1e-9 THEN emphasis ELSE 0 END) AS q FROM sums),
polarity AS (
  SELECT doc_id,
    CASE WHEN n_tokens = 0 THEN 0.0 ELSE floor(q / (p + q + neu_count) * 1000.0::DOUBLE + 0.5) / 1000 END AS neg,
    CASE WHEN n_tokens = 0 THEN 0.0 ELSE floor(neu_count / (p + q + neu_count) * 1000.0::DOUBLE + 0.5) / 1000 END AS neu,
    CASE WHEN n_tokens = 0 THEN 0.0 ELSE floor(p / (p + q + neu_count) * 1000.0::DOUBLE + 0.5) / 1000 END AS pos,
    CASE WHEN n_tokens = 0 THEN 0.0
      ELSE floor(total / sqrt(total * total + 15) * 10000.0::DOUBLE + 0.5) / 10000 END AS compound
  FROM loud)"""

HEADLINES_SQL = POLARITY_SQL + """,
headlines AS (
  SELECT e.event_type AS symbol, e.event_id AS pos, e.ts AS pub_ts, CAST(e.ts + INTERVAL 330 MINUTE AS DATE) AS date,
    e.event_id % (SELECT count(*) FROM documents) AS doc_id, p.compound AS score
  FROM events e JOIN polarity p ON p.doc_id = e.event_id % (SELECT count(*) FROM documents))"""
