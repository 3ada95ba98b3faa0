"""From landed feeds and price payloads to scored headlines and one annotated row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.dates import ist_date, parse_published
from tallyglass.functions.text import tone
from tallyglass.operators.prices import daily_close, horizon_filter, status_notes, stock_summary
from tallyglass.operators.sentiment import polarity_scores


def scored_headlines(items: DataFrame, lexicon: DataFrame, today: str, days: int) -> DataFrame:
    """items(symbol, feed, pos, title, source, link, pub_date) -> the same with ``date``, ``score`` and ``tone``.

    Only headlines of the horizon are scored; error rows, dates that cannot be read and older ones are gone before.  Wires
    repeat each other: each different title is scored once and joined back.  A headline without a title scores 0.  Order
    the result by date (newest first), feed and pos to show it.
    """
    dated = items.where(F.col("pos").isNotNull()).withColumn("date", ist_date(parse_published(F.col("pub_date"))))
    recent = horizon_filter(dated, today, days).withColumn("title", F.coalesce("title", F.lit("")))
    titles = recent.select(F.col("title").alias("_title")).distinct().withColumn("_text", F.col("_title"))
    scores = polarity_scores(titles, lexicon, "_title", "_text").select("_title", F.col("compound").alias("score"))
    return recent.join(scores, F.col("title") == F.col("_title")).drop("_title").withColumn("tone", tone(F.col("score")))


def feed_report(symbols: DataFrame, items: DataFrame, points: DataFrame, lexicon: DataFrame, today: str, days: int) -> DataFrame:
    """One row per symbol from what the readers give: ``stock_summary`` with both error flags, and the ``notes`` for its reader.

    ``items`` are feed items with a ``symbol``, ``points`` price points(symbol, pos, date, close); both may hold the readers' error
    rows.  A side failed when nothing at all came for a symbol, whatever the reason: one answering feed of several is enough.
    One side's failure leaves the other's figures as they are.
    """
    closes = points.where(F.col("close").isNotNull())
    came = items.where(F.col("pos").isNotNull()).select("symbol", F.lit(False).alias("news_error"), F.lit(None).cast("boolean").alias("price_error"))
    came = came.unionByName(closes.select("symbol", F.lit(None).cast("boolean").alias("news_error"), F.lit(False).alias("price_error")))
    found = came.groupBy("symbol").agg(*[F.max(side).alias(side) for side in ("news_error", "price_error")])
    listed = symbols.select("symbol").distinct()
    failed = listed.join(found, "symbol", "left").fillna(True, ["news_error", "price_error"])
    headlines = scored_headlines(items, lexicon, today, days)
    summary = stock_summary(listed, headlines, daily_close(closes), today, days, failed)
    return status_notes(summary, days, F.col("news_error"), F.col("price_error"))
