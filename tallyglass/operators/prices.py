"""Price series and the headline-to-price summary.

Every window here runs over at most one row per (symbol, calendar day): closes and headline dates are
reduced to days map-side first, so a window's length is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_close(points: DataFrame, pos: str = "pos") -> DataFrame:
    """(symbol, date, close, pos) -> one close per day, the last in payload order; null closes dropped."""
    return points.where(F.col("close").isNotNull()).groupBy("symbol", "date").agg(
        F.max_by("close", pos).alias("close")
    )


def next_close(prices: DataFrame) -> DataFrame:
    series = Window.partitionBy("symbol").orderBy("date")
    return prices.withColumn("next_close", F.lead("close").over(series))


def _forward(dates: DataFrame, prices: DataFrame) -> DataFrame:
    """Every row of ``dates`` (one per symbol and date) with ``_found``, the first price day on or after it.

    One sort per symbol over the union of both sides, no inequality join.
    """
    carried = [c for c in prices.columns if c not in ("symbol", "date")]
    price = F.struct(F.col("date").alias("price_date"), *carried)
    both = dates.withColumn("_wanted", F.lit(1)).unionByName(
        prices.select("symbol", "date", price.alias("_price")), allowMissingColumns=True
    )
    # Walking back from the last day keeps the frame a running one; a day's price comes before its request.
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("_wanted").asc_nulls_first())
    found = both.withColumn("_found", F.last("_price", ignorenulls=True).over(back))
    return found.where(F.col("_wanted").isNotNull()).drop("_wanted", "_price")


def price_on_or_after(dates: DataFrame, prices: DataFrame) -> DataFrame:
    """Forward as-of join: for each distinct (symbol, date) the first price day on or after it.

    ``prices`` may carry extra columns; they come along.  Dates past the last price give no row.
    """
    found = _forward(dates.select("symbol", "date").distinct(), prices)
    return found.where(F.col("_found").isNotNull()).select("symbol", "date", "_found.*")


def percent_change(base: Column, later: Column) -> Column:
    """Null, not infinity, when the base is zero."""
    return F.try_divide(later - base, base) * 100


def next_day_return(dates: DataFrame, prices: DataFrame) -> DataFrame:
    """Per distinct headline date: move from its base price to the next row of the series."""
    found = price_on_or_after(dates, next_close(prices))
    return found.where(F.col("next_close").isNotNull()).select(
        "symbol", "date", "price_date", "close", "next_close",
        percent_change(F.col("close"), F.col("next_close")).alias("next_day_pct"),
    )


def next_day_avg(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(
        F.avg("next_day_pct").alias("next_day_avg_pct"), F.count("next_day_pct").alias("next_day_sample_size")
    )


def horizon_filter(df: DataFrame, today: str, days: int, date: str = "date") -> DataFrame:
    """Keep dates from ``today - days`` on; there is no upper bound.  Null dates are dropped."""
    return df.where(F.col(date) >= F.date_sub(F.to_date(F.lit(today)), days))


def horizon_move(prices: DataFrame, today: str, days: int) -> DataFrame:
    """Move from the first close in the horizon to the last close of the series; null without both."""
    start = F.date_sub(F.to_date(F.lit(today)), days)
    inside = F.when(F.col("date") >= start, F.col("date"))
    ends = prices.groupBy("symbol").agg(
        F.min_by("close", inside).alias("first_close"), F.max_by("close", "date").alias("last_close")
    )
    usable = (F.col("first_close") != 0) & (F.col("last_close") != 0)
    return ends.select(
        "symbol", "first_close", "last_close",
        F.when(usable, percent_change(F.col("first_close"), F.col("last_close"))).alias("movement_pct"),
    )


def daily_sentiment(headlines: DataFrame) -> DataFrame:
    return headlines.groupBy("symbol", "date").agg(
        F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n_headlines")
    )


def net_sentiment(daily: DataFrame) -> DataFrame:
    """Mean of the daily means, so a busy day weighs no more than a quiet one."""
    return daily.groupBy("symbol").agg(
        F.avg("avg_score").alias("net_sentiment"),
        F.sum("n_headlines").alias("headline_count"),
        F.count(F.lit(1)).alias("date_count"),
    )


def stock_summary(symbols: DataFrame, headlines: DataFrame, prices: DataFrame, today: str, days: int,
                  failed: DataFrame | None = None) -> DataFrame:
    """One row per symbol; a missing news or price side leaves nulls (counts 0), never drops the row.

    ``failed(symbol, news_error, price_error)``, where given, tells which sides could not be fetched; both flags come
    out beside the figures, false for symbols it does not list, and ``status_notes`` takes them.

    Headlines and prices are read once each and laid out together, one row per symbol and day and side.  One window pass
    gives prices the next close and headline days the price they meet; one aggregate sums both sides up.
    """
    start = F.date_sub(F.to_date(F.lit(today)), days)
    daily = daily_sentiment(headlines.where(F.col("date") >= start))
    price = F.struct("date", "close").alias("_price")
    both = daily.withColumn("_wanted", F.lit(1)).unionByName(prices.select("symbol", "date", price), allowMissingColumns=True)
    # A day's price comes before its headlines: walking on for the next close, walking back for the price they meet.
    series = Window.partitionBy("symbol")
    back = series.orderBy(F.col("date").desc(), F.col("_wanted").asc_nulls_first())
    later = F.last("_price", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    paired = both.withColumn("_pair", F.when(F.col("_price").isNotNull(), F.struct(
        F.col("_price.close").alias("close"), later["close"].alias("next_close"))))
    met = F.last("_pair", ignorenulls=True).over(back)
    moved = paired.withColumn("_met", F.when(F.col("_wanted").isNotNull(), met))
    moved = moved.withColumn("next_day_pct", percent_change(F.col("_met.close"), F.col("_met.next_close")))
    day = F.when(F.col("_price").isNotNull(), F.col("date"))
    sums = moved.groupBy("symbol").agg(
        F.avg("avg_score").alias("net_sentiment"),
        F.sum("n_headlines").alias("headline_count"),
        F.count("_wanted").alias("date_count"),
        F.avg("next_day_pct").alias("next_day_avg_pct"),
        F.count("next_day_pct").alias("next_day_sample_size"),
        F.min_by("_price", F.when(day >= start, day)).alias("_first"),
        F.max_by("_price", day).alias("_last"),
    )
    first, last = F.col("_first.close"), F.col("_last.close")
    movement = F.when((first != 0) & (last != 0), percent_change(first, last))
    zero = F.lit(0).cast("bigint")
    summary = symbols.select("symbol").distinct().join(sums, "symbol", "left").select(
        "symbol",
        F.coalesce("headline_count", zero).alias("headline_count"),
        "net_sentiment", movement.alias("movement_pct"), "next_day_avg_pct",
        F.coalesce("next_day_sample_size", zero).alias("next_day_sample_size"),
        F.coalesce("date_count", zero).alias("date_count"),
    )
    if failed is None:
        return summary
    flags = {side: F.coalesce(F.col(side), F.lit(False)) for side in ("news_error", "price_error")}
    either = failed.groupBy("symbol").agg(*[F.bool_or(side).alias(side) for side in flags])
    return summary.join(either, "symbol", "left").withColumns(flags)


def status_notes(summary: DataFrame, days: int, news_error: Column | None = None,
                 price_error: Column | None = None) -> DataFrame:
    """Data-quality notes per symbol: one on the news side, one on the price side, or none."""
    news_error = F.lit(False) if news_error is None else news_error
    price_error = F.lit(False) if price_error is None else price_error
    symbol = F.col("symbol")
    news = (
        F.when(news_error, F.concat(symbol, F.lit(": couldn't fetch news right now.")))
        .when(F.col("headline_count") == 0,
              F.concat(symbol, F.lit(f": no headlines found within the last {days} days.")))
        .when(F.col("next_day_sample_size") < F.col("date_count"),
              F.concat(symbol, F.lit(": next-day figure only covers dates with a following trading day so far.")))
    )
    price = (
        F.when(price_error, F.concat(symbol, F.lit(": price data is unavailable right now.")))
        .when(~news_error & F.col("movement_pct").isNull(),
              F.concat(symbol, F.lit(f": no trading data found within the last {days} days.")))
    )
    return summary.withColumn("notes", F.concat_ws(" ", news, price))


# ---------------------------------------------------------------- chart series


def union_dates(points: DataFrame) -> DataFrame:
    return points.select("date").distinct().orderBy("date")


def align_series(points: DataFrame, series: str = "symbol", value: str = "close") -> DataFrame:
    """Every series on every date of their union; a missing point is null.

    The dates are at most the days of the calendar, so they travel as one array inside the plan.
    """
    dates = points.agg(F.array_sort(F.collect_set("date")).alias("dates")).scalar()
    grid = points.select(series).distinct().select(series, F.explode(dates).alias("date"))
    return grid.join(points.select(series, "date", value), [series, "date"], "left")


def rebase_pct(prices: DataFrame) -> DataFrame:
    """Percent change from each series' own first point; series with fewer than two points are dropped."""
    series = Window.partitionBy("symbol")
    so_far = series.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = prices.withColumns({
        "pct": percent_change(F.first("close").over(so_far), F.col("close")), "_n": F.count(F.lit(1)).over(series)})
    return counted.where("_n >= 2").drop("_n")


def last_point(points: DataFrame, series: str = "symbol", value: str = "close") -> DataFrame:
    present = F.when(F.col(value).isNotNull(), F.col("date"))
    return points.groupBy(series).agg(
        F.max(present).alias("last_date"), F.max_by(value, present).alias("last_value")
    )


def line_segments(points: DataFrame, series: str = "symbol", value: str = "close") -> DataFrame:
    """Runs of present values on the union of dates: a missing value lifts the pen.

    Within a run the place of the date among all dates and the rank among the series' own points grow together, so
    no grid of series and dates is needed.  The dates travel as in ``align_series``.
    """
    dates = points.agg(F.array_sort(F.collect_set("date")).alias("dates")).scalar()
    own = F.dense_rank().over(Window.partitionBy(series).orderBy("date"))
    placed = points.where(F.col(value).isNotNull() & F.col("date").isNotNull()).withColumn(
        "_run", F.array_position(dates, F.col("date")) - own)
    return (
        placed.groupBy(series, "_run")
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("points"))
        .drop("_run")
    )


def series_extent(points: DataFrame, value: str = "close", comparison: bool = False) -> DataFrame:
    """Axis range: a price chart is padded by a tenth, a comparison includes zero and is padded by 15 %."""
    low, high = F.min(value), F.max(value)
    if comparison:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    ends = points.agg(low.alias("low"), high.alias("high"))

    def nonzero(c: Column) -> Column:
        return F.when(c != 0, c)

    span = F.coalesce(
        nonzero(F.col("high") - F.col("low")),
        *([] if comparison else [nonzero(F.col("high") * 0.01)]),
        F.lit(1.0),
    )
    pad = span * (0.15 if comparison else 0.1)
    return ends.select("low", "high", (F.col("low") - pad).alias("axis_min"), (F.col("high") + pad).alias("axis_max"))
