"""Exact questions over sheet rows and document statistics: filter, group, aggregate, sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.text import (
    cell_text, count_chars, count_words, natural_order, same_key, to_number,
)
from tallyglass.operators.ordered import running_sum
from tallyglass.scale import only_if

# Chart limits.
MAX_CATEGORIES, MAX_STAT_CATEGORIES, MAX_BARS, MAX_SERIES, MAX_PIE = 50, 500, 60, 6, 6  # fixed values

AGGREGATIONS = ("sum", "average", "count", "min", "max", "none")


def number_of(df: DataFrame, column: str) -> Column:
    """A column as a number: numeric columns as they are, text parsed, anything else null."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return to_number(c)
    return F.lit(None).cast("double")


def text_of(df: DataFrame, column: str) -> Column:
    """A column as a sheet shows it: whole numbers without ``.0``, midnight timestamps as dates, blank as null."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        shown = cell_text(number=F.col(column).cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        shown = cell_text(stamp=F.col(column))
    else:
        shown = F.col(column).cast("string")
    return F.when(shown != "", shown)


def find_column(df: DataFrame, name: str) -> str:
    """The column of that name, whatever its case and outer blanks."""
    wanted = name.strip().lower()
    for column in df.columns:
        if column.strip().lower() == wanted:
            return column
    raise ValueError(f"the sheet has no column “{name}” (columns: {', '.join(df.columns)})")


def _literal_number(value) -> float | None:
    import re

    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    bare = re.sub(r"[,\s₹$€£%]", "", value) if isinstance(value, str) else ""
    return float(bare) if re.fullmatch(r"[-+]?\d*\.?\d+(e[-+]?\d+)?", bare, re.I | re.A) else None


def predicate(df: DataFrame, column: str, op: str, value) -> Column:
    """One filter of a question.  Never null: an empty cell does satisfy ``not_equals``."""
    column = find_column(df, column)
    number, given = number_of(df, column), _literal_number(value)
    shown, no = text_of(df, column), F.lit(False)
    if op in ("equals", "not_equals"):
        # A constant with the column's own type on one side keeps the comparison pushable to the scan.
        text = same_key(shown) == F.lit("" if value is None else str(value).strip().lower())
        if given is None:
            equal = text
        elif isinstance(df.schema[column].dataType, T.NumericType):
            equal = F.coalesce(F.col(column) == given, no)
        else:
            equal = F.when(number.isNotNull(), number == given).otherwise(text)
        return equal if op == "equals" else ~equal
    if op == "contains":
        return F.lower(F.coalesce(shown, F.lit(""))).contains(str(value).lower())
    if op in ("greater_than", "less_than"):
        if given is None:
            return no
        if isinstance(df.schema[column].dataType, T.NumericType):
            number = F.col(column)
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            no = F.abs(number) == float("inf")
            return (number > given if op == "greater_than" else number < given) & ~no & ~F.isnan(number)
        return number > given if op == "greater_than" else number < given
    return F.lit(True)


def sheet_filter(df: DataFrame, filters: Sequence[tuple]) -> DataFrame:
    """Keep rows satisfying every (column, op, value)."""
    return reduce(lambda out, f: out.where(predicate(df, *f)), filters, df)


def category_of(df: DataFrame, category: str | None) -> Column:
    if category is None:
        return F.lit("All selected rows")
    return F.coalesce(text_of(df, find_column(df, category)), F.lit("(blank)"))


def series_name(column: str, aggregation: str) -> str:
    return f"Count of {column}" if aggregation == "count" else column


def sheet_aggregate(df: DataFrame, category: str | None, values: Sequence[str], aggregation: str = "sum",
                    filters: Sequence[tuple] = (), sort: str = "sheet_order", row: str = "row") -> DataFrame:
    """Filter -> group by the category (or one grand total) -> aggregate 1..6 columns -> sort.

    One partial and one final hash aggregate; the sort touches one row per category.  A column without a number in any
    selected row is refused (``reject_empty_series``), unless rows are only counted.
    """
    if not values:
        raise ValueError("the proposal named no column to plot")
    values = [find_column(df, v) for v in values]
    if aggregation not in AGGREGATIONS:
        aggregation = "sum"
    if aggregation == "none":
        raise ValueError("use sheet_rows_listing for rows one by one")
    makers = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}

    def measure(column: str) -> Column:
        if aggregation == "count":
            filled = F.col(column).isNotNull() & (F.col(column).cast("string") != "")
            return F.count(F.when(filled, 1))
        return makers[aggregation](number_of(df, column))

    grouped = (
        sheet_filter(df, filters)
        .groupBy(category_of(df, category).alias("category"))
        .agg(F.min(row).alias("first_row"), *[measure(c).alias(series_name(c, aggregation)) for c in values])
    )
    if aggregation != "count":
        grouped = reject_empty_series(grouped, values, aggregation)
    return category_sort(grouped, sort, series_name(values[0], aggregation))


def category_sort(grouped: DataFrame, sort: str, first_value: str) -> DataFrame:
    """Order categories, names as a reader expects; nulls last, ties by first appearance."""
    seen = F.col("first_row").asc()
    if sort == "category":
        return grouped.orderBy(natural_order(F.col("category")), seen)
    if sort == "value_desc":
        return grouped.orderBy(F.col(first_value).desc_nulls_last(), seen)
    if sort == "value_asc":
        return grouped.orderBy(F.col(first_value).asc_nulls_last(), seen)
    return grouped.orderBy(seen)


def reject_empty_series(grouped: DataFrame, values: Sequence[str], aggregation: str = "sum") -> DataFrame:
    """Fail when a column holds no number in any group.

    The check looks at every column of the groups, so its aggregate is the same as theirs and Spark runs it once.
    """
    names = [series_name(v, aggregation) for v in values]
    rest = reduce(lambda seen, c: seen & (F.count(c) >= 0), [c for c in grouped.columns if c not in names], F.lit(True))
    empty = [F.when((F.count(n) == 0) & rest, F.lit(f"column “{n}” has no numbers in the selected rows")) for n in names]
    return only_if(grouped, grouped.agg(F.coalesce(*empty, F.lit(None).cast("string")).alias("message")))


def sheet_rows_listing(df: DataFrame, category: str, values: Sequence[str], filters: Sequence[tuple] = (),
                       row: str = "row", max_rows: int = MAX_CATEGORIES) -> DataFrame:
    """Each row its own category.  More than ``max_rows`` rows is an error, not a cut."""
    kept = sheet_filter(df, filters)
    values = [find_column(df, v) for v in values]
    shown = text_of(df, find_column(df, category))
    label = F.coalesce(shown, F.concat(F.lit("Row "), F.col(row).cast("string")))
    listed = kept.select(F.col(row), label.alias("category"), *[number_of(df, c).alias(c) for c in values])
    # Counting stops one row past the limit.
    over = kept.limit(max_rows + 1).agg(
        F.when(F.count(F.lit(1)) > max_rows, F.lit(f"that would list more than {max_rows} rows one by one"))
        .alias("message")
    )
    return only_if(listed, over).orderBy(row)


def row_span(df: DataFrame, filters: Sequence[tuple] = (), row: str = "row") -> DataFrame:
    return sheet_filter(df, filters).agg(
        F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count(F.lit(1)).alias("used")
    )


def chart_guards(grouped: DataFrame, series: Sequence[str], kind: str = "bar",
                 statistics: bool = False) -> DataFrame:
    """One row: the reason a chart is refused, or null.  Reasons are tried in order."""
    cap = MAX_STAT_CATEGORIES if statistics else MAX_CATEGORIES
    bad_part = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) for c in series])
    figures = grouped.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad_part, 1)).alias("bad"))
    n = F.col("n")
    checks = [(n == 0, "there is nothing to plot after the filters")]
    if kind == "bar":
        checks.append((n > MAX_BARS, "too many bars to read; ask for a line chart instead"))
    checks += [
        (n > cap, f"more than {cap} categories; ask for a filter or a grouping"),
        (F.lit(len(series) > MAX_SERIES), f"at most {MAX_SERIES} series can be plotted at once"),
    ]
    if kind == "pie":
        checks += [
            (F.lit(len(series) != 1), "a pie chart can show only one series"),
            (n > MAX_PIE, f"a pie chart is only readable with up to {MAX_PIE} parts"),
            (F.col("bad") > 0, "a pie chart needs positive values for every part"),
        ]
    reason = F.coalesce(*[F.when(test, F.lit(text)) for test, text in checks])
    return figures.select(F.col("n").alias("categories"), reason.alias("error"))


def pie_share(grouped: DataFrame, value: str, category: str = "category") -> DataFrame:
    """Share of the whole in percent; a zero total divides by one."""
    total = grouped.agg(F.sum(value)).scalar()
    whole = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return grouped.select(category, value, (F.col(value) / whole * 100).alias("share_pct"))


def to_long(grouped: DataFrame, series: Sequence[str]) -> DataFrame:
    """Wide chart data -> (category, series, value)."""
    return grouped.unpivot(["category"], list(series), "series", "value")


def calculate_text(grouped: DataFrame, series: Sequence[str], pos: str, source: str | Column, settings: str = "",
                   titles: Sequence[str] | None = None) -> DataFrame:
    """Result of a calculation as pipe text, one row (pos, line) per line: a head, the categories in the order of
    their integer ``pos``, a blank line, and where the figures come from with the ``settings`` they were made by.

    ``titles`` head the series where their columns are named otherwise.  Lines are never gathered, so there may be any
    number of categories.
    """
    def figure(c: str) -> Column:
        fixed = F.format_string("%.4f", F.round(F.col(c).cast("double"), 4))
        return F.coalesce(F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ""), F.lit(""))

    last = F.concat(F.lit("Source: "), F.lit(source) if isinstance(source, str) else source, F.lit(f". {settings}".rstrip(" ")))
    frame = grouped.sparkSession.createDataFrame(
        [(-(1 << 62), " | ".join(["Category", *(titles or series)])), (1 << 62, ""), ((1 << 62) + 1, None)], "pos bigint, line string")
    frame = frame.withColumn("line", F.coalesce("line", last))
    line = F.concat_ws(" | ", "category", *[figure(c) for c in series])
    return frame.union(grouped.select(F.col(pos).cast("bigint"), line))


# ---------------------------------------------------------------- finding a sheet


def resolve_sheet(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(request_id, file, folder, sheet, column) x (file_pos, file, folder, sheet, column) -> one match each.

    Names match whatever their case and outer blanks.  A file in the asked folder is preferred, then list
    order; a wrong folder falls back to the first file of that name.  A miss keeps the request with an error.
    """
    keyed = catalog.select(
        "file_pos", same_key(F.col("sheet")).alias("_sheet"), same_key(F.col("column")).alias("_column"),
        F.col("sheet").alias("found_sheet"), F.col("column").alias("found_column"),
    )
    files = catalog.select(
        "file_pos", F.col("file").alias("found_file"), F.col("folder").alias("found_folder"),
        same_key(F.col("file")).alias("_file"), same_key(F.col("folder")).alias("_folder"),
    ).distinct()
    asked = requests.select(
        "request_id", same_key(F.col("file")).alias("_file"), same_key(F.col("sheet")).alias("_sheet"),
        same_key(F.col("column")).alias("_column"),
        F.when(F.col("folder").isNotNull(), same_key(F.col("folder"))).alias("_asked_folder"),
    )
    # Only two files of a name can be chosen: the first in the asked folder and the first anywhere.
    first = F.min(F.struct("file_pos", "found_file", "found_folder"))
    in_folder = files.groupBy("_file", F.col("_folder").alias("_asked_folder")).agg(first.alias("_here"))
    anywhere = files.groupBy("_file").agg(first.alias("_any"))
    chosen = (
        asked.join(in_folder, ["_file", "_asked_folder"], "left").join(anywhere, "_file", "left")
        .withColumn("_c", F.coalesce("_here", "_any"))
        .select("request_id", "_sheet", "_column", "_c.file_pos", "_c.found_file", "_c.found_folder")
    )
    matched = chosen.join(keyed, ["file_pos", "_sheet", "_column"], "left")
    return matched.select(
        "request_id", "found_file", "found_folder", "found_sheet", "found_column",
        F.when(F.col("file_pos").isNull(), "no such file")
        .when(F.col("found_column").isNull(), "no such sheet or column").alias("error"),
    )


# ---------------------------------------------------------------- document statistics


def unit_measure(measure: str = "words") -> Column:
    text = F.col("text")
    return (count_chars(text) if measure == "characters" else count_words(text)).cast("bigint")


def stats_by_file(units: DataFrame, measure: str = "words") -> DataFrame:
    return units.groupBy("file_id").agg(F.sum(unit_measure(measure)).alias("value"))


def file_statistics(units: DataFrame) -> DataFrame:
    """Words and characters of every file in one pass."""
    return units.groupBy("file_id").agg(
        F.sum(unit_measure("words")).alias("words"), F.sum(unit_measure("characters")).alias("characters")
    )


def stats_by_section(units: DataFrame, measure: str = "words") -> DataFrame:
    """One row per unit, equal sections not merged; an unnamed section is numbered by its place in the file."""
    measured = units.select("file_id", "unit_pos", "section", unit_measure(measure).alias("value"))
    placed = running_sum(measured, ["file_id"], ["unit_pos"], F.lit(1), "_place")
    section = F.coalesce(
        F.when(F.col("section") != "", F.col("section")),
        F.concat(F.lit("Section "), (F.col("_place") + 1).cast("bigint").cast("string")),
    )
    return placed.select("file_id", "unit_pos", section.alias("category"), "value")


def page_grid(files: DataFrame, counts: DataFrame, pages: str = "pages", value: str = "value") -> DataFrame:
    """Pages 1..n of every file, a page without text counting 0.

    ``counts(file_id, unit_pos, page, value)``: of two units on one page the last wins.
    """
    last = counts.groupBy("file_id", "page").agg(F.max_by(value, "unit_pos").alias(value))
    grid = files.select("file_id", F.explode(F.sequence(F.lit(1), F.col(pages).cast("int"))).alias("page"))
    return grid.join(last, ["file_id", "page"], "left").select(
        "file_id", "page", F.coalesce(value, F.lit(0).cast("bigint")).alias(value)
    )


def stats_by_page(files: DataFrame, units: DataFrame, measure: str = "words") -> DataFrame:
    counts = units.select("file_id", "unit_pos", "page", unit_measure(measure).alias("value"))
    return page_grid(files, counts)


def context_chars(chunks: DataFrame, limit: int = 150_000) -> DataFrame:
    """Total characters of the chunks and the reading mode they call for; the bound is inclusive."""
    total = F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0).cast("bigint"))
    return chunks.agg(total.alias("total_chars")).withColumn(
        "mode", F.when(F.col("total_chars") <= limit, "full").otherwise("passages")
    )


# ---------------------------------------------------------------- answer keys


def conditional_totals(df: DataFrame, key: str, value: str, condition: Column) -> DataFrame:
    """Total per key over the rows that satisfy the condition."""
    return df.where(condition).groupBy(key).agg(F.sum(value).alias("total"))


def top_of(totals: DataFrame, key: str) -> DataFrame:
    return totals.agg(F.max_by(key, "total").alias("top"), F.max("total").alias("total"))


def missed_targets(totals: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Keys whose total stayed under the target, sorted by key."""
    return totals.join(targets, key).where(F.col("total") < F.col("target")).orderBy(key)


def eval_summary(scores: DataFrame) -> DataFrame:
    """Per use case and over all: questions, points, citation rate, made-up answers, seconds.

    Rates skip blanks; without any entry they are null.
    """
    cited, made_up = F.col("citations_ok"), F.col("made_up")

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    return scores.rollup("use_case").agg(
        F.grouping("use_case").alias("_all"),
        F.count(F.lit(1)).alias("questions"),
        F.count("score").alias("scored"),
        n(F.col("score") == 2).alias("fully_correct"),
        F.try_divide(F.sum("score").cast("double"), 2 * F.count("score")).alias("accuracy"),
        F.try_divide(n(cited == "Y").cast("double"), n(cited != "")).alias("citation_rate"),
        n(made_up == "Y").alias("made_up_answers"),
        F.avg("seconds").alias("avg_seconds"),
    ).select(
        F.when(F.col("_all") == 1, "All").otherwise(F.col("use_case")).alias("use_case"),
        "questions", "scored", "fully_correct", "accuracy", "citation_rate", "made_up_answers", "avg_seconds",
    )


def stockouts(stores: DataFrame) -> DataFrame:
    """Nested (product, days) lists -> rows; a store without any vanishes."""
    return stores.select("store", F.explode("stockouts").alias("s")).select("store", "s.product", "s.days")


# ---------------------------------------------------------------- cells -> rows


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where(F.coalesce(F.col("value"), F.lit("")) != "")


def header_infer(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, row, col, value) -> header names of each sheet: its first row with any text.

    Column positions up to the header's last one are covered; a blank one gets its letter.
    """
    from tallyglass.functions.text import column_letter

    keys = ["file_id", "sheet"]
    first = _filled(cells).groupBy(*keys).agg(F.min("row").alias("row"))
    head = cells.join(first, [*keys, "row"], "left_semi")
    named = F.when(F.coalesce(F.col("value"), F.lit("")) != "", F.col("value")).otherwise(column_letter(F.col("col")))
    return head.select(*keys, F.col("row").alias("header_row"), "col", named.alias("header"))


def sheet_units(cells: DataFrame) -> DataFrame:
    """One unit of text per data row: ``Header: value; Header: value``.  Blank cells and rows are left out.

    A row wider than the header uses column letters.  Cells are gathered into rows once; the first row of each sheet, found
    by a map-side minimum, travels to the others as one map of names.  A row's cells are the only thing collected together.
    """
    from tallyglass.functions.text import column_letter

    keys = ["file_id", "sheet"]
    # Cells without a place have no row; named here, the filter is the same for both readers of the rows.
    placed = _filled(cells).where(F.col("file_id").isNotNull() & F.col("sheet").isNotNull() & F.col("row").isNotNull())
    rows = placed.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_cells"))
    heads = rows.groupBy(*keys).agg(F.min("row").alias("_first"), F.min_by("_cells", "row").alias("_head"))
    # The last of several cells at one place names the column.
    names = F.map_from_entries(F.filter("_head", lambda c, i: F.coalesce(F.get("_head", i + 1)["col"] != c["col"], F.lit(True))))
    data = rows.join(heads.select(*keys, "_first", names.alias("_names")), keys).where(F.col("row") > F.col("_first"))

    def pair(c: Column) -> Column:
        name = F.coalesce(F.try_element_at("_names", c["col"]), column_letter(c["col"]))
        return F.struct(c["col"].alias("col"), F.concat(name, F.lit(": "), c["value"]).alias("pair"))

    return data.select(*keys, "row", sheet_row_text(F.transform("_cells", pair)).alias("text"))


def sheet_row_text(pairs: Column) -> Column:
    """(col, pair) structs of one row -> text in column order."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["pair"]), "; ")


def page_equivalents(units: DataFrame, kind: Column, pages: Column | None = None) -> DataFrame:
    """Size of a file in pages: real pages of a PDF, 3000 characters or 50 rows of the other kinds, at least 1."""
    pages = F.lit(None).cast("bigint") if pages is None else pages
    figures = units.groupBy("file_id").agg(
        F.max(kind).alias("kind"), F.max(pages).alias("_pages"),
        F.sum(F.length("text").cast("bigint")).alias("_chars"), F.count(F.lit(1)).alias("_rows"),
    )
    by_kind = (
        F.when(F.col("kind") == "pdf", F.col("_pages"))
        .when(F.col("kind") == "sheet", F.ceil(F.col("_rows") / 50))
        .otherwise(F.ceil(F.col("_chars") / 3000))
    )
    return figures.select("file_id", "kind", F.greatest(F.lit(1), by_kind).cast("bigint").alias("page_equivalent"))
