"""A whole calculation request: find the sheet, check its columns, compute, and say where the figures come from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import joined_path, same_key
from tallyglass.operators.sheets import (
    AGGREGATIONS, calculate_text, category_sort, header_infer, row_span, series_name, sheet_aggregate, sheet_rows_listing,
)

# Rows that may be listed one by one, and the names of the totals.  The sentences of refusals, the source line and the
# names of the settings below are fixed wording too.
MAX_LISTED = 200
TOTALS = {
    "sum": "Sum", "average": "Average", "count": "Count", "min": "Minimum", "max": "Maximum", "none": "Each row (no totals)",
}


@dataclass(frozen=True)
class Request:
    """What is asked of one sheet.  Names match whatever their case and outer blanks; filters are (column, op, value)."""

    file: str
    sheet: str
    value_columns: tuple[str, ...]
    folder: str | None = None
    category_column: str | None = None
    aggregation: str = "sum"
    filters: tuple[tuple, ...] = ()
    sort: str = "sheet_order"


@dataclass(frozen=True)
class Sheet:
    """A sheet that was found: where it lies and its columns, by name, in sheet order."""

    file_id: object
    path: str
    name: str
    header_row: int
    columns: Mapping[str, int] = field(default_factory=dict)

    def column(self, asked: str) -> str:
        for name in self.columns:
            if _key(name) == _key(asked):
                return name
        raise ValueError(f"sheet “{self.name}” has no column “{asked}” (columns: {', '.join(self.columns)})")


def _key(name: str) -> str:
    return name.strip().lower()


def find_sheet(request: Request, files: DataFrame, cells: DataFrame) -> Sheet:
    """The sheet asked for in files(file_id, pos, name, folder, sheets) and cells(file_id, sheet, row, col, value).

    Of the files of that name that hold sheets the first in the asked folder is taken, else the first of all.  One file row
    and the header cells of one sheet come to the driver, no more.
    """
    named = files.where((same_key(F.col("name")) == _key(request.file)) & (F.col("sheets") > 0))
    astray = F.lit(False) if request.folder is None else same_key(F.coalesce("folder", F.lit(""))) != _key(request.folder)
    found = named.orderBy(astray, "pos").select("file_id", "name", joined_path(F.col("folder"), F.col("name")).alias("path")).head()
    if found is None:
        raise ValueError(f"the spreadsheet “{request.file}” isn’t among your documents")
    own = cells.where((F.col("file_id") == F.lit(found.file_id)) & (same_key(F.col("sheet")) == _key(request.sheet)))
    heads = sorted(header_infer(own).collect(), key=lambda h: (h.sheet, h.col))
    if not heads:
        raise ValueError(f"“{found.name}” has no sheet called “{request.sheet}”")
    columns: dict[str, int] = {}
    for head in heads:
        if head.sheet == heads[0].sheet:
            columns.setdefault(head.header, head.col)
    return Sheet(found.file_id, found.path, heads[0].sheet, heads[0].header_row, columns)


def sheet_rows(sheet: Sheet, cells: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """(row, ...): the data rows with any text, cells laid side by side by one map-side aggregate.

    ``columns`` gives each header its column name in the result.
    """
    own = cells.where((F.col("file_id") == F.lit(sheet.file_id)) & (F.col("sheet") == sheet.name) & (F.col("row") > sheet.header_row))
    filled = own.where(F.coalesce("value", F.lit("")) != "")
    return filled.groupBy("row").agg(
        *[F.max(F.when(F.col("col") == sheet.columns[head], F.col("value"))).alias(name) for head, name in columns.items()])


def _source(path: str, sheet: str, span: DataFrame) -> Column:
    """Where the figures come from, with the first and last row used; known when the plan runs."""
    used = F.format_string(" · rows %d–%d (%d used)", "first_row", "last_row", "used")
    return F.concat(F.lit(f"{path} · sheet “{sheet}”"), span.select(F.when(F.col("used") > 0, used).otherwise("").alias("used")).scalar())


def calculate(request: Request, files: DataFrame, cells: DataFrame) -> DataFrame:
    """The answer to a request as lines(pos, line): a head, one line per category, a blank line, source and settings.

    A request that names what is not there gives one line that says so.  A column without a number in the selected rows, or
    too many rows to list, fails when the plan runs.
    """
    try:
        return _calculated(request, files, cells)
    except ValueError as problem:
        return files.sparkSession.createDataFrame([(0, f"Could not calculate: {problem}.")], "pos bigint, line string")


def _calculated(request: Request, files: DataFrame, cells: DataFrame) -> DataFrame:
    sheet = find_sheet(request, files, cells)
    category = sheet.column(request.category_column) if request.category_column else None
    values = [sheet.column(c) for c in request.value_columns]
    if not values:
        raise ValueError("the proposal didn’t name a column to plot")
    filters = [(sheet.column(c), op, value) for c, op, value in request.filters]
    how = request.aggregation if request.aggregation in AGGREGATIONS else "sum"
    if how == "none" and category is None:
        raise ValueError("“each row” needs a category column")
    wanted = dict.fromkeys([*([category] if category else []), *values, *(f[0] for f in filters)])
    # Working names, since a header may be called anything, ``row`` too.
    plain = {c: f"c{i}" for i, c in enumerate(wanted)}
    rows = sheet_rows(sheet, cells, plain)
    short = [(plain[c], op, value) for c, op, value in filters]
    if how == "none":
        figures = sheet_rows_listing(rows, plain[category], [plain[v] for v in values], short, max_rows=MAX_LISTED)
        figures = category_sort(figures.withColumnRenamed("row", "first_row"), request.sort, plain[values[0]])
    else:
        figures = sheet_aggregate(rows, plain[category] if category else None, [plain[v] for v in values], how, short, request.sort)
    names = {series_name(plain[v], how): series_name(v, how) for v in values}
    # Sorted rows lie in the order of their partitions, and so do these numbers.
    placed = figures.withColumn("_pos", F.monotonically_increasing_id())
    told = "; ".join(f"{c} {op.replace('_', ' ')} “{v}”" for c, op, v in filters) or "None (all rows)"
    settings = (f"X axis (categories): {category or 'None (grand total)'}; Y values: {', '.join(values)}; "
                f"Totals: {TOTALS[how]}; Filters: {told}.")
    return calculate_text(placed, list(names), "_pos", _source(sheet.path, sheet.name, row_span(rows, short)), settings, list(names.values()))
