import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import dates, text
from tallyglass.operators import prices as P
from tallyglass.operators import sheets as S


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [
        (2, "South", "₹1,200", 3.0), (3, "North", "5%", None), (4, None, "12.", 1.0), (5, "south", "", 4.0),
        (7, "South", None, 5.0), (8, "Item 10", "300", 6.0), (9, "Item 9", "-20", float("nan")),
    ]
    return spark.createDataFrame(rows, "row int, Region string, Revenue string, Units double")


def test_numbers_in_cells(spark):
    cells = ["₹1,234.5", "5%", "12.", "", None, "1e3", "+.5", "abc", " 7 ", "1e999", "$-3"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(text.to_number(F.col("c")).alias("n"))
    assert [r.n for r in df.collect()] == [1234.5, 5.0, None, None, None, 1000.0, 0.5, None, 7.0, None, -3.0]


@pytest.mark.parametrize("spec,rows", [
    (("Region", "equals", " SOUTH "), [2, 5, 7]),
    (("Region", "not_equals", "South"), [3, 4, 8, 9]),          # an empty cell does satisfy not_equals
    (("Revenue", "equals", "1200"), [2]),
    (("Revenue", "not_equals", 5), [2, 4, 5, 7, 8, 9]),
    (("Region", "contains", "OUT"), [2, 5, 7]),
    (("Revenue", "greater_than", "100"), [2, 8]),
    (("Revenue", "less_than", 0), [9]),
    (("Revenue", "greater_than", "many"), []),
    (("Units", "equals", 3), [2]),
    (("Units", "not_equals", 3), [3, 4, 5, 7, 8, 9]),
    (("Region", "resembles", "x"), [2, 3, 4, 5, 7, 8, 9]),      # an unknown operator keeps the row
])
def test_filters(sheet, spec, rows):
    assert [r.row for r in S.sheet_filter(sheet, [spec]).orderBy("row").collect()] == rows


def test_filter_on_a_number_reaches_the_scan(tables):
    plan = S.sheet_filter(tables.lineitem, [("l_quantity", "greater_than", 10)])._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_groups_and_sorts(sheet):
    got = S.sheet_aggregate(sheet, "Region", ["Revenue"], "sum", sort="value_desc").collect()
    assert [(r.category, r.Revenue) for r in got] == [
        ("South", 1200.0), ("Item 10", 300.0), ("North", 5.0), ("Item 9", -20.0), ("(blank)", None), ("south", None)]
    low = S.sheet_aggregate(sheet, "Region", ["Revenue"], "max", sort="value_asc").collect()
    assert [r.category for r in low] == ["Item 9", "North", "Item 10", "South", "(blank)", "south"]
    names = S.sheet_aggregate(sheet, "Region", ["Revenue"], "sum", sort="category").collect()
    assert [r.category for r in names if r.category.startswith("Item")] == ["Item 9", "Item 10"]
    count = S.sheet_aggregate(sheet, "Region", ["Revenue"], "count").collect()
    assert [(r.category, r["Count of Revenue"]) for r in count][:4] == [("South", 1), ("North", 1), ("(blank)", 1), ("south", 0)]
    total = S.sheet_aggregate(sheet, None, ["Units"], "median").collect()   # unknown: sum
    assert [(r.category, r.Units) for r in total] == [("All selected rows", 19.0)]


def test_columns_are_found_like_labels_and_numbers_group_as_shown(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.5, 1.0), (3, None, 4.0)], "row int, Size double, `Net revenue` double")
    got = S.sheet_aggregate(df, " size", ["net Revenue "], "sum").collect()
    assert [(r.category, r["Net revenue"]) for r in got] == [("5", 2.0), ("5.5", 1.0), ("(blank)", 4.0)]
    with pytest.raises(ValueError, match="columns: row, Size, Net revenue"):
        S.sheet_aggregate(df, "Colour", ["Size"])


def test_listing_refuses_too_many_rows(sheet):
    assert [r.category for r in S.sheet_rows_listing(sheet, "Region", ["Units"]).collect()][2] == "Row 4"
    with pytest.raises(Exception, match="more than 3 rows"):
        S.sheet_rows_listing(sheet, "Region", ["Units"], max_rows=3).collect()


def test_column_without_numbers_is_refused(sheet):
    grouped = S.sheet_aggregate(sheet, "Units", ["Region"], "sum")
    with pytest.raises(Exception, match="has no numbers"):
        S.reject_empty_series(grouped, ["Region"]).collect()
    fine = S.sheet_aggregate(sheet, "Region", ["Units"])
    assert S.reject_empty_series(fine, ["Units"]).count() == 6


@pytest.mark.parametrize("how", ["sum", "average", "min", "max"])
def test_aggregate_refuses_a_column_without_numbers(sheet, how):
    with pytest.raises(Exception, match="column “Region” has no numbers in the selected rows"):
        S.sheet_aggregate(sheet, "Units", ["Units", "Region"], how).collect()
    assert S.sheet_aggregate(sheet, "Units", ["Region"], "count").count() > 0
    assert S.sheet_aggregate(sheet, "Region", ["Units"], how, filters=[("Region", "equals", "no such region")]).count() == 0


def test_guards(spark):
    pie = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "category string, v double")
    assert S.chart_guards(pie, ["v"], "pie").head().error == "a pie chart needs positive values for every part"
    assert S.chart_guards(pie, ["v"], "bar").head().error is None
    assert S.chart_guards(pie.limit(0), ["v"], "line").head().error.startswith("there is nothing")
    assert S.pie_share(spark.createDataFrame([("a", 0.0)], "category string, v double"), "v").head().share_pct == 0.0


def test_cells(spark):
    rows = [("f", "s", 1, 0, ""), ("f", "s", 2, 0, "Region"), ("f", "s", 2, 1, ""), ("f", "s", 3, 0, "South"), ("f", "s", 3, 1, "14"),
            ("f", "s", 4, 0, ""), ("f", "s", 5, 0, "North"), ("f", "s", 5, 27, "x")]
    cells = spark.createDataFrame(rows, "file_id string, sheet string, row int, col int, value string")
    got = [(r.row, r.text) for r in S.sheet_units(cells).orderBy("row").collect()]
    assert got == [(3, "Region: South; Column B: 14"), (5, "Region: North; Column AB: x")]


def test_units_of_a_hot_sheet_and_odd_headers(spark, many_partitions):
    """Unsorted cells, a header row below blank ones, a blank name, wide rows, a sheet of its header alone."""
    rows = [("f", "hot", 1, 0, None), ("f", "hot", 2, 0, "A"), ("f", "hot", 2, 1, " "), ("f", "hot", 2, 3, "D"), ("g", "only", 7, 2, "x")]
    rows += [("f", "hot", r, c, f"{r}.{c}") for r in range(3, 303) for c in (4, 3, 1, 0) if (r + c) % 5]
    cells = spark.createDataFrame(rows, "file_id string, sheet string, row int, col int, value string").repartition(9)
    got = {r.row: r.text for r in S.sheet_units(cells).collect()}
    names = {0: "A", 1: " ", 3: "D", 4: "Column E"}
    assert got == {r: "; ".join(f"{names[c]}: {r}.{c}" for c in (0, 1, 3, 4) if (r + c) % 5) for r in range(3, 303)}


def test_units_gather_cells_once(spark):
    """The rows are made by one exchange of the cells; the header's branch reads it again."""
    rows = [("f", "s", r, c, f"{r}.{c}") for r in range(50) for c in range(3)]
    df = S.sheet_units(spark.createDataFrame(rows, "file_id string, sheet string, row int, col int, value string"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Scan ExistingRDD") <= 2


def test_cell_text(spark):
    df = spark.createDataFrame([(14.0, dt.datetime(2026, 7, 1), " a \n b"), (12.4, dt.datetime(2026, 7, 1, 9, 5), None)],
                               "n double, t timestamp, s string")
    got = df.select(text.cell_text(number=F.col("n")), text.cell_text(stamp=F.col("t")), text.cell_text(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("14", "2026-07-01", "a   b"),
                                      ("12.4", "2026-07-01 09:05:00", "")]


def test_column_letters(spark):
    index = [0, 25, 26, 51, 701, 702, 18277]
    df = spark.createDataFrame([(i,) for i in index], "i int").select(text.column_letter(F.col("i")).alias("c"))
    assert [r.c for r in df.collect()] == [f"Column {x}" for x in ("A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ")]


def test_source_labels(spark):
    rows = [("F", "a.pdf", None, None, None, 3, None), ("", "b.docx", None, None, None, None, "Leave"), (None, "c.docx", None, None, None, 0, ""),
            ("F/G", "d.xlsx", "Rev", 2, 5, 9, "x"), ("", "d.xlsx", "Rev", 2, 2, None, None)]
    cols = ["folder", "name", "sheet", "row_start", "row_end", "page", "section"]
    df = spark.createDataFrame(rows, "folder string, name string, sheet string, row_start int, row_end int, page int, section string")
    got = [r[0] for r in df.select(text.source_label(*(F.col(c) for c in cols))).collect()]
    assert got == ["F/a.pdf, page 3", 'b.docx, section "Leave"', "c.docx", 'F/G/d.xlsx, sheet "Rev", rows 2-5', 'd.xlsx, sheet "Rev", row 2']


# ---------------------------------------------------------------- prices


def days(spark, rows, schema):
    df = spark.createDataFrame([tuple(r) for r in rows], schema.replace("date date", "date string"))
    return df.withColumn("date", F.to_date("date"))


def test_as_of_over_weekends(spark):
    prices = days(spark, [("A", "2024-01-05", 10.0), ("A", "2024-01-08", 11.0), ("A", "2024-01-09", 0.0), ("A", "2024-01-10", 5.0)],
                  "symbol string, date date, close double")
    heads = days(spark, [("A", d) for d in ("2024-01-05", "2024-01-06", "2024-01-07", "2024-01-07", "2024-01-09", "2024-01-10", "2024-01-11")] + [("B", "2024-01-05")],
                 "symbol string, date date")
    found = {str(r.date): (str(r.price_date), r.close) for r in P.price_on_or_after(heads, prices).collect()}
    assert found == {"2024-01-05": ("2024-01-05", 10.0), "2024-01-06": ("2024-01-08", 11.0), "2024-01-07": ("2024-01-08", 11.0),
                     "2024-01-09": ("2024-01-09", 0.0), "2024-01-10": ("2024-01-10", 5.0)}
    moves = {str(r.date): r.next_day_pct for r in P.next_day_return(heads, prices).collect()}
    # Two headline dates share one price day and both count; a zero base gives no figure; the last day has no next.
    assert moves == {"2024-01-05": pytest.approx(10.0), "2024-01-06": -100.0, "2024-01-07": -100.0, "2024-01-09": None}
    assert P.horizon_move(prices, "2024-01-15", 7).head().movement_pct == pytest.approx((5 - 11) / 11 * 100)
    assert P.horizon_move(prices, "2024-01-15", 6).head().movement_pct is None


def test_summary_keeps_symbols_without_any_side(spark):
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    heads = days(spark, [("A", "2024-01-05", 0.4), ("A", "2024-01-05", 0.2), ("A", "2024-01-06", -0.3)], "symbol string, date date, score double")
    prices = days(spark, [("A", "2024-01-05", 10.0), ("A", "2024-01-06", 11.0), ("B", "2024-01-05", 4.0)], "symbol string, date date, close double")
    rows = {r.symbol: r for r in P.status_notes(P.stock_summary(symbols, heads, prices, "2024-01-07", 7), 7).collect()}
    assert (rows["A"].headline_count, rows["A"].date_count, rows["A"].next_day_sample_size) == (3, 2, 1)
    assert rows["A"].net_sentiment == pytest.approx(0.0)      # mean of daily means, not of articles
    assert rows["A"].notes == "A: next-day figure only covers dates with a following trading day so far."
    assert (rows["B"].headline_count, rows["B"].net_sentiment, rows["B"].movement_pct) == (0, None, 0.0)
    assert rows["C"].notes == ("C: no headlines found within the last 7 days. C: no trading data found within the last 7 days.")


def test_published_dates(spark):
    written = ["2026-09-09 20:42:36", "Wed, 09 Sep 2026 04:42:36 GMT", "Wed, 09 Sep 2026 23:30:00 +0530", "2026-09-09T18:31:00Z",
               "2026-09-09", "soon", "", None]
    df = spark.createDataFrame([(w,) for w in written], "w string").select(dates.ist_date(dates.parse_published(F.col("w"))).alias("d"))
    assert [str(r.d) if r.d else None for r in df.collect()] == [
        "2026-09-10", "2026-09-09", "2026-09-09", "2026-09-10", "2026-09-09", None, None, None]


def test_half_up_and_half_even(spark):
    df = spark.createDataFrame([(-0.00005, 3650.0), (0.12345, 3550.0), (-2.5, 3651.0)], "x double, h double")
    got = df.select(text.half_up(F.col("x"), 4).alias("a"), text.hundreds(F.col("h")).alias("b")).collect()
    assert [r.a for r in got] == [0.0, pytest.approx(0.1235), -2.5] and [r.b for r in got] == [3600.0, 3600.0, 3700.0]


def test_windows_of_prices_follow_a_map_side_reduction(tables):
    plan = P.next_close(tables.prices())._jdf.queryExecution().toString()
    assert plan.index("Window") < plan.index("partial_max_by")


def test_calculation_of_many_categories(spark):
    from tallyglass.operators.sheets import calculate_text

    grouped = spark.range(250).selectExpr("concat('c', id) category", "id first_row", "id / 2 AS v")
    lines = [r.line for r in calculate_text(grouped, ["v"], "first_row", "sheet 1", "By category.").orderBy("pos").collect()]
    assert len(lines) == 253 and lines[0] == "Category | v" and lines[4] == "c3 | 1.5" and lines[-1] == "Source: sheet 1. By category."


def test_only_finite_numbers_compare(spark):
    from tallyglass.operators.sheets import sheet_filter

    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (3.0,)], "x double")
    assert [r.x for r in sheet_filter(df, [("x", "greater_than", 2)]).collect()] == [3.0]
    assert [r.x for r in sheet_filter(df, [("x", "less_than", 2)]).collect()] == [1.0]


def test_categories_in_the_order_a_reader_expects(spark):
    names = ["zebra", "(blank)", "Apfel", "item 10", "Äpfel", "Item 9", "apfel", "eclair 2", "éclair", "item 9", "item 010", "Ångström", "b"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "category string, first_row long").repartition(5)
    got = [r.category for r in S.category_sort(rows, "category", "first_row").collect()]
    assert got == ["(blank)", "Ångström", "apfel", "Apfel", "Äpfel", "b", "éclair", "eclair 2", "item 9", "Item 9", "item 10", "item 010", "zebra"]
