"""Whole calculation requests over small workbooks worked out by hand."""

import pytest

from tallyglass.operators import requests as Q

CELLS = "file_id string, sheet string, row long, col int, value string"


def cells_of(file_id, sheet, rows, first=1):
    return [(file_id, sheet, first + i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)]


@pytest.fixture(scope="module")
def books(spark):
    files = spark.createDataFrame([
        ("a", 0, "Sales.xlsx", "old", 1), ("b", 1, "sales.xlsx", "new", 2), ("c", 2, "sales.xlsx", "none", 0), ("d", 3, "odd.xlsx", None, 1),
    ], "file_id string, pos int, name string, folder string, sheets int")
    cells = spark.createDataFrame([
        *cells_of("a", "Data", [["Region", "Units"], ["x", "1"]]),
        *cells_of("b", "Data", [["", ""], ["Region", "Units", "row"], ["South", "1,000", "q"], ["north", "2", ""], ["South", "n/a", "r"],
                                ["", "7.5", ""], ["", "", ""]], 3),
        *cells_of("b", "Words", [["A", "B"], ["x", "y"]]),
        *cells_of("d", "S", [["Row", "file_id"], ["k", "3"], ["m", "4"]]),
    ], CELLS).repartition(4)
    return files, cells


def lines(request, books):
    return [r.line for r in Q.calculate(request, *books).orderBy("pos").collect()]


@pytest.mark.parametrize("sort, order", [
    ("sheet_order", ["South | 1000", "north | 2", "(blank) | 7.5"]), ("value_asc", ["north | 2", "(blank) | 7.5", "South | 1000"]),
    ("value_desc", ["South | 1000", "(blank) | 7.5", "north | 2"]), ("category", ["(blank) | 7.5", "north | 2", "South | 1000"])])
def test_totals_by_category(books, sort, order):
    got = lines(Q.Request(" SALES.xlsx", "data ", ("units",), "New", "REGION", "sum", (), sort), books)
    assert got == ["Category | Units", *order, "", "Source: new/sales.xlsx · sheet “Data” · rows 5–8 (4 used). X axis (categories): Region; "
                   "Y values: Units; Totals: Sum; Filters: None (all rows)."]


def test_folder_astray_filters_and_grand_total(books):
    got = lines(Q.Request("sales.xlsx", "Data", ("Region",), "nowhere", aggregation="count", filters=(("units", "equals", 1),)), books)
    assert got == ["Category | Count of Region", "All selected rows | 1", "", "Source: old/Sales.xlsx · sheet “Data” · rows 2–2 (1 used). X axis "
                   "(categories): None (grand total); Y values: Region; Totals: Count; Filters: Units equals “1”."]


def test_rows_one_by_one_with_headers_of_any_name(books):
    got = lines(Q.Request("odd.xlsx", "s", ("file_id",), category_column="row", aggregation="none", sort="value_desc"), books)
    assert got[:3] == ["Category | file_id", "m | 4", "k | 3"] and got[4].startswith("Source: odd.xlsx · sheet “S” · rows 2–3 (2 used).")


@pytest.mark.parametrize("request_, told", [
    (Q.Request("x.xlsx", "Data", ("Units",)), "the spreadsheet “x.xlsx” isn’t among your documents"),
    (Q.Request("sales.xlsx", "Date", ("Units",)), "“Sales.xlsx” has no sheet called “Date”"),
    (Q.Request("sales.xlsx", "Data", ("Price",), "new"), "sheet “Data” has no column “Price” (columns: Region, Units, row)"),
    (Q.Request("sales.xlsx", "Data", ("Units",), aggregation="none"), "“each row” needs a category column"),
    (Q.Request("sales.xlsx", "Data", ()), "the proposal didn’t name a column to plot")])
def test_what_is_not_there_is_said(books, request_, told):
    assert lines(request_, books) == [f"Could not calculate: {told}."]


def test_a_column_without_numbers_is_refused(books):
    with pytest.raises(Exception, match="no numbers in the selected rows"):
        lines(Q.Request("sales.xlsx", "Words", ("B",), "new", "A"), books)


def test_an_empty_selection_has_no_rows_to_name(books):
    got = lines(Q.Request("sales.xlsx", "Data", ("Units",), "new", "Region", "count", (("Units", "greater_than", 5000),)), books)
    assert got[0] == "Category | Count of Units" and "“Data”. X axis" in got[-1] and len(got) == 3
