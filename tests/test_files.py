from pyspark.sql import functions as F

from tallyglass.functions import text
from tallyglass.operators import answers as A
from tallyglass.operators import files as L
from tallyglass.operators import lookup as K


def entries(spark, rows):
    return spark.createDataFrame([(z, i, p, s) for i, (z, p, s) in enumerate(rows)], "zip string, pos long, path string, size long")


def test_nested_archive_keeps_its_folders(spark):
    rows = [("OneDrive_2026.zip", p, 10) for p in (
        "Board Reports/2026/Q2/report.pdf", "Board Reports/Finance/sales.xlsx", "Board Reports/notes.txt",
        "__MACOSX/Board Reports/._x.pdf", "Board Reports/~$lock.docx", "Board Reports/")]
    got = {(r.folder, r.name, r.status, r.reason) for r in L.archive_entries(entries(spark, rows)).collect()}
    assert got == {("Board Reports/2026/Q2", "report.pdf", "ready", None), ("Board Reports/Finance", "sales.xlsx", "ready", None),
                   ("Board Reports", "notes.txt", "failed", "unsupported file type")}


def test_flat_archive_gets_its_own_name(spark):
    got = L.archive_entries(entries(spark, [("Q2 pack.zip", "report.pdf", 1), ("Q2 pack.zip", "sub\\report.pdf", 1)]))
    assert sorted(r.folder for r in got.collect()) == ["Q2 pack", "Q2 pack/sub"]


def test_archive_limits(spark):
    mb = 1024 * 1024
    rows = [("b.zip", f"f{i}.pdf", 4 * mb) for i in range(3)] + [("c.zip", f"d/f{i}.pdf", mb) for i in range(5)] + [("c.zip", "d/big.pdf", 21 * mb)]
    got = L.archive_entries(entries(spark, rows), max_files=4, max_total_mb=8).collect()
    assert {r.reason for r in got if r.zip == "b.zip"} == {"zip expands to more than 8 MB"}
    assert sorted((r.name, r.reason) for r in got if r.zip == "c.zip" and r.reason) == [
        ("big.pdf", "larger than 20 MB"), ("f4.pdf", "file limit reached")]


def test_catalog_lines(spark):
    files = spark.createDataFrame([(0, "a.pdf", "F", 3, 0, 3), (1, "b.docx", None, 0, 0, 2), (2, "c.xlsx", "", 0, 2, 9)],
                                  "pos long, name string, folder string, pages int, sheets int, units int")
    got = [r.line for r in L.document_catalog(files).orderBy("pos").collect()]
    assert got == ['- file "a.pdf" (folder "F", path "F/a.pdf"): PDF, 3 pages',
                   '- file "b.docx" (folder "", path "b.docx"): Word document, 2 section(s)',
                   '- file "c.xlsx" (folder "", path "c.xlsx"): spreadsheet, 2 sheet(s)']


def test_suggestions(spark):
    symbols = spark.createDataFrame([("TCS", "Tata Consultancy", 0), ("INFY", "Infosys", 1), ("TATAPOWER", "Tata Power", 2), ("X", "The Intata", 3)],
                                    "symbol string, name string, pos long")
    got = [r.symbol for r in K.suggest_symbols(symbols, ["tata"]).orderBy("n").collect()]
    assert got == ["TCS", "TATAPOWER", "X"]
    assert K.suggest_symbols(symbols, ["  "]).count() == 0
    params = spark.createDataFrame([(1, " infosys, ,nothing, INFY , TCS")], "param_id int, param string")
    assert [r.symbol for r in K.parse_symbol_param(params, symbols).collect()] == ["INFY"]   # sliced before it is resolved


def test_replies(spark):
    replies = ["I couldn’t find this in your documents", " I couldn't find this in your documents.. ", "I couldn't find this in your documents. But see [1].",
               "Found [2][2], [9] and [1], [99999999999]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, text string")
    got = df.select(text.is_not_found(F.col("text")), text.is_not_found_prefix(F.col("text")), text.cited_numbers(F.col("text"), F.lit(5))).collect()
    assert [tuple(r) for r in got] == [(True, False, []), (True, True, []), (False, True, [1]), (False, False, [1, 2])]
    kinds = A.answer_records(df, F.lit(5), F.col("i") == 3).collect()
    assert [r.kind for r in kinds] == ["notfound", "notfound", "answer", "chart"]


def test_excerpt_charts_are_checked(spark):
    schema = "proposal_id int, n_hits int, categories array<string>, series array<struct<name:string,values:array<double>,refs:array<int>>>"
    rows = [(1, 3, ["a", "b"], [("s", [1.0, None], [1, 3])]), (2, 3, ["a", "b"], [("s", [1.0], [1, 2])]), (3, 3, ["a"], [("s", [1.0], [4])])]
    got = A.excerpt_chart(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.proposal_id, r.category, r.value, r.ref) for r in got if r.error is None) == [(1, "a", 1.0, 1), (1, "b", None, 3)]
    assert {r.proposal_id: r.error is not None for r in got} == {1: False, 2: True, 3: True}


def test_markdown(spark):
    told = "Lead\n| A | B |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\n\n- x\n* y\n\nlast | not a table"
    rows = A.markdown_blocks(spark.createDataFrame([(1, told)], "answer_id int, text string")).collect()
    cells = sorted((r.row, r.col, r.text) for r in rows if r.kind == "table")
    assert cells == [(0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, ""), (2, 0, "2"), (2, 1, "3")]
    assert sorted(r.text for r in rows if r.kind != "table") == ["Lead", "last | not a table", "x", "y"]


def test_suggestions_for_a_table_of_typed_texts(spark):
    names = [("T1", "Tata Steel", 1), ("T2", "Old Tata", 2), ("TATA", None, 3), ("X", "ab", 4), (None, "tat", 5)]
    symbols = spark.createDataFrame(names, "symbol string, name string, pos int")
    texts = ["tata", " TATA ", "t", "steel", "tata steel!", "  ", None, "b", "ta"]
    typed = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = sorted((r.query_id, r.n, r.pos) for r in K.suggest_for_typed(symbols, typed, limit=3).collect())
    one_by_one = K.suggest_symbols(symbols, [t or "" for t in texts], 3)
    assert got == sorted((r.query_id, r.n, r.pos) for r in one_by_one.collect()) and len(got) == 14
    assert K.suggest_for_typed(symbols, typed.limit(0)).count() == 0


def test_only_typed_runs_of_symbols_go_on(spark):
    """Runs that nobody typed are left in their task; a run counts once a symbol, and none spans name and symbol."""
    symbols = spark.createDataFrame(
        [("anna", "banana", 1), ("ab", "xyz", 2), (None, "Ünanü", 3), ("nan", None, 4), ("", "", 5), ("ab", "xyz", 2)],
        "symbol string, name string, pos int")
    wanted = spark.createDataFrame([("ana",), ("nan",), ("a",), ("za",), ("ü",)], "_gram string")
    got = sorted((r._gram, r.pos) for r in K._runs_of(symbols, wanted, [1, 3]).collect())
    assert got == [("a", 1), ("a", 2), ("a", 2), ("a", 3), ("a", 4), ("ana", 1), ("nan", 1), ("nan", 3), ("nan", 4), ("ü", 3)]
    asked = [" NAN ", "ana", "zab", "an", "ü", "banana", "", None, "ana"]
    typed = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    found = {(r.query_id, r.pos) for r in K.suggest_for_typed(symbols, typed).collect()}
    rows = [(r.pos, (r.name or "").lower(), (r.symbol or "").lower()) for r in symbols.collect()]
    assert found == {(i, pos) for i, q in enumerate(asked) if (q or "").strip()
                     for pos, *labels in rows if any(q.strip().lower() in label for label in labels)}
