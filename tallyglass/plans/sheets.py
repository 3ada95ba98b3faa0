"""Sheet questions, document statistics and answer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import text
from tallyglass.functions.text import JS_BLANK
from tallyglass.operators import answers as A
from tallyglass.operators import requests as Q
from tallyglass.operators import sheets as S
from tallyglass.plans.base import query
from tallyglass.sources import writers

ROW = "l_orderkey * 8 + l_linenumber"


def money(df, *columns, places=4):
    """Sums of prices compared at a fixed number of places: the order of a float sum is the engine's choice."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---------------------------------------------------------------- the general question

_QUESTION = [("l_quantity", "greater_than", 10), ("l_returnflag", "not_equals", "A"), ("l_shipdate", "contains", "199")]


@query("sheet_filter", f"""SELECT {ROW} AS row, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity > 10 AND l_returnflag <> 'A' AND contains(CAST(l_shipdate AS VARCHAR), '199')""")
def _(t):
    return S.sheet_filter(t.sheet(), _QUESTION).select("row", "l_quantity", "l_returnflag")


@query("sheet_aggregate", f"""SELECT l_returnflag AS category, min({ROW}) AS first_row,
round(sum(l_extendedprice), 4) AS l_extendedprice, sum(l_quantity) AS l_quantity
FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'A' AND contains(CAST(l_shipdate AS VARCHAR), '199') GROUP BY 1""")
def _(t):
    out = S.sheet_aggregate(t.sheet(), "l_returnflag", ["l_extendedprice", "l_quantity"], "sum", _QUESTION, "value_desc")
    return money(out, "l_extendedprice")


@query("sheet_aggregate_average", f"""SELECT l_linestatus AS category, min({ROW}) AS first_row,
round(avg(l_discount), 8) AS l_discount FROM lineitem WHERE l_quantity < 25 GROUP BY 1""")
def _(t):
    out = S.sheet_aggregate(t.sheet(), "l_linestatus", ["l_discount"], "average", [("l_quantity", "less_than", "25")])
    return money(out, "l_discount", places=8)


@query("sheet_aggregate_count", f"""SELECT 'All selected rows' AS category, min({ROW}) AS first_row,
count(*) AS "Count of l_tax", count(*) AS "Count of l_shipdate" FROM lineitem WHERE l_discount = 0.05""")
def _(t):
    return S.sheet_aggregate(t.sheet(), None, ["l_tax", "l_shipdate"], "count", [("l_discount", "equals", "5e-2")])


@query("sheet_aggregate_min_max", """SELECT o_orderpriority AS category, min(o_orderkey) AS first_row,
min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def _(t):
    ask = lambda how, name: S.sheet_aggregate(
        t.orders, "o_orderpriority", ["o_totalprice"], how, [("o_orderstatus", "equals", " f ")], "category", "o_orderkey"
    ).withColumnRenamed("o_totalprice", name)
    return ask("min", "lowest").join(ask("max", "highest").drop("first_row"), "category")


@query("category_sort", """SELECT c_mktsegment AS category, min(c_custkey) AS first_row, round(sum(c_acctbal), 4) AS c_acctbal
FROM customer GROUP BY 1""")
def _(t):
    out = S.sheet_aggregate(t.customer, "c_mktsegment", ["c_acctbal"], "sum", (), "value_asc", "c_custkey")
    return money(out, "c_acctbal")


@query("natural_sort", """SELECT p_brand, count(*) AS n, lower(regexp_extract(p_brand, '^([^0-9]*)', 1))
|| lpad(regexp_extract(p_brand, '([0-9]+)', 1), 20, '0') AS sort_key FROM part GROUP BY 1""")
def _(t):
    brands = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return brands.withColumn("sort_key", text.natural_key(F.col("p_brand"))).orderBy("sort_key")


@query("sheet_rows_listing", """SELECT r_regionkey AS row, r_name AS category, r_regionkey::DOUBLE AS r_regionkey FROM region""")
def _(t):
    sheet = t.region.withColumn("row", F.col("r_regionkey"))
    return S.sheet_rows_listing(sheet, "r_name", ["r_regionkey"])


@query("row_span", f"""SELECT min({ROW}) AS first_row, max({ROW}) AS last_row, count(*) AS used FROM lineitem
WHERE l_quantity > 10 AND l_returnflag <> 'A' AND contains(CAST(l_shipdate AS VARCHAR), '199')""")
def _(t):
    return S.row_span(t.sheet(), _QUESTION)


@query("chart_guards", """
WITH g AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem), f AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)
SELECT 'bar' AS kind, n AS categories, CASE WHEN n > 60 THEN 'too many bars to read; ask for a line chart instead'
  WHEN n > 50 THEN 'more than 50 categories; ask for a filter or a grouping' END AS error FROM g
UNION ALL SELECT 'line', n, CASE WHEN n > 50 THEN 'more than 50 categories; ask for a filter or a grouping' END FROM g
UNION ALL SELECT 'pie', n, CASE WHEN n > 6 THEN 'a pie chart is only readable with up to 6 parts' END FROM f""")
def _(t):
    by = lambda c: S.sheet_aggregate(t.sheet(), c, ["l_quantity"])
    checks = [
        S.chart_guards(by(c), ["l_quantity"], kind).withColumn("kind", F.lit(kind))
        for c, kind in (("l_suppkey", "bar"), ("l_suppkey", "line"), ("l_returnflag", "pie"))
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("pie_share", """SELECT l_returnflag AS category, sum(l_quantity) AS l_quantity,
round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * 100, 6) AS share_pct FROM lineitem GROUP BY 1""")
def _(t):
    out = S.pie_share(S.sheet_aggregate(t.sheet(), "l_returnflag", ["l_quantity"]), "l_quantity")
    return out.withColumn("share_pct", F.round("share_pct", 6))


@query("to_number", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price,
CASE WHEN l_linenumber = 4 THEN NULL ELSE round(l_discount * 100, 0) END AS discount FROM lineitem""")
def _(t):
    line = F.col("l_linenumber")
    price = F.concat(F.lit("₹ "), F.format_number("l_extendedprice", 2))
    discount = F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        text.to_number(F.when(line == 3, "12.").otherwise(price)).alias("price"),
        text.to_number(F.when(line == 4, "").otherwise(discount)).alias("discount"))


@query("same_text", """SELECT c_custkey, c_mktsegment = 'BUILDING' AS same, c_custkey % 2 = 0 AS blank FROM customer""")
def _(t):
    spaced = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit("\t"))
    empty = F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise("x")
    return t.customer.select(
        "c_custkey", text.same_text(spaced, F.lit("Building")).alias("same"),
        text.same_text(empty, F.lit("  ")).alias("blank"))


@query("calculate_text", """
WITH g AS (SELECT l_returnflag AS c, min(l_orderkey * 8 + l_linenumber) AS r, round(sum(l_quantity), 4) AS q,
  round(avg(l_tax), 4) AS x FROM lineitem GROUP BY 1)
SELECT -4611686018427387904 AS pos, 'Category | l_quantity | l_tax' AS line
UNION ALL SELECT r, c || ' | ' || regexp_replace(regexp_replace(printf('%.4f', q), '0+$', ''), '\\.$', '') || ' | '
  || regexp_replace(regexp_replace(printf('%.4f', x), '0+$', ''), '\\.$', '') FROM g
UNION ALL SELECT 4611686018427387904, '' UNION ALL SELECT 4611686018427387905, 'Source: lineitem. By l_returnflag.'""")
def _(t):
    one = S.sheet_aggregate(t.sheet(), "l_returnflag", ["l_quantity"], "sum")
    two = S.sheet_aggregate(t.sheet(), "l_returnflag", ["l_tax"], "average").drop("first_row")
    both = one.join(two, "category")
    return S.calculate_text(both, ["l_quantity", "l_tax"], "first_row", "lineitem", "By l_returnflag.")


@query("write_chart_csv", """
WITH g AS (SELECT o_orderpriority AS c, min(o_orderkey) AS r, count(*) AS n FROM orders GROUP BY 1)
SELECT -4611686018427387904 AS pos, 'Priority,"Orders, all"' AS line
UNION ALL SELECT r, CASE WHEN c LIKE '%,%' THEN '"' || c || '"' ELSE c END || ',' || n FROM g
UNION ALL SELECT 4611686018427387904, '' UNION ALL SELECT 4611686018427387905, '"Source: orders, all rows"'""")
def _(t):
    grouped = t.orders.groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.min("o_orderkey").alias("first_row"), F.count(F.lit(1)).alias("Orders, all"))
    return writers.chart_csv_lines(grouped, "category", ["Orders, all"], "first_row", "orders, all rows", "Priority")


@query("resolve_sheet", """
SELECT p_partkey AS request_id, CASE WHEN p_size < 45 THEN s.s_name END AS found_file,
  CASE WHEN p_size < 45 THEN n.n_name END AS found_folder,
  CASE WHEN p_size < 45 AND p_size >= 5 THEN 'Rows' END AS found_sheet,
  CASE WHEN p_size < 45 AND p_size >= 5 THEN 'Balance' END AS found_column,
  CASE WHEN p_size >= 45 THEN 'no such file' WHEN p_size < 5 THEN 'no such sheet or column' END AS error
FROM part JOIN supplier s ON s.s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def _(t):
    # One sheet per supplier; parts ask for them in odd spellings, in the wrong folder, or for what is not there.
    catalog = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("file_pos"), F.col("s_name").alias("file"), F.col("n_name").alias("folder"),
        F.lit("Rows").alias("sheet"), F.lit("Balance").alias("column"))
    n = t.supplier.agg(F.count(F.lit(1))).scalar()
    size = F.col("p_size")
    asked = t.part.select("p_partkey", "p_size", (F.col("p_partkey") % n).alias("file_pos")).join(catalog, "file_pos")
    requests = asked.select(
        F.col("p_partkey").alias("request_id"),
        F.when(size >= 45, "nowhere.xlsx").otherwise(F.concat(F.lit("  "), F.upper("file"))).alias("file"),
        F.when(size % 3 == 0, "elsewhere").when(size % 3 == 1, F.col("folder")).alias("folder"),
        F.lit("ROWS ").alias("sheet"), F.when(size < 5, "Missing").otherwise(" balance").alias("column"))
    return S.resolve_sheet(requests, catalog)


# ---------------------------------------------------------------- document statistics

_WORDS = f"len(regexp_extract_all(text, '[^{JS_BLANK}]+'))"
_CHARS = f"length(trim(regexp_replace(text, '[{JS_BLANK}]+', ' ', 'g')))"


@query("doc_stats", f"""SELECT source AS file_id, CAST(sum({_WORDS}) AS BIGINT) AS words,
CAST(sum({_CHARS}) AS BIGINT) AS characters FROM documents GROUP BY 1""")
def _(t):
    return S.file_statistics(t.units())


@query("count_words", f"SELECT doc_id, {_WORDS}::INT AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", text.count_words(F.col("text")).alias("words"))


@query("count_chars", f"SELECT doc_id, {_CHARS}::INT AS characters FROM documents")
def _(t):
    return t.documents.select("doc_id", text.count_chars(F.col("text")).alias("characters"))


@query("doc_stats_section", f"""SELECT source AS file_id, doc_id AS unit_pos,
CASE WHEN lang = 'en' THEN 'Section ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) ELSE lang END AS category, {_WORDS} AS value FROM documents""")
def _(t):
    units = t.units().withColumn("section", F.when(F.col("section") == "en", "").otherwise(F.col("section")))
    return S.stats_by_section(units)


@query("page_grid", f"""SELECT c.conv_id AS file_id, (c.turn + 1)::INT AS page,
CASE WHEN c.role = 'system' THEN 0 ELSE {_WORDS} END AS value FROM conversations c""")
def _(t):
    # A conversation is a file, a turn its page; system turns have no text layer.
    turns = t.conversations
    files = turns.groupBy(F.col("conv_id").alias("file_id")).agg((F.max("turn") + 1).alias("pages"))
    units = turns.where(F.col("role") != "system").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("unit_pos"), (F.col("turn") + 1).cast("int").alias("page"),
        "text")
    return S.stats_by_page(files, units)


@query("page_equivalents", """
WITH k AS (SELECT source, CASE source WHEN 'src1' THEN 'pdf' WHEN 'src2' THEN 'sheet' ELSE 'doc' END AS kind, text FROM documents)
SELECT source AS file_id, max(kind) AS kind, CAST(greatest(1, CASE max(kind) WHEN 'pdf' THEN count(*)
  WHEN 'sheet' THEN ceil(count(*) / 50) ELSE ceil(sum(length(text)) / 3000) END) AS BIGINT) AS page_equivalent
FROM k GROUP BY 1""")
def _(t):
    pages = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    units = t.units().join(pages.withColumnRenamed("source", "file_id"), "file_id")
    kind = F.when(F.col("file_id") == "src1", "pdf").when(F.col("file_id") == "src2", "sheet").otherwise("doc")
    return S.page_equivalents(units, kind, F.col("pages"))


@query("sheet_count", "SELECT p_type AS file_id, count(DISTINCT p_brand) AS sheets FROM part GROUP BY 1")
def _(t):
    from tallyglass.operators.files import sheet_count

    return sheet_count(t.part.select(F.col("p_type").alias("file_id"), F.col("p_brand").alias("sheet")))


# ---------------------------------------------------------------- cells

_CELLS_SQL = """grid AS (
  SELECT p_type AS file_id, p_brand AS sheet, p_partkey + 1 AS row, p_name, p_type, p_size, p_retailprice FROM part),
cells AS (
  SELECT file_id, sheet, row, 0 AS col, p_name AS value FROM grid
  UNION ALL SELECT file_id, sheet, row, 1, CASE WHEN p_size < 10 THEN '' ELSE p_size::VARCHAR END FROM grid
  UNION ALL SELECT file_id, sheet, row, 2, CASE WHEN p_retailprice = floor(p_retailprice)
    THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END FROM grid
  UNION ALL SELECT file_id, sheet, row, 30, 'wide' FROM grid WHERE p_size > 40),
head AS (SELECT file_id, sheet, min(row) AS header_row FROM cells WHERE value <> '' GROUP BY 1, 2),
headers AS (SELECT c.file_id, c.sheet, h.header_row, c.col, CASE WHEN c.value <> '' THEN c.value
    WHEN c.col < 26 THEN 'Column ' || chr(65 + c.col) ELSE 'Column A' || chr(65 + c.col - 26) END AS header
  FROM cells c JOIN head h ON h.file_id = c.file_id AND h.sheet = c.sheet AND h.header_row = c.row)"""


def _cells(t):
    """Parts as a workbook per type, a sheet per brand; small sizes are blank cells, large parts are wider."""
    price = text.cell_text(number=F.col("p_retailprice"))
    size = F.when(F.col("p_size") < 10, "").otherwise(text.cell_text(number=F.col("p_size").cast("double")))

    def cell(col, value):
        return F.struct(F.lit(col).alias("col"), value.alias("value"))

    wide = F.when(F.col("p_size") > 40, F.array(cell(30, F.lit("wide")))).otherwise(
        F.array().cast("array<struct<col:int,value:string>>"))
    row = F.concat(F.array(cell(0, F.col("p_name")), cell(1, size), cell(2, price)), wide)
    return t.part.select(
        F.col("p_type").alias("file_id"), F.col("p_brand").alias("sheet"), (F.col("p_partkey") + 1).alias("row"),
        F.inline(row))


@query("header_infer", f"WITH {_CELLS_SQL} SELECT * FROM headers")
def _(t):
    return S.header_infer(_cells(t))


_UNITS_SQL = _CELLS_SQL + """,
sheet_units AS (
  SELECT c.file_id, c.sheet, c.row, string_agg(coalesce(h.header, CASE WHEN c.col < 26 THEN 'Column ' || chr(65 + c.col)
    ELSE 'Column A' || chr(65 + c.col - 26) END) || ': ' || c.value, '; ' ORDER BY c.col) AS text
  FROM cells c JOIN head k ON k.file_id = c.file_id AND k.sheet = c.sheet AND c.row > k.header_row
  LEFT JOIN headers h ON h.file_id = c.file_id AND h.sheet = c.sheet AND h.col = c.col
  WHERE c.value <> '' GROUP BY 1, 2, 3)"""


@query("sheet_units", f"WITH {_UNITS_SQL} SELECT * FROM sheet_units")
def _(t):
    return S.sheet_units(_cells(t))


@query("sheet_row_text", """SELECT l_orderkey, l_linenumber, count(*) AS copies, min('Quantity: ' || CAST(l_quantity::BIGINT AS VARCHAR)
|| CASE WHEN l_tax = 0 THEN '' ELSE '; Tax: ' || CAST(l_tax AS VARCHAR) END || '; Flag: ' || l_returnflag) AS text
FROM lineitem GROUP BY ALL""")
def _(t):
    pair = lambda i, name, value, keep: F.when(keep, F.struct(
        F.lit(i).alias("col"), F.concat(F.lit(name + ": "), value).alias("pair")))
    yes = F.lit(True)
    pairs = F.array_compact(F.array(
        pair(0, "Quantity", text.cell_text(number=F.col("l_quantity")), yes),
        pair(1, "Tax", text.cell_text(number=F.col("l_tax")), F.col("l_tax") != 0),
        pair(2, "Flag", text.cell_text(F.col("l_returnflag")), yes)))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", S.sheet_row_text(pairs).alias("text"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text"))


@query("cell_text", """SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice::BIGINT AS VARCHAR)
ELSE CAST(o_totalprice AS VARCHAR) END AS price, printf('%.2f', floor(o_totalprice) * 1000 + 0.25) AS large,
CASE o_orderkey % 4 WHEN 0 THEN '0.0005' WHEN 1 THEN '-0.001' WHEN 2 THEN '0.0000625' ELSE '0.25' END AS small, strftime(o_orderdate, '%Y-%m-%d') AS day,
strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS moment FROM orders""")
def _(t):
    day = F.col("o_orderdate")
    later = day + F.expr("INTERVAL 90 MINUTE")
    return t.orders.select(
        "o_orderkey", text.cell_text(number=F.round("o_totalprice", 2)).alias("price"),
        text.cell_text(number=F.floor("o_totalprice") * 1000 + F.lit(0.25)).alias("large"),
        text.cell_text(number=F.get(F.array(*map(F.lit, (0.0005, -0.001, 0.0000625, 0.25))), F.col("o_orderkey") % 4)).alias("small"),
        text.cell_text(stamp=day).alias("day"), text.cell_text(stamp=later).alias("moment"))


@query("column_letter", """SELECT DISTINCT c AS i, 'Column ' || CASE WHEN c < 26 THEN chr(65 + c)
WHEN c < 702 THEN chr(65 + (c - 26) // 26) || chr(65 + (c - 26) % 26)
ELSE chr(65 + (c - 702) // 676) || chr(65 + ((c - 702) // 26) % 26) || chr(65 + (c - 702) % 26) END AS letter
FROM (SELECT (p_partkey % 18278)::INT AS c FROM part)""")
def _(t):
    index = t.part.select((F.col("p_partkey") % 18278).cast("int").alias("i")).distinct()
    return index.withColumn("letter", text.column_letter(F.col("i")))


# ---------------------------------------------------------------- answer keys


@query("conditional_totals", """SELECT p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem
JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1""")
def _(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    net = rows.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = S.conditional_totals(net, "p_name", "net", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    return money(out, "total", places=2)


@query("top_of_totals", """SELECT arg_max(k, total) AS top, max(total) AS total FROM (
SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1)""")
def _(t):
    return S.top_of(S.conditional_totals(t.lineitem, "l_suppkey", "l_quantity", F.lit(True)), "l_suppkey")


_TARGETS = """units AS (SELECT p_brand, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem
  JOIN part ON p_partkey = l_partkey GROUP BY 1),
targets AS (SELECT p_brand, round_even(total * (0.85 + (length(p_brand) % 2) * 0.3), -2)::BIGINT AS target FROM units)"""


def _targets(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    units = rows.groupBy("p_brand").agg(F.sum("l_quantity").cast("bigint").alias("total"))
    factor = F.lit(0.85) + (F.length("p_brand") % 2) * F.lit(0.3)
    targets = units.select("p_brand", text.hundreds(F.col("total") * factor).cast("bigint").alias("target"))
    return units, targets


@query("target_round", f"WITH {_TARGETS} SELECT * FROM targets")
def _(t):
    return _targets(t)[1]


@query("missed_targets", f"WITH {_TARGETS} SELECT u.p_brand, u.total, g.target FROM units u JOIN targets g USING (p_brand) WHERE u.total < g.target")
def _(t):
    units, targets = _targets(t)
    return S.missed_targets(units, targets, "p_brand")


@query("eval_summary", """
WITH s AS (SELECT source AS use_case, CASE WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN 0 WHEN toxic = 0 THEN 1 END AS score,
  CASE WHEN toxic IS NULL THEN '' WHEN quality = 1 THEN 'Y' ELSE 'N' END AS citations_ok,
  CASE WHEN toxic = 1 THEN 'Y' WHEN toxic = 0 THEN 'N' END AS made_up,
  CASE WHEN n_chars > 500 THEN n_chars / 100.0::DOUBLE END AS seconds
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(use_case) = 1 THEN 'All' ELSE use_case END AS use_case, count(*) AS questions, count(score) AS scored,
  count(*) FILTER (score = 2) AS fully_correct, round(sum(score) / nullif(2.0 * count(score), 0), 8) AS accuracy,
  round(count(*) FILTER (citations_ok = 'Y') / nullif(count(*) FILTER (citations_ok <> ''), 0)::DOUBLE, 8) AS citation_rate,
  count(*) FILTER (made_up = 'Y') AS made_up_answers, round(avg(seconds), 8) AS avg_seconds
FROM s GROUP BY ROLLUP (use_case)""")
def _(t):
    # Documents as evaluation questions, their labels as the scores; unlabelled ones are not scored.
    joined = t.documents.join(t.labels, "doc_id", "left")
    good, toxic = F.col("quality") == 1, F.col("toxic")
    scores = joined.select(
        F.col("source").alias("use_case"),
        F.when(good, 2).when(toxic == 1, 0).when(toxic == 0, 1).alias("score"),
        F.when(toxic.isNull(), "").when(good, "Y").otherwise("N").alias("citations_ok"),
        F.when(toxic == 1, "Y").when(toxic == 0, "N").alias("made_up"),
        F.when(F.col("n_chars") > 500, F.col("n_chars") / 100.0).alias("seconds"))
    return money(S.eval_summary(scores), "accuracy", "citation_rate", "avg_seconds", places=8)


@query("stockouts", """SELECT l_orderkey AS store, p_name AS product, p_size AS days FROM lineitem
JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50""")
def _(t):
    # A report per order line: the part when it was ordered in full, otherwise an empty list.
    line = F.struct(F.col("p_name").alias("product"), F.col("p_size").alias("days"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    listed = F.filter(F.array(F.when(F.col("l_quantity") == 50, line)), lambda s: s.isNotNull())
    return S.stockouts(rows.select(F.col("l_orderkey").alias("store"), listed.alias("stockouts")))


# ---------------------------------------------------------------- quoted figures

_QUOTED_SQL = """bad AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'the quoted figures did not line up with the categories'
  WHEN o_orderkey % 11 = 0 THEN 'a figure pointed at an excerpt that does not exist' END AS error FROM orders),
figures AS (SELECT o_orderkey, 0 AS k, 'Total' AS category, o_totalprice AS value FROM bad WHERE error IS NULL
  UNION ALL SELECT o_orderkey, 1, 'Customer', o_custkey FROM bad WHERE error IS NULL
  UNION ALL SELECT o_orderkey, 2, 'Priority ' || o_orderpriority, NULL FROM bad WHERE error IS NULL)"""


def _proposals(t):
    """An order as a quoted chart of three figures, each quoting the excerpt of its own place."""
    key = F.col("o_orderkey")
    values = F.array("o_totalprice", F.col("o_custkey").cast("double"), F.lit(None).cast("double"))
    series = F.struct(
        F.lit("Quoted").alias("name"),
        F.when(key % 7 == 0, F.slice(values, 1, 2)).otherwise(values).alias("values"),
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("refs"))
    names = F.array(F.lit("Total"), F.lit("Customer"), F.concat(F.lit("Priority "), "o_orderpriority"))
    hits = F.when(key % 11 == 0, 2).otherwise(3)
    return t.orders.select(
        key.alias("proposal_id"), hits.alias("n_hits"), names.alias("categories"), F.array(series).alias("series"))


@query("excerpt_chart", f"""WITH {_QUOTED_SQL}
SELECT o_orderkey AS proposal_id, error, NULL::INT AS category_pos, NULL::VARCHAR AS category, NULL::VARCHAR AS series,
  NULL::DOUBLE AS value, NULL::INT AS ref FROM bad WHERE error IS NOT NULL
UNION ALL SELECT o_orderkey, NULL, k, category, 'Quoted', value, k + 1 FROM figures""")
def _(t):
    return A.excerpt_chart(_proposals(t))


@query("excerpt_refs", f"""WITH {_QUOTED_SQL} SELECT o_orderkey AS proposal_id, k + 1 AS ref, category, value,
  'orders, row ' || (k + 1) AS label FROM figures""")
def _(t):
    proposals = _proposals(t)
    hits = proposals.select("proposal_id", F.explode(F.sequence(F.lit(1), F.col("n_hits"))).alias("n"))
    hits = hits.withColumn("label", F.concat(F.lit("orders, row "), F.col("n").cast("string")))
    return A.excerpt_refs(A.excerpt_chart(proposals), hits).select("proposal_id", "ref", "category", "value", "label")


# ---------------------------------------------------------------- whole requests

def _workbooks(t):
    """Orders as cells: a workbook per priority and status (its folder), a sheet with a header row in each."""
    head = ["Order", "Customer", "Price", "Day"]
    shown = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"),
             text.cell_text(number=F.col("o_totalprice").cast("double")), F.date_format("o_orderdate", "yyyy-MM")]
    file_id, sheet = F.concat("o_orderstatus", F.lit("/"), "o_orderpriority").alias("file_id"), F.lit("Orders").alias("sheet")
    laid = lambda values: F.inline(F.array(*[F.struct(F.lit(i).alias("col"), v.alias("value")) for i, v in enumerate(values)]))
    data = t.orders.select(file_id, sheet, (F.col("o_orderkey") + 2).alias("row"), laid(shown))
    files = t.orders.select(file_id, file_id.alias("pos"), F.concat("o_orderpriority", F.lit(".xlsx")).alias("name"),
                            F.col("o_orderstatus").alias("folder"), F.lit(1).alias("sheets")).distinct()
    heads = files.select("file_id", sheet, F.lit(1).cast("bigint").alias("row"), laid([F.lit(h) for h in head]))
    return files, data.unionByName(heads)


_TOLD = "regexp_replace(regexp_replace(printf('%.4f', {0}), '0+$', ''), '\\.$', '')"


@query("calculate_request", f"""WITH rows AS (SELECT *, o_orderkey + 2 AS row, strftime(o_orderdate, '%Y-%m') AS day FROM orders
  WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' AND o_custkey > 10)
SELECT 'Category | Price | Customer' AS line
UNION ALL SELECT day || ' | ' || {_TOLD.format('round(max(o_totalprice), 4)')} || ' | ' || max(o_custkey) FROM rows GROUP BY day
UNION ALL SELECT '' UNION ALL SELECT 'Source: O/2-HIGH.xlsx · sheet “Orders” · rows ' || min(row) || '–' || max(row) || ' (' || count(*)
  || ' used). X axis (categories): Day; Y values: Price, Customer; Totals: Maximum; Filters: Customer greater than “10”.' FROM rows""")
def _(t):
    asked = Q.Request(" 2-high.XLSX", "orders", ("price", "CUSTOMER"), "o", " day", "max", (("customer", "greater_than", "10"),), "value_desc")
    return Q.calculate(asked, *_workbooks(t)).select("line")
