import json

from pyspark.sql import functions as F

from tallyglass.sources import readers, writers


def test_feed_json(spark, tmp_path):
    items = [{"title": f"T{i} &amp; co - Src{i}", "author": "Ann" if i == 1 else "", "link": f"https://www.s.example.com/{i}", "pubDate": "2026-09-09 20:42:36"} for i in range(14)]
    items[2]["title"] = "No dash"
    (tmp_path / "a.json").write_text(json.dumps({"status": "ok", "items": items}))
    (tmp_path / "b.json").write_text(json.dumps({"status": "error", "message": "limit"}))
    (tmp_path / "c.json").write_text("<html>")
    rows = readers.read_feed_json(spark, str(tmp_path)).collect()
    good = sorted((r.pos, r.title, r.source) for r in rows if r.error is None)
    assert len(good) == 12 and good[0] == (0, "T0 & co", "Src0") and good[1] == (1, "T1 & co", "Ann") and good[2] == (2, "No dash", "s.example.com")
    assert sorted(r.error for r in rows if r.error) == ["feed error", "limit"]


def test_feed_xml(spark, tmp_path):
    item = "<item><title>A - B - Src</title><pubDate>d</pubDate>{}</item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format("") + item.format('<link>l</link><source url="u">Tag</source>') * 14 + "</channel></rss>")
    rows = readers.read_feed_xml(spark, str(tmp_path)).orderBy("pos").collect()
    assert len(rows) == 12
    assert tuple(rows[0])[1:] == (0, "A - B", "Src", "#", "d") and tuple(rows[1])[1:] == (1, "A - B - Src", "Tag", "l", "d")


def test_feed_xml_keeps_its_order_over_splits_and_reports_broken_feeds(spark, tmp_path):
    for name, n in (("a", 300), ("b", 5)):
        items = "\n".join(f"<item><title>{name}{i} - S</title>{'<pubDate>d</pubDate>' * (i % 2)}</item>" for i in range(n))
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel>\n{items}\n</channel></rss>")
    (tmp_path / "c.xml").write_text("<rss><channel></channel></rss>")
    (tmp_path / "d.xml").write_text("<html>blocked")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.read_feed_xml(spark, str(tmp_path), errors=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted((r.feed[-5:], r.pos, r.title) for r in rows if r.error is None)
    assert got == [("a.xml", i, f"a{i}") for i in range(12)] + [("b.xml", i, f"b{i}") for i in range(5)]
    assert sorted((r.feed[-5:], r.error) for r in rows if r.error) == [("c.xml", "No items returned"), ("d.xml", "No items returned")]


def test_price_payload(spark, tmp_path):
    body = {"chart": {"result": [{"timestamp": [0, 86400, 86401], "indicators": {"quote": [{"close": [1.5, None, 2.5]}]}}], "error": None}}
    (tmp_path / "GOOD.json").write_text("Title: x\n" + json.dumps(body))
    (tmp_path / "NONE.json").write_text(json.dumps({"chart": {"result": None, "error": {"description": "No data found"}}}))
    (tmp_path / "TEXT.txt").write_text("blocked")
    rows = readers.read_price_payload(spark, str(tmp_path)).collect()
    assert sorted((r.pos, str(r.date), r.close) for r in rows if r.symbol == "GOOD") == [(0, "1970-01-01", 1.5), (2, "1970-01-02", 2.5)]
    assert {r.symbol: r.error for r in rows if r.error} == {"NONE": "No data found", "TEXT": "Unexpected proxy response"}


def test_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"name": "B", "symbol": "b"}, {"name": "A", "symbol": "a"}]))
    (tmp_path / "l.json").write_text(json.dumps({"good": 1.9, "bad": -2}))
    assert [tuple(r)[1:] for r in readers.read_symbols(spark, str(tmp_path / "s.json")).orderBy("pos").collect()] == [(0, "b", "B"), (1, "a", "A")]
    assert dict(readers.read_lexicon(spark, str(tmp_path / "l.json")).collect()) == {"good": 1.9, "bad": -2.0}


def test_listing_starts_with_the_folder_itself(spark, tmp_path):
    root = tmp_path / "Reports"
    (root / "2026" / "Q2").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"123")
    (root / "2026" / "Q2" / "b c.docx").write_bytes(b"12345")
    rows = sorted((r.name, r.folder, r.size) for r in readers.list_files(spark, str(root)).collect())
    assert [(f, s) for _, f, s in rows] == [("Reports", 3), ("Reports/2026/Q2", 5)] and rows[0][0] == "a.pdf"


def test_snapshot_replaces_one_workspace(spark, tmp_path):
    path = str(tmp_path / "index")
    chunks = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "workspace string, chunk_index int, text string")
    writers.save_index(chunks, path)
    writers.save_index(chunks.where("workspace = 'a'").withColumn("text", F.lit("new")), path)
    assert sorted((r.workspace, r.text) for r in writers.load_index(spark, path).collect()) == [("a", "new"), ("b", "y")]
    assert [r.text for r in writers.load_index(spark, path, "b").collect()] == ["y"]
    old = spark.read.parquet(path).where("workspace = 'a'").withColumn("version", F.lit(99)).withColumn("workspace", F.lit("c"))
    old.write.mode("append").partitionBy("workspace").parquet(path)
    assert writers.load_index(spark, path, "c").count() == 0


def test_csv(spark, tmp_path):
    chart = spark.createDataFrame([(1, 'say "hi"', None), (0, "a,b", 2.5)], "pos long, category string, v double")
    path = str(tmp_path / "csv")
    writers.write_chart_csv(chart, path, "category", ["v"], "pos", "f.xlsx, sheet")
    parts = sorted(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts) == 'Category,v\n"a,b",2.5\n"say ""hi""",\n\n"Source: f.xlsx, sheet"\n'


def test_manifest_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(7, 1, "b.pdf", "F"), (7, 0, "a.pdf", "F")], "pack int, pos int, name string, folder string")
    questions = spark.createDataFrame([(7, 0, "A1", "Why?")], "pack int, pos int, id string, text string")
    writers.write_manifest(files, questions, str(tmp_path / "m"), "Co")
    f, q = readers.read_manifest(spark, str(tmp_path / "m"))
    assert [r.name for r in f.orderBy("pos").collect()] == ["a.pdf", "b.pdf"] and q.head().text == "Why?"


def test_feeds_and_series_without_content_give_an_error_row(spark):
    feeds = spark.createDataFrame([("a", '{"status":"ok","items":[]}'), ("b", '{"status":"ok"}')], "feed string, value string")
    assert {(r.feed, r.error) for r in readers.parse_feed_json(feeds).collect()} == {("a", "No items returned"), ("b", "No items returned")}
    body = '{"chart":{"result":[{"timestamp":[1,2],"indicators":{"quote":[{"close":[null,null]}]}}]}}'
    rows = readers.parse_price_payload(spark.createDataFrame([("s", body)], "symbol string, value string")).collect()
    assert [(r.symbol, r.close, r.error) for r in rows] == [("s", None, "Empty price series")]


def test_packed_feeds_give_the_rows_of_feed_files(spark, tmp_path):
    item = "<item><title>{}</title><link>l</link></item>".format
    feeds = {
        "plain": item("a - S") + item("b") + item("c &amp; d") * 14,
        "broken": item("a") + item("b & c") + item("d < e") + item("f"),
        "cdata": "<!-- " + item("no") + " --><description><![CDATA[" + item("no") + "]]></description>" + item("<![CDATA[x </item> <item> y]]>") + item("z"),
        "inside": "<item><title>o</title><item><title>in</title></item></item>" + item("d"),
        "start": '<item id="1>2"><title>q</title></item><item/><item\n x="/"><title>r</title></item ><items>' + item("s") + "</items>",
        "source": '<item><title>A - B</title><source url="u"> Tag </source><link> </link><pubDate>d</pubDate></item>' + item("\n lines\r\nof it - S "),
        "open": item("a") + "<item><title>cut",
        "quote": item("a") + '<item id="1><title>b</title></item>' + item("c"),
        "long": item("<b/>" * 50000 + "x"),
        "none": "",
    }
    feeds = {name: f"<rss><channel>{items}</channel></rss>" for name, items in feeds.items()} | {"html": "<html>blocked"}
    (tmp_path / "files").mkdir()
    for name, value in feeds.items():
        (tmp_path / "files" / name).write_bytes(value.encode())
    spark.createDataFrame([*feeds.items()], "feed string, value string").write.json(str(tmp_path / "packed"))

    def rows(errors, **kind):
        found = readers.read_feed_xml(spark, str(tmp_path / ("packed" if kind else "files")), errors, **kind)
        return sorted((r.feed.rsplit("/", 1)[-1], *map(str, r[1:])) for r in found.collect())

    assert rows(True, packed=True) == rows(True) and rows(False, packed=True) == rows(False)
    assert sum(r[0] == "plain" for r in rows(False, packed=True)) == 12
    assert [r[0] for r in rows(True, packed=True) if r[-1] == "No items returned"] == ["html", "none"]


def test_a_broken_packed_feed_spoils_no_other_item_or_feed(spark):
    feeds = spark.createDataFrame([
        ("a", "<rss><item><title>x</link></item><item><title>y</title></item></rss>"), ("a", "<rss><item><title>z</title></item></rss>"),
        ("b", None), ("c", "")], "feed string, value string")
    rows = readers.parse_feed_xml(feeds, errors=True).collect()
    assert sorted((r.feed, str(r.pos), str(r.title), r.error or "") for r in rows) == [
        ("a", "0", "", ""), ("a", "0", "z", ""), ("a", "1", "y", ""), ("b", "None", "None", "No items returned"), ("c", "None", "None", "No items returned")]


def test_feeds_are_landed_many_to_a_file(spark, tmp_path, monkeypatch):
    from tallyglass.plans import documents, load

    parts = [(k, f"part {k}", f"B{k % 7}", ["X", "", None, "Y/Z"][k % 4], k % 50) for k in range(3000)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(documents, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = load()[0]["read_feed_xml"](spark, str(tmp_path)).collect()
    landed = [f for f in (tmp_path / "feeds").rglob("part-*") if f.is_file()]
    assert len(landed) <= 8  # there are 200 feeds, and the driver lists every file
    feeds = {}
    for key, _, brand, kind, size in parts:
        feeds.setdefault((kind, key // 60), []).append((key, brand, size))
    want = [(pos, f"part {key} - Wire" if size > 25 else f"part {key}", brand if size > 25 else "Wire",
             "#" if size % 5 == 0 else f"https://x.example.com/{key}", "Fri, 05 Jan 2024 10:00:00 GMT")
            for items in feeds.values() for pos, (key, brand, size) in enumerate(items[:12])]
    assert len(feeds) == 200 and sorted(map(tuple, rows)) == sorted(want)
