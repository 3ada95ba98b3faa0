"""Landed files -> DataFrames.  Every reader has a fixed schema, so no pass over the data infers one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions.dates import ist_date_of_seconds
from tallyglass.functions.text import (
    basename, blank_to_null, decode_entities, source_fallback, strip_source, strip_source_tagged,
)
from tallyglass.operators.ordered import first_per_key

FEED_ITEMS = 12  # fixed value: items taken from one feed

_FEED = "status string, message string, items array<struct<title:string,author:string,link:string,pubDate:string>>"
_XML_ITEM = "title string, link string, pubDate string, source struct<_VALUE:string,_url:string>"
_XML_FIELDS = ["title", "source", "link", "pub_date"]


def _xml_items(depth: int = 3) -> str:
    """Pattern of an ``item`` element with those inside it; comments, CDATA and instructions are passed over whole.

    What is left open runs to the end of the text.  Loops over groups are possessive: Java walks them without a stack.
    """
    passed = r"<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<\?.*?(?:\?>|\z)"
    start = r"""<item(?=[\s/>])(?:[^"'>/]++|"[^"]*(?:"|\z)|'[^']*(?:'|\z)|/(?!>))*+"""
    item = ""
    for _ in range(depth):
        item = rf"{start}(?:/>|\z|>(?:[^<]++|{passed}|{item + '|' if item else ''}<(?!/item\s*>))*+(?:</item\s*>|\z))"
    return f"(?s){passed}|({item})"


_XML_ITEMS = _xml_items()
_PRICE = (
    "chart struct<result:array<struct<timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<close:array<double>>>>>>,error:struct<description:string>>"
)


def read_feed_json(spark: SparkSession, path: str) -> DataFrame:
    """Feed files, one JSON document each -> (feed, pos, title, source, link, pub_date, error).

    The first twelve items in feed order; a feed that is not ``ok`` or has no items gives one error row.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed"), "value")
    return parse_feed_json(text)


def parse_feed_json(feeds: DataFrame) -> DataFrame:
    parsed = feeds.select("feed", F.from_json("value", _FEED).alias("f"))
    sound = F.col("f.status") == "ok"
    error = F.when(~F.coalesce(sound, F.lit(False)), F.coalesce("f.message", F.lit("feed error"))).when(
        F.coalesce(F.size("f.items"), F.lit(0)) <= 0, F.lit("No items returned"))
    items = F.slice(F.when(sound, F.col("f.items")), 1, FEED_ITEMS)
    rows = parsed.select("feed", error.alias("error"), F.posexplode_outer(items).alias("pos", "i"))
    decoded = rows.select("feed", "error", "pos", "i.*", decode_entities(F.col("i.title")).alias("_t"))
    title, source = strip_source(F.col("_t"))
    return decoded.select(
        "feed", "pos", title.alias("title"),
        F.when(F.col("error").isNull(), source_fallback(F.col("author"), source, F.col("link"))).alias("source"),
        "link", F.col("pubDate").alias("pub_date"), "error",
    )


def read_feed_xml(spark: SparkSession, path: str, errors: bool = False, packed: bool = False) -> DataFrame:
    """RSS files -> (feed, pos, title, source, link, pub_date); one feed per file, or per JSON line {feed, value} with ``packed``.

    Items keep their order in the file: by the place of the block that holds them, then in the order its reader meets them.
    With ``errors`` a column ``error`` is added, and a feed without a readable item gives one row that tells so.
    The driver lists every file, so feeds by the hundred thousand are landed packed.
    """
    if packed:
        return parse_feed_xml(spark.read.schema("feed string, value string").json(path), errors)
    items = (
        spark.read.format("xml").option("rowTag", "item").schema(_XML_ITEM).load(path)
        .select("*", F.col("_metadata.file_path").alias("feed"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_at"))
    )
    first = first_per_key(items, ["feed"], [F.col("_block"), F.col("_at")], FEED_ITEMS, "_n")
    found = first.select("feed", (F.col("_n") - 1).alias("pos"), *_xml_fields())
    if not errors:
        return found
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("feed"))
    without = listed.join(found.select("feed").distinct(), "feed", "left_anti").withColumn("error", F.lit("No items returned"))
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(without, allowMissingColumns=True)


def parse_feed_xml(feeds: DataFrame, errors: bool = False) -> DataFrame:
    """(feed, value) -> the rows of ``read_feed_xml``, whole feeds as texts.

    Items are cut out of the text and parsed one by one, so a broken one gives an empty item and spoils no other.
    """
    cut = F.filter(F.regexp_extract_all("value", F.lit(_XML_ITEMS), F.lit(1)), lambda x: x != "")
    texts = feeds.select("feed", F.posexplode_outer(F.slice(cut, 1, FEED_ITEMS)).alias("pos", "_text"))
    rows = texts.select("feed", "pos", F.from_xml("_text", _XML_ITEM).alias("i")).select("feed", "pos", "i.*")
    found = F.col("pos").isNotNull()
    if not errors:
        return rows.where(found).select("feed", "pos", *_xml_fields())
    fields = [F.when(found, c).alias(name) for c, name in zip(_xml_fields(), _XML_FIELDS, strict=True)]
    return rows.select("feed", "pos", *fields, F.when(~found, "No items returned").alias("error"))


def _xml_fields() -> list[Column]:
    """(title, source, link, pub_date) of an RSS item."""
    raw = F.coalesce(F.col("title"), F.lit(""))
    title, source = strip_source_tagged(raw, F.col("source._VALUE"))
    link = F.coalesce(blank_to_null(F.col("link")), F.lit("#"))
    return [c.alias(name) for c, name in zip((title, source, link, F.coalesce("pubDate", F.lit(""))), _XML_FIELDS, strict=True)]


def unwrap_json_preamble(text):
    """Text from its first ``{`` on; null without one."""
    at = F.instr(text, "{")
    return F.when(at > 0, F.substring(text, at, F.length(text)))


def read_price_payload(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    symbol = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[A-Za-z]+)?$", 1)
    return parse_price_payload(text.select(symbol.alias("symbol"), "value"))


def parse_price_payload(payloads: DataFrame) -> DataFrame:
    """(symbol, value) -> (symbol, pos, date, close, error): parallel arrays zipped by index, null closes dropped.

    A text without JSON, a payload without a result and a series without a close give one error row.
    """
    body = unwrap_json_preamble(F.col("value"))
    parsed = payloads.select("symbol", body.alias("_b"), F.from_json(body, _PRICE).alias("p")).select(
        "symbol", "_b", F.get("p.chart.result", F.lit(0)).alias("r"), F.col("p.chart.error.description").alias("e"))
    error = F.when(F.col("_b").isNull(), "Unexpected proxy response").when(
        F.col("r").isNull(), F.coalesce("e", F.lit("No price data returned")))
    close = F.get("r.indicators.quote", F.lit(0))["close"]
    points = F.transform(
        F.col("r.timestamp"), lambda t, i: F.struct(t.alias("seconds"), F.get(F.col("c"), i).alias("close")))
    rows = parsed.select("symbol", error.alias("error"), "r", close.alias("c")).withColumn("points", points)
    empty = ~F.exists(F.coalesce("points", F.array().cast("array<struct<seconds:bigint,close:double>>")), lambda x: x["close"].isNotNull())
    failed = F.coalesce("error", F.when(empty, "Empty price series"))
    rows = rows.select("symbol", failed.alias("error"), F.posexplode_outer(F.when(failed.isNull(), F.col("points"))).alias("pos", "x"))
    return rows.where(F.col("error").isNotNull() | F.col("x.close").isNotNull()).select(
        "symbol", "pos", ist_date_of_seconds(F.col("x.seconds")).alias("date"), F.col("x.close").alias("close"), "error")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists of {name, symbol} -> (list, pos, symbol, name) in list order; one document is one list."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("list"), "value")
    entries = F.from_json("value", "array<struct<name:string,symbol:string>>")
    return whole.select("list", F.posexplode(entries).alias("pos", "s")).select(
        "list", F.col("pos").cast("bigint").alias("pos"), "s.symbol", "s.name")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object token -> valence."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,double>")).alias("token", "valence"))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sample manifests -> (files, questions); one document per file, or per line with ``lines``."""
    schema = (
        "company string, note string, "
        "files array<struct<name:string,folder:string,path:string,title:string,description:string,kind:string>>, "
        "questions array<struct<id:string,group:string,text:string,reference:string>>"
    )
    whole = spark.read.schema(schema).json(path, multiLine=not lines)
    return (
        whole.select(F.posexplode("files").alias("pos", "f")).select("pos", "f.*"),
        whole.select(F.posexplode("questions").alias("pos", "q")).select("pos", "q.*"),
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under ``folder`` -> (name, folder, size); contents are never read.

    The reported folder starts with the chosen folder's own name.
    """
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    inner = F.regexp_replace(F.substring_index("path", f"/{root}/", -1), "/?[^/]*$", "")
    return found.select(
        basename(F.col("path")).alias("name"),
        F.when(inner == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), inner)).alias("folder"),
        F.col("length").alias("size"),
    )
