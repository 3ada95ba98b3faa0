"""The numbered operators over the shared test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm import (
    byte_bpe, chat, exact_dedup, line_dedup, merkle, minhash_dedup, packing, pii, quality_classifier, quality_rules, simhash_dedup,
    url_filter, whitening, word_tokens,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- 1

@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


# ---------------------------------------------------------------- 6

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Words of the usual categories of block lists (advertising, adult, gambling, drugs, fraud).
LISTED_WORDS = (
    "ads", "adserver", "track", "tracker", "tracking", "adult", "porn", "sex", "xxx", "bet", "bets", "betting", "casino", "gambling",
    "lottery", "poker", "cialis", "pharmacy", "pills", "viagra", "malware", "phishing", "spam", "warez",
)
# The list of the query: the URLs with such a word of its own in host or path.
LISTED_URL = rf"(?:^|[^a-z0-9])(?:{'|'.join(LISTED_WORDS)})(?:[^a-z0-9]|$)"


def _sql_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_canonical() -> str:
    host = "regexp_replace(host, '^www\\.|:(?:80|443)$', '', 'g')"
    path = "regexp_replace(path, '(?:/index)?(?:\\.html?)?/*$', '')"
    query_text = "coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '')"
    kept = (f"list_sort(list_filter(string_split({query_text}, '&'), lambda p: p <> '' AND NOT "
            f"regexp_matches(p, '^{url_filter.TRACKING}(?:=|$)')))")
    return f"{host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


@query("op6_url_filter", f"""
WITH part AS (
  SELECT page_id, url, {_sql_lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (SELECT *, CASE WHEN contains(url, '://') THEN {_sql_canonical()} END AS key FROM part),
listed AS (SELECT DISTINCT key FROM canon WHERE key IS NOT NULL AND regexp_matches({_sql_lower("host || path")}, '{LISTED_URL}')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM canon)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    place = F.translate(F.concat(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))),
                        string.ascii_uppercase, string.ascii_lowercase)
    listed = pages.where(place.rlike(LISTED_URL)).select("url")
    judged = url_filter.filter_urls(pages, listed, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ---------------------------------------------------------------- 10

@query("op10_simhash_dedup")
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- 2

_BLANKS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op2_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, {_sql_lower(f"trim(line, {_BLANKS_SQL})")} AS key FROM lines),
repeated AS (SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.low < k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.low IS NULL OR r.low = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON r.key = k.key GROUP BY k.doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


# ---------------------------------------------------------------- 4

def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents marked as good stand for the trusted source."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


# ---------------------------------------------------------------- 9

DELTA_CHARS = 1000
CONTROL = "\\### Assistant: </turn> ok"


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log behind ``conversations``: one sequence per conversation over all its messages, with rows out of order.

    Messages are numbered in order of turn, then role and text, so that repeated rows stay messages of their own.  Each is
    streamed in deltas of ``DELTA_CHARS`` characters.  Of three messages one is streamed as it is; one begins with a wrong draft
    and is regenerated; one is drafted and edited only after the message that follows it was streamed.
    """
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", text.alias("text"), F.row_number().over(order).cast("bigint").alias("message"))
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / DELTA_CHARS).cast("int")
    way, draft = F.col("message") % 3, F.col("part") < 0
    parts = F.reverse(F.sequence(F.when(way == 0, 0).otherwise(-1), last))
    streamed = numbered.select("*", F.explode(parts).alias("part"))
    # Four stretches of the sequence belong to a message: draft, final text, and, in the stretches of the next, its edit.
    stretch = F.col("message") * 4 + F.when(draft | (way == 0), 0).when(way == 1, 1).otherwise(6)
    begins = F.when(way == 1, "regenerate").when(way == 2, "edit").otherwise("delta")
    said = F.substring("text", F.col("part") * DELTA_CHARS + 1, F.lit(DELTA_CHARS))
    return streamed.select(
        "conv_id", (stretch * (1 << 32) + F.col("part") + 1).alias("seq"), "message",
        F.when(F.col("part") == 0, begins).otherwise("delta").alias("op"), "role",
        F.when(draft, F.concat(F.lit("draft: "), F.reverse(F.substring("text", 1, DELTA_CHARS)))).otherwise(said).alias("text"))


@query("op9_chat_format", f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {"'" + CONTROL + "'"} UNION ALL SELECT -7, 1, 'assistant', {"'" + CONTROL + "'"}),
written AS (
  SELECT *, replace(replace(replace(replace(text, '\\', '\\\\'), '<turn', '<\\turn'), '</turn', '<\\/turn'), '##', '#\\#') AS body,
    replace(replace(replace(replace(replace(role, '\\', '\\\\'), '<turn', '<\\turn'), '</turn', '<\\/turn'), '##', '#\\#'), ':', '\\:')
      AS head FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(head) + {len(chat.OPEN) + len(chat.COLON) + len(chat.CLOSE)}) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(chat_events(spark, sf_dir))
    read = chats.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                        chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# ---------------------------------------------------------------- 3

CAPACITY, END_ID = 4096, 1


def packed_digest(docs: DataFrame) -> DataFrame:
    """Where every piece of every document goes, with a digest of its ids in their place."""
    pieces = word_tokens.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)
    return packing.pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ---------------------------------------------------------------- 5

@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The Python workers of an executor hold a batch each; the default of 64 MB is too much for small executors.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- 7

@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = quality_classifier.learn(docs, labels, "quality")
    scored = quality_classifier.quality_scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


# ---------------------------------------------------------------- 8

PSEUDONYM_KEY = b"key of the test tables"


@query("op8_pii_pseudonyms")
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, counts_col="counts")
    return masked.select("doc_id", "text", *[F.col("counts")[i].alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)])


# ---------------------------------------------------------------- 11

def row_leaf(text: str = "text") -> Column:
    """The digest of a documents row over its fields in order."""
    return merkle.hashed(*[merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.field(F.expr(text)))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


# The reflected CRC-32 of a decimal number, bit by bit: list_reduce starts at its first element.
_SQL_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(
  string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: ((ord(c) >> k) & 1)::UBIGINT)))),
  lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""


def _sql_tree(name: str, levels: int) -> str:
    """Levels 1 and up of ``{name}0 (grp, pos, digest)``, then ``{name}p``: all nodes with their run's other digests."""
    steps = []
    for i in range(levels):
        steps.append(f"""{name}{i}s AS (SELECT *, pos // 16 AS run, count(*) OVER (PARTITION BY grp) AS total,
  coalesce(string_agg(digest, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{i})""")
        steps.append(f"""{name}{i + 1} AS (SELECT grp, run AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
  FROM {name}{i}s WHERE total > 1 GROUP BY grp, run)""")
    tops = " UNION ALL ".join(f"SELECT grp, digest FROM {name}{i}s WHERE total = 1" for i in range(levels))
    # Paths from the top down: lists of (left, right).
    steps.append(f"{name}q{levels} AS (SELECT grp, pos, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS path FROM {name}{levels} WHERE false)")
    for i in range(levels - 1, -1, -1):
        steps.append(f"""{name}q{i} AS (SELECT c.grp, c.pos, CASE WHEN total = 1 THEN CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[])
  ELSE list_prepend({{'l': c.l, 'r': c.r}}, q.path) END AS path
  FROM {name}{i}s c LEFT JOIN {name}q{i + 1} q ON q.grp = c.grp AND q.pos = c.run)""")
    steps.append(f"{name}t AS ({tops})")
    return ",\n".join(steps)


@query("op11_merkle_manifest", f"""
WITH read AS (SELECT *, coalesce('=' || source, '-') AS grp,
  {" || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents),
hashed AS (SELECT doc_id, grp, sha256(head || {_sql_field("text")}) AS digest,
  CASE WHEN {_SQL_CRC32} % 5 = 0 THEN sha256(head || {_sql_field(_sql_lower("text"))}) END AS again FROM read),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM hashed),
d0 AS (SELECT grp, pos, digest FROM leaves),
{_sql_tree("d", 6)},
s0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, digest, grp AS name FROM dt),
{_sql_tree("s", 5)},
every AS (
  SELECT doc_id, v.digest AS leaf, s0.digest AS subroot, (SELECT digest FROM st) AS root, list_concat(d.path, s.path) AS path,
    coalesce(again, v.digest) AS start
  FROM leaves v JOIN dq0 d ON d.grp = v.grp AND d.pos = v.pos JOIN s0 ON s0.name = v.grp JOIN sq0 s ON s.pos = s0.pos),
done AS (SELECT *, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': start, 'r': ''}}, path),
    lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root FROM every)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    made = merkle.manifest(table(spark, sf_dir, "documents"), row_leaf(), again=F.when(tampered, row_leaf(lower)))
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                       merkle.hashed(merkle.siblings_text(F.col("path"))).alias("proof_sha256"), "folded_root", "verified")


# ---------------------------------------------------------------- 12

@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit_whitening(rows)).withColumnRenamed("id", "vec_id")


# ---------------------------------------------------------------- 13

@query("op13_minhash_dedup")
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
