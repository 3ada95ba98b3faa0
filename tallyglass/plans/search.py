"""Vectors, prompts, answers, lookups and event counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions import text, vectors
from tallyglass.operators import answers as A
from tallyglass.operators import chunking as C
from tallyglass.operators import events as E
from tallyglass.operators import lookup as K
from tallyglass.operators import retrieval as R
from tallyglass.operators.files import document_catalog
from tallyglass.plans.base import query
from tallyglass.plans.documents import fixed_sql, numbered_sql
from tallyglass.scale import staged

# ---------------------------------------------------------------- vectors

_CENTROIDS_SQL = """cent AS (SELECT query_id, list(a ORDER BY i) AS q FROM (
  SELECT label AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)
  GROUP BY 1, 2) GROUP BY 1),
vec AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT query_id, chunk_id, round(list_inner_product(e, q) / sqrt(list_inner_product(e, e))
  / sqrt(list_inner_product(q, q)), 9) AS score FROM vec CROSS JOIN cent),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM sims WHERE score >= 0.1)"""


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


def _centroids(t):
    """One query per label: the mean of all its vectors."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda c: c["a"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


@query("dot", """SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 8) AS d
FROM embeddings""")
def _(t):
    return t.embeddings.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 8).alias("d"))


@query("l2_normalize", """SELECT vec_id, (i - 1)::INT AS i, round(x[i] / sqrt(list_inner_product(x, x)), 8) + 0.0 AS x FROM (
SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * 3) AS x FROM embeddings), unnest(range(1, len(x) + 1)) u(i)""")
def _(t):
    tripled = F.transform("embedding", lambda v: v.cast("double") * 3)
    rows = t.embeddings.select("vec_id", F.posexplode(vectors.l2_normalize(tripled)).alias("i", "x"))
    return _rounded(rows, "x", places=8)


@query("similarity_join", f"WITH {_CENTROIDS_SQL} SELECT query_id, chunk_id, round(score, 9) AS score FROM sims WHERE score >= 0.3")
def _(t):
    return _rounded(R.similarity_join(_vectors(t), _centroids(t), 0.3), "score", places=9)


@query("similarity_join_grid", f"WITH {_CENTROIDS_SQL} SELECT query_id, chunk_id, round(score, 9) AS score FROM sims WHERE score >= 0.3")
def _(t):
    # The same join by blocks, as it runs when the queries are too many to travel.
    pairs = R.similarity_join(_vectors(t), _centroids(t), 0.3, max_query_rows=0, block_rows=200)
    return _rounded(pairs, "score", places=9)


@query("min_similarity_filter", f"WITH {_CENTROIDS_SQL} SELECT query_id, chunk_id, round(score, 9) AS score FROM sims WHERE score >= 0.45")
def _(t):
    pairs = R.similarity_join(_vectors(t), _centroids(t), 0.3)
    return _rounded(R.min_similarity_filter(pairs, 0.45), "score", places=9)


@query("vector_topk", f"WITH {_CENTROIDS_SQL} SELECT query_id, n::INT AS n, chunk_id, round(score, 9) AS score FROM ranked WHERE n <= 10")
def _(t):
    return _rounded(R.vector_topk(_vectors(t), _centroids(t), 10, 0.1), "score", places=9)


@query("hit_number", f"WITH {_CENTROIDS_SQL} SELECT query_id, n::INT AS n, chunk_id, round(score, 9) AS score FROM ranked WHERE n <= 15 AND score >= 0.3")
def _(t):
    pairs = R.similarity_join(_vectors(t), _centroids(t), 0.3)
    return _rounded(R.hit_number(pairs, 15).select("query_id", "n", "chunk_id", "score"), "score", places=9)


# Closeness of two vectors of a pool, for vectors as lists and as bags.
_CLOSE_LISTS = """SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, list_inner_product(x.e, y.e)
    / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) AS s
  FROM pool a JOIN pool b ON a.query_id = b.query_id JOIN vec x ON x.chunk_id = a.chunk_id JOIN vec y ON y.chunk_id = b.chunk_id"""
_CLOSE_BAGS = """SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, coalesce(sum(x.x * y.x), 0) AS s
  FROM pool a JOIN pool b ON a.query_id = b.query_id JOIN d x ON x.id = a.chunk_id
  LEFT JOIN d y ON y.id = b.chunk_id AND y.bucket = x.bucket GROUP BY 1, 2, 3"""


def _mmr_sql(k: int, lam: float, close: str = _CLOSE_LISTS) -> str:
    """Tables up to ``picked(query_id, n, chunk_id, score)``, from ``ranked``: one step per pick."""
    steps = [f"""pool AS (SELECT * FROM ranked WHERE n <= {4 * k}),
close AS MATERIALIZED ({close}),
pick1 AS (SELECT query_id, chunk_id, score, 1 AS pos FROM pool WHERE n = 1)"""]
    for j in range(2, k + 1):
        steps.append(f"""pick{j} AS (SELECT * FROM pick{j - 1} UNION ALL SELECT query_id, chunk_id, score, {j} FROM (
  SELECT p.query_id, p.chunk_id, p.score, row_number() OVER (PARTITION BY p.query_id
    ORDER BY round({lam} * p.score - (1 - {lam}::DOUBLE) * max(c.s), 9) DESC, p.n) AS r
  FROM pool p JOIN pick{j - 1} q ON q.query_id = p.query_id JOIN close c ON c.query_id = p.query_id AND c.a = p.chunk_id
    AND c.b = q.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM pick{j - 1} z WHERE z.query_id = p.query_id AND z.chunk_id = p.chunk_id)
  GROUP BY p.query_id, p.chunk_id, p.score, p.n) WHERE r = 1)""")
    return ",\n".join(steps) + f",\npicked AS (SELECT query_id, pos::INT AS n, chunk_id, score FROM pick{k})"


@query("mmr_topk", f"WITH {_CENTROIDS_SQL}, {_mmr_sql(5, 0.5)} SELECT query_id, n, chunk_id, round(score, 9) AS score FROM picked")
def _(t):
    return _rounded(R.mmr_topk(_vectors(t), _centroids(t), 5, 0.1, 0.5), "score", places=9)


# ---------------------------------------------------------------- text search

def _bag_sql(name: str, source: str) -> str:
    return f"""{name}_w AS (SELECT id, CAST('0x' || right(md5(w), 3) AS INT) % 512 AS bucket, count(*) AS c FROM (
    SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}_w)"""


@query("hash_embed", f"""WITH {_bag_sql('bag', '(SELECT doc_id AS id, text FROM documents)')}
SELECT id AS doc_id, bucket::INT AS bucket, round(x, 8) AS weight FROM bag""")
def _(t):
    embedded = t.documents.select("doc_id", vectors.hash_embed(F.col("text")).alias("e"))
    return _rounded(
        embedded.select("doc_id", F.posexplode_outer("e").alias("bucket", "weight")).where("weight <> 0"), "weight", places=8)


# The whole chain: documents in chunks of 800 characters, an item asked after the last question of the conversation of
# its number, five diverse hits.
_SEARCH_SQL = f"""pc AS ({fixed_sql(800, 120)}), ch AS ({numbered_sql('pc')}),
idx AS MATERIALIZED (SELECT file_id || '#' || chunk_index AS id, * FROM ch),
{_bag_sql('d', 'idx')},
{_bag_sql('q', '(SELECT item_id AS id, text FROM benchmark)')},
{_bag_sql('p', "(SELECT conv_id AS id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)")},
mixed AS (SELECT id, bucket, sum(x) AS x FROM (SELECT id, bucket, 0.75 * x AS x FROM q UNION ALL
  SELECT id, bucket, 0.25 * x FROM p WHERE id IN (SELECT item_id FROM benchmark)) GROUP BY 1, 2),
asked AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM mixed),
tsims AS (SELECT asked.id AS query_id, d.id AS chunk_id, round(sum(asked.x * d.x), 9) AS score FROM asked JOIN d USING (bucket)
  GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM tsims WHERE score >= 0.45),
{_mmr_sql(5, 0.7, _CLOSE_BAGS)}"""


def _index(t):
    chunks = C.chunk_units(t.units(), "fixed", 800, 120)
    chunk_id = F.concat("file_id", F.lit("#"), F.col("chunk_index").cast("string"))
    return staged(chunks.select(chunk_id.alias("chunk_id"), "*", vectors.hash_embed(F.col("text")).alias("embedding")), "index")


def _text_hits(t, index):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), vectors.hash_embed(F.col("text")).alias("embedding"))
    before = t.conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.max_by("text", "turn").alias("text"))
    before = before.select("query_id", vectors.hash_embed(F.col("text")).alias("embedding"))
    return R.search(index.select("chunk_id", "embedding"), R.blended_queries(asked, before), 5, 0.45)


@query("search", f"WITH {_SEARCH_SQL} SELECT query_id, n, chunk_id, round(score, 9) AS score FROM picked")
def _(t):
    return _rounded(_text_hits(t, _index(t)), "score", places=9)


_EXCERPTS_SQL = _SEARCH_SQL + """,
ex AS (SELECT query_id, n, file_id || '/' || unit_pos || ', section "' || section || '"' AS label, text, score
  FROM picked JOIN idx ON idx.id = picked.chunk_id)"""


def _excerpts(t):
    index, none = _index(t), F.lit(None)
    return index.drop("embedding").join(_text_hits(t, index), "chunk_id").select(
        "query_id", "n", "text", "score", F.col("chunk_id").alias("file_id"), F.col("unit_pos").cast("string").alias("name"),
        F.col("file_id").alias("folder"), none.cast("int").alias("page"), "section", none.cast("string").alias("sheet"),
        none.cast("int").alias("row_start"), none.cast("int").alias("row_end"))


@query("hit_sources", f"""WITH {_EXCERPTS_SQL} SELECT query_id, n::INT AS n, label, round(score, 3) AS score, md5(text) AS snippet FROM ex""")
def _(t):
    sources = A.hit_sources(_excerpts(t))
    return sources.select("query_id", "n", "label", "score", F.md5("snippet").alias("snippet"))


_BLOCK_SQL = """blocks AS (SELECT query_id, '<excerpts>' || chr(10) || string_agg('<excerpt n="' || n || '" source="' ||
  replace(replace(replace(label, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '">' || chr(10) || text || chr(10) || '</excerpt>',
  chr(10) ORDER BY n) || chr(10) || '</excerpts>' AS excerpts, count(*) AS n_hits FROM ex GROUP BY 1)"""


def _labelled(t):
    return A.hit_sources(_excerpts(t)).withColumnRenamed("snippet", "text")


@query("excerpt_block", f"WITH {_EXCERPTS_SQL}, {_BLOCK_SQL} SELECT query_id, md5(excerpts) AS digest, n_hits FROM blocks")
def _(t):
    return R.excerpt_block(_labelled(t)).select("query_id", F.md5("excerpts").alias("digest"), "n_hits")


_PROMPTS_SQL = f"""{_EXCERPTS_SQL}, {_BLOCK_SQL},
hist AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
past AS (SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS told, count(*) AS k FROM hist WHERE rn <= 4 GROUP BY 1)"""
_ASKED_SQL = """SELECT b.item_id AS query_id, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits > 0 THEN coalesce(k, 0) + 1 END AS n_messages, md5(coalesce(told || '|', '') || 'user:' || {listed} excerpts
  || chr(10) || chr(10) || 'Question: ' || b.text) AS digest,
  CASE WHEN n_hits IS NULL THEN 'I couldn''t find this in your documents.' END AS answer
FROM benchmark b LEFT JOIN blocks x ON x.query_id = b.item_id LEFT JOIN past ON conv_id = b.item_id"""


@query("build_prompts", f"WITH {_PROMPTS_SQL} {_ASKED_SQL.format(listed='')}")
def _(t):
    return _prompts(t)


def _prompts(t, catalog=None):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    history = R.trim_history(t.conversations, 2).withColumnRenamed("conv_id", "query_id")
    prompts = R.build_prompts(asked, _labelled(t), history, "concise", True, catalog=catalog)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return prompts.select(
        "query_id", "n_hits", F.when(F.col("messages").isNotNull(), F.size("messages")).cast("bigint").alias("n_messages"),
        F.md5(told).alias("digest"), "answer")


# The sources of the documents as files, listed before the excerpts.
@query("build_prompts_catalog", f"""WITH {_PROMPTS_SQL},
listed AS (SELECT '<chart_sources>' || chr(10) || string_agg('- file "' || source || '" (folder "", path "' || source || '"): Word document, '
  || k || ' section(s)', chr(10) ORDER BY source) || chr(10) || '</chart_sources>' || chr(10) || chr(10) AS block
  FROM (SELECT source, count(*) AS k FROM documents GROUP BY 1 ORDER BY 1 LIMIT 60))
{_ASKED_SQL.format(listed='(SELECT block FROM listed) ||')}""")
def _(t):
    none = F.lit(0).cast("bigint")
    files = t.documents.groupBy(F.col("source").alias("pos")).agg(F.count(F.lit(1)).alias("units")).select(
        "pos", F.col("pos").alias("name"), F.lit("").alias("folder"), none.alias("pages"), none.alias("sheets"), "units")
    return _prompts(t, document_catalog(files))


@query("last_user_turn", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_text FROM conversations""")
def _(t):
    return R.last_user_turn(t.conversations).select("conv_id", "turn", "last_user_text")


@query("trim_history", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
FROM conversations) WHERE rn <= 4""")
def _(t):
    return R.trim_history(t.conversations, 2).select("conv_id", "turn", "role")


@query("blend_query", f"""WITH u AS (SELECT conv_id * 1000 + turn AS id, text, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev
  FROM conversations WHERE role = 'user'), {_bag_sql('bag', 'u')},
s AS (SELECT u.id, u.prev, (SELECT coalesce(sum(x * x), 0) FROM bag WHERE bag.id = u.id) AS a,
  (SELECT coalesce(sum(x * x), 0) FROM bag WHERE bag.id = u.prev) AS b,
  (SELECT coalesce(sum(m.x * n.x), 0) FROM bag m JOIN bag n ON m.bucket = n.bucket WHERE m.id = u.id AND n.id = u.prev) AS c FROM u)
SELECT id AS query_id, round(CASE WHEN prev IS NULL THEN a ELSE (0.75 * a + 0.25 * c)
  / CASE WHEN 0.5625 * a + 0.375 * c + 0.0625 * b = 0 THEN 1 ELSE sqrt(0.5625 * a + 0.375 * c + 0.0625 * b) END END, 8) + 0.0 AS closeness FROM s""")
def _(t):
    users = t.conversations.where(F.col("role") == "user")
    turns = R.last_user_turn(users).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.select("query_id", vectors.hash_embed(F.col("text")).alias("embedding"))
    before = turns.where(F.col("last_user_text").isNotNull()).select(
        "query_id", vectors.hash_embed(F.col("last_user_text")).alias("embedding"))
    blended = R.blended_queries(asked, before).withColumnRenamed("embedding", "blended").join(asked, "query_id")
    return _rounded(blended.select(
        "query_id", vectors.dot(F.col("blended"), F.col("embedding")).alias("closeness")), "closeness", places=8)


# ---------------------------------------------------------------- answers

_ANSWERS_SQL = """ans AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, CASE
  WHEN turn = 3 AND conv_id % 3 = 0 THEN '  I couldn’t find this in your documents . '
  WHEN turn = 3 AND conv_id % 3 = 1 THEN 'I couldn''t find this in your documents. But see [2].'
  WHEN turn = 5 THEN text ELSE text || ' [' || turn || '][2] and [' || (turn + 2) || '], [99], [2]' END AS text
  FROM conversations WHERE role = 'assistant'),
cites AS (SELECT DISTINCT answer_id, CAST(unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS INT) AS n FROM ans),
cited AS (SELECT a.answer_id, a.conv_id, a.text, coalesce(list(c.n ORDER BY c.n) FILTER (c.n BETWEEN 1 AND 5), []) AS cited
  FROM ans a LEFT JOIN cites c ON c.answer_id = a.answer_id GROUP BY 1, 2, 3)"""


def _answers(t):
    """Assistant turns with citation marks added from their turn number; some are refusals."""
    turn, conv = F.col("turn"), F.col("conv_id")
    marked = F.concat("text", F.lit(" ["), turn.cast("string"), F.lit("][2] and ["), (turn + 2).cast("string"), F.lit("], [99], [2]"))
    told = (
        F.when((turn == 3) & (conv % 3 == 0), "  I couldn’t find this in your documents . ")
        .when((turn == 3) & (conv % 3 == 1), "I couldn't find this in your documents. But see [2].")
        .when(turn == 5, F.col("text")).otherwise(marked))
    return t.conversations.where(F.col("role") == "assistant").select(
        (conv * 1000 + turn).alias("answer_id"), "conv_id", told.alias("text"))


@query("cited_set", f"WITH {_ANSWERS_SQL} SELECT answer_id, array_to_string(cited, ',') AS cited FROM cited")
def _(t):
    cited = text.cited_numbers(F.col("text"), F.lit(5))
    return _answers(t).select("answer_id", F.array_join(cited, ",").alias("cited"))


@query("is_not_found", f"""WITH {_ANSWERS_SQL} SELECT answer_id, regexp_replace(replace(lower(trim(text)), '’', ''''), '[. ]+$', '')
= 'i couldn''t find this in your documents' AS not_found FROM ans""")
def _(t):
    return _answers(t).select("answer_id", text.is_not_found(F.col("text")).alias("not_found"))


@query("is_not_found_prefix", f"""WITH {_ANSWERS_SQL} SELECT answer_id, starts_with(trim(text),
'I couldn''t find this in your documents') AS not_found FROM ans""")
def _(t):
    return _answers(t).select("answer_id", text.is_not_found_prefix(F.col("text")).alias("not_found"))


@query("answer_records", f"""WITH {_ANSWERS_SQL} SELECT answer_id, CASE WHEN conv_id % 10 = 4 THEN 'chart'
WHEN regexp_replace(replace(lower(trim(text)), '’', ''''), '[. ]+$', '') = 'i couldn''t find this in your documents'
  AND conv_id % 10 <> 3 THEN 'notfound' ELSE 'answer' END AS kind, len(cited)::INT AS n_cited FROM cited""")
def _(t):
    conv = F.col("conv_id")
    records = A.answer_records(_answers(t), F.lit(5), conv % 10 == 4, F.when(conv % 10 == 3, 1).otherwise(0))
    return records.select("answer_id", "kind", F.size("cited").alias("n_cited"))


@query("cite_sources", f"""WITH {_ANSWERS_SQL}, h AS (SELECT a.answer_id, n::INT AS n FROM ans a, unnest(range(1, 6)) u(n))
SELECT h.answer_id, h.n, 'hit ' || h.n AS label FROM h JOIN cited c ON c.answer_id = h.answer_id
WHERE list_contains(c.cited, h.n) OR len(c.cited) = 0""")
def _(t):
    answers = _answers(t).withColumn("cited", text.cited_numbers(F.col("text"), F.lit(5)))
    hits = answers.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).withColumn(
        "label", F.concat(F.lit("hit "), F.col("n").cast("string")))
    return A.cite_sources(answers, hits)


@query("union_citations", f"""WITH {_ANSWERS_SQL} SELECT answer_id, array_to_string(list_sort(list_distinct(list_concat(cited, [4, 1]))), ',') AS shown FROM cited""")
def _(t):
    cited = text.cited_numbers(F.col("text"), F.lit(5))
    shown = A.union_citations(cited, F.array(F.lit(4), F.lit(1)))
    return _answers(t).select("answer_id", F.array_join(shown, ",").alias("shown"))


_MARKDOWN_SQL = """src AS (SELECT s_suppkey AS id, s_name AS nm, CAST(s_nationkey AS VARCHAR) AS nk FROM supplier)
SELECT id AS answer_id, 0 AS block, 'paragraph' AS kind, NULL::INT AS row, NULL::INT AS col, 'Balances of ' || nm AS text FROM src
UNION ALL SELECT id, 0, 'table', 0, 0, 'Name' FROM src UNION ALL SELECT id, 0, 'table', 0, 1, 'Nation' FROM src
UNION ALL SELECT id, 0, 'table', 1, 0, nm FROM src UNION ALL SELECT id, 0, 'table', 1, 1, nk FROM src
UNION ALL SELECT id, 0, 'table', 2, 0, 'short' FROM src UNION ALL SELECT id, 0, 'table', 2, 1, '' FROM src
UNION ALL SELECT id, 1, 'item', 0, NULL, 'first ' || nm FROM src UNION ALL SELECT id, 1, 'item', 1, NULL, 'second' FROM src
UNION ALL SELECT id, 2, 'paragraph', NULL, NULL, 'plain' || chr(10) || nk FROM src"""


@query("markdown_blocks", f"WITH {_MARKDOWN_SQL}")
def _(t):
    name, nation = F.col("s_name"), F.col("s_nationkey").cast("string")
    told = F.concat(
        F.lit("Balances of "), name, F.lit("\n| Name | Nation |\n|---|:---:|\n| "), name, F.lit(" | "), nation,
        F.lit(" |\n| short |\n\n- first "), name, F.lit("\n 2. second\n \nplain\n"), nation)
    return A.markdown_blocks(t.supplier.select(F.col("s_suppkey").alias("answer_id"), told.alias("text")))


# ---------------------------------------------------------------- lookups


def _symbols(t):
    return t.part.select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))


_TYPED = ["re", "RING", " brand#1 ", "  ", "zzz"]


@query("suggest_symbols", """WITH q(query_id, query, q) AS (VALUES (0, 're', 're'), (1, 'RING', 'ring'), (2, ' brand#1 ', 'brand#1'), (4, 'zzz', 'zzz')),
m AS (SELECT query_id, query, p_brand AS symbol, p_name AS name, p_partkey AS pos,
  CASE WHEN starts_with(lower(p_name), q) OR starts_with(lower(p_brand), q) THEN 0 ELSE 1 END AS k FROM part, q
  WHERE contains(lower(p_name), q) OR contains(lower(p_brand), q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, pos) AS n FROM m)
SELECT query_id::INT AS query_id, query, symbol, name, pos, n::INT AS n FROM r WHERE n <= 8""")
def _(t):
    return K.suggest_symbols(_symbols(t), _TYPED)


@query("suggest_for_typed", """WITH q AS (SELECT page_id, lower(trim(split_part(split_part(url, '://', 2), '.', 1))) AS q FROM pages),
u AS (SELECT DISTINCT q FROM q WHERE q <> ''),
m AS (SELECT q, p_brand AS symbol, p_partkey AS pos, CASE WHEN starts_with(lower(p_name), q) OR starts_with(lower(p_brand), q) THEN 0 ELSE 1 END AS k
  FROM part, u WHERE contains(lower(p_name), q) OR contains(lower(p_brand), q)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k, pos) AS n FROM m)
SELECT page_id, symbol, pos, n::INT AS n FROM q JOIN r USING (q) WHERE n <= 8""")
def _(t):
    typed = t.pages.select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)).alias("query"))
    return K.suggest_for_typed(_symbols(t), typed).select("page_id", "symbol", "pos", "n")


@query("exclude_selected", """SELECT p_partkey AS pos, p_name AS name, p_brand AS symbol FROM part WHERE p_brand NOT IN (
SELECT p_brand FROM part WHERE p_size = 50)""")
def _(t):
    selected = t.part.where(F.col("p_size") == 50).select(F.col("p_brand").alias("symbol"))
    return K.exclude_selected(_symbols(t), selected).select("pos", "name", "symbol")


_FIRST_SQL = """keys AS (SELECT lower(p_name) AS k, p_partkey AS pos, p_name AS name, p_brand AS symbol FROM part
  UNION ALL SELECT lower(p_brand), p_partkey, p_name, p_brand FROM part),
firsts AS (SELECT k, arg_min(name, pos) AS name, arg_min(symbol, pos) AS symbol FROM keys GROUP BY 1)"""


@query("find_symbol", f"""WITH {_FIRST_SQL}, q AS (SELECT p_partkey AS query_id, ' ' || upper(CASE WHEN p_size % 3 = 0 THEN p_brand
WHEN p_size % 3 = 1 THEN p_name ELSE '' END) || ' ' AS query FROM part)
SELECT query_id, query, symbol, name FROM q JOIN firsts ON k = lower(trim(query)) WHERE trim(query) <> ''""")
def _(t):
    size = F.col("p_size")
    asked = F.when(size % 3 == 0, F.col("p_brand")).when(size % 3 == 1, F.col("p_name")).otherwise("")
    queries = t.part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit(" "), F.upper(asked), F.lit(" ")).alias("query"))
    return K.find_symbol(_symbols(t), queries)


@query("parse_symbol_param", f"""WITH {_FIRST_SQL}, p AS (SELECT c_custkey AS param_id, unnest([0, 1, 2]) AS pos_in_param,
  unnest(['brand#' || (c_custkey % 25 + 1), 'brand#' || (c_custkey % 7 + 1), 'nothing']) AS q FROM customer)
SELECT param_id, symbol, min(pos_in_param)::INT AS pos_in_param FROM p JOIN firsts ON k = q GROUP BY 1, 2""")
def _(t):
    key = F.col("c_custkey")
    written = F.concat(
        F.lit(" Brand#"), (key % 25 + 1).cast("string"), F.lit(", ,brand#"), (key % 7 + 1).cast("string"),
        F.lit(" ,nothing,Brand#2,Brand#3"))
    return K.parse_symbol_param(t.customer.select(key.alias("param_id"), written.alias("param")), _symbols(t))


@query("question_lookup", """SELECT b.item_id AS question_id, r.ref_id FROM benchmark b JOIN (
SELECT lower(trim(text)) AS k, min(item_id) AS ref_id FROM benchmark GROUP BY 1) r ON r.k = lower(trim(b.text))""")
def _(t):
    asked = t.benchmark.select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("\t "), F.translate("text", "abcdefgh", "ABCDEFGH"), F.lit(" \n")).alias("text"))
    return K.question_lookup(asked, t.benchmark.select(F.col("item_id").alias("ref_id"), "text"))


# ---------------------------------------------------------------- event counters


@query("idle_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS session_start, max(ts) AS last_used, count(*) AS n_events
FROM s GROUP BY 1, 2""")
def _(t):
    out = E.idle_sessions(t.events, ttl_minutes=720)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_used")})


@query("daily_quota", """SELECT event_id, user_id, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (
PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2 AS allowed FROM events""")
def _(t):
    return E.daily_quota(t.events, 2, F.col("event_type") != "error").select("event_id", "user_id", "allowed")


@query("rate_limit", """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, true AS allowed, [ts] AS recent FROM o WHERE rn = 1
  UNION ALL SELECT event_id, user_id, rn, ok, CASE WHEN ok THEN list_append(live, ts) ELSE live END FROM (
    SELECT o.*, list_filter(r.recent, lambda x: x > o.ts - INTERVAL 48 HOUR) AS live,
      len(list_filter(r.recent, lambda x: x > o.ts - INTERVAL 48 HOUR)) < 3 AS ok
    FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT event_id, user_id, allowed FROM r""")
def _(t):
    return E.rate_limit(t.events, 3, 48 * 3600).select("event_id", "user_id", "allowed")
