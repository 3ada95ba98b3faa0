"""Finding symbols by name, and questions by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import JS_BLANK_CHARS, strip_blank
from tallyglass.operators.ordered import first_per_key
from tallyglass.scale import broadcast_if_small, durable, spread

# Suggestions shown, symbols per search.
MAX_SUGGESTIONS, MAX_SYMBOLS = 8, 3
# Characters of a typed text that are looked up before the rest is compared.
GRAM = 3


def suggest_symbols(symbols: DataFrame, typed: list[str], limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """For each typed text: symbols(symbol, name, pos) that start with it, then those that contain it.

    The typed texts are literals of the call; each task keeps its own best ``limit`` rows per text.
    """
    asked = [(i, t, t.strip().lower()) for i, t in enumerate(typed) if t.strip()]
    if not asked:
        asked_rows = F.array().cast("array<struct<query_id:int,query:string,q:string>>")
    else:
        asked_rows = F.array(*[
            F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("query"), F.lit(q).alias("q")) for i, t, q in asked
        ])
    rank = _fit(F.lower("name"), F.lower("symbol"), F.col("_a.q"))
    hits = symbols.select("symbol", "name", "pos", F.explode(asked_rows).alias("_a")).select(
        F.col("_a.query_id").alias("query_id"), F.col("_a.query").alias("query"), "symbol", "name", "pos",
        rank.alias("_rank"),
    ).where(F.col("_rank").isNotNull())
    return first_per_key(hits, ["query_id"], [F.col("_rank"), F.col("pos")], limit).drop("_rank")


def suggest_for_typed(symbols: DataFrame, typed: DataFrame, text: str = "query", limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """``suggest_symbols`` for a table of typed texts: its rows with ``symbol, name, pos, n``; blank texts find nothing.

    Each different text is answered once, however often it was typed.  Names and symbols are cut into all their runs of
    up to ``GRAM`` characters; of these only runs of typed texts go on.  They are counted first, and a text looks up the one of its
    own runs that fewest symbols hold.  A run that all names share is met only by texts that consist of it.  A text with a run that no symbol holds
    finds nothing.  The best ``limit`` rows then go to all rows that typed the text.
    """
    key = F.lower(strip_blank(F.col(text), JS_BLANK_CHARS))
    asked = typed.withColumn("_q", key).where(F.col("_q") != "")

    q, ends = F.col("_q"), F.length("_q") - GRAM + 1
    long = F.array_distinct(F.transform(F.sequence(F.lit(1), ends), lambda i: F.substring(q, i, F.lit(GRAM))))
    # The runs of a text that are as long as can be: shorter ones are held by more symbols.
    own = F.when(ends < 1, F.array("_q")).otherwise(long)
    texts = durable(asked.select("_q").distinct().select("_q", F.explode(own).alias("_gram")))
    wanted = durable(texts.select("_gram").distinct())
    sizes = [n for n, in wanted.select(F.length("_gram")).distinct().collect()]
    grams = _runs_of(spread(symbols.select("symbol", "name", "pos"), "pos"), broadcast_if_small(wanted), sizes)
    held = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = texts.join(held, "_gram", "left").groupBy("_q").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rarest"))
    picked = durable(counted.where("_rarest.n > 0").select("_q", F.col("_rarest")["gram"].alias("_gram")))
    rank = _fit(F.lower("name"), F.lower("symbol"), F.col("_q"))
    hits = grams.join(broadcast_if_small(picked), "_gram").withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = first_per_key(hits, ["_q"], [F.col("_rank"), F.col("pos")], limit).select("_q", "symbol", "name", "pos", "n")
    best = broadcast_if_small(durable(best))
    return asked.join(best, "_q").select(*typed.columns, "symbol", "name", "pos", "n")


def _runs_of(symbols: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``symbol, name, pos, _gram``: the wanted runs of ``sizes`` characters that a name or symbol holds, each once a row.

    A run counts where it stands first, and in the symbol only if the name does not hold it.
    """
    name, symbol = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "symbol"))
    labels = F.explode(F.array(F.struct(F.lit(True).alias("named"), name.alias("label")),
                               F.struct(F.lit(False).alias("named"), symbol.alias("label"))))
    rows = symbols.select("symbol", "name", "pos", labels.alias("_l")).select("symbol", "name", "pos", "_l.*").where("label <> ''")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("label"))))
    rows = rows.withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")))
    rows = rows.where(F.col("_i") + F.col("_size") - 1 <= F.length("label"))
    rows = rows.withColumn("_gram", F.substring("label", F.col("_i"), F.col("_size"))).join(wanted, "_gram", "left_semi")
    first = F.call_function("locate", F.col("_gram"), F.col("label")) == F.col("_i")
    return rows.where(first & (F.col("named") | ~name.contains(F.col("_gram")))).select("symbol", "name", "pos", "_gram")


def _fit(name: Column, symbol: Column, q: Column) -> Column:
    """0 where a label starts with the text, 1 where one contains it, else null."""
    starts = F.coalesce(name.startswith(q), F.lit(False)) | F.coalesce(symbol.startswith(q), F.lit(False))
    return F.when(starts, 0).when(name.contains(q) | symbol.contains(q), 1)


def exclude_selected(suggestions: DataFrame, selected: DataFrame) -> DataFrame:
    return suggestions.join(selected.select("symbol").distinct(), "symbol", "left_anti")


def find_symbol(symbols: DataFrame, queries: DataFrame, query: str = "query") -> DataFrame:
    """Exact name or symbol, whatever the case; the first in list order wins.  Blank queries find nothing.

    An equi-join on the lower-case key; names are reduced to their first holder map-side before it.
    """
    both = symbols.select("symbol", "name", "pos", F.explode(F.array_distinct(
        F.array(F.lower("name"), F.lower("symbol")))).alias("_key"))
    first = both.groupBy("_key").agg(F.min_by(F.struct("symbol", "name", "pos"), "pos").alias("_s"))
    key = F.lower(strip_blank(F.col(query), JS_BLANK_CHARS))
    asked = queries.withColumn("_key", key).where(F.col("_key") != "")
    return asked.join(first, "_key").select(*queries.columns, "_s.symbol", "_s.name")


def parse_symbol_param(params: DataFrame, symbols: DataFrame, id_col: str = "param_id",
                       text: str = "param", most: int = MAX_SYMBOLS) -> DataFrame:
    """``"A, B,,C,D"`` -> its first ``most`` non-blank names, resolved, each symbol once, in order."""
    names = F.transform(F.split(F.col(text), ","), lambda s: strip_blank(s, JS_BLANK_CHARS))
    first = F.slice(F.filter(names, lambda s: s != ""), 1, most)
    asked = params.select(id_col, F.posexplode(first).alias("pos_in_param", "query"))
    found = find_symbol(symbols, asked)
    return found.groupBy(id_col, "symbol").agg(F.min("pos_in_param").alias("pos_in_param"))


def question_lookup(questions: DataFrame, references: DataFrame) -> DataFrame:
    """questions(question_id, text) matched to references(ref_id, text), case and outer blanks aside; first match."""
    key = lambda: F.lower(strip_blank(F.col("text"), JS_BLANK_CHARS))
    first = references.groupBy(key().alias("_key")).agg(F.min("ref_id").alias("ref_id"))
    return questions.withColumn("_key", key()).join(first, "_key").select("question_id", "ref_id")
