"""Quality rules: plain text statistics, and how likely a text's hashed n-grams are under a trusted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import BLANKS, let, packed, unpacked, whole_text, words_of
from tallyglass.scale import BROADCAST_ROWS, broadcast_if_small

BUCKETS = 1 << 14
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def _count(items: Column) -> Column:
    return F.size(items).cast("bigint")


def _windows(hashes: Column, width: int) -> Column:
    """One hash per run of ``width`` words."""
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])
    return F.when(F.size(hashes) >= width, F.transform(F.sequence(F.lit(0), F.size(hashes) - width), one)).otherwise(
        F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that are found twice or more.

    Sorting (hash, place) brings equal windows together; the places of repeated ones, in order, each cover up to the
    next one's start.  Texts without a repeat, the most, are settled by a count of distinct hashes.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def length(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
        let(let(placed, repeated), length))


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` that the text holds twice or more, the first included."""
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_windows(h, WINDOW), _covered))


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))
    return let(lines, lambda x: _count(x) - _count(F.array_distinct(x)))


def _buckets(hashes: Column) -> Column:
    """The buckets of all words and all pairs of words."""
    grams = F.concat(hashes, _windows(hashes, 2))
    return F.transform(grams, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def ngram_model(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                smoothing: float = 1.0, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """One row with ``weights``: per bucket the log of its share in trusted texts over its share in all texts.

    ``trusted`` holds ids in ``id_col``: all of them make up the trusted model, all texts the raw one.  Both counts
    come from one reading and combine map-side into ``BUCKETS`` rows.  The ids travel to the texts only where a count
    finds at most ``max_broadcast``; otherwise both sides are shuffled by id, texts before their n-grams, which are longer.
    """
    chosen = trusted.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().withColumn(
        "__trusted", F.lit(1))
    texts = docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"))
    flagged = texts.join(broadcast_if_small(chosen, max_broadcast), "__id", "left")
    # explode() would have its input computed once more, to drop texts without words beforehand.
    grams = flagged.select("__trusted", F.explode_outer(_buckets_once(F.col("__text"))).alias("bucket")).where(
        "bucket IS NOT NULL")
    counts = grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("own"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").fillna(0, ["raw", "own"])
    gathered = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "own"))).alias("c"),
                          F.sum("raw").alias("all_raw"), F.sum("own").alias("all_own"))
    def share(count: Column, total: str) -> Column:
        return (count + smoothing) / (F.col(total) + smoothing * BUCKETS)
    weights = F.transform(
        "c", lambda c: (F.log(share(c["own"], "all_own")) - F.log(share(c["raw"], "all_raw"))).cast("float"))
    return gathered.select(weights.alias("weights"))


def _buckets_once(text: Column) -> Column:
    return let(_hashes(text), _buckets)


def quality_columns(text: Column, weights: Column) -> Column:
    """All statistics of one text as a struct; the text is split into words once."""
    def stats(words: Column) -> Column:
        def by_hash(hashes: Column) -> Column:
            def fit(grams: Column) -> Column:
                total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(weights, b))
                return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))
            return F.struct(let(_windows(hashes, WINDOW), _covered).alias("n_repeat_words"), let(_buckets(hashes), fit).alias("ratio"))
        found = let(F.transform(words, lambda w: F.xxhash64(w)), by_hash)
        return F.struct(_count(words).alias("n_words"), found.alias("found"))
    bare = F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint")
    symbols = F.length(F.regexp_replace(text, "[^" + SYMBOLS[1:-1] + "]+", "")).cast("bigint")
    return F.struct(let(words_of(text), stats).alias("s"), bare.alias("word_chars"), symbols.alias("n_symbols"),
                    _repeated_lines(text).alias("n_dup_lines"))


def _judged(rows: DataFrame, text: Column, weights: Column, threshold: float) -> DataFrame:
    """``rows`` with ``__q``: the statistics, ``base_failed`` and ``kept``, in one expression that reads the text once."""
    def verdict(s: Column) -> Column:
        words, repeats, ratio = s["s"]["n_words"], s["s"]["found"]["n_repeat_words"], s["s"]["found"]["ratio"]
        failed = (words < 10) | (100 * repeats > 20 * words)
        return F.struct(
            words.alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
            s["n_dup_lines"].alias("n_dup_lines"), repeats.alias("n_repeat_words"), failed.alias("base_failed"),
            (~failed & (ratio >= threshold)).alias("kept"), ratio.alias("log_ratio"))

    # Spark takes no subquery inside a lambda function, so the one value of the weights comes in as a column.
    weighted = rows.withColumn("__w", weights)
    return weighted.select(*rows.columns, let(quality_columns(text, F.col("__w")), verdict).alias("__q"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = -0.2) -> DataFrame:
    """One row per document: ``doc_id``, the statistics, ``base_failed``, ``kept`` and ``log_ratio``.

    Words are runs without the blanks U+0020 and U+0009 to U+000D; a null text has none and fails.  ``log_ratio`` is
    the mean over a text's words and pairs of words of the log of their shares in the trusted and the raw model
    (``ngram_model``); a document is kept when the base rules hold and it is at least ``threshold``.  Without trusted
    texts, or with trusted texts like the whole corpus, every ratio is near 0 and the base rules alone decide.  Null
    ids are judged like others but cannot be trusted; repeated rows repeat in the result and count twice in the raw
    model.
    """
    weights = ngram_model(docs, trusted, id_col, text_col).scalar()
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("__text"))
    return _judged(rows, F.col("__text"), weights, threshold).select("doc_id", "__q.*")


def drop_poor(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = -0.2) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns as they are."""
    weights = ngram_model(docs, trusted, id_col, text_col).scalar()
    rows = packed(docs, text=whole_text(text_col))
    return unpacked(_judged(rows, F.col("__text"), weights, threshold).where("__q.kept"), docs)
