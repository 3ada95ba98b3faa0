"""Lexicon-and-rule sentiment (Hutto & Gilbert, 2014) as joins and aggregations.

Shape of the plan, for any number of texts:

1. equal tokens of a text share the valence of the first one, so each different token is laid out once, with its places
   and the first one's neighbours, inside the row with array functions (no shuffle);
2. a lexicon proven small is broadcast to these rows.  A larger one, as long as it is proven to fit in bounded memory, is sent
   packed, and texts take their valences where they lie.  One beyond that never meets the rows one by one: texts lie in blocks,
   the different words of a block are joined to the lexicon, and the block's texts take the valences found; tokens without a
   valence are dropped at once, as they add 0.  Before texts move to their block, a Bloom filter of the lexicon blanks the
   words that neither it nor a rule can know, so these are neither shuffled nor looked up;
3. the rules are column expressions over the token's neighbours;
4. a text is summed where it lies.  Only texts that share their id are summed per token first.

No window over tokens and no group larger than one text or one block is needed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import even_blanks, half_up
from tallyglass.scale import BROADCAST_ROWS, broadcast_if_small, is_small, split_by_id

# Model constants.
BOOST = 0.293
CAPS = 0.733
NEGATION = -0.74
ALPHA = 15.0
BUT_BEFORE, BUT_AFTER = 0.5, 1.5

NOISE = 1e-9  # smaller than any difference the model can mean

# Characters of text whose words are looked up together in a lexicon too large to be broadcast.
BLOCK_CHARS = 1 << 23

# A lexicon past the row bound of a broadcast is sent packed if it takes at most so many bytes for each row of that bound (64 MB
# at the usual one), a word taking its own bytes, a hash, a valence and an offset.
PACKED_BYTES, WORD_BYTES = 320, 20

# Bits that one word sets inside its 64-bit mask, how many words share a mask on average, and the most masks (8 MB).
FILTER_BITS, WORDS_PER_MASK, MOST_MASKS = 4, 4, 1 << 20

# Negations.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't",
    "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh",
    "wasnt", "werent", "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont",
    "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

# Words that strengthen the next word, and words and phrases that weaken it.
STRONGER = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "effing",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously", "flipping", "flippin",
    "fricking", "frickin", "frigging", "friggin", "fully", "fucking", "greatly", "hella", "highly", "hugely",
    "incredibly", "intensely", "majorly", "more", "most", "particularly", "purely", "quite", "really",
    "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "uber", "unbelievably",
    "unusually", "utterly", "very",
]
WEAKER = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof", "sort-of",
]
WEAKER_PHRASES = ["just enough", "kind of", "sort of"]

# Phrases with a valence of their own.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0,
}

# Words, in lower case, that a rule compares with a neighbour or with the token itself.
RULE_WORDS = sorted({
    *NEGATIONS, *STRONGER, *WEAKER, *[w for phrase in (*WEAKER_PHRASES, *IDIOMS) for w in phrase.split()],
    "never", "so", "this", "least", "at", "very", "but",
})

# ASCII punctuation, and the affixes that are cut off a word.
PUNCTUATION = r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]\^_`{|}~"""
AFFIX = r"""(?:\?!\?!|!\?!\?|\?!\?|!\?!|!!!|\?\?\?|!!|\?\?|[.!?,;:\-'"])"""
_WORD = rf"([^{PUNCTUATION} ]{{2,}}|[\x{{10000}}-\x{{10FFFF}}])"
_STRIPPABLE = rf"^{AFFIX}{_WORD}$|^{_WORD}{AFFIX}$"
_TOUCHED = rf"^[{PUNCTUATION}]|[{PUNCTUATION}]$"


def tokens(text: Column) -> Column:
    """Words of a text in order, one listed punctuation affix cut off, one-letter words dropped.

    A character outside the basic plane counts as two letters, so a single emoji stays.  Only words with
    punctuation at an end meet the affix pattern.
    """
    words = F.filter(F.split(even_blanks(text), " +"), lambda w: (F.length(w) > 1) | (F.octet_length(w) == 4))
    return F.transform(
        words, lambda w: F.when(w.rlike(_TOUCHED), F.regexp_replace(w, _STRIPPABLE, "$1$2")).otherwise(w)
    )


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def cap_diff(words: Column) -> Column:
    """Some words are in capitals, but not all of them."""
    return F.exists(words, is_upper) & F.exists(words, lambda w: ~is_upper(w))


def negated(word: Column) -> Column:
    low = F.lower(word)
    return low.isin(NEGATIONS) | low.contains("n't")


def is_booster(word: Column) -> Column:
    return F.lower(word).isin([*STRONGER, *WEAKER])


def booster_scalar(word: Column, valence: Column, caps: Column) -> Column:
    low = F.lower(word)
    base = F.when(low.isin(STRONGER), F.lit(BOOST)).when(low.isin(WEAKER), F.lit(-BOOST))
    signed = F.when(valence < 0, -base).otherwise(base)
    loud = F.when(is_upper(word) & caps, F.when(valence > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)
    return F.coalesce(signed + loud, F.lit(0.0))


def punct_emphasis(text: Column) -> Column:
    exclaims = F.least(F.regexp_count(text, F.lit("!")), F.lit(4)) * 0.292
    asks = F.regexp_count(text, F.lit(r"\?"))
    return exclaims + F.when(asks > 3, 0.96).when(asks > 1, asks * 0.18).otherwise(0.0)


def normalize_score(total: Column) -> Column:
    return total / F.sqrt(total * total + ALPHA)


def but_position(words: Column) -> Column:
    """0-based position of the first ``but``, null when there is none."""
    found = F.array_position(F.transform(words, F.lower), "but")
    return F.when(found > 0, found.cast("int") - 1)


def but_weight(pos: Column, but: Column) -> Column:
    return F.when(pos < but, BUT_BEFORE).when(pos > but, BUT_AFTER).otherwise(1.0)


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per token with its three left and two right neighbours; narrow.

    Each text also yields one closing row with a null token, which keeps texts without any scored token
    alive through the aggregations and carries the text's own figures.
    """
    none = F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    laid = docs.select(id_col, text.alias("_text"), tokens(text).alias("_w"))
    laid = laid.select(
        id_col, "_w",
        F.size("_w").alias("n_tokens"), cap_diff(F.col("_w")).alias("caps"),
        but_position(F.col("_w")).alias("but_pos"), punct_emphasis(F.col("_text")).alias("emphasis"),
        F.arrays_zip(
            F.concat(F.col("_w"), F.array(none)).alias("token"),
            F.concat(F.array(none), F.col("_w")).alias("p1"),
            F.concat(F.array(none, none), F.col("_w")).alias("p2"),
            F.concat(F.array(none, none, none), F.col("_w")).alias("p3"),
            F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("n1"),
            F.slice("_w", F.lit(3), F.greatest(F.size("_w"), F.lit(1))).alias("n2"),
        ).alias("_z"),
    )
    names = [id_col, "n_tokens", "caps", "but_pos", "emphasis"]
    return (
        # The outer form: the plain one makes the optimizer test the array first, cutting the text twice.
        laid.select(*names, F.posexplode_outer("_z").alias("pos", "_t"))
        .select(*names, "pos", "_t.*")
        .where(F.col("pos") <= F.col("n_tokens"))
    )


def token_rows(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """(keep..., pos, token): one row per token and nothing more."""
    # The outer form for the same reason as above.
    rows = docs.select(*keep, F.posexplode_outer(tokens(F.col(text_col))).alias("pos", "token"))
    return rows.where(F.col("token").isNotNull())


def _let(value: Column, use) -> Column:
    """Bind ``value`` once inside an expression: ``use`` gets a variable, so nothing is evaluated again."""
    return F.transform(F.array(value), use)[0]


def word_places(words: Column, valences: Column | None = None) -> Column:
    """The different words of an array: ``array<struct<token, places>>``, ``places`` (0-based) in ascending order.

    Given ``valences`` beside the words, only the words that have one.
    """
    placed = F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
    if valences is not None:
        placed = F.filter(placed, lambda x: F.get(valences, x["pos"]).isNotNull())
    placed = F.sort_array(placed)

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (s[i]["token"] != F.get(s, i - 1)["token"]))

    def cut(s: Column) -> Column:
        return F.when(F.size(s) > 0, _let(starts(s), lambda at: F.transform(
            F.sequence(F.lit(0), F.size(at) - 2),
            lambda k: F.struct(s[at[k]]["token"].alias("token"),
                               F.transform(F.slice(s, at[k] + 1, at[k + 1] - at[k]), lambda x: x["pos"]).alias("places")))))

    return _let(placed, cut)


def first_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, token, first_pos, n``: each different token of an id, its first place and how often it stands there.

    Counted inside the row; only texts that share their id meet in a shuffle.
    """
    once, again = split_by_id(docs.select(id_col, text_col), id_col)
    found = once.select(id_col, F.explode(word_places(tokens(F.col(text_col)))).alias("_t")).select(
        id_col, "_t.token", F.col("_t.places")[0].alias("first_pos"), F.size("_t.places").cast("bigint").alias("n"))
    if again is None:
        return found
    rows = token_rows(again, id_col, text_col=text_col)
    return found.unionByName(rows.groupBy(id_col, "token").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")))


def lexicon_lookup(token_rows: DataFrame, lexicon: DataFrame, column: str = "token",
                   name: str = "valence") -> DataFrame:
    """Left join of a token column to its valence, looked up in lower case."""
    side = lexicon.select(F.col("token").alias("_key"), F.col("valence").alias("_valence"))
    joined = token_rows.join(side, F.lower(F.col(column)) == F.col("_key"), "left").drop("_key")
    return joined.withColumnRenamed("_valence", name)


def _packed(lexicon: DataFrame, max_bytes: int) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
    """The hashes of the lexicon's words in ascending order, the words and their valences; None where they take over
    ``max_bytes``, which is told before anything is gathered, or where two rows share a hash.
    """
    known = lexicon.where(F.col("valence").isNotNull() & F.col("token").isNotNull())
    size = F.coalesce(F.sum(F.octet_length("token") + WORD_BYTES), F.lit(0))
    if known.agg(size).first()[0] > max_bytes:
        return None
    own = known.select(F.xxhash64("token").alias("h"), "token", F.col("valence").cast("double").alias("valence")).toArrow()
    own = own.sort_by("h").combine_chunks()
    hashes = own.column("h").to_numpy()
    if (hashes[1:] == hashes[:-1]).any():
        return None
    return hashes, pa.concat_arrays(own.column("token").chunks or [pa.array([], pa.string())]), own.column("valence").to_numpy()


def _valences_in_place(laid: DataFrame, packed: tuple[np.ndarray, pa.Array, np.ndarray]) -> DataFrame:
    """``laid`` with ``valences`` for its words ``_w``: those of the packed lexicon, null where it has none.  Nothing moves.

    A hash finds the only word that can be meant, and the word itself decides.
    """
    sent = laid.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("array<double>")
    def look_up(low: pa.Array, hashes: pa.Array) -> pa.Array:
        keys, words, values = sent.value
        flat, h = low.flatten(), hashes.flatten().to_numpy()
        known, found = np.zeros(len(h), bool), np.zeros(len(h))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            near = np.flatnonzero(keys[at] == h)
            same = pc.equal(flat.take(pa.array(near)), words.take(pa.array(at[near])).cast(flat.type))
            near = near[same.to_numpy(zero_copy_only=False)]
            known[near], found[near] = True, values[at[near]]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(low).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found, mask=~known))

    low = laid.withColumn("_low", F.transform("_w", F.lower))
    return low.withColumn("valences", look_up("_low", F.transform("_low", lambda w: F.xxhash64(w)))).drop("_low")


def _word_filter(lexicon: DataFrame) -> np.ndarray:
    """A Bloom filter of the lexicon's words: 64-bit masks, at most ``MOST_MASKS``; more words only let more others pass.

    A word's hash, without its sign, tells its mask by its remainder and the bits inside by its parts of six bits.
    """
    hashes = lexicon.where(F.col("valence").isNotNull()).select(F.xxhash64("token").alias("h"))
    masks = max(1, min(MOST_MASKS, math.ceil(hashes.count() / WORDS_PER_MASK)))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned("h", 6 * i).bitwiseAND(63).cast("int")) for i in range(FILTER_BITS)]
    place = F.pmod(F.shiftrightunsigned("h", 1), F.lit(masks).cast("bigint")).alias("place")
    own = hashes.groupBy(place).agg(F.bit_or(reduce(Column.bitwiseOR, bits)).alias("mask")).toArrow()
    filled = np.zeros(masks, np.uint64)
    filled[own.column("place").to_numpy()] = own.column("mask").to_numpy().view(np.uint64)
    return filled


def _known_words(laid: DataFrame, lexicon: DataFrame, rules: bool) -> DataFrame:
    """``laid`` with ``_line`` for its words ``_w``: the words in one line, those empty that are no word of the lexicon for
    sure, nor, with ``rules``, matter to a rule.  Words hold no blank, so the line cut at blanks gives them back.
    """
    filled = laid.sparkSession.sparkContext.broadcast(_word_filter(lexicon))

    @F.arrow_udf("string")
    def line(words: pa.Array, hashes: pa.Array) -> pa.Array:
        flat, masks = words.flatten(), filled.value
        h = hashes.flatten()
        spared = h.is_null().to_numpy(zero_copy_only=False)
        h = h.fill_null(0).to_numpy().view(np.uint64)
        own, known = masks[(h >> np.uint64(1)) % np.uint64(len(masks))], np.ones(len(h), bool)
        for i in range(FILTER_BITS):
            known &= (own >> (h >> np.uint64(6 * i) & np.uint64(63)) & np.uint64(1)).astype(bool)
        kept = pc.if_else(pa.array(known | spared), flat, "")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), kept), " ")

    def hash_of(word: Column) -> Column:
        low = F.lower(word)
        known = F.xxhash64(low)
        return F.when(~(low.isin(RULE_WORDS) | low.contains("n't")), known) if rules else known

    return laid.withColumn("_line", line("_w", F.transform("_w", hash_of))).drop("_w")


def _with_valences(laid: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``laid``, which lies in blocks by ``_block``, with ``valences`` for its lower-case words ``_low``: those of the
    lexicon (one row per token), null where it has none.  Empty words have none.

    The different words of a block meet the lexicon, and what is found comes back to the block.
    """
    # The outer form: the plain one tests the array below the shuffle of the blocks, which then is not the same for both.
    asked = laid.select("_block", F.explode_outer("_low").alias("token")).where("token <> ''").distinct()
    found = lexicon_lookup(asked, lexicon).where(F.col("valence").isNotNull())
    kept = laid.drop("_block", "_low")
    names = kept.columns

    def look_up(block: pa.Table, known: pa.Table) -> pa.Table:
        low = block.column("_low").combine_chunks()
        flat = low.flatten()
        at = pc.index_in(flat, value_set=known.column("token").combine_chunks().cast(flat.type))
        sizes = pc.list_value_length(low).to_numpy(zero_copy_only=False).tolist()
        ends = [0]
        for n in sizes:
            ends.append(ends[-1] + n)
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.column("valence").combine_chunks().take(at))
        return pa.Table.from_arrays([*(block.column(c) for c in names), values], names=[*names, "valences"])

    schema = kept.withColumn("valences", F.lit(None).cast("array<double>")).schema
    found = found.select(F.col("_block").alias("_found_in"), "token", F.col("valence").cast("double").alias("valence"))
    return laid.groupBy("_block").cogroup(found.groupBy("_found_in")).applyInArrow(look_up, schema)


def _in_blocks(laid: DataFrame, chars: int) -> DataFrame:
    """``laid`` by ``_block``, each of about ``BLOCK_CHARS`` of all ``chars``.  Equal rows aside, rows spread evenly.

    The block is told from all columns on both sides of the shuffle, so all that read the blocks, whichever columns they need,
    ask for the very same shuffle and texts are written once.
    """
    blocks = math.ceil((chars or 1) / BLOCK_CHARS)
    block = F.pmod(F.xxhash64(*laid.columns), F.lit(blocks))
    return laid.repartition(blocks, block).withColumn("_block", block)


def _n_chars(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.length(text_col))).first()[0] or 0


def valence_sums(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id, n, scored, total``: tokens of an id, those that the lexicon (one row per token) scores, and their sum."""
    if is_small(lexicon, max_broadcast_rows):
        found = lexicon_lookup(token_rows(docs, id_col, text_col=text_col), F.broadcast(lexicon))
        return found.groupBy(id_col).agg(
            F.count(F.lit(1)).alias("n"), F.count("valence").alias("scored"), F.sum("valence").alias("total"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(id_col, tokens(text).alias("_w")).select(id_col, F.size("_w").alias("n"), "_w")
    packed = _packed(lexicon, max_broadcast_rows * PACKED_BYTES)
    if packed is not None:
        found = _valences_in_place(words, packed)
    else:
        low = F.transform(F.split("_line", " "), F.lower)
        placed = _in_blocks(_known_words(words, lexicon, rules=False), _n_chars(docs, text_col))
        found = _with_valences(placed.select(id_col, "n", "_block", low.alias("_low")), lexicon)
    scored = F.filter("valences", lambda v: v.isNotNull())
    each = found.where("n > 0").select(id_col, "n", scored.alias("_s")).select(
        id_col, "n", F.size("_s").alias("scored"),
        F.when(F.size("_s") > 0, F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)).alias("total"))
    return each.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("total").alias("total"))


def word_table(lexicon: DataFrame) -> DataFrame:
    """The lexicon with the rule words beside it: (token, valence, boost, negation)."""
    rules = [(w, BOOST, False) for w in STRONGER] + [(w, -BOOST, False) for w in WEAKER]
    rules += [(w, None, True) for w in NEGATIONS]
    side = lexicon.sparkSession.createDataFrame(rules, "token string, boost double, negation boolean")
    both = lexicon.select("token", "valence").unionByName(side, allowMissingColumns=True)
    return both.groupBy("token").agg(F.max("valence").alias("valence"), F.max("boost").alias("boost"),
                                     F.max("negation").alias("negation"))


def _neighbour_lookup(rows: DataFrame, words: DataFrame, p: int) -> DataFrame:
    """What the p-th word to the left is: scored (``l``, unless known), a booster (``b``), a negation (``g``)."""
    low = F.lower(F.col(f"p{p}"))
    side = words.select(F.col("token").alias("_key"), "valence", "boost", "negation").withColumnsRenamed(
        {"valence": "_valence", "boost": f"b{p}", "negation": "_negation"})
    joined = rows.join(side, low == F.col("_key"), "left")
    return joined.withColumns({
        f"l{p}": F.col(f"l{p}") if f"l{p}" in rows.columns else F.col("_valence").isNotNull(),
        f"g{p}": F.coalesce(F.col("_negation"), F.lit(False)) | low.contains("n't"),
    }).drop("_key", "_valence", "_negation")


def _phrase(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _idiom(valence: Column, t: Column, p1: Column, p2: Column, p3: Column, n1: Column, n2: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in IDIOMS.items() for x in pair])

    def value_of(*words: Column) -> Column:
        return F.try_element_at(table, F.concat(*[x for w in words for x in (w, F.lit(" "))][:-1]))

    # An idiom reaching to the right wins over one to the left; of those to the left the first found wins.
    found = F.coalesce(
        value_of(t, n1, n2), value_of(t, n1), value_of(p1, t), value_of(p2, p1, t), value_of(p2, p1),
        value_of(p3, p2, p1), value_of(p3, p2), valence,
    )
    # Phrases are put together only where a word that ends one is near.
    endings = sorted({words.split()[-1] for words in IDIOMS})
    near = F.arrays_overlap(F.array_compact(F.array(t, p1, p2, n1, n2)), F.array(*[F.lit(w) for w in endings]))
    weak = p2.isin("kind", "sort", "just") | p3.isin("kind", "sort", "just")
    valence = F.when(near, found).otherwise(valence)
    weakened = weak & (_phrase(p3, p2).isin(WEAKER_PHRASES) | _phrase(p2, p1).isin(WEAKER_PHRASES))
    return F.when(weakened, valence - BOOST).otherwise(valence)


def _apply_rules(hits: DataFrame) -> DataFrame:
    """Valence of each scored token from its neighbours; one projection per rule keeps expressions small."""
    t, caps = F.col("token"), F.col("caps")
    p1, p2, p3, n1, n2 = (F.col(c) for c in ("p1", "p2", "p3", "n1", "n2"))
    v = F.col("v")
    so_this = ["so", "this"]

    def signed(amount: Column | float, by: Column) -> Column:
        return F.when(by > 0, amount).otherwise(-amount)

    def boosted(p: int) -> Column:
        boost = F.when(v < 0, -F.col(f"b{p}")).otherwise(F.col(f"b{p}"))
        loud = F.when(is_upper(F.col(f"p{p}")) & caps, signed(F.lit(CAPS), v)).otherwise(0.0)
        return (boost + loud) * (1.0, 0.95, 0.9)[p - 1]

    def free(p: int) -> Column:
        return F.col(f"p{p}").isNotNull() & ~F.col(f"l{p}")

    valence = F.col("valence")
    out = hits.withColumn(
        "v", F.when(is_upper(t) & caps, valence + signed(F.lit(CAPS), valence)).otherwise(valence))
    # "never so" and "never this" two or three words back strengthen instead of turning the valence round.
    never = {
        1: (F.lit(False), 1.0),
        2: ((p2 == "never") & p1.isin(so_this), 1.5),
        3: (((p3 == "never") & p2.isin(so_this)) | p1.isin(so_this), 1.25),
    }
    for p in (1, 2, 3):
        out = out.withColumn("v", F.when(free(p) & F.col(f"b{p}").isNotNull(), v + boosted(p)).otherwise(v))
        test, factor = never[p]
        out = out.withColumn(
            "v", F.when(free(p) & test, v * factor).when(free(p) & F.col(f"g{p}"), v * NEGATION).otherwise(v))
    out = out.withColumn("v", F.when(free(3), _idiom(v, t, p1, p2, p3, n1, n2)).otherwise(v))
    # "least" in front, unless it reads "at least" or "very least".
    spared = F.coalesce(F.lower(p2).isin("at", "very"), F.lit(False))
    out = out.withColumn("v", F.when(free(1) & (F.lower(p1) == "least") & ~spared, v * NEGATION).otherwise(v))
    # "kind of" carries no valence itself.
    kind_of = (F.lower(t) == "kind") & (F.lower(n1) == "of")
    return out.withColumn("v", F.when(F.coalesce(kind_of, F.lit(False)), 0.0).otherwise(v))


def _laid_out(rows: DataFrame, id_col: str) -> DataFrame:
    """Texts with their words ``_w`` and their own figures."""
    laid = rows.select(id_col, "_text", tokens(F.col("_text")).alias("_w"))
    return laid.select(
        id_col, "_w", F.size("_w").alias("n_tokens"), cap_diff(F.col("_w")).alias("caps"),
        but_position(F.col("_w")).alias("but_pos"), punct_emphasis(F.col("_text")).alias("emphasis"))


def _different_tokens(laid: DataFrame, id_col: str) -> DataFrame:
    """One row per text and different token: its ``places``, the first one ``pos`` and the neighbours there.

    With ``valences`` beside the words only scored tokens are laid out, with ``valence`` and whether the words to the left
    are scored.  Each text also yields one closing row with a null token, which keeps texts without any scored token alive
    through the aggregations and carries the text's own figures.
    """
    valued = "valences" in laid.columns

    def row(t: Column) -> Column:
        first, w = t["places"][0], F.col("_w")
        around = {"p1": -1, "p2": -2, "p3": -3, "n1": 1, "n2": 2}
        fields = [t["token"].alias("token"), t["places"].alias("places"), first.alias("pos"),
                  *[F.get(w, first + by).alias(name) for name, by in around.items()]]
        if valued:
            v = F.col("valences")
            fields += [F.get(v, first).alias("valence"), *[F.get(v, first - p).isNotNull().alias(f"l{p}") for p in (1, 2, 3)]]
        return F.struct(*fields)

    found = word_places(F.col("_w"), F.col("valences") if valued else None)
    names = [id_col, "n_tokens", "caps", "but_pos", "emphasis"]
    # The outer form: the plain one makes the optimizer test the array first, cutting the text twice.
    return laid.select(*names, F.explode_outer(F.concat(F.transform(found, row), F.array(F.lit(None)))).alias("_t")).select(
        *names, "_t.*")


def token_valences(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per id and distinct scored token: valence ``v``, total ``weight``, count ``n``.

    A row with a null token per text carries the text's figures.  Boosters add 0 and are left out.
    """
    words = word_table(lexicon)
    small, packed = is_small(lexicon, max_broadcast_rows), None
    if small:
        rules = words = F.broadcast(words)
    else:
        rules = F.broadcast(word_table(lexicon.limit(0)))
        words = words.where(F.col("valence").isNotNull()).select("token", "valence")
        packed = _packed(words, max_broadcast_rows * PACKED_BYTES)

    def valued(texts: DataFrame) -> DataFrame:
        if small:
            text = F.coalesce(F.col(text_col), F.lit(""))
            rows = _different_tokens(_laid_out(texts.select(id_col, text.alias("_text")), id_col), id_col)
            rows = lexicon_lookup(rows, words.where(F.col("valence").isNotNull() & F.col("boost").isNull()))
            hits = rows.where(F.col("valence").isNotNull() | F.col("token").isNull())
        else:
            text = F.coalesce(F.col(text_col), F.lit(""))
            laid = _laid_out(texts.select(id_col, text.alias("_text")), id_col)
            if packed is not None:
                laid = _valences_in_place(laid, packed)
            else:
                placed = _in_blocks(_known_words(laid, lexicon, rules=True), _n_chars(texts, text_col))
                laid = placed.withColumn("_w", F.split("_line", " ")).drop("_line")
                laid = _with_valences(laid.withColumn("_low", F.transform("_w", F.lower)), words)
            rows = _different_tokens(laid, id_col)
            hits = rows.where(F.col("token").isNull() | ~is_booster(F.col("token")))
        for p in (1, 2, 3):
            hits = _neighbour_lookup(hits, rules, p)
        weight = F.aggregate("places", F.lit(0.0), lambda sum_, at: sum_ + but_weight(at, F.col("but_pos")))
        return _apply_rules(hits).select(
            id_col, "token", "pos", "v", weight.alias("weight"),
            F.coalesce(F.size("places"), F.lit(1)).cast("bigint").alias("n"), "n_tokens", "emphasis")

    once, again = split_by_id(docs, id_col)
    rows = valued(once).drop("pos")
    if again is None:
        return rows
    return rows.unionByName(valued(again).groupBy(id_col, "token").agg(
        F.min_by("v", "pos").alias("v"), F.sum("weight").alias("weight"), F.sum("n").alias("n"),
        F.max("n_tokens").alias("n_tokens"), F.max("emphasis").alias("emphasis")))


def sentence_sums(valences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: total, positive and negative sums (each token biased by one) and the neutral count."""
    scored = F.col("token").isNotNull()
    v, share = F.col("v"), F.col("v") * F.col("weight")
    return valences.groupBy(id_col).agg(
        F.sum(F.when(scored, share).otherwise(0.0)).alias("total"),
        F.sum(F.when(scored & (v > 0), share + F.col("n")).otherwise(0.0)).alias("pos_sum"),
        F.sum(F.when(scored & (v < 0), share - F.col("n")).otherwise(0.0)).alias("neg_sum"),
        (F.max("n_tokens") - F.sum(F.when(scored & (v != 0), F.col("n")).otherwise(0))).cast("bigint")
        .alias("neu_count"),
        F.max("n_tokens").cast("bigint").alias("n_tokens"),
        F.max("emphasis").alias("emphasis"),
    )


def polarity_of_sums(sums: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Emphasis goes to the larger side.  Sides that differ by less than ``NOISE`` are equal: a float sum's last
    bits depend on the order of partial sums, and must not decide which way a text is pushed.
    """
    emphasis, total = F.col("emphasis"), F.col("total")
    loud = (
        F.when(total > NOISE, total + emphasis).when(total < -NOISE, total - emphasis).otherwise(0.0)
    )
    pos, neg = F.col("pos_sum"), F.col("neg_sum")
    lead = pos - F.abs(neg)
    out = sums.select(
        id_col, "n_tokens", "neu_count", loud.alias("_total"),
        F.when(lead > NOISE, pos + emphasis).otherwise(pos).alias("_pos"),
        F.abs(F.when(lead < -NOISE, neg - emphasis).otherwise(neg)).alias("_neg"),
    )
    whole = F.col("_pos") + F.col("_neg") + F.col("neu_count")

    def share(part: str) -> Column:
        return F.when(F.col("n_tokens") == 0, 0.0).otherwise(half_up(F.try_divide(F.col(part), whole), 3))

    return out.select(
        id_col, share("_neg").alias("neg"), share("neu_count").alias("neu"), share("_pos").alias("pos"),
        F.when(F.col("n_tokens") == 0, 0.0).otherwise(half_up(normalize_score(F.col("_total")), 4))
        .alias("compound"),
    )


def polarity_scores(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text) x lexicon -> (id, neg, neu, pos, compound).  Ids must be unique."""
    valences = token_valences(docs, lexicon, id_col, text_col, max_broadcast_rows)
    return polarity_of_sums(sentence_sums(valences, id_col), id_col)


def merge_lexicons(base: DataFrame, finance: DataFrame, scale: float = 0.1) -> DataFrame:
    """Finance words override base words, their valence scaled."""
    b = base.select("token", F.col("valence").alias("_base"))
    f = finance.select("token", F.col("valence").alias("_finance"))
    return b.join(f, "token", "full_outer").select(
        "token", F.coalesce(F.col("_finance") * scale, F.col("_base")).alias("valence")
    )
