import random

import pytest
from plain_scorer import score, words_of
from pyspark.sql import functions as F

from tallyglass.operators import sentiment as S

LEXICON = {
    "good": 1.9, "great": 3.1, "bad": -2.5, "terrible": -2.1, "kind": 2.4, "shit": -2.6, "bomb": -2.2, "death": -2.9,
    "kiss": 1.8, "zero": 0.0, "ass": -2.5, "mustard": 0.5, "right": 0.3, "so": 0.0, "no": -1.2, "😀": 2.0, "cut": -1.1,
    "mouth": 0.2, "but": 0.4,
}
PINS = [
    "", "a b c", "good", "GOOD news", "not good", "not very good", "it was not at all good", "never so good",
    "they never this great", "was never ever so good thing", "very good", "VERY good day", "slightly bad", "good but bad",
    "bad but good but bad", "least good", "at least good", "very least good thing", "the least good", "the movie is the shit",
    "you are the bomb today now", "it was a kiss of death for them", "they cut the mustard good", "kind of good stuff",
    "this is kind of good", "we have just enough good food", "sort of bad in here", "good!!!!!", "good??", "good????", "bad!?!?",
    "'good' \"good\" (good) good!!!! !good good; -good", "good good good", "don't like bad", "isn't it great", "DON'T be bad",
    "I am hardly SO good", "😀 a 😀!", "zero is ZERO here", "well yeah right bad", "good bad", "Good, bad: great; terrible.",
    "no no good", "hand to mouth is bad", "that was a bad ass thing great", "good bad﻿great",
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


def scored(spark, lexicon, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.polarity_scores(docs, lexicon, **kw).collect()
    return {r.doc_id: (r.neg, r.neu, r.pos, r.compound) for r in rows}


def test_hand_made_sentences(spark, lexicon):
    got = scored(spark, lexicon, PINS)
    for i, text in enumerate(PINS):
        assert got[i] == pytest.approx(score(text, LEXICON), abs=1e-9), text


def test_random_sentences(spark, lexicon):
    rng = random.Random(11)
    pool = [*LEXICON, *LEXICON, "not", "never", "so", "this", "very", "hardly", "least", "at", "but", "kind", "of", "sort",
            "just", "enough", "without", "isn't", "the", "of", "to", "hand", "yeah", "plain", "Word", "x", "most", "kindof"]
    dress = [str, str, str, str.upper, str.title, lambda w: w + "!", lambda w: w + "?!?", lambda w: "'" + w, lambda w: w + ",."]
    texts = [" ".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    got = scored(spark, lexicon, texts)
    wrong = [(t, got[i], score(t, LEXICON)) for i, t in enumerate(texts) if got[i] != pytest.approx(score(t, LEXICON), abs=1e-9)]
    # A figure that falls on a rounding edge may differ by one unit of its last place.
    assert all(abs(a - b) <= 1.01e-3 for _, g, w in wrong for a, b in zip(g, w)) and len(wrong) <= 3, wrong[:3]


def test_shuffled_lexicon_gives_the_same(spark, lexicon, tables):
    texts = PINS * 2
    assert scored(spark, lexicon, texts) == scored(spark, lexicon, texts, max_broadcast_rows=0)


def test_documents(spark, tables):
    lexicon = tables.lexicon().collect()
    known = {r.token: r.valence for r in lexicon}
    got = {r.doc_id: (r.neg, r.neu, r.pos, r.compound) for r in tables.scores().collect()}
    texts = tables.documents.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    off = [r.doc_id for r in texts if got[r.doc_id] != pytest.approx(score(r.text, known), abs=1e-9)]
    assert not off


def test_tokens(spark):
    texts = ["Well-known 'tis a, bb! ...cc c. ?!?dd dd!?!? --ee", "x 😀 yy zz", "é ça «guillemets»"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.w for r in docs.select("doc_id", S.tokens(F.col("text")).alias("w")).collect()}
    assert [got[i] for i in range(3)] == [words_of(t) for t in texts]


def test_plan_has_no_window_and_no_cross_join(tables, lexicon):
    plan = S.polarity_scores(tables.documents, lexicon)._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_merge_lexicons(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "token string, valence double")
    finance = spark.createDataFrame([("b", 30.0), ("c", -5.0)], "token string, valence double")
    assert dict(S.merge_lexicons(base, finance).collect()) == pytest.approx({"a": 1.0, "b": 3.0, "c": -0.5})


def test_texts_that_share_an_id_and_blocks(spark, lexicon, monkeypatch):
    """Equal ids and null ids are summed as one text, whichever way the lexicon is met and however texts lie in blocks."""
    rows = [(i, t) for i, t in enumerate(PINS)] + [(5, "good BAD not good"), (6, PINS[6]), (None, "great"), (None, None), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "BLOCK_CHARS", 150)
    got = [sorted((tuple(r) for r in S.polarity_scores(docs, lexicon, max_broadcast_rows=m).collect()), key=str) for m in (0, 100)]
    assert got[0] == got[1] and len(got[0]) == len(PINS) + 2
    sums = [sorted((tuple(r) for r in S.valence_sums(docs, lexicon, max_broadcast_rows=m).collect()), key=str) for m in (0, 100)]
    assert [r[:3] for r in sums[0]] == [r[:3] for r in sums[1]]
    assert [r[3] for r in sums[0]] == [r[3] if r[3] is None else pytest.approx(r[3]) for r in sums[1]]


def test_large_lexicon_meets_no_tokens_one_by_one(tables, lexicon):
    """Joins take the different words of a block; texts go round twice, and no row per token is shuffled or sorted."""
    plan = S.polarity_scores(tables.documents, lexicon, max_broadcast_rows=0)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "FlatMapCoGroupsInArrow" in physical and physical.count("SortMergeJoin") + physical.count("ShuffledHashJoin") <= 1
    assert "token#" not in "".join(line for line in physical.splitlines() if "hashpartitioning(doc_id" in line)


def test_large_lexicon_shuffles_texts_once(tables, lexicon, monkeypatch):
    """Both readers of the blocks take one shuffle of the texts, and their words are not shuffled beside it."""
    monkeypatch.setattr(S, "BLOCK_CHARS", 1 << 17)
    docs = tables.documents.coalesce(1)
    for found in (S.polarity_scores(docs, lexicon, max_broadcast_rows=0), S.valence_sums(docs, lexicon, max_broadcast_rows=0)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        final = [line for line in plan[:plan.index("== Initial Plan ==")].splitlines() if "Exchange" in line]
        blocks = [line for line in final if "xxhash64" in line]
        assert len(blocks) == 2 and sum("ReusedExchange" in line for line in blocks) == 1
        assert not any("hashpartitioning(_block" in line for line in final)


def _nodes(plan):
    """The nodes of a finished adaptive plan, those inside its stages too."""
    yield plan
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    for child in [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]:
        yield from _nodes(child)


@pytest.mark.parametrize("run", [S.polarity_scores, S.valence_sums])
def test_large_lexicon_moves_no_unknown_words(spark, lexicon, monkeypatch, run):
    """Words that neither the lexicon nor a rule knows do not move to the blocks."""
    monkeypatch.setattr(S, "BLOCK_CHARS", 1 << 13)
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(10**9)}" for _ in range(300)) + " not very good" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = run(docs, lexicon, max_broadcast_rows=0)
    found.collect()
    moved = [n.metrics().apply("dataSize").value() for n in _nodes(found._jdf.queryExecution().executedPlan())
             if n.getClass().getSimpleName() == "ShuffleExchangeExec" and "xxhash64" in n.outputPartitioning().toString()]
    assert moved and sum(moved) < sum(map(len, texts)) / 4


def test_word_filter_never_decides(spark, lexicon, monkeypatch):
    """A filter that lets every word pass gives the same rows; one that fits blanks what no rule and no valence needs."""
    texts = [*PINS, None, "Kind of GOOD", "isn't  so BAD! \n plainword", "x", "the Plain words"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "good"), (None, "bad plain")],
                                 "doc_id long, text string")

    def rows(run, most, masks):
        monkeypatch.setattr(S, "MOST_MASKS", masks)
        return sorted((tuple(r) for r in run(docs, lexicon, max_broadcast_rows=most).collect()), key=str)

    for run in (S.polarity_scores, S.valence_sums):
        plain = rows(run, 100, 1)
        assert [[pytest.approx(x) for x in r] for r in plain] == [list(r) for r in rows(run, 0, 1)]
        assert [[pytest.approx(x) for x in r] for r in plain] == [list(r) for r in rows(run, 0, 1 << 20)]
    words = spark.createDataFrame([(["plainword", "Good", "isn't", "the", "Never", "qwertzui"],), ([],)], "_w array<string>")
    lines = {r["_line"] for r in S._known_words(words, lexicon, rules=True).collect()}
    assert lines == {" Good isn't the Never ", ""}
    assert S._known_words(words, lexicon, rules=False).first()["_line"].split(" ")[1] == "Good"


@pytest.mark.parametrize("run", [S.polarity_scores, S.valence_sums])
def test_packed_lexicon_moves_no_texts(spark, run):
    """Past the row bound, but within that of bytes, texts and words stay where they lie; ids and sums move."""
    rng = random.Random(5)
    words = [f"word{rng.randrange(10**9)}" for _ in range(400)]
    lexicon = spark.createDataFrame([(w, 1.0 + i % 3) for i, w in enumerate(words)], "token string, valence double").repartition(2)
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(20)]
    found = run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, max_broadcast_rows=100)
    found.collect()
    nodes = list(_nodes(found._jdf.queryExecution().executedPlan()))
    moved = [n.metrics().apply("dataSize").value() for n in nodes if n.getClass().getSimpleName() == "ShuffleExchangeExec"]
    assert sum(moved) < sum(map(len, texts)) / 10
    assert not any("CoGroup" in n.getClass().getSimpleName() for n in nodes)


def test_packed_lexicon_gives_the_same(spark, lexicon, monkeypatch):
    """Small, packed and in blocks: the same rows, for texts that share their id and for null ids too."""
    odd = lexicon.unionByName(spark.createDataFrame([("plain", None), (None, 2.0)], "token string, valence double"))
    rows = [*enumerate(PINS), (5, "good BAD not good"), (6, PINS[6]), (None, "great"), (None, None), (99, None), (98, "Plain GOOD")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S._packed(lexicon, 0) is None and len(S._packed(odd, 1000)[0]) == len(LEXICON)
    assert S._packed(lexicon.unionByName(lexicon), 10**6) is None
    for run in (S.polarity_scores, S.valence_sums):
        small, packed, blocks = (
            sorted((tuple(r) for r in run(docs, odd, max_broadcast_rows=m).collect()), key=str) for m in (100, 5, 0))
        assert [[pytest.approx(x) for x in r] for r in small] == [list(r) for r in packed]
        assert [[pytest.approx(x) for x in r] for r in small] == [list(r) for r in blocks]


def test_first_occurrences(spark):
    rows = [(1, "bb aa, bb!  cc aa"), (2, None), (3, ""), (4, "aa"), (4, "bb aa bb"), (None, "xx"), (None, "xx yy"), (5, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, text in rows:
        for pos, word in enumerate(words_of(text or "")):
            first, n = want.get((i, word), (pos, 0))
            want[i, word] = (min(first, pos), n + 1)
    assert {(r.doc_id, r.token): (r.first_pos, r.n) for r in S.first_occurrences(docs).collect()} == want
    # Where no id repeats nothing but ids is shuffled.
    plan = S.first_occurrences(docs.where("doc_id < 4"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
