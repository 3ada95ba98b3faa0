"""The near-copy stage against a plain version: every pair's Jaccard of five-word runs."""

import random
from itertools import combinations

from llm_fixtures import documents
from pyspark.sql import functions as F

from tallyglass.llm import near_copies, simhash_dedup
from tallyglass.scale import staged


def plain_runs(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """The smallest id of each component of {id: text}, and the number of linked pairs."""
    runs = {i: plain_runs(t) for i, t in texts.items()}
    root, n = {i: i for i in texts}, 0
    for a, b in combinations(sorted(texts), 2):
        both = len(runs[a] & runs[b])
        union = len(runs[a]) + len(runs[b]) - both
        if not union or both >= 0.8 * union:
            n += 1
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values()), n


def near_texts():
    rng, texts = random.Random(5), {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[len(texts)] = " ".join(words)
        for edits in (1, 3, 5, 6, 9, 14, 40):
            copy = list(words)
            for at in rng.sample(range(300), edits):
                copy[at] = f"x{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(copy)
    return texts


def test_similar_texts_go_and_others_stay(spark):
    texts = near_texts()
    want, n = plain_kept(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id for r in near_copies.drop_near_copies(docs).collect()}
    assert n > 40 and got == want
    # Three of 64 bits find fewer of them.
    assert len({r.doc_id for r in simhash_dedup.drop_near_copies(docs).collect()}) > len(want)


def test_stage_of_the_pipeline_is_the_similarity(spark):
    import corpus_pipeline

    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == plain_kept(texts)[0]


def test_chains_in_one_bucket(spark, monkeypatch):
    """All texts in one bucket, in a chain whose ends are unlike, beside others that are like none."""
    monkeypatch.setattr(near_copies, "band_keys", lambda runs: [0])
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 10:i * 10 + 200]) for i in (3, 0, 5, 1, 4, 2)}
    texts |= {i: f"a text of its own with number {i} and little else" for i in range(10, 55)}
    rows = spark.createDataFrame(list(texts.items()), "n bigint, text string").repartition(1)
    roots = {r.a: r.b for r in near_copies.similar_roots(rows, 5, 0.8).collect()}
    assert {i - roots.get(i, i) for i in texts if i >= 10} == {0} and roots == {i: 0 for i in range(1, 6)}


def test_odd_rows(spark):
    odd = documents(spark)
    kept = near_copies.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]
    twice = odd.select(F.lit(None).cast("bigint").alias("doc_id"), "text").where("digest = 'y'")
    assert near_copies.drop_near_copies(twice).count() == 1
    assert near_copies.drop_near_copies(odd.limit(0)).count() == 0


def test_text_is_written_once(spark, monkeypatch):
    """Of the tables that the stage writes only the rows hold texts, and each text stands there once."""
    written = {}
    monkeypatch.setattr(near_copies, "staged", lambda df, name: written.setdefault(name, staged(df, name)))
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, "z")], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [1, 3]
    strings = {name: df.schema.simpleString().count(":string") for name, df in written.items()}
    assert strings.pop("near-rows") == 2 and not any(strings.values())
    # Columns inside others are found as before.
    monkeypatch.undo()
    inside = docs.select(F.struct("doc_id", "text").alias("doc"), F.col("lang").alias("a.b"))
    assert sorted(r.doc.doc_id for r in near_copies.drop_near_copies(inside, "doc.doc_id", "doc.text").collect()) == [1, 3]


def test_buckets_are_those_of_the_trie(spark):
    """Texts whose words hang together within a few bits share a bucket of that word; texts that meet nobody drop out."""
    texts = near_texts() | {1000 + i: f"a text of its own with number {i} and little else" for i in range(3)}
    rows = spark.createDataFrame(list(texts.items()), "n bigint, text string")
    sketches = near_copies._sketches(rows, 5).localCheckpoint()
    words = {r.n: [k % (1 << 64) for k in r["keys"]] for r in sketches.collect()}
    assert all(len(w) == near_copies.WORDS for w in words.values())
    want = {i: [] for i in words}
    for w in range(near_copies.WORDS):
        root = {i: i for i in words}
        for a, b in combinations(sorted(words), 2):
            if (words[a][w] ^ words[b][w]).bit_count() <= near_copies.NEAR_BITS:
                root = {i: root[a] if r == root[b] else r for i, r in root.items()}
        for i in words:
            want[i].append(root[i])
    alone = {i for i in words if all(sum(r[w] == want[i][w] for r in want.values()) == 1 for w in range(near_copies.WORDS))}
    got = {r.n: r["keys"] for r in near_copies._buckets(sketches).collect()}
    assert set(got) == set(words) - alone and alone
    for w in range(near_copies.WORDS):
        for a, b in combinations(sorted(got), 2):
            assert (got[a][w] == got[b][w]) == (want[a][w] == want[b][w])
