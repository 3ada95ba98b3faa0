"""SuperMinHash near-duplicates against the Jaccard of every pair, and the signatures against their definition."""

import random
from itertools import combinations

import numpy as np
import pytest
from conftest import SMALL
from llm_fixtures import documents

from tallyglass.llm import minhash_dedup, similar_sets, superminhash
from tallyglass.llm.queries import QUERIES


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_result(texts):
    """{id: (size, component)} of {id: text}."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in texts}


def near_texts(n_bases=10, length=200):
    rng, texts = random.Random(7), {}
    for _ in range(n_bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        texts[len(texts)] = " ".join(words)
        for edits in (1, 2, 4, 5, 6, 7, 9, 14, 40):
            copy = list(words)
            for at in rng.sample(range(length), edits):
                copy[at] = f"x{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(copy).upper() if edits == 2 else "\n".join(copy)
    return texts


def result(rows):
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    return {r.id: (r.n_shingles, r.component_id) for r in rows}


def test_query_equals_brute_force(spark, tables):
    want = plain_result({r.doc_id: r.text for r in tables.documents.collect()})
    rows = QUERIES["op13_minhash_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_edited_texts(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert result(minhash_dedup.minhash_dedup(docs).collect()) == plain_result(texts)


def test_one_bucket_in_parts_and_blocks(spark, monkeypatch):
    """All texts share one bucket: chains whose ends are unlike, many texts like none, small parts."""
    monkeypatch.setattr(minhash_dedup, "band_keys", lambda row, bands, depth: np.zeros(1, np.int64))
    monkeypatch.setattr(similar_sets, "PART", 8)
    monkeypatch.setattr(similar_sets, "PART_HASHES", 1000)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i * 10:i * 10 + 200]) for i in (3, 0, 5, 1, 4, 2)}
    # Texts that resemble each other by about 0.75 and are links for none.
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    for i in range(10, 40):
        copy = list(base)
        for at in rng.sample(range(0, 200, 4), 7):
            copy[at] = f"y{i}-{at}"
        texts[i] = " ".join(copy)
    texts |= {i: f"a text of its own with number {i} and little else" for i in range(50, 70)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    want = plain_result(texts)
    assert len({c for i, (_, c) in want.items() if 10 <= i < 40}) > 1 and want[5][1] == 0
    assert result(minhash_dedup.minhash_dedup(docs).collect()) == want


def test_odd_rows(spark):
    odd = documents(spark)
    rows = minhash_dedup.minhash_dedup(odd).collect()
    assert len(rows) == odd.count() and minhash_dedup.minhash_dedup(odd).columns == ["id", "n_shingles", "component_id", "kept"]
    found = sorted((str(r.id), r.n_shingles, str(r.component_id), r.kept) for r in rows)
    assert [f for f in found if f[0] in "1234578"] == [
        ("1", 5, "1", True), ("2", 5, "1", False), ("2", 5, "1", False), ("3", 0, "3", True), ("4", 0, "4", True), ("5", 0, "5", True),
        ("7", 5, "7", True), ("8", 1, "8", True)]
    assert ("None", 8, "None", True) in found
    nameless = odd.where("doc_id IN (1, 2) OR doc_id IS NULL").selectExpr("nullif(doc_id, 1) AS doc_id", "text")
    assert {(r.id, r.component_id) for r in minhash_dedup.minhash_dedup(nameless).where("n_shingles = 5").collect()} == {(None, 2), (2, 2)}
    assert minhash_dedup.minhash_dedup(odd.limit(0)).count() == 0


def plain_signature(elements, m):
    """One element after the other, each with a whole shuffle of its own."""
    h = [int(superminhash.EMPTY)] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            bits = int(superminhash._random(np.array([e], np.uint64), j)[0])
            k = j + ((bits >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], (j << 32) | (bits & 0xFFFFFFFF))
    return h


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_signatures_follow_their_definition(monkeypatch, block):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 3, 30, 90)]
    assert superminhash.signatures(sets, 16).tolist() == [plain_signature(s.tolist(), 16) for s in sets]


def test_signatures_estimate_the_similarity_with_less_variance():
    rng, errors = np.random.default_rng(6), []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        a, b = superminhash.signatures([np.unique(pool[:40]), np.unique(pool[10:])], 256)
        errors.append((a == b).mean() - 30 / 50)
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.9 * (0.6 * 0.4 / 256) ** 0.5
