"""SimHash against a plain version: every pair compared, components by search."""

import numpy as np
import xxhash
from llm_fixtures import documents

from tallyglass.llm import simhash_dedup
from tallyglass.llm.trie import join_tries


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{id: print} to {id: smallest id reachable}."""
    left, found = set(prints), {}
    while left:
        start = min(left)
        reached, wait = {start}, [start]
        while wait:
            at = wait.pop()
            near = {i for i in left - reached if (prints[i] ^ prints[at]).bit_count() <= 3}
            reached |= near
            wait.extend(near)
        found.update(dict.fromkeys(reached, start))
        left -= reached
    return found


def test_components_equal_brute_force(spark, tables):
    rows = {r.doc_id: plain_print(r.text) for r in tables.documents.select("doc_id", "text").collect()}
    want = plain_components(rows)
    got = simhash_dedup.simhash_components(tables.documents, group_size=64).collect()
    assert {r.doc_id: r.print % (1 << 64) for r in got} == rows
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_of_crowded_prefixes(spark):
    """Values that share a long prefix, or hang together in chains, are split into small node pairs without losing links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            b ^= sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False))
            values.add(b)
    values |= {(0xABCDEF << 40) | int(x) << 26 for x in rng.integers(0, 1 << 14, 80)}
    ids = sorted(values)
    want = plain_components({i: i for i in ids})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in ids]
    table = spark.createDataFrame(signed, "print bigint")
    for size in (48, 100_000):
        links = simhash_dedup.near_links(table, len(ids), group_size=size).collect()
        joined = {i: i for i in ids}

        def root(x):
            while joined[x] != x:
                x = joined[x]
            return x

        for a, b in links:
            x, y = sorted((root(a % (1 << 64)), root(b % (1 << 64))))
            joined[y] = x
        assert {i: root(i) for i in ids} == want


def test_tries_in_one_task():
    values = np.array([0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 15], np.uint64)
    labels = join_tries(values, None, 0, 0, 3, 3)
    assert labels.tolist() == [0] * 7
    assert join_tries(values[:1], None, 0, 0, 3, 1).tolist() == [0]


def test_odd_rows(spark):
    odd = documents(spark)
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.simhash_components(odd).collect()}
    empty = {i for i, text in [(r.doc_id, r.text) for r in odd.collect()] if not (text or "").split() and i is not None}
    assert {c for i, c in got if i in empty} == {min(empty)}
    kept = simhash_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got}
    assert simhash_dedup.simhash_components(odd.limit(0)).count() == 0
    assert simhash_dedup.drop_near_copies(odd.limit(0)).count() == 0
