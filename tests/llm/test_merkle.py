"""The Merkle manifest against a plain tree, for several fan-outs, hot and single-leaf groups and odd rows."""

import hashlib
from collections import Counter

import pytest
from llm_fixtures import documents
from pyspark.sql import functions as F

from tallyglass.llm import merkle


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(digests, fanout):
    """The last node and, per leaf, its siblings level by level as (left, right) texts."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, path in enumerate(paths):
            run = at[i] // fanout * fanout
            path.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + fanout])))
            at[i] //= fanout
        level = [plain_hash(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_rows(rows, fanout):
    """Counter of (id, group, leaf, subroot, root, siblings) of rows (id, group, digest)."""
    groups = {}
    for i, group, digest in rows:
        groups.setdefault(group, []).append((i is not None, i or 0, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([d for *_, d in sorted(groups[g])], fanout) for g in order}
    root, over = plain_tree([trees[g][0] for g in order], fanout)
    found = Counter()
    for g, above in zip(order, over):
        for (known, i, digest), path in zip(sorted(groups[g]), trees[g][1]):
            text = "".join(a + b for a, b in path + above)
            found[i if known else None, g, digest, trees[g][0], root, text] += 1
    return found


def digest_of(row):
    return plain_hash(plain_field(row.doc_id), plain_field(row.text), plain_field(row.lang))


def leaf(text=None):
    return merkle.hashed(merkle.field(F.col("doc_id")), merkle.field(F.col("text") if text is None else text), merkle.field(F.col("lang")))


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_a_plain_tree(spark, many_partitions, fanout):
    hot = [(i, f"text {i % 7}", "hot") for i in range(300)]
    rows = hot + [(i * 3, "ä" * (i % 5), f"s{i % 40}") for i in range(90)] + [
        (None, None, None), (None, None, None), (None, "x", None), (5, "x", None), (5, "x", None), (5, "y", "ß"), (1, "z", ""), (9, "only", "Z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    got = merkle.manifest(docs, leaf(), group_col="lang", fanout=fanout)
    got = got.withColumn("siblings", merkle.siblings_text(F.col("path"))).collect()
    want = plain_rows([(r.doc_id, r.lang, digest_of(r)) for r in docs.collect()], fanout)
    assert Counter((r.id, r.group, r.leaf, r.subroot, r.root, r.siblings) for r in got) == want
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_changed_rows_are_found(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit("l").alias("lang"))
    rows = merkle.manifest(docs, leaf(), "lang", again=F.when(F.col("doc_id") % 10 == 3, leaf(F.lower("text")))).collect()
    assert {r.id for r in rows if not r.verified} == set(range(3, 100, 10)) and len(rows) == 100


def test_odd_rows(spark):
    odd = documents(spark)
    rows = merkle.manifest(odd, leaf(), "lang").collect()
    want = plain_rows([(r.doc_id, r.lang, digest_of(r)) for r in odd.collect()], 16)
    assert Counter((r.id, r.group, r.leaf, r.subroot, r.root) for r in rows) == Counter(k[:5] for k in want.elements())
    one = merkle.manifest(odd.where("doc_id = 8"), leaf(), "lang").collect()
    assert [(r.leaf, r.subroot, r.path, r.verified) for r in one] == [(one[0].root, one[0].root, [], True)]
    assert merkle.manifest(odd.limit(0), leaf(), "lang").count() == 0


def test_long_text_is_hashed_whole(spark):
    docs = spark.createDataFrame([(1, "é" * 1_000_000, "a"), (2, None, "a")], "doc_id bigint, text string, lang string")
    rows = {r.id: r.leaf for r in merkle.manifest(docs, leaf(), "lang").collect()}
    assert rows == {r.doc_id: digest_of(r) for r in docs.collect()}
