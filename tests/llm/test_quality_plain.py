"""The quality verdict and the classifier against plain versions in Python and numpy."""

import math
import re
import struct
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_fixtures import documents
from pyspark.sql import functions as F

from tallyglass.llm import quality_classifier, quality_rules
from tallyglass.llm.quality_classifier import Discriminant


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def signed_bytes(value):
    return struct.pack("<Q", value)


def plain_buckets(text):
    """Hash buckets of all words, then of all pairs of neighbours."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words_of(text)]
    pairs = [xxhash.xxh64_intdigest(signed_bytes(b), seed=xxhash.xxh64_intdigest(signed_bytes(a), seed=42))
             for a, b in zip(hashes, hashes[1:])]
    return [h % (1 << 14) for h in hashes + pairs]


def test_log_ratio_and_verdict(spark, tables):
    docs = tables.documents.select("doc_id", "text").union(documents(spark).select(F.col("doc_id") + 1_000_000, "text"))
    trusted = tables.labels.where("quality = 1").select("doc_id")
    good = {r.doc_id for r in trusted.collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    raw, own = np.ones(1 << 14), np.ones(1 << 14)
    for i, text in texts:
        np.add.at(raw, plain_buckets(text), 1)
        if i in good:
            np.add.at(own, plain_buckets(text), 1)
    weights = (np.log(own / own.sum()) - np.log(raw / raw.sum())).astype(np.float32).astype(float)
    for threshold in (-0.2, 0.0):
        rows = quality_rules.quality_rules(docs, trusted, threshold=threshold).collect()
        found = sorted((str(r.doc_id), round(r.log_ratio, 6)) for r in rows)
        want = sorted((str(i), round(float(weights[b].mean()) if (b := plain_buckets(t)) else 0.0, 6)) for i, t in texts)
        assert [a for a, _ in found] == [a for a, _ in want]
        assert np.allclose([a for _, a in found], [a for _, a in want], atol=2e-6)
        assert all(r.kept == (not r.base_failed and r.log_ratio >= threshold) for r in rows)
    assert any(not r.kept and not r.base_failed for r in rows) and any(r.kept for r in rows)


def plain_statistics(text):
    text, words = text or "", words_of(text)
    n, lengths = len(words), [len(w) for w in words]
    windows = [tuple(words[i:i + 5]) for i in range(n - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean * mean, 0))

    def share(part, whole):
        return math.sqrt(part / max(whole, 1))

    return [
        math.log1p(len(text)), math.log1p(n), math.log1p(mean), share(len(re.findall(r"[#*$%&|<>{}=_~^\\]", text)), len(text)),
        share(sum(unicodedata.category(c) == "Lu" for c in text), len(text)), share(len(re.findall("[0-9]", text)), len(text)),
        share(len(re.findall("[.,;:!?]", text)), len(text)), share(len(set(words)), n), share(len(covered), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n), share(sum(x == 1 for x in lengths), n),
        math.log1p(text.count("\n") + 1 if n else 0), math.log1p(spread)]


def test_statistics(spark, tables):
    docs = tables.documents.select("doc_id", "text").union(documents(spark).select(F.col("doc_id") + 1_000_000, "text"))
    rows = docs.select("text", quality_classifier.statistics(F.coalesce("text", F.lit(""))).alias("x")).collect()
    assert np.allclose([r.x for r in rows], [plain_statistics(r.text) for r in rows], atol=1e-9)


@pytest.mark.parametrize("shrinkage", [0.1, 0.5])
def test_discriminant(spark, shrinkage):
    """Scores by determinants and solved systems instead of cached factors."""
    rng = np.random.default_rng(9)
    classes = {0: rng.normal(size=(80, 4)), 1: rng.normal(size=(30, 4)) @ rng.normal(size=(4, 4)) + 1}
    classes[0][:, 3] = classes[1][:, 3] = 2.0  # constant
    model = Discriminant.fit({k: (len(x), x.sum(axis=0), x.T @ x) for k, x in classes.items()}, shrinkage)
    moments = {k: (x.mean(axis=0), np.cov(x.T, bias=True)) for k, x in classes.items()}
    pooled = (80 * moments[0][1] + 30 * moments[1][1]) / 110
    target = (1 - shrinkage) * pooled + shrinkage * np.diag(np.diag(pooled))
    points = np.vstack([classes[0][:20], classes[1][:20], np.zeros((1, 4)), np.full((1, 4), 50.0)])

    def density(k, x):
        mean, own = moments[k]
        cov = (1 - shrinkage) * own + shrinkage * target + np.diag(np.diag(pooled) * 1e-2 + 1e-4)
        return math.log(len(classes[k]) / 110) - np.linalg.slogdet(cov)[1] / 2 - (x - mean) @ np.linalg.solve(cov, x - mean) / 2

    want = [1 / (1 + math.exp(min(700, density(0, x) - density(1, x)))) for x in points]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "i int, x array<double>")
    got = [r.s for r in table.select("i", model.score(F.col("x")).alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want, atol=1e-8) and 0 < sum(w > 0.5 for w in want) < len(want)
