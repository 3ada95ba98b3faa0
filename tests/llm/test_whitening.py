"""Whitening against numpy's eigenvectors, exact sums against Python numbers, eigenvectors against known matrices."""

import math

import numpy as np
import pytest
from conftest import SMALL

from tallyglass.llm import whitening
from tallyglass.llm.eigen import LONG, eigenvectors
from tallyglass.llm.queries import QUERIES


def plain_whitening(vectors, components=16):
    """(n, deviations, whitened, explained) of usable vectors, by numpy's double precision eigenvectors."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(axis=0)
    centred = once - sums / n
    v = centred.T @ centred / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ q / np.sqrt(values), values / np.trace(v)


def check(rows, ids, vectors):
    n, deviation, white, explained = plain_whitening(vectors)
    k = white.shape[1]
    got = sorted(rows, key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids)
    assert [r.vec_id for r in got] == [i for i in sorted(ids) for _ in range(k)]
    assert [r.component for r in got] == list(range(1, k + 1)) * len(ids)
    assert [r.deviation for r in got] == np.repeat(deviation[order], k).tolist() and {r.n for r in got} == {n}
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    sign = np.sign((mine * white[order]).sum(axis=0))
    assert np.abs(mine * sign - white[order]).max() < 1e-8
    assert np.abs(np.array([r.explained for r in got[:k]]) - explained).max() < 1e-12
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_query_equals_numpy(spark, tables):
    rows = tables.embeddings.collect()
    check(QUERIES["op12_embedding_whitening"](spark, SMALL).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark, many_partitions):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=3).round(3).tolist(), f"c{i}") for i in range(60)]
    again = [(100 + i, good[0][1], "same") for i in range(30)]
    bad = [(200, None, "x"), (201, [1.0, None, 2.0], "x"), (202, [1.0, math.nan, 2.0], "x"), (203, [math.inf, 1.0, 1.0], "x"),
           (204, [], "x"), (205, [1.0, 2.0], "x"), (206, [1e300, 0.0, 0.0], "x")]
    table = spark.createDataFrame(good + again + bad + [good[1], good[1]], "vec_id bigint, embedding array<double>, component string").repartition(5)
    model = whitening.fit_whitening(table, components=16)
    rows = whitening.whiten(table, model).withColumnRenamed("id", "vec_id").collect()
    assert model.count == 60 and model.dimension == 3
    used = good + again
    assert len(rows) == 3 * (len(used) + 2)
    check(set(rows), [i for i, *_ in used], [v for _, v, _ in used])
    nameless = table.selectExpr("CAST(null AS BIGINT) AS vec_id", "embedding")
    assert whitening.whiten(nameless, model).where("id IS NULL").count() == 3 * (len(used) + 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_too_few_vectors_give_no_component(spark, rows):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert whitening.whiten(table, whitening.fit_whitening(table)).count() == 0


def test_directions_without_variance_are_left_out(spark):
    table = spark.createDataFrame([(i, [float(i), 5.0, float(2 * i)]) for i in range(20)], "vec_id bigint, embedding array<double>")
    model = whitening.fit_whitening(table)
    assert len(model.explained) == 1 and abs(model.explained[0] - 1) < 1e-12 and model.identity_error < 1e-12


def test_sums_stay_exact_for_large_numbers():
    rng = np.random.default_rng(5)
    whole = rng.integers(-(1 << 51), 1 << 51, (300, 4))
    plain = whole.astype(object)
    assert (whitening.exact_sums(whole)[:-1] == plain.sum(axis=0)).all()
    assert (whitening.exact_products(whole) == plain.T @ plain).all()
    small = whole >> 45
    assert (whitening.exact_products(small) == small.T @ small).all()
    assert whitening._deviations(whole[:2], 10 ** 9, [0] * 4) == [None, None]
    assert whitening._deviations(small[:3], 7, [1, 2, 3, 4]) == [sum((7 * x - t) ** 2 for x, t in zip(r, (1, 2, 3, 4))) for r in small[:3].tolist()]


def test_packed_vectors_are_equal_only_when_the_vectors_are():
    rows = [np.array(r, np.int64) for r in ([0, 1], [0, -1], [127, -128], [128, 0], [-129, 0], [1 << 40, 3], [0, 0])]
    keys = [whitening.pack_vector(r) for r in rows]
    assert len(set(keys)) == len(rows)
    for key, row in zip(keys, rows):
        assert (whitening.unpack_vectors(whitening.pa.array([key]))[0] == row).all()


def spectrum(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(LONG)
    for _ in range(3):
        q = q + q @ (np.eye(len(q), dtype=LONG) - q.T @ q) / 2
    a = (q * values.astype(LONG)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values", [
    np.linspace(0.1, 2, 40), np.concatenate((np.full(8, 3.0), np.linspace(0.1, 2, 30))),
    np.concatenate((3 + np.arange(8) * 1e-9, np.linspace(0.1, 2, 30))), np.geomspace(1e-6, 1e6, 30), np.array([2.0])])
def test_eigenvectors_in_clusters(values):
    a, _ = spectrum(values)
    found, x = eigenvectors(a)
    size = np.abs(values).max()
    assert np.abs(a @ x - x * found).max() < 1e-17 * size and np.abs(x.T @ x - np.eye(len(x))).max() < 1e-17
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17 * size


def test_eigenvectors_reach_double_precision():
    values = np.concatenate((3 + np.arange(5) * 1e-4, np.linspace(0.1, 2, 30)))
    a, q = spectrum(values)
    _, x = eigenvectors(a)
    q = q[:, np.argsort(-values)]
    assert np.abs(x * np.sign((x * q).sum(axis=0)) - q).max() < 1e-14
    single = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(single * np.sign((single * q).sum(axis=0)) - q).max() > 1e-5
