"""The bidiagonal solver against numpy, and the whitening against dense linear algebra in exact whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm import whitening
from sluicebox.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
RANDOM = np.random.default_rng(4)


@pytest.mark.parametrize(
    "a",
    [
        RANDOM.normal(size=(300, 40)), RANDOM.normal(size=(300, 40)) * np.geomspace(1, 1e-9, 40), np.eye(7) * 3, np.diag([3, 3, 2, 2, 1.0]), RANDOM.normal(size=(3, 6)),
        np.outer(np.arange(5.0), np.arange(6.0)), np.ones((4, 3)), RANDOM.normal(size=(50, 1)), np.zeros((4, 4)), np.kron(np.eye(3), RANDOM.normal(size=(9, 5))),
        np.diag(1 + 1e-10 * np.arange(9)) @ np.linalg.qr(RANDOM.normal(size=(9, 9)))[0], np.diag(np.abs(np.arange(-10.0, 11))) + np.eye(21, k=1) + np.eye(21, k=-1),
    ],
)
def test_solver(a):
    r = whitening.triangle(a)
    d, f, right = whitening.bidiagonal(r)
    both = np.diag(d) + np.diag(f, 1)
    v = np.array([whitening.back(right, e) for e in np.eye(len(r))]).T
    assert np.allclose(v.T @ r.T @ r @ v, both.T @ both, atol=1e-12 * max(1, np.abs(r).max()) ** 2)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(whitening.singular_values(d, f), want, rtol=1e-10, atol=1e-13 * max(want[0], 1e-300))
    values, vectors = whitening.directions(r, 4)
    assert len(values) == min(4, (want > 1e-12 * max(want[0], 1e-300)).sum()) and np.allclose(values, want[: len(values)], rtol=1e-12)
    if len(values):
        white = a @ vectors.T / values
        assert np.abs(white.T @ white - np.eye(len(values))).max() < 1e-11


def test_small_singular_values_keep_their_digits():
    d, f = np.array([1.0, 1e-7, 1e-15, 1e-30]), np.array([0.5, 1e-9, 1e-20])
    product = whitening.singular_values(d, f).prod()
    assert abs(product / d.prod() - 1) < 1e-13


def dense(vectors):
    """(n, S, eigenvalues, vectors, trace) of the distinct whole vectors."""
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    n, s = len(x), x.sum(axis=0)
    c = (x.astype(object) * n - s).astype(float) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    return n, s, e[::-1], w[:, ::-1].T, np.trace(v)


def test_query_equals_dense_algebra(spark):
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, s, e, w, trace = dense(list(given.values()))
    assert len(rows) == 4 * len(given) and {r.n for r in rows} == {n}
    signs: dict = {}
    for r in rows:
        x = np.floor(256 * np.array(given[r.vec_id], float)).astype(np.int64)
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        want = (x - s / n) @ w[r.component - 1] / np.sqrt(e[r.component - 1])
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(sign * r.whitened - want) < 1e-9
        assert abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-10


def test_blocks_and_tree_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    vectors = [(i, [float(v) for v in RANDOM.normal(size=5) * (5, 3, 2, 1, 0.5)]) for i in range(200)]
    by = whitening.fit(whitening.whole_numbers(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(13)), 5)
    n, s, e, w, trace = dense([v for _, v in vectors])
    assert by.n == n and list(by.sums) == s.tolist() and np.allclose(by.values, e, rtol=1e-10)
    assert np.allclose(np.abs((by.vectors * w).sum(axis=1)), 1, atol=1e-9) and by.identity_error < 1e-10


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [2.0, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, []), (None, [0.0, -0.0]), (8, [1.0]), (9, [1e300, 0.0])]
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, n int, x int")
    found = whitening.whiten(table).collect()
    assert sorted((r.vec_id or -1, r.component) for r in found) == sorted([(i, c) for i in (-1, 1, 1, 2) for c in (1, 2)])
    assert {r.n for r in found} == {3} and all(r.identity_error < 1e-12 for r in found)
    assert abs(sum({r.component: r.explained for r in found}.values()) - 1) < 1e-12
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 1")).count() == 0  # one distinct vector has no variance
    assert whitening.whiten(table.where("vec_id = 1")).columns == whitening.whiten(table).columns


def test_deviations_beyond_a_long_are_null(spark):
    rows = spark.createDataFrame([(i, [float(2**38 * i), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.deviation for r in whitening.whiten(rows).collect()}
    assert found == {0: None, 1: 0, 2: None}
    mixed = spark.createDataFrame([(1, [1.0] * 3), (2, [2.0] * 3), (3, [3.0])], "vec_id long, embedding array<float>").withColumn("extra", F.lit(1))
    assert {r.vec_id for r in whitening.whiten(mixed).collect()} == {1, 2}
