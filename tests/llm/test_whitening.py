"""Whitening against floating-point eigenvectors and whole-number sums."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from kinfolk.llm import queries, whitening


def polynomial(a):
    """Coefficients of det(x - A), constant first, by whole-number recurrences (Faddeev and LeVerrier)."""
    d, A = len(a), np.array(a, dtype=object)
    m, c = np.zeros((d, d), dtype=object), [1]
    for k in range(1, d + 1):
        m = A @ m + c[-1] * np.eye(d, dtype=int).astype(object)
        c.append(-sum((A @ m)[i][i] for i in range(d)) // k)
    return c[::-1]


def scatter(x):
    n = len(x)
    a = n * (x.T @ x) - np.outer(x.sum(0), x.sum(0))
    return tuple(tuple(int(v) for v in row) for row in a)


@pytest.mark.parametrize("d, n", [(1, 5), (2, 9), (7, 30), (19, 12)])
def test_polynomial_is_exact(spark, d, n):
    a = scatter(np.random.default_rng(d).integers(-90, 90, (n, d)))
    assert whitening.characteristic_polynomial(spark, a) == polynomial(a)


def test_polynomial_with_zero_pivots(spark):
    x = np.zeros((12, 6), int)
    x[:4, 0], x[4:8, 3], x[2:9, 5] = [1, 2, 3, 4], [5, 1, 1, 2], 3
    x[:, 4] = x[:, 0]
    assert whitening.characteristic_polynomial(spark, scatter(x)) == polynomial(scatter(x))


def test_roots_with_multiplicities():
    # (x - 5)^3 (x - 2) (x - 2.5 scaled away) x^2, and two roots that differ by one in 10^12
    c = [1]
    for r in (5, 5, 5, 2, 0, 0, 10**12, 10**12 + 1):
        c = [(c[i - 1] if i else 0) - r * (c[i] if i < len(c) else 0) for i in range(len(c) + 1)]
    got = [(Fraction(m, 2**t), k) for m, t, k in whitening.largest_roots(c, 8)]
    assert [k for _, k in got] == [1, 1, 3, 1]
    assert all(abs(x - y) < Fraction(y, 10**50) for (x, _), y in zip(got, (10**12 + 1, 10**12, 5, 2), strict=True))
    assert [k for *_, k in whitening.largest_roots(c, 2)] == [1, 1]


def whitened(spark, x, most=8):
    """As the operator does, from floating point."""
    n = len(x)
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    return (x - x.mean(0)) @ axes / np.sqrt(e), e / np.trace(v), ((n * x - x.sum(0)).astype(object) ** 2).sum(1)


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id bigint, embedding array<float>, component int").repartition(3)


def test_against_floating_point(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32)
    got = whitening.whiten(rows_of(spark, list(enumerate(data.tolist())))).collect()
    x = np.floor(data.astype(float) * 1024).astype(np.int64) + 100_000
    w, share, deviation = whitened(spark, x)
    assert len(got) == 300 * 8
    for r in got:
        assert abs(r.whitened) == pytest.approx(abs(w[r.vec_id, r.component - 1]), abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-10)
        assert (r.n, r.deviation) == (300, deviation[r.vec_id])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    for k in range(1, 9):  # one sign for all rows
        mine = {r.vec_id: r.whitened for r in got if r.component == k}
        assert abs(sum(mine[i] * w[i, k - 1] for i in mine)) == pytest.approx(300, rel=1e-9)


def test_rows_that_take_no_part(spark):
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, -1.0, 0.0]), (2, [0.25, -1.0, 0.0]), (None, [3.0, 0.0, 0.0]), (4, [1.0, 1.0, 1.5])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [3e38, 0.0, 0.0]), (11, [1.0, 2.0])]
    got = whitening.whiten(rows_of(spark, good + bad)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, k) for i, _ in good for k in (1, 2, 3))
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-9


def test_nothing_to_whiten(spark):
    assert whitening.whiten(rows_of(spark, [])).collect() == []
    assert whitening.whiten(rows_of(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(rows_of(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    flat = whitening.whiten(rows_of(spark, [(i, [1.0, float(i), 2.0 * i]) for i in range(5)])).collect()  # one line only
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1.0) and flat[0].identity_error < 1e-9


def test_equal_eigenvalues(spark):
    cross = [(i, v) for i, v in enumerate(np.vstack([np.eye(4), -np.eye(4)]).tolist())]
    got = whitening.whiten(rows_of(spark, cross)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-9
    assert all(r.explained == pytest.approx(0.25) for r in got)


def test_large_entries_are_summed_exactly():
    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 25, (1 << 39)):
        y = rng.integers(-top, top, (50, 4))
        assert (whitening._products(y) == y.T.astype(object) @ y.astype(object)).all()


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(rows_of(spark, [(i, [float(i) * 1e7, float(i * i)]) for i in range(40)])).collect()
    assert {r.deviation is None for r in got} >= {True} and got[0].identity_error < 1e-6


def test_query(spark):
    got = queries.QUERIES["op12_embedding_whitening"](spark, SMALL).toPandas()
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(data.embedding).astype(float) * 1024).astype(np.int64) + 100_000
    w, share, deviation = whitened(spark, x)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[data.vec_id].to_numpy()
    assert np.allclose(np.abs(table), np.abs(w), atol=1e-8)
    first = got[got.component == 1].set_index("vec_id").loc[data.vec_id]
    assert (first.deviation.to_numpy().astype(object) == deviation).all() and np.allclose(first.explained, share[0], rtol=1e-10)
