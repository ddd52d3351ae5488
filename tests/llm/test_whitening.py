"""Whitening against plain whole numbers and numpy's eigenvalues."""

from fractions import Fraction

import numpy as np
import pytest

from paragauge.llm import whitening as H


def plain_polynomial(matrix):
    """Faddeev and LeVerrier's recurrence in fractions."""
    d = len(matrix)
    a = [[Fraction(int(x)) for x in row] for row in matrix]
    times = lambda x, y: [[sum(p * q for p, q in zip(r, c)) for c in zip(*y)] for r in x]
    m = [[Fraction(0)] * d for _ in range(d)]
    out = [Fraction(1)]
    for k in range(1, d + 1):
        m = times(a, m)
        for i in range(d):
            m[i][i] += out[-1]
        am = times(a, m)
        out.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(x) for x in out]


def gram(seed, n, d, size=50):
    x = np.random.default_rng(seed).integers(-size, size, (n, d)).astype(object)
    return x.T @ x


@pytest.mark.parametrize("seed,n,d", [(1, 30, 7), (2, 3, 6), (3, 40, 12)])
def test_polynomial_and_roots(spark, seed, n, d):
    matrix = gram(seed, n, d)
    found = H.characteristic(spark, matrix)
    assert found == plain_polynomial(matrix)
    roots, bits = H.largest_roots(found, int(np.trace(matrix)), d)
    want = np.sort(np.linalg.eigvalsh(matrix.astype(float)))[::-1][: min(n, d)]
    assert np.allclose([r / 2**bits for r, _ in roots], want, rtol=1e-9)


def test_multiple_roots_and_zeros(spark):
    """Turned from diag(9, 9, 9, 4, 0): an orthonormal basis of the whole space of 9."""
    q = np.array([[1, 1, 1, 1, 0], [1, -1, 1, -1, 0], [1, 1, -1, -1, 0], [1, -1, -1, 1, 0], [0, 0, 0, 0, 2]], object)
    matrix = q @ np.diag(np.array([9, 9, 9, 4, 0], object)) @ q.T
    roots, bits = H.largest_roots(H.characteristic(spark, matrix), int(np.trace(matrix)))
    assert [(round(r / 2**bits), m) for r, m in roots] == [(36, 3), (16, 1)]
    space = H.null_space(matrix, roots[0][0], bits, 3)
    assert np.allclose(space.T @ space, np.eye(3), atol=1e-14)
    assert np.allclose(matrix.astype(float) @ space, 36 * space, atol=1e-12)


def test_products_are_exact():
    x = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, (5000, 3))
    want = x.astype(object).T @ x.astype(object)
    assert (H.products(x) == want).all()
    assert [sum(v << H.DIGIT * k for k, v in enumerate(H._digits(y))) for y in (-(1 << 130), 7, 0)] == [-(1 << 130), 7, 0]


def test_rows(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 9)) * 0.3  # rank 5 but for rounding
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(base)]
    odd = [(None, [1.0] * 9, "x"), (901, None, "x"), (902, [1.0] * 8 + [None], "x"), (903, [float("nan")] * 9, "x"),
           (904, [float("-inf")] * 9, "x"), (905, [1.0], "x"), (906, [], "x"), (3, rows[3][1], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string").repartition(3)
    got = H.whitened(table).collect()
    kept = [r[:2] for r in [*rows, odd[0], odd[-1]]]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert len(got) == n * 9 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    want = sorted((k if k is not None else -1, int(v)) for (k, _), v in zip(kept, ((n * x - s) ** 2).sum(1)))
    assert sorted({(r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got}) == sorted(set(want))
    explained = {r.component: r.explained for r in got}
    assert np.allclose([explained[k] for k in range(1, 10)], values[::-1] / values.sum(), rtol=1e-9)
    first = {r.vec_id: r.whitened for r in got if r.component == 1}
    mine = (x - s / n) @ vectors[:, -1] / np.sqrt(values[-1])
    other = np.array([first[k] for k, _ in kept])
    assert np.allclose(other * np.sign(other[0]), mine * np.sign(mine[0]), atol=1e-8)
    texts = {r.vec_id: int(r.deviation) for r in H.deviations(table).collect()}
    assert texts == {(k if k != -1 else None): v for k, v in want}


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 4):
        out = H.whitened(spark.createDataFrame(rows, schema))
        assert out.columns[:3] == ["vec_id", "component", "n"] and out.collect() == []
    assert H.deviations(spark.createDataFrame([(1, [0.5])] * 2, schema)).collect()[0].deviation == "0"


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [1e15 * i, -1e15 * i * i]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = H.whitened(table).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} == {1, 2}
    assert all(len(r.deviation) > 19 for r in H.deviations(table).collect())
