"""Whitening against numpy and Python's integers."""

import numpy as np
import pytest

from junctura.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, x string, component int")


def brute(rows):
    sound = [(i, [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in sound})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(dims)]
    centred = np.array([[n * x[d] - sums[d] for d in range(dims)] for x in distinct], float) / n
    v = centred.T @ centred / n
    return sound, n, sums, v


def test_scatter():
    r = np.random.default_rng(1)
    for x in (r.integers(-50, 50, (1000, 5)), r.integers(0, 2, (63, 3)), np.full((7, 2), 9), r.integers(-(1 << 61), 1 << 61, (130, 3)), np.zeros((1, 1), "i8")):
        sums, products = whitening.scatter(x.astype("i8"))
        wide = x.astype(object)
        assert sums.tolist() == wide.sum(axis=0).tolist() and (products == wide.T @ wide).all()


@pytest.mark.parametrize("dims", [3, 20])
def test_whiten(spark, dims):
    r = np.random.default_rng(dims)
    base = r.normal(size=(200, dims)) * np.linspace(0.1, 3, dims)
    rows = [(k, [float(np.float32(c)) for c in v], "clash", "clash", 1) for k, v in enumerate(base)]
    rows += [(500, rows[3][1], "", "", 0), (500, rows[3][1], "", "", 0), (None, rows[4][1], "", "", 0)]
    odd = [(600, None, "", "", 0), (601, [None] * dims, "", "", 0), (602, [float("nan")] * dims, "", "", 0), (603, [float("inf")] + [0.0] * (dims - 1), "", "", 0), (604, [], "", "", 0), (605, [1.0] * (dims + 1), "", "", 0)]
    got = whitening.whiten(table(spark, rows + odd)).collect()
    sound, n, sums, v = brute(rows)
    k = min(dims, 16)
    assert len(got) == len(sound) * k and {g.vec_id for g in got} == {i for i, _ in sound}
    values = np.linalg.eigvalsh(v)[::-1]
    by = {}
    for g in got:
        by.setdefault(g.vec_id, {})[g.component] = g
        assert g.n == n and g.identity_error <= 1e-9 and abs(g.explained - values[g.component - 1] / np.trace(v)) <= 1e-9
    for i, x in sound:
        assert int(by[i][1].deviation) == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
    seen = {tuple(x): i for i, x in sound}
    w = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i in seen.values()])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    # whitened distances over all components are Mahalanobis distances, whatever the signs
    if dims == k:
        x = np.array([list(x) for x in seen], float) - np.array(sums) / n
        assert np.allclose((w**2).sum(axis=1), np.einsum("ij,jk,ik->i", x, np.linalg.inv(v), x))


def test_without_directions(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], "", "", 0)] * 3)).count() == 0
    flat = whitening.whiten(table(spark, [(k, [1.0, k * 1.0, 2.0 * k], "", "", 0) for k in range(9)])).collect()
    assert {g.component for g in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_large_numbers(spark):
    rows = [(k, [k * 2.0**40, -(k**2) * 2.0**41], "", "", 0) for k in range(40)]
    got = whitening.whiten(table(spark, rows)).filter("component = 1").collect()
    sound, n, sums, _ = brute(rows)
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in sound}
    assert {g.vec_id: int(g.deviation) for g in got} == want and max(want.values()) > 1 << 63
