"""Whitening against exact fractions and against plain loops."""

import math
from fractions import Fraction

import numpy as np
import pytest

from marginalia.llm import whitening


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, component string").repartition(3)


def plain(rows, scale=64, offset=1_000_000):
    x = [[math.floor(scale * c) + offset for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = [[float(sum(Fraction(n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x) / n**3) for b in range(d)] for a in range(d)]
    return [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x], np.array(v), np.array([[float(Fraction(n * r[k] - s[k], n)) for k in range(d)] for r in x])


@pytest.mark.parametrize("spread,centre", [(1.0, 0.0), (3.0, 40_000.0), (1e5, -1e7)])
def test_equals_plain_loops(spark, spread, centre):
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(90, 7)) * spread * np.arange(1, 8) + centre).tolist()
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 7), (904, [float("inf")] * 7), (905, [1.0, 2.0])]
    rows = [(i, v) for i, v in enumerate(values)] + [(None, values[0]), (5, values[5])]
    found = whitening.whitened_components(table(spark, rows + odd), components=4).collect()
    deviation, v, centred = plain([r for _, r in rows])
    assert sorted({(r.vec_id, int(r.deviation)) for r in found}, key=str) == sorted({(i, x) for (i, _), x in zip(rows, deviation, strict=True)}, key=str)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {len(rows)} and {r.component for r in found} == {1, 2, 3, 4}
    for k in range(4):
        got = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        want = {i: w for (i, _), w in zip(rows, centred @ vectors[:, k] / math.sqrt(values[k]), strict=True)}
        sign = math.copysign(1, got[0] * want[0])
        assert all(math.isclose(got[i], sign * want[i], rel_tol=1e-7, abs_tol=1e-8) for i in want)
        assert all(math.isclose(r.explained, values[k] / np.trace(v), rel_tol=1e-9) for r in found if r.component == k + 1)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


@pytest.mark.parametrize("far", [10, 1 << 19, (1 << 20) + 3, 1 << 45, 1 << 62])
def test_scatter_is_exact(far, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(far % 97)
    y = rng.integers(-far, far + 1, size=(50, 4))
    y[0], y[1] = far, -far
    sums, products = whitening.scatter(y)
    exact = y.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist() and products.tolist() == exact.T.dot(exact).tolist()


def test_totals_survive_any_size(spark):
    values = [[2.0**50 + k, -(2.0**55), 1e300, 0.25 * k] for k in range(40)]
    n, sums, products = whitening.totals(whitening.clean(table(spark, list(enumerate(values)))))
    exact = np.array([[min(math.floor(64 * c), 2**62) for c in v] for v in values], object)
    assert n == 40 and sums.tolist() == exact.sum(axis=0).tolist() and products.tolist() == exact.T.dot(exact).tolist()
    deviation, _ = whitening.projected(exact.astype(np.int64), whitening.fit(whitening.clean(table(spark, list(enumerate(values))))))
    assert deviation == ((40 * exact - exact.sum(axis=0)) ** 2).sum(axis=1).tolist()


def test_degenerate_tables(spark):
    assert whitening.whitened_components(table(spark, [(1, None)])).count() == 0
    assert whitening.whitened_components(table(spark, [])).count() == 0
    one = whitening.whitened_components(table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r.component, r.whitened, r.deviation, r.identity_error) for r in one] == [(1, None, 0, None), (2, None, 0, None)]
    flat = whitening.whitened_components(table(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(30)], "float")).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.component for r in flat} == {1, 2, 3}
    assert flat[0].identity_error < 1e-12
