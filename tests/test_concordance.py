"""Kendall's tau-b against all pairs."""

import numpy as np
import pytest

from tabularium.operators import aggregate as A
from tabularium.operators import concordance as C


def tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum())


def test_inversions_with_weights():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 57, 300):
        y, w = draw.integers(0, 40, n), draw.integers(1, 9, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])
        assert C.inversions(y, w) == want == C.inversions(y / 7, w)
        assert C.inversions(y, w.astype(np.int64) << 40) == want << 80


@pytest.mark.parametrize("max_rows", [1000, 90, 25])
@pytest.mark.parametrize("kind", ["ties", "one value often", "all apart", "reversed"])
def test_tau_equals_all_pairs(spark, kind, max_rows):
    draw = np.random.default_rng(5)
    n = 400
    x = draw.normal(size=n)
    y = x * 0.4 + draw.normal(size=n)
    if kind == "ties":
        x, y = np.round(x, 1), np.round(y * 2)
    elif kind == "one value often":
        x, y = np.where(draw.random(n) < 0.5, 1.5, x), np.where(draw.random(n) < 0.5, 0.0, y)
    elif kind == "reversed":
        y = -x
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None), (None, 2.0), (float("nan"), 3.0)], "a double, b double")
    assert abs(C.kendall(rows, "a", "b", max_rows) - tau(x, y)) < 1e-12


def test_hand_table_and_constants(spark):
    rows = spark.createDataFrame([(1, 1, 7), (2, 3, 7), (2, 2, 7), (3, 3, 7), (4, 1, 7)], "a int, b int, c int")
    got = {(r["col1"], r["col2"]): r["r"] for r in A.correlations(rows, ["a", "b", "c"], "kendall").collect()}
    # 4 concordant, 3 discordant; 1 pair tied in a, 2 in b
    assert abs(got["a", "b"] - 1 / (9 * 8) ** 0.5) < 1e-12 and got["a", "c"] is None
    assert C.kendall(rows.limit(0), "a", "b") is None
