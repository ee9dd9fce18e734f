import numpy as np
import pandas as pd
import pytest

from tabularium.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.where(rng.random(20_000) < 0.34, 5.0, rng.normal(5, 3, 20_000))
    y = rng.integers(0, 4, 20_000).astype(float)
    return pd.DataFrame({"x": x, "y": y, "k": rng.integers(0, 3, 20_000)})


def check(found, data):
    for c in ("x", "y"):
        want = data[c].quantile(PROBS)
        for p in PROBS:
            assert found[c][p] == pytest.approx(want[p], abs=1e-9)


def test_sorted_and_bracketed(spark, data):
    df = spark.createDataFrame(data)
    check(Q.quantiles(df, ["x", "y"], PROBS), data)
    check(Q._bracketed(df, ["x", "y"], PROBS), data)


def test_bracketed_again_when_much_is_inside(spark, data, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 2)
    df = spark.createDataFrame(data)
    check(Q._bracketed(df, ["x", "y"], PROBS), data)


def test_grouped_by_value_counts(spark, data):
    df = spark.createDataFrame(data)
    rows = Q._by_value_counts(df, ["k"], ["x"], [0.25, 0.5]).collect()
    want = data.groupby("k")["x"].quantile([0.25, 0.5])
    assert len(rows) == 6
    for r in rows:
        assert r["value"] == pytest.approx(want[(r["k"], r["p"])], abs=1e-9)


def test_nulls_empty_and_single(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    found = Q.quantiles(df, ["a", "b"], [0.5])
    assert found["a"][0.5] is None and found["b"][0.5] == 1.0
    assert Q._bracketed(df, ["a", "b"], [0.5]) == {"a": {0.5: None}, "b": {0.5: 1.0}}
    assert Q.quantiles(df.filter("b > 5"), ["b"], [0.5]) == {"b": {0.5: None}}


def test_few_numbers_reach_the_driver(spark, monkeypatch):
    """Whatever the size: at most bins x ranks rows a pass, here over a skewed column with far outliers."""
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"x": np.r_[np.exp(rng.normal(0, 9, 60_000)), [1e300, -1e300, 0.0, -0.0]], "y": np.repeat(0.1, 60_004)})
    seen, settle = [], Q._Search.settle
    monkeypatch.setattr(Q._Search, "settle", lambda self, counts: (seen.append((len(counts), len(self.ranks))), settle(self, counts)))
    found = Q.quantiles(spark.createDataFrame(data), ["x", "y"], PROBS)
    for p in PROBS:
        assert found["x"][p] == pytest.approx(data["x"].quantile(p), rel=1e-12) and found["y"][p] == 0.1
    assert all(n <= (Q.BINS + 4) * ranks for n, ranks in seen) and len(seen) <= 2 * 9


def test_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(float(x),) for x in range(50)] + [(float("inf"),)] * 3 + [(float("-inf"),)] * 2 + [(float("nan"),), (None,)], "a double")
    found = Q.quantiles(df, ["a"], [0.0, 0.5, 1.0])["a"]
    assert found[0.0] == float("-inf") and found[1.0] == float("inf") and found[0.5] == 25.0
