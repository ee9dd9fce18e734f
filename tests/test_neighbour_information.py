"""k-nearest mutual information against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import selection as L


def psi(n):
    return -0.57721566490153286 + math.fsum(1 / i for i in range(1, n))


def brute(x, y, k=3):
    known = ~np.isnan(x) & np.array([v is not None and list(y).count(v) > 1 for v in y])
    x, y = x[known], np.array(y)[known]
    terms = []
    for i in range(len(x)):
        own = np.abs(x[y == y[i]] - x[i])
        used = min(k, len(own) - 1)
        reach = np.nextafter(np.sort(own)[used], 0)
        terms.append(psi(used) - psi(len(own)) - psi(int((np.abs(x - x[i]) <= reach).sum())))
    return max(0.0, psi(len(x)) + math.fsum(terms) / len(terms))


def rows(spark, x, y):
    return spark.createDataFrame([(i, None if np.isnan(a) else float(a), b) for i, (a, b) in enumerate(zip(x, y))], "id bigint, x double, y string").repartition(3)


@pytest.mark.parametrize("kind", ["apart", "ties", "decimals"])
def test_equals_brute_force(spark, kind):
    draw = np.random.default_rng(4)
    y = draw.choice(["a", "b", "c"], 2000, p=[0.7, 0.28, 0.02])
    x = draw.normal(size=2000) + (y == "b") * 1.5
    x = {"apart": x, "ties": np.round(x), "decimals": np.round(x, 1) * 0.7}[kind]
    x[:3] = np.nan
    got = L.neighbour_information(rows(spark, x, y), ["x"], "y", "id").first()
    assert got["column"] == "x" and abs(got["score"] - brute(x, y)) < 1e-9


def test_split_groups_and_small_classes(spark, small_groups):
    draw = np.random.default_rng(5)
    y = ["a"] * 120 + ["b"] * 90 + ["c"] * 2 + ["d"] + [None] * 4
    x = draw.normal(size=len(y)) + np.array([v == "b" for v in y])
    got = L.neighbour_information(rows(spark, x, y), ["x"], "y", "id").first()["score"]
    assert abs(got - brute(x, y)) < 1e-9


def test_selection_by_neighbours(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("noise"), (F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 100 > 50).alias("y"))
    assert L.select_features(df, ["noise", "a"], "y", "neighbours", k=1, key="id") == ["a"]
