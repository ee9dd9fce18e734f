"""Windows over a hot key, no key and NULL keys against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.operators.ordered import Ordered, row_numbers


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 600
    key = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 40, n))
    value = rng.normal(size=n)
    return pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.integers(0, 50, n), "v": value, "known": rng.random(n) < 0.6})


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("g", F.when(F.col("known"), F.col("v"))).drop("known")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10, 37, 10_000])
def test_lag_and_rolling(table, frame, keys, limit):
    made = Ordered(table, keys, ["t", "id"], limit).bounded(
        12, 3, lambda w: {"lag": F.lag("v", 12).over(w), "lead": F.lead("v", 3).over(w), "sum": F.sum("v").over(w.rowsBetween(-5, 2))}
    )
    got = made.toPandas().sort_values("id").reset_index(drop=True)
    want = frame.sort_values(["t", "id"])
    grouped = want.groupby("k")["v"] if keys else want.groupby(lambda _: 0)["v"]
    want = want.assign(
        lag=grouped.shift(12),
        lead=grouped.shift(-3),
        sum=grouped.transform(lambda s: pd.Series([s.iloc[max(0, i - 5) : i + 3].sum() for i in range(len(s))], s.index)),
    ).sort_values("id")
    assert len(got) == len(frame)
    for c in ("lag", "lead", "sum"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("limit", [10, 10_000])
def test_running_and_fill(table, frame, keys, limit):
    made = Ordered(table, keys, ["t", "id"], limit).running(sums={"n": F.lit(1), "s": F.col("v")}, ffill={"f": F.col("g")}, bfill={"b": F.col("g")})
    got = made.toPandas().sort_values("id").reset_index(drop=True)
    want = frame.assign(g=frame["v"].where(frame["known"])).sort_values(["t", "id"])
    by = want["k"] if keys else pd.Series(0, want.index)
    want = want.assign(n=1).assign(
        n=lambda d: d["n"].groupby(by).cumsum(), s=want["v"].groupby(by).cumsum(), f=want["g"].groupby(by).ffill(), b=want["g"].groupby(by).bfill()
    ).sort_values("id")
    for c in ("n", "s", "f", "b"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 5) for i in range(60)], "id bigint, k bigint")
    got = row_numbers(df, ["k"], ["id"]).count()
    split = Ordered(df, ["k"], ["id"], 7).running(sums={"rn": F.lit(1)})
    assert got == 60
    assert split.groupBy("k").agg(F.max("rn")).count() == 2
    assert split.agg(F.max("rn")).first()[0] == 30


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, k bigint")
    assert row_numbers(df, ["k"], ["id"]).count() == 0
    assert row_numbers(df, [], ["id"]).count() == 0


def test_no_list_of_ranges_travels_with_the_rows(table):
    made = Ordered(table, [], ["t", "id"], 20).bounded(5, 2, lambda w: {"lag": F.lag("v", 5).over(w)})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "ResolvedHint" not in plan and "strategy=broadcast" not in plan
    # a row is copied to the blocks beside its own only
    assert made.count() == 600


def test_frames_longer_than_the_limit(table, frame):
    made = Ordered(table, [], ["t", "id"], 10).bounded(70, 45, lambda w: {"sum": F.sum("v").over(w.rowsBetween(-70, 45))})
    got = made.toPandas().sort_values("id").reset_index(drop=True)
    v = frame.sort_values(["t", "id"])["v"]
    want = pd.Series([v.iloc[max(0, i - 70) : i + 46].sum() for i in range(len(v))], v.index).sort_index()
    np.testing.assert_allclose(got["sum"].to_numpy(float), want.to_numpy(float), atol=1e-9)
