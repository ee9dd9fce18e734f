"""Feature selection scores from grouped sums, moments and counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guarded import col, corr, numeric_columns, wide_to_long
from .aggregate import correlations
from .lookup import join_lookup
from .ordered import Ordered, running_totals
from .quantiles import quantiles


def variance_table(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.01) -> DataFrame:
    columns = columns or numeric_columns(df)
    row = df.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    return wide_to_long(row, {c: {"variance": F.col(f"v{i}")} for i, c in enumerate(columns)}).withColumn("kept", F.col("variance") > threshold)


def correlated_columns(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> list[str]:
    """Later column of every pair whose |r| exceeds the threshold."""
    columns = columns or numeric_columns(df)
    high = correlations(df, columns).filter(F.abs("r") > threshold).select("col2").distinct().collect()
    found = {r[0] for r in high}
    return [c for c in columns if c in found]


def drop_correlated(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    return df.drop(*correlated_columns(df, columns, threshold))


def chi2_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): chi-square of class sums of non-negative features against their expectation."""
    sums = df.groupBy(col(target).alias("__y")).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(col(c)).cast("double").alias(f"s{i}") for i, c in enumerate(columns)])
    total = sums.agg(F.sum("__n").alias("n"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(columns))]).first()
    parts = []
    for i in range(len(columns)):
        expected = F.col("__n") / F.lit(float(total["n"])) * F.lit(total[f"t{i}"])
        gap = F.col(f"s{i}") - expected
        parts.append(F.sum(F.try_divide(gap * gap, expected)).alias(f"c{i}"))
    return wide_to_long(sums.agg(*parts), {c: {"score": F.col(f"c{i}")} for i, c in enumerate(columns)})


def anova_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): one-way F statistic of each feature over the classes."""
    sums = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        sums += [F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}")]
    groups = df.groupBy(col(target).alias("__y")).agg(F.count(F.lit(1)).alias("__n"), *sums)
    outer = [F.count(F.lit(1)).cast("double").alias("k"), F.sum("__n").cast("double").alias("n")]
    for i in range(len(columns)):
        outer += [F.sum(f"s{i}").alias(f"s{i}"), F.sum(f"q{i}").alias(f"q{i}"), F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("__n")).alias(f"b{i}")]
    row = groups.agg(*outer)
    blocks = {}
    for i, c in enumerate(columns):
        between = F.col(f"b{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n")
        within = F.col(f"q{i}") - F.col(f"b{i}")
        blocks[c] = {"score": F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))}
    return wide_to_long(row, blocks)


def regression_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, score): F statistic of the univariate regression, r^2/(1-r^2)*(n-2)."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), *[corr(c, target).alias(f"r{i}") for i, c in enumerate(columns)]]
    blocks = {}
    for i, c in enumerate(columns):
        r2 = F.col(f"r{i}") * F.col(f"r{i}")
        blocks[c] = {"score": F.try_divide(r2, 1 - r2) * (F.col("n") - 2)}
    return wide_to_long(df.agg(*aggs), blocks)


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(column, score): mutual information in nats between quantile bins of each feature and the class."""
    from ..functions.guarded import interval_index

    q = quantiles(df, columns, [i / bins for i in range(bins + 1)])
    cells = []
    for c in columns:
        edges = sorted({v for v in q[c].values() if v is not None})
        cells.append(F.struct(F.lit(c).alias("column"), F.coalesce(interval_index(col(c).cast("double"), edges), F.lit(-1)).alias("bin")))
    joint = df.select(F.inline(F.array(*cells)), col(target).alias("__y")).groupBy("column", "bin", "__y").agg(F.count(F.lit(1)).alias("n"))
    # at most columns x (bins + 1) x classes rows from here on
    by_bin = joint.groupBy("column", "bin").agg(F.sum("n").alias("nb"))
    by_class = joint.groupBy("column", "__y").agg(F.sum("n").alias("nc"))
    totals = joint.groupBy("column").agg(F.sum("n").alias("nn"))
    merged = joint.join(by_bin, ["column", "bin"]).join(by_class.withColumnRenamed("__y", "__c"), (joint["column"] == by_class["column"]) & F.expr("__y <=> __c")).drop(by_class["column"])
    merged = merged.join(totals, "column")
    p = F.col("n") / F.col("nn").cast("double")
    return merged.groupBy("column").agg(F.sum(p * F.ln(F.col("n") * F.col("nn") / (F.col("nb") * F.col("nc")).cast("double"))).alias("score"))


def digamma(n: Column) -> Column:
    """psi of a whole number n >= 1: the asymptotic series ten steps further on, less those steps."""
    x = n.cast("double") + 10.0
    series = F.ln(x) - 0.5 / x - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8) - 1 / (132 * x**10)
    steps = [F.lit(1.0) / (n + F.lit(float(i))) for i in range(10)]
    return series - sum(steps[1:], steps[0])


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _ball(x: pd.Series, radius: pd.Series) -> pd.DataFrame:
    """The least and the largest double whose distance to x, as computed, is below the radius, or zero where that is."""
    x, reach = x.to_numpy(dtype=float), np.nextafter(radius.to_numpy(dtype=float), 0)
    ends = []
    for side in (-1, 1):
        end = x + side * reach
        # rounding leaves the sum a step or two off
        for _ in range(3):
            end = np.where(np.abs(end - x) > reach, np.nextafter(end, x), end)
        for _ in range(3):
            further = np.nextafter(end, side * np.inf)
            end = np.where(np.abs(further - x) <= reach, further, end)
        ends.append(end)
    return pd.DataFrame({"low": ends[0], "high": ends[1]})


def neighbour_information(df: DataFrame, columns: list[str], target: str, key: str, k: int = 3) -> DataFrame:
    """(column, score): mutual information in nats between each feature and the class by k nearest neighbours.

    For a row, the distance to the k-th nearest row of its class bounds a ball; rows of any class in it are counted. The
    score is psi(n) + mean psi(k) - mean psi(rows of the class) - mean psi(rows in the ball), at least 0. Rows in order
    of value have their neighbours within k places in their class, and counts are differences of running totals, so a
    class or a value of any size is split over tasks. Classes of one row and rows with unknown feature or class are left
    out; smaller classes use the neighbours they have. ``key`` is unique and breaks ties.
    """
    out = []
    for c in columns:
        rows = df.select(col(key).alias("__k"), (col(c).cast("double") + 0.0).alias("__x"), col(target).alias("__y")).filter("__x IS NOT NULL AND NOT isnan(__x) AND __y IS NOT NULL")
        sizes = rows.groupBy("__y").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1")
        rows = join_lookup(rows, sizes, ["__y"], "inner")
        x = F.col("__x")

        def build(w):
            left = [F.lag(x, i).over(w) for i in range(1, k + 1)]
            right = [F.lead(x, i).over(w) for i in range(1, k + 1)]
            return {f"__l{i + 1}": a for i, a in enumerate(left)} | {f"__r{i + 1}": a for i, a in enumerate(right)}

        near = Ordered(rows, ["__y"], ["__x", "__k"]).bounded(k, k, build)
        # the j nearest rows of a class are some on the left and the others on the right
        part = lambda side, i: F.abs(F.col(f"__{side}{i}") - x) if i else F.lit(0.0)
        reach = lambda j: F.least(*[F.when(part("l", i).isNotNull() & part("r", j - i).isNotNull(), F.greatest(part("l", i), part("r", j - i))) for i in range(j + 1)])
        used = F.least(F.lit(k).cast("bigint"), F.col("__c") - 1)
        radius = F.coalesce(*[F.when(used == j, reach(j)) for j in range(1, k + 1)])
        balls = near.select("__k", "__x", "__c", used.alias("__u"), _ball(x, radius).alias("b"))
        # at equal values: begins of balls, then rows, then ends
        stacked = balls.select(F.explode(F.array(
            F.struct(F.col("b.low").alias("v"), F.lit(0).alias("what"), F.lit(0).alias("one")),
            F.struct(F.col("__x").alias("v"), F.lit(1).alias("what"), F.lit(1).alias("one")),
            F.struct(F.col("b.high").alias("v"), F.lit(2).alias("what"), F.lit(0).alias("one")),
        )).alias("e"), "__k", "__c", "__u").select("e.*", "__k", "__c", "__u")
        below = running_totals(stacked, [], ["v", "what", "__k"], {"__n": F.col("one").cast("bigint")})
        inside = below.filter("what <> 1").groupBy("__k").agg(F.sum(F.when(F.col("what") == 2, F.col("__n")).otherwise(-F.col("__n"))).alias("__m"), F.first("__c").alias("__c"), F.first("__u").alias("__u"))
        score = digamma(F.count(F.lit(1))) + F.avg(digamma(F.col("__u"))) - F.avg(digamma(F.col("__c"))) - F.avg(digamma(F.col("__m")))
        out.append(inside.agg(F.greatest(F.lit(0.0), score).alias("score")).select(F.lit(c).alias("column"), "score"))
    return reduce(lambda a, b: a.unionByName(b), out)


def top_scores(scores: DataFrame, k: int) -> list[str]:
    return [r["column"] for r in scores.orderBy(F.col("score").desc_nulls_last(), "column").limit(k).collect()]


SCORES = {"chi2": chi2_scores, "anova": anova_scores, "regression": regression_scores, "mutual_info": mutual_information, "neighbours": neighbour_information}


def select_features(df: DataFrame, columns: list[str], target: str, method: str = "anova", k: int = 10, **options) -> list[str]:
    """Names of the selected columns.

    Filter methods score columns; ``variance`` and ``correlation`` drop columns; ``forest``, ``rfe`` and ``l1`` fit models.
    """
    if method in SCORES:
        return top_scores(SCORES[method](df, columns, target, **options), k)
    if method == "variance":
        table = {r["column"] for r in variance_table(df, columns, **options).filter("kept").collect()}
        return [c for c in columns if c in table]
    if method == "correlation":
        dropped = set(correlated_columns(df, columns, **options))
        return [c for c in columns if c not in dropped]
    from . import modelling

    wrappers = {"forest": modelling.forest_selection, "rfe": modelling.recursive_elimination, "l1": modelling.l1_selection}
    return wrappers[method](df, columns, target, k=k, **options)
