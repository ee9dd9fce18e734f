"""Joins and retrievals reachable through free SQL that need a scalable form."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import all_of, col
from .ordered import Ordered, running_totals
from .similarity import saved


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, left_key: list[str], right_key: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row at or before it.

    Both sides are stacked and the last right row is carried forward, so there is one shuffle and no range condition;
    a hot key is split over ranges like any other ordered group. ``left_key``/``right_key`` break ties in their own
    types. Right rows without key or time match nothing, and left rows without them find nothing.
    """
    payload = F.struct(*[col(v).alias(v) for v in values])
    ties = lambda side, names: [col(n).alias(f"__{side}{i}") for i, n in enumerate(names)]
    whole = F.struct(*[col(c) for c in left.columns])
    known = all_of([col(c).isNotNull() for c in [*on, right_ts]])
    a = left.select(*[col(k).alias(f"__k_{k}") for k in on], col(left_ts).alias("__ts"), F.lit(1).alias("__side"), *ties("l", left_key), whole.alias("__row"))
    b = right.filter(known).select(*[col(k).alias(f"__k_{k}") for k in on], col(right_ts).alias("__ts"), F.lit(0).alias("__side"), *ties("r", right_key), payload.alias("__value"))
    keys = [f"__k_{k}" for k in on]
    stacked = a.unionByName(b, allowMissingColumns=True)
    order = ["__ts", "__side", *[f"__r{i}" for i in range(len(right_key))], *[f"__l{i}" for i in range(len(left_key))]]
    carried = Ordered(stacked, keys, order).running(ffill={"__found": F.col("__value")})
    return carried.filter("__side = 1").select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


FAN, LEVELS = 8, 4


def _cells(points: list[DataFrame]) -> Callable[[Column], Column]:
    """A function from a double to the number of its cell, among 4096 of about as many points each.

    The edges are quantiles of the points, so that crowded stretches have narrow cells. NaN is above all others.
    """
    values = reduce(lambda a, b: a.unionByName(b), points).na.drop()
    n = FAN**LEVELS
    found = values.agg(F.percentile_approx("x", [i / n for i in range(1, n)], 4 * n).alias("edges")).first()["edges"] or []
    edges = np.unique(np.array([e for e in found if e == e]))

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype=float), side="right"), index=x.index).where(x.notna())

    return place


def _pieces(first: Column, last: Column) -> Column:
    """Cover of the cells first..last by aligned runs of 1, 8, 64 or 512 cells: (level, run), at most 14 a level."""
    listed = lambda a, b, level: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>")), lambda x: F.struct(F.lit(level).alias("level"), x.alias("run")))
    out, a, b = [], first, last
    for level in range(LEVELS - 1):
        inner, outer = F.ceil(a / F.lit(FAN)).cast("int"), F.floor((b + 1) / F.lit(FAN)).cast("int")
        some = inner < outer
        out += [F.when(some, listed(a, inner * FAN - 1, level)).otherwise(listed(a, b, level)), F.when(some, listed(outer * FAN, b, level)).otherwise(listed(F.lit(1), F.lit(0), level))]
        # without whole runs inside, nothing is left for the next level
        a, b = F.when(some, inner).otherwise(F.lit(1)), F.when(some, outer - 1).otherwise(F.lit(0))
    return F.concat(*out, listed(a, b, LEVELS - 1))


def range_join(points: DataFrame, ranges: DataFrame, x: str, low: str, high: str) -> DataFrame:
    """Rows with low <= x < high as an equi-join.

    The points' quantiles cut the axis into cells; a range is listed once per run of its cover by aligned runs of cells, at
    most 50 times however long it is, and a point once per run length that some range uses. Both sides are shuffled by run,
    so AQE can split a crowded one. Empty ranges and nulls join with nothing.
    """
    place = _cells([points.select(col(x).cast("double").alias("x"))])
    whole = ranges.filter(col(low) < col(high)).withColumns({"__a": place(col(low).cast("double")), "__b": place(col(high).cast("double"))})
    spread = whole.withColumn("__run", F.explode(_pieces(F.col("__a"), F.col("__b")))).drop("__a", "__b")
    used = sorted(r["level"] for r in spread.select("__run.level").distinct().collect())  # at most LEVELS rows
    runs = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(F.col("__c") / F.lit(FAN**level)).cast("int").alias("run")) for level in used] or [F.lit(None).cast("struct<level:int,run:int>")])
    listed = points.filter(col(x).isNotNull()).withColumn("__c", place(col(x).cast("double"))).withColumn("__run", F.explode(runs)).drop("__c")
    return listed.join(spread, "__run").filter((col(x) >= col(low)) & (col(x) < col(high))).drop("__run")


def overlap_join(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str) -> DataFrame:
    """Pairs of rows whose ranges [low, high) overlap, each once; columns of the two sides have different names.

    Two ranges overlap where one begins inside the other: the right one at or behind the left one's begin, or the left one
    behind the right one's. Both cases are range joins. Empty ranges overlap nothing.
    """
    a, b = left.filter(col(left_low) < col(left_high)), right.filter(col(right_low) < col(right_high))
    inside = range_join(b, a, right_low, left_low, left_high)
    behind = range_join(a, b, left_low, right_low, right_high).filter(col(left_low) > col(right_low))
    columns = [*left.columns, *right.columns]
    return inside.select(*[col(c) for c in columns]).unionByName(behind.select(*[col(c) for c in columns]))


def overlap_counts(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str, name: str = "overlaps") -> DataFrame:
    """Left rows with the number of right ranges [low, high) that overlap theirs, without listing the pairs.

    A range that ends at or before the left one's begin begins before its end too, so the number is that of the begins below
    the left end less that of the ends up to the left begin: two running totals over the distinct ends, written once, and two
    joins by value. Left rows with an empty range or without overlap are left out, as by the join.
    """
    a, b = left.filter(col(left_low) < col(left_high)), right.filter(col(right_low) < col(right_high))
    mark = lambda c, begun, ended: F.struct(col(c).alias("__x"), F.lit(begun).alias("__begun"), F.lit(ended).alias("__ended"))
    marks = b.select(F.inline(F.array(mark(right_low, 1, 0), mark(right_high, 0, 1)))).unionByName(a.select(F.inline(F.array(mark(left_low, 0, 0), mark(left_high, 0, 0)))))
    steps = saved(marks.groupBy("__x").agg(F.sum("__begun").alias("__begun"), F.sum("__ended").alias("__ended")), "ends")
    totals = running_totals(steps, [], ["__x"], {"__b": F.col("__begun"), "__e": F.col("__ended")})
    below = totals.select(F.col("__x").alias("__high"), (F.col("__b") - F.col("__begun")).alias("__below"))
    upto = totals.select(F.col("__x").alias("__low"), F.col("__e").alias("__upto"))
    met = a.join(below, col(left_high) == F.col("__high")).join(upto, col(left_low) == F.col("__low"))
    return met.withColumn(name, F.col("__below") - F.col("__upto")).filter(col(name) > 0).drop("__high", "__below", "__low", "__upto")
