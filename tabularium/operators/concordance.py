"""Kendall's tau-b by counting inversions over ranges.

Sorted by x and then y, a discordant pair is an inversion of y. Distinct (x, y) cells with their counts are cut into ranges
by x and into bins by y. Inversions inside a range, and inside a bin between ranges, are counted by tasks; those between
ranges and bins depend on the sums per (range, bin) only and are the same problem on a much smaller table. A y value that
many cells share has a bin of its own, in which there are none, so no task holds more than about ``max_rows`` cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import col
from ..session import max_group_rows
from ..streaming.sources import scratch_folder


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_i * w_j over i < j with y_i > y_j, bit by bit of the ranks of y."""
    if len(y) < 2:
        return 0
    ranks = np.unique(y, return_inverse=True)[1]
    # products of sums must fit
    wide = int(w.sum()) ** 2 >= 1 << 62
    w = w.astype(object if wide else np.int64)
    total = 0
    for bit in reversed(range(int(ranks.max()).bit_length())):
        # rows with equal higher bits stand together, in their first order
        order = np.argsort(ranks >> (bit + 1), kind="stable")
        group, one, own = ranks[order] >> (bit + 1), (ranks[order] >> bit) & 1, w[order]
        above = np.cumsum(own * one)
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.repeat(np.r_[np.zeros(1, dtype=above.dtype), above[heads[1:] - 1]], np.diff(np.r_[heads, len(group)]))
        total += int((own * (1 - one) * (above - before)).sum())
    return total


def _counted(groups: DataFrame, by: str, order: list[str]) -> int:
    """Inversions of y inside each group, whose rows are put in order first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        return pa.table({"n": [str(inversions(table["y"].to_numpy(), table["w"].to_numpy()))]})

    found = groups.groupBy(by).applyInArrow(run, "n string")
    return int(found.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0))).first()[0])


def discordant(cells: DataFrame, max_rows: int) -> int:
    """Discordant pairs of distinct (x double, y double) cells with counts w."""
    n = cells.count()
    if n <= max_rows:
        return _counted(cells.withColumn("all", F.lit(0)), "all", ["x", "y"])
    # the sums are at most half as many rows
    ranges = max(2, min(math.ceil(n / max_rows), math.isqrt(n) // 2))
    probabilities = [i / ranges for i in range(1, ranges)]
    edges = np.unique(np.array(cells.approxQuantile("y", probabilities, 0.1 / ranges)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            # odd bins hold one edge's value, even ones what lies between
            left, right = np.searchsorted(edges, y, "left"), np.searchsorted(edges, y, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left + right, pa.int32())], ["x", "y", "w", "part", "bin"])

    ranged = cells.select("x", "y", "w").repartitionByRange(ranges, "x", "y").withColumn("part", F.spark_partition_id())
    folder = scratch_folder(cells.sparkSession, "kendall")
    ranged.mapInArrow(place, "x double, y double, w bigint, part int, bin int").write.parquet(folder)
    ranged = cells.sparkSession.read.parquet(folder)
    inside = _counted(ranged, "part", ["x", "y"])
    # cells of one range go up in y here, so that only pairs between ranges count
    same_bin = _counted(ranged.filter("bin % 2 = 0"), "bin", ["part", "y"])
    sums = ranged.groupBy(F.col("part").cast("double").alias("x"), F.col("bin").cast("double").alias("y")).agg(F.sum("w").alias("w"))
    return inside + same_bin + discordant(sums, max_rows)


def ties(cells: DataFrame, *by: str) -> int:
    """Pairs of rows that are equal in ``by``."""
    sizes = cells.groupBy(*by).agg(F.sum("w").cast("decimal(19,0)").alias("t"))
    return int(sizes.agg(F.coalesce(F.sum((F.col("t") * (F.col("t") - 1)).cast("decimal(38,0)")), F.lit(0))).first()[0]) // 2


def kendall(df: DataFrame, a: str, b: str, max_rows: int | None = None) -> float | None:
    """tau-b of two columns as doubles over rows where both are known; None where one of them is constant."""
    max_rows = max_rows or max_group_rows(df.sparkSession)
    both = df.select(col(a).cast("double").alias("x"), col(b).cast("double").alias("y")).na.drop()
    # adding zero makes one value of the two zeros
    cells = both.groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    folder = scratch_folder(df.sparkSession, "cells")
    cells.write.parquet(folder)
    cells = df.sparkSession.read.parquet(folder)
    n = int(cells.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0])
    pairs, same_x, same_y, same = n * (n - 1) // 2, ties(cells, "x"), ties(cells, "y"), ties(cells, "x", "y")
    if pairs in (same_x, same_y):
        return None
    against = discordant(cells, max_rows)
    agree = pairs - same_x - same_y + same - against
    return (agree - against) / math.sqrt((pairs - same_x) * (pairs - same_y))
