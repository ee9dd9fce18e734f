"""Exact linear-interpolation quantiles without an unbounded aggregation buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import col
from .lookup import join_lookup
from .ordered import running_totals


def _by_value_counts(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Quantiles from value counts and split running totals: no task ever holds all values of a group."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("__v")) for c in cols])
    long = df.select(*[col(k) for k in keys], F.inline(pairs)).filter(F.col("__v").isNotNull())
    group = [*keys, "column"]
    counts = long.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ends = running_totals(counts, group, ["__v"], {"__end": F.col("__n")})
    totals = counts.groupBy(*group).agg((F.sum("__n") - 1).alias("__last"))
    wanted = totals.select(
        *group,
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"),
        "__last",
    ).withColumn("__h", F.col("p") * F.col("__last"))
    # zero-based order statistics k and k+1 around position h
    wanted = wanted.withColumn("__k", F.floor("__h")).withColumn("__f", F.col("__h") - F.floor("__h"))
    targets = wanted.groupBy(*group).agg(F.collect_list(F.struct("p", "__k", "__f", "__last")).alias("__want"))
    hits = join_lookup(ends, targets, group, "inner", null_safe=True).select(
        *group, "__v", "__n", "__end", F.explode("__want").alias("w")
    )
    begin = F.col("__end") - F.col("__n")
    low = (F.col("w.__k") >= begin) & (F.col("w.__k") < F.col("__end"))
    nxt = F.least(F.col("w.__k") + 1, F.col("w.__last"))
    high = (nxt >= begin) & (nxt < F.col("__end"))
    return (
        hits.filter(low | high)
        .groupBy(*group, F.col("w.p").alias("p"), F.col("w.__f").alias("__f"))
        .agg(F.max(F.when(low, F.col("__v"))).alias("__a"), F.max(F.when(high, F.col("__v"))).alias("__b"))
        .select(*group, "p", (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("value"))
    )


COLUMNS_PER_PASS = 8
BINS = 512
PASSES = 16


class _Search:
    """Order statistics of one column, by pairs of values that close in on them.

    The values of all pairs are edges. They cut the column into zones: the copies of an edge (odd numbers) and what lies
    strictly between two edges (even ones), which is cut into bins where the two are a pair.
    """

    def __init__(self, low: float, high: float, n: int, ranks: set[int]):
        self.pairs = {(low, high)}
        self.found = {0: low, n - 1: high}
        self.ranks = ranks - {0, n - 1}

    def edges(self) -> np.ndarray:
        return np.unique(np.array(list(self.pairs)))

    def settle(self, counts: list) -> None:
        """Read ranks off the counts of (zone, bin), given in order; the others get nearer pairs."""
        at, self.pairs = 0, set()
        for r in counts:
            low, high, n = r["low"], r["high"], r["n"]
            for k in [k for k in self.ranks if at <= k < at + n and k not in self.found]:
                if low == high or k == at:
                    self.found[k] = low
                elif k == at + n - 1:
                    self.found[k] = high
                else:
                    self.pairs.add((low, high))
            at += n
        self.ranks = {k for k in self.ranks if k not in self.found}


def _ordinal(x: np.ndarray) -> np.ndarray:
    """The place of a double among all doubles, as a double: monotone, and even over orders of magnitude."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits).astype(np.float64)


def _counts(df: DataFrame, searches: list[_Search], even: bool) -> DataFrame:
    """(c, zone, bin, n, low, high): values of each column by zone and bin, added up in the tasks first.

    Bins are equally wide, or with ``even`` hold equally many of the possible doubles.
    """
    limits, pairs, bins = [s.edges() for s in searches], [s.pairs for s in searches], BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by the upper edge of a zone: where it begins, and the scale of its bins (0: not cut)
        begins, scales, evens = [], [], []
        for e, own in zip(limits, pairs):
            lows = np.r_[e[:1], e[:-1]]
            width = np.array([b - a if (a, b) in own else 0.0 for a, b in zip(lows, e)])
            evens.append(even | ~np.isfinite(width))
            width = np.where(evens[-1], [_ordinal(np.array([b]))[0] - _ordinal(np.array([a]))[0] if (a, b) in own else 0.0 for a, b in zip(lows, e)], width)
            begins.append(lows)
            scales.append(np.divide(bins, width, out=np.zeros(len(e)), where=width > 0))
        sizes = [(2 * len(e) + 1) * bins for e in limits]
        n = [np.zeros(s, np.int64) for s in sizes]
        low, high = [np.full(s, np.inf) for s in sizes], [np.full(s, -np.inf) for s in sizes]
        for batch in batches:
            for i, e in enumerate(limits):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                left, right = np.searchsorted(e, x, "left"), np.searchsorted(e, x, "right")
                zone, upper = left + right, np.minimum(left, len(e) - 1)
                key = zone * bins
                cut = np.flatnonzero((zone % 2 == 0) & (left < len(e)) & (scales[i][upper] > 0))
                y, at, by = x[cut], begins[i][upper[cut]], evens[i][upper[cut]]
                away = np.where(by, _ordinal(y) - _ordinal(at), y - np.where(by, y, at))
                key[cut] += np.clip(np.floor(away * scales[i][upper[cut]]), 0, bins - 1).astype(np.int64)
                n[i] += np.bincount(key, minlength=sizes[i])
                np.minimum.at(low[i], key, x)
                np.maximum.at(high[i], key, x)
        for i in range(len(limits)):
            key = np.flatnonzero(n[i])
            own = [np.full(len(key), i), key // bins, key % bins, n[i][key], low[i][key], high[i][key]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in own], ["c", "zone", "bin", "n", "low", "high"])

    made = df.mapInArrow(run, "c bigint, zone bigint, bin bigint, n bigint, low double, high double")
    return made.groupBy("c", "zone", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _bracketed(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, dict[float, float | None]]:
    """Exact global quantiles in a few narrow passes, without moving the data or fetching values.

    A pass cuts the stretches that hold wanted ranks into bins, in the tasks, and notes the count, least and largest value of
    each. A rank at an end of its bin is found, the bins of the others are cut in the next pass: two or three for evenly
    spread values; every third pass follows the doubles themselves, so far outliers cost a few more. The driver receives
    three numbers a bin, at most ``BINS`` bins a wanted rank, whatever the table's size; NaN counts as missing.
    """
    raw = {c: col(c).cast("double") for c in columns}
    v = {c: F.when(~F.isnan(raw[c]), raw[c]) for c in columns}
    first = df.agg(
        *[F.count(v[c]).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.min(v[c]).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(v[c]).alias(f"z{i}") for i, c in enumerate(columns)],
    ).first()
    searches = {}
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        if n:
            ranks = {k for p in probs for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}
            searches[c] = _Search(first[f"a{i}"], first[f"z{i}"], n, ranks)
    for turn in range(PASSES):
        left = [c for c, s in searches.items() if s.ranks]
        if not left:
            break
        counts = _counts(df.select(*[v[c].alias(f"x{i}") for i, c in enumerate(left)]), [searches[c] for c in left], turn % 3 == 2).collect()
        counts.sort(key=lambda r: (r["c"], r["zone"], r["bin"]))
        for i, c in enumerate(left):
            searches[c].settle([r for r in counts if r["c"] == i])
    out: dict[str, dict[float, float | None]] = {c: {p: None for p in probs} for c in columns}
    for i, c in enumerate(columns):
        s, n = searches.get(c), first[f"n{i}"]
        if not n:
            continue
        if s.ranks:
            # values closer than the bins can tell apart
            own = _by_value_counts(df.select(v[c].alias("__x")), [], ["__x"], probs)
            out[c] = {r["p"]: r["value"] for r in own.collect()}
            continue
        for p in probs:
            k = int(p * (n - 1))
            x, y = s.found[k], s.found[min(k + 1, n - 1)]
            out[c][p] = x if x == y else x + (y - x) * (p * (n - 1) - k)
    return out


def quantile_table(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """(keys..., column, p, value) with exact quantiles of every column in every group."""
    if not keys:
        found = quantiles(df, cols, probs)
        rows = [(c, float(p), found[c][float(p)]) for c in cols for p in probs]
        return df.sparkSession.createDataFrame(rows, "column string, p double, value double")
    return _by_value_counts(df, keys, cols, probs)


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, dict[float, float | None]]:
    """Fitted quantiles as scalars: columns x probabilities values reach the driver."""
    out: dict[str, dict[float, float | None]] = {}
    if not cols:
        return out
    for i in range(0, len(cols), COLUMNS_PER_PASS):
        out |= _bracketed(df, cols[i : i + COLUMNS_PER_PASS], [float(p) for p in probs])
    return out


def median_by(df: DataFrame, keys: list[str], c: str, name: str = "median") -> DataFrame:
    return quantile_table(df, keys, [c], [0.5]).select(*[col(k) for k in keys], F.col("value").alias(name))
