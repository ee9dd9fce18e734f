"""Lag, rolling, trend and trailing-anomaly features along an explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import col
from .aggregate import monotonic_columns  # noqa: F401  (part of this module's surface)
from .lookup import join_lookup
from .ordered import Ordered

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_features(df: DataFrame, columns: list[str], order_by: list[str], keys: list[str] = (), lags: list[int] = (1, 7, 14, 30)) -> DataFrame:
    def build(w):
        return {f"{c}_lag_{k}": F.lag(col(c), k).over(w) for c in columns for k in lags}

    return Ordered(df, list(keys), order_by).bounded(max(lags), 0, build)


def rolling_features(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    keys: list[str] = (),
    windows: list[int] = (7, 14, 30),
    stats: list[str] = ("mean", "std", "min", "max"),
    shift: int = 0,
) -> DataFrame:
    """Rolling statistics, NULL until the window holds ``w`` values; ``shift=1`` leaves the current row out."""

    def build(spec):
        out = {}
        for c in columns:
            for w in windows:
                frame = spec.rowsBetween(-(w - 1) - shift, -shift)
                full = F.count(col(c)).over(frame) == w
                for s in stats:
                    out[f"{c}_rolling_{s}_{w}"] = F.when(full, ROLLING[s](col(c)).over(frame))
        return out

    return Ordered(df, list(keys), order_by).bounded(max(windows) - 1 + shift, 0, build)


def centred_trend(df: DataFrame, column: str, window: int, order_by: list[str], keys: list[str] = (), name: str = "trend") -> DataFrame:
    """Centred moving average; rows without a full window take the nearest earlier, then later, value."""
    after = (window - 1) // 2
    before = window - 1 - after

    def build(spec):
        frame = spec.rowsBetween(-before, after)
        return {"__t": F.when(F.count(col(column)).over(frame) == window, F.avg(col(column)).over(frame))}

    averaged = Ordered(df, list(keys), order_by).bounded(before, after, build)
    filled = Ordered(averaged, list(keys), order_by).running(ffill={"__f": F.col("__t")}, bfill={"__b": F.col("__t")})
    return filled.withColumn(name, F.coalesce("__f", "__b")).drop("__t", "__f", "__b")


def trailing_anomalies(
    df: DataFrame,
    columns: list[str],
    order_by: list[str],
    keys: list[str] = (),
    window: int = 100,
    threshold: float = 3.0,
    min_rows: int = 10,
) -> DataFrame:
    """Largest |z| of the row against the ``window`` rows before it; 0 while fewer than ``min_rows`` exist."""

    def build(spec):
        frame = spec.rowsBetween(-window, -1)
        scores = [
            F.abs(col(c) - F.avg(col(c)).over(frame)) / (F.stddev_pop(col(c)).over(frame) + F.lit(1e-8)) for c in columns
        ]
        ready = F.count(F.lit(1)).over(frame) >= min_rows
        worst = scores[0] if len(scores) == 1 else F.greatest(*scores)
        return {"score": F.when(ready, worst).otherwise(F.lit(0.0))}

    out = Ordered(df, list(keys), order_by).bounded(window, 0, build)
    return out.withColumn("is_anomaly", (F.col("score") > threshold).cast("int"))


def last_k(df: DataFrame, keys: list[str], order_by: list[str], k: int) -> DataFrame:
    """Last k rows of every key; the rank filter is applied before the shuffle as well, so no group is gathered whole."""
    w = Window.partitionBy(*[col(c) for c in keys]).orderBy(*[col(c).desc() for c in order_by])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def recent_accuracy(df: DataFrame, prediction: str, actual: str, order_by: list[str], keys: list[str] = (), last: int = 100, min_labelled: int = 10) -> DataFrame:
    """Accuracy over the labelled rows among the last N; NULL below ``min_labelled``."""
    if keys:
        recent = last_k(df, list(keys), order_by, last)
    else:
        recent = df.orderBy(*[col(c).desc() for c in order_by]).limit(last)
    hit = F.when(col(actual).isNotNull(), (col(prediction) == col(actual)).cast("double"))
    out = recent.groupBy(*[col(k) for k in keys]).agg(F.count(hit).alias("labelled"), F.avg(hit).alias("accuracy"))
    return out.withColumn("accuracy", F.when(F.col("labelled") >= min_labelled, F.col("accuracy")))


def rolling_accuracy(df: DataFrame, prediction: str, actual: str, order_by: list[str], keys: list[str] = (), window: int = 100) -> DataFrame:
    hit = F.when(col(actual).isNotNull(), (col(prediction) == col(actual)).cast("double"))
    return Ordered(df.withColumn("__hit", hit), list(keys), order_by).bounded(
        window - 1, 0, lambda w: {"rolling_accuracy": F.avg("__hit").over(w.rowsBetween(-(window - 1), 0))}
    ).drop("__hit")


def sequential_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, sequential): unique integers running from 0 or 1 without gaps, decided without a sort."""
    from ..functions.guarded import wide_to_long

    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count_distinct(col(c)).alias(f"d{i}"), F.min(col(c)).alias(f"a{i}"), F.max(col(c)).alias(f"z{i}")]
    blocks = {
        c: {
            "sequential": F.coalesce(
                (F.col(f"d{i}") == F.col("rows")) & (F.col(f"z{i}") - F.col(f"a{i}") == F.col("rows") - 1) & F.col(f"a{i}").isin(0, 1),
                F.lit(False),
            )
        }
        for i, c in enumerate(columns)
    }
    return wide_to_long(df.agg(*aggs), blocks)


def category_codes(df: DataFrame, columns: list[str], name: str = "code") -> DataFrame:
    """(columns..., code): dense 0-based rank of each distinct category combination in sorted order."""
    values = df.select(*[col(c) for c in columns]).filter(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in columns])).distinct()
    return Ordered(values, [], columns).running(sums={name: F.lit(1).cast("long")}).withColumn(name, col(name) - 1)
