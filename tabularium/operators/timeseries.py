"""Series preparation, frequency, supervised lag features, future rows, decomposition and temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import array_sum, col
from .lookup import join_lookup
from .ordered import Ordered, row_numbers
from .quantiles import quantile_table
from .windows import centred_trend, last_k

FEATURES = ["lag_1", "lag_7", "lag_30", "rolling_7", "rolling_30", "day_of_week", "month", "trend"]


def prepare(df: DataFrame, ts: str, value: str, keys: list[str] = (), tiebreak: list[str] = ()) -> DataFrame:
    """Fill gaps: linear between known values (by position), edges take the nearest known value."""
    keys, order = list(keys), [ts, *tiebreak]
    numbered = row_numbers(df, keys, order, "__rn")
    known = F.when(col(value).isNotNull(), F.struct(F.col("__rn").alias("at"), col(value).cast("double").alias("v")))
    around = Ordered(numbered, keys, order).running(ffill={"__p": known}, bfill={"__q": known})
    p, q = F.col("__p"), F.col("__q")
    share = (F.col("__rn") - p["at"]).cast("double") / F.nullif((q["at"] - p["at"]).cast("double"), F.lit(0.0))
    filled = F.coalesce(col(value).cast("double"), p["v"] + (q["v"] - p["v"]) * share, p["v"], q["v"])
    return around.withColumn(value, filled).drop("__rn", "__p", "__q")


def frequency(df: DataFrame, ts: str, keys: list[str] = (), tiebreak: list[str] = ()) -> DataFrame:
    """(keys..., median_gap_seconds, frequency) from the median gap between neighbours."""
    keys = list(keys)
    seconds = F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)
    gaps = Ordered(df.withColumn("__s", seconds), keys, [ts, *tiebreak]).bounded(
        1, 0, lambda w: {"__gap": F.col("__s") - F.lag("__s").over(w)}
    )
    medians = quantile_table(gaps.select(*[col(k) for k in keys], "__gap"), keys, ["__gap"], [0.5])
    g = F.col("value")
    name = (
        F.when(g <= 3600, "hour").when(g <= 86400, "day").when(g <= 7 * 86400, "week").when(g <= 31 * 86400, "month").otherwise("day")
    )
    return medians.select(*[col(k) for k in keys], g.alias("median_gap_seconds"), name.alias("frequency"))


def supervised(df: DataFrame, ts: str, value: str, keys: list[str] = (), tiebreak: list[str] = (), shift: int = 0) -> DataFrame:
    """Model features per row, incomplete rows dropped; ``shift=1`` keeps the current value out of rolling means."""
    keys, order = list(keys), [ts, *tiebreak]

    def build(w):
        out = {f"lag_{k}": F.lag(col(value), k).over(w) for k in (1, 7, 30)}
        for k in (7, 30):
            frame = w.rowsBetween(-(k - 1) - shift, -shift)
            out[f"rolling_{k}"] = F.when(F.count(col(value)).over(frame) == k, F.avg(col(value)).over(frame))
        return out

    numbered = row_numbers(df, keys, order, "__rn")
    made = Ordered(numbered, keys, order).bounded(30, 0, build)
    made = made.withColumns({"day_of_week": F.weekday(col(ts)), "month": F.month(col(ts)), "trend": F.col("__rn") - 1})
    return made.drop("__rn").na.drop(subset=[value, "lag_1", "lag_7", "lag_30", "rolling_7", "rolling_30"])


def future_rows(df: DataFrame, ts: str, value: str, periods: int, keys: list[str] = (), tiebreak: list[str] = ()) -> DataFrame:
    """Feature rows of the next ``periods`` days, the last value standing in for unknown ones.

    Only the last 30 values of a series are needed, so each series travels as one short array.
    """
    keys = list(keys)
    group = keys or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(0))
    order = F.struct(*[col(c) for c in [ts, *tiebreak]])
    recent = last_k(df, group, [ts, *tiebreak], 30)
    tail = recent.groupBy(*[col(k) for k in group]).agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), col(value).cast("double").alias("v")))).alias("__t"),
        F.max(col(ts)).alias("__last"),
    )
    sizes = df.groupBy(*[col(k) for k in group]).agg(F.count(F.lit(1)).alias("__n"))
    rows = tail.join(sizes, group).withColumn("__h", F.transform("__t", lambda s: s["v"]))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    last = F.element_at("__h", -1)
    series = F.concat(F.col("__h"), F.array_repeat(last, F.col("step")))
    rows = rows.withColumn("__x", series)
    back = lambda k: F.when(F.size("__x") >= k, F.try_element_at("__x", F.lit(-k))).otherwise(F.element_at("__x", -1))
    window = lambda k: F.slice("__x", F.greatest(F.size("__x") - (k - 1), F.lit(1)), F.lit(k))
    mean = lambda k: array_sum(window(k)) / F.size(window(k))
    date = F.col("__last") + F.make_dt_interval(F.col("step") + 1)
    return rows.select(
        *[col(k) for k in keys],
        date.alias("date"),
        F.element_at("__x", -1).alias("lag_1"),
        back(7).alias("lag_7"),
        back(30).alias("lag_30"),
        mean(7).alias("rolling_7"),
        mean(30).alias("rolling_30"),
        F.weekday(date).alias("day_of_week"),
        F.month(date).alias("month"),
        (F.col("__n") + F.col("step")).alias("trend"),
    )


def forecast_interval(test: DataFrame, forecast: DataFrame, actual: str, prediction: str, z: float = 1.96) -> DataFrame:
    """Attach lower and upper bounds from the population spread of the hold-out residuals."""
    spread = test.agg(F.stddev_pop(col(actual) - col(prediction)).alias("s")).first()["s"]
    half = F.lit(None if spread is None else z * spread).cast("double")
    return forecast.withColumns({"lower": col(prediction) - half, "upper": col(prediction) + half})


def decompose(df: DataFrame, ts: str, value: str, tiebreak: list[str] = (), period: int | None = None) -> DataFrame:
    """trend (centred mean over min(7, n/4) rows), seasonal and residual of one series.

    ``seasonal`` is 0 unless a ``period`` is given; then it is the mean detrended value of each phase.
    """
    order = [ts, *tiebreak]
    window = min(7, df.count() // 4)
    out = centred_trend(df, value, window, order) if window > 0 else df.withColumn("trend", col(value).cast("double"))
    if period is None:
        out = out.withColumn("seasonal", F.lit(0.0))
    else:
        phased = row_numbers(out, [], order, "__rn").withColumn("__phase", F.col("__rn") % period)
        means = phased.groupBy("__phase").agg(F.avg(col(value) - F.col("trend")).alias("seasonal"))
        out = join_lookup(phased, means, ["__phase"]).drop("__rn", "__phase")
    return out.withColumn("residual", col(value) - F.col("trend") - F.col("seasonal"))


def temporal_split(df: DataFrame, order_by: list[str], keys: list[str] = (), train: float = 0.8) -> DataFrame:
    """Mark the first ``train`` share of each series ``train``, the rest ``test``."""
    keys = list(keys)
    group = keys or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(0))
    sizes = df.groupBy(*[col(k) for k in group]).agg(F.count(F.lit(1)).alias("__n"))
    numbered = join_lookup(row_numbers(df, group, order_by, "__rn"), sizes, group, null_safe=True)
    first = F.col("__rn") <= F.floor(F.col("__n") * F.lit(train))
    return numbered.withColumn("split", F.when(first, "train").otherwise("test")).drop("__rn", "__n", "__all")
