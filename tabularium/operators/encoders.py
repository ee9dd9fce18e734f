"""Categorical encodings and scalers: fit is one aggregation, transform an expression or a lookup join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import col
from .cleaning import label_codes
from .lookup import join_lookup
from .quantiles import quantiles
from .windows import category_codes


def _category_name(c: str, v: object) -> str:
    return f"{c}_{v}"


def one_hot(df: DataFrame, column: str, max_values: int = 20, null_indicator: bool = True, drop_first: bool = False, values: list | None = None) -> DataFrame:
    """0/1 column per category (sorted); above ``max_values`` categories the table is returned unchanged."""
    if values is None:
        found = df.select(col(column)).filter(col(column).isNotNull()).distinct().limit(max_values + 1).collect()
        if len(found) > max_values:
            return df
        values = sorted(r[0] for r in found)
    values = values[1:] if drop_first else values
    made = {_category_name(column, v): F.coalesce(col(column) == v, F.lit(False)).cast("int") for v in values}
    if null_indicator:
        made[f"{column}_nan"] = col(column).isNull().cast("int")
    return df.withColumns(made)


class LabelEncoder:
    """Sorted 0-based codes; NULL and unseen values become -1."""

    def __init__(self, column: str):
        self.column = column
        self.table: DataFrame | None = None

    def fit(self, df: DataFrame) -> "LabelEncoder":
        self.table = label_codes(df, self.column)
        return self

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = name or f"{self.column}_code"
        out = join_lookup(df, self.table.withColumnRenamed("code", name), [self.column])
        return out.withColumn(name, F.coalesce(col(name), F.lit(-1)))

    def inverse(self, df: DataFrame, code: str, name: str) -> DataFrame:
        back = self.table.select(F.col("code").alias(code), col(self.column).alias(name))
        return join_lookup(df, back, [code])


def frequency_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Share of the rows holding the same value."""
    total = df.count()
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("__n"))
    name = name or f"{column}_freq"
    return join_lookup(df, counts, [column]).withColumn(name, F.col("__n") / F.lit(float(total))).drop("__n")


def count_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Number of rows holding the same value; NULL stays NULL."""
    name = name or f"{column}_count"
    counts = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias(name))
    return join_lookup(df, counts, [column])


class TargetEncoder:
    """(n*mean + s*global) / (n + s); unseen and NULL categories get the global mean."""

    def __init__(self, column: str, target: str, smoothing: float = 1.0):
        self.column, self.target, self.smoothing = column, target, smoothing

    def fit(self, df: DataFrame) -> "TargetEncoder":
        y = col(self.target).cast("double")
        self.overall = df.agg(F.avg(y).alias("m")).first()["m"]
        stats = df.filter(col(self.column).isNotNull()).groupBy(col(self.column)).agg(F.count(y).alias("__n"), F.sum(y).alias("__s"))
        weight = F.lit(float(self.smoothing))
        value = (F.col("__s") + weight * F.lit(self.overall)) / (F.col("__n") + weight)
        self.table = stats.select(col(self.column), value.alias("__te"))
        return self

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        out = join_lookup(df, self.table, [self.column])
        return out.withColumn(name or f"{self.column}_target", F.coalesce("__te", F.lit(self.overall))).drop("__te")


def m_estimate_encode(df: DataFrame, column: str, target: str, m: float = 10.0) -> DataFrame:
    return TargetEncoder(column, target, m).fit(df).transform(df, f"{column}_m_estimate")


def group_rate(train: DataFrame, df: DataFrame, column: str, target: str, name: str = "group_rate") -> DataFrame:
    """Outcome rate of the training group; singletons and unknown groups give -1."""
    stats = train.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.avg(col(target).cast("double")).alias("__r"), F.count(F.lit(1)).alias("__n"))
    out = join_lookup(df, stats.filter("__n > 1").drop("__n"), [column])
    return out.withColumn(name, F.coalesce("__r", F.lit(-1.0))).drop("__r")


def leave_one_out(train: DataFrame, df: DataFrame | None, column: str, target: str, name: str = "loo_rate") -> DataFrame:
    """Training rows: group rate without the row itself, singletons take the global mean; other rows: full group rate."""
    y = col(target).cast("double")
    overall = F.lit(train.agg(F.avg(y).alias("m")).first()["m"])
    stats = train.groupBy(col(column)).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    if df is None:
        out = join_lookup(train, stats, [column], null_safe=True)
        own = (F.col("__s") - y) / (F.col("__n") - 1)
        value = F.when(F.col("__n") > 1, own).otherwise(overall)
    else:
        out = join_lookup(df, stats, [column], null_safe=True)
        value = F.coalesce(F.try_divide("__s", F.col("__n")), overall)
    return out.withColumn(name, value).drop("__s", "__n")


def cross_codes(df: DataFrame, columns: list[str], name: str = "cross_code") -> DataFrame:
    """Joined categories ``a_b`` as sorted codes; a NULL part counts as the text ``nan``."""
    joined = F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in columns])
    out = df.withColumn("__cross", joined)
    return join_lookup(out, category_codes(out, ["__cross"], name), ["__cross"]).drop("__cross")


def cross_candidates(df: DataFrame, columns: list[str], below: int = 10, limit: int | None = None) -> list[str]:
    row = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"d{i}"] < below][:limit]


@dataclass
class Scaler:
    """Affine scaling fitted by one aggregation; a zero scale acts as one."""

    columns: list[str]
    method: str = "standard"
    feature_range: tuple[float, float] = (0.0, 1.0)

    def fit(self, df: DataFrame) -> "Scaler":
        self.shift, self.scale = {}, {}
        if self.method == "robust":
            for c, q in quantiles(df, self.columns, [0.25, 0.5, 0.75]).items():
                self.shift[c], self.scale[c] = q[0.5], (q[0.75] - q[0.25]) or 1.0
            return self
        aggs = []
        for i, c in enumerate(self.columns):
            v = col(c).cast("double")
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(self.columns):
            if self.method == "standard":
                self.shift[c], self.scale[c] = row[f"m{i}"], row[f"s{i}"] or 1.0
            else:
                low, high = self.feature_range
                self.scale[c] = ((row[f"z{i}"] - row[f"a{i}"]) or 1.0) / (high - low)
                self.shift[c] = row[f"a{i}"] - low * self.scale[c]
        return self

    def _map(self, df: DataFrame, make) -> DataFrame:
        return df.withColumns({c: make(col(c).cast("double"), F.lit(self.shift[c]), F.lit(self.scale[c])) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda v, shift, scale: (v - shift) / scale)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda v, shift, scale: v * scale + shift)
