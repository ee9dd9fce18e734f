"""Column expressions that keep NULL, zero and ANSI-mode edge cases safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATES)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, the missing-value rule of the whole library."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def safe_divide(a, b, default: float | None = None) -> Column:
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(c, low, high) -> Column:
    """Clip that keeps NULL (least/greatest skip NULLs)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def corr(x, y) -> Column:
    """Pearson r over complete pairs; NULL on a constant side instead of an ANSI error."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def sample_skew(c) -> Column:
    """Bias-corrected skewness G1 (NULL below three values or on a constant)."""
    c = col(c).cast("double")
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (NULL below four values or on a constant)."""
    c = col(c).cast("double")
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def interval_index(c, edges: list[float], include_lowest: bool = True) -> Column:
    """0-based index of the right-closed interval (edges[i], edges[i+1]]; NULL outside."""
    c = col(c)
    if len(edges) < 2:
        return F.lit(None).cast("int")
    first = c >= F.lit(edges[0]) if include_lowest else c > F.lit(edges[0])
    out = F.when(first & (c <= F.lit(edges[1])), F.lit(0))
    for i in range(1, len(edges) - 1):
        out = out.when((c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1])), F.lit(i))
    return out


def row_mean(cols: list[str]) -> Column:
    values = F.filter(F.array(*[col(c).cast("double") for c in cols]), lambda v: v.isNotNull())
    return F.try_divide(array_sum(values), F.size(values).cast("double"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def wide_to_long(row: DataFrame, blocks: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One wide aggregate row -> one row per block, each with the same named fields."""
    structs = [
        F.struct(F.lit(name).alias(key), *[value.alias(field) for field, value in fields.items()])
        for name, fields in blocks.items()
    ]
    return row.select(F.inline(F.array(*structs)))
