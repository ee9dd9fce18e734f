"""Imputation, capping, scaling columns, coercion and ordered cleaning plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import clip, col, numeric_columns, safe_divide, string_columns
from .aggregate import mode_values
from .lookup import join_lookup
from .ordered import row_numbers
from .profile import column_profile, iqr_bounds
from .quantiles import median_by, quantiles


def _fill(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    fills = {c: v for c, v in fills.items() if v is not None}
    return df.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()}) if fills else df


def fill_missing(df: DataFrame, drop_above: float = 0.5, centre: str = "median") -> DataFrame:
    """Drop columns missing more than ``drop_above``; fill numbers with the median (or mean), text with the mode."""
    aggs = [F.avg(col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    share = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(df.columns)}
    out = df.drop(*[c for c in df.columns if share[c] > drop_above])
    gaps = [c for c in out.columns if share[c] > 0]
    numeric = [c for c in gaps if c in numeric_columns(out)]
    if centre == "median":
        fills: dict[str, object] = {c: q[0.5] for c, q in quantiles(out, numeric, [0.5]).items()}
    else:
        fills = out.agg(*[F.avg(col(c)).alias(c) for c in numeric]).first().asDict() if numeric else {}
    text = [c for c in gaps if c in string_columns(out)]
    return _fill(out, fills | mode_values(out, text))


def cap_outliers(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(df, columns or numeric_columns(df), k)
    return df.withColumns({c: clip(col(c).cast("double"), float(lo), float(hi)) for c, (lo, hi) in bounds.items()})


def add_normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """``c_normalized`` in 0..1; constant columns are skipped."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(col(c)).alias(f"a{i}"), F.max(col(c)).alias(f"z{i}"))]).first()
    made = {}
    for i, c in enumerate(columns):
        low, high = row[f"a{i}"], row[f"z{i}"]
        if low is not None and high > low:
            made[f"{c}_normalized"] = (col(c) - F.lit(float(low))) / F.lit(float(high - low))
    return df.withColumns(made) if made else df


def add_standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """``c_standardized`` by mean and sample deviation; zero deviation is skipped."""
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_samp(col(c)).alias(f"s{i}"))]).first()
    made = {f"{c}_standardized": (col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"]) for i, c in enumerate(columns) if row[f"s{i}"]}
    return df.withColumns(made) if made else df


def encode_small(df: DataFrame, columns: list[str] | None = None, max_values: int = 10) -> DataFrame:
    """``c_encoded`` 0..k-1 in sorted order for text columns with at most ``max_values`` values; NULL stays NULL."""
    columns = columns or string_columns(df)
    made = {}
    for c in columns:
        values = [r[0] for r in df.select(col(c)).filter(col(c).isNotNull()).distinct().limit(max_values + 1).collect()]
        if 0 < len(values) <= max_values:
            code = F.lit(None).cast("int")
            for i, v in enumerate(sorted(values)):
                code = F.when(col(c) == v, F.lit(i)).otherwise(code)
            made[f"{c}_encoded"] = code
    return df.withColumns(made) if made else df


STEPS = {
    "missing": lambda df, a: fill_missing(df, **a),
    "duplicates": lambda df, a: df.dropDuplicates(),
    "outliers": lambda df, a: cap_outliers(df, **a),
    "normalize": lambda df, a: add_normalised(df, a.get("columns") or numeric_columns(df)),
    "standardize": lambda df, a: add_standardised(df, a.get("columns") or numeric_columns(df)),
    "encode": lambda df, a: encode_small(df, **a),
}


def clean(df: DataFrame, operations: list[str | tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """Apply steps in order, refitting statistics after each; returns (table, step log)."""
    log, out = [], df
    for position, operation in enumerate(operations):
        name, args = (operation, {}) if isinstance(operation, str) else operation
        before = set(out.columns)
        out = STEPS[name](out, args)
        log.append((position, name, sorted(set(out.columns) - before), sorted(before - set(out.columns))))
    schema = "position int, operation string, added array<string>, removed array<string>"
    return out, df.sparkSession.createDataFrame(log, schema)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): 0-based sorted codes of the distinct non-null values."""
    values = df.select(col(column)).filter(col(column).isNotNull()).distinct()
    return row_numbers(values, [], [column], "code").withColumn("code", F.col("code") - 1)


def coerce_numeric(df: DataFrame, columns: list[str] | None = None, accept: float = 0.3) -> DataFrame:
    """Text to numbers: strip other characters if more than ``accept`` of the rows then parse (rest 0), else label codes."""
    columns = columns or string_columns(df)
    number = {c: F.regexp_replace(col(c), r"[^\d.\-]", "").try_cast("double") for c in columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(number[c]).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    out = df
    for i, c in enumerate(columns):
        if row[f"p{i}"] > row["n"] * accept:
            out = out.withColumn(c, F.coalesce(number[c], F.lit(0.0)))
        else:
            filled = out.withColumn(c, F.coalesce(col(c), F.lit("missing")))
            codes = label_codes(filled, c)
            out = join_lookup(filled, codes, [c]).withColumn(c, F.col("code")).drop("code")
    return out.select(*[col(c) for c in df.columns])


def fill_all(df: DataFrame) -> DataFrame:
    """Numbers to their median (0 without one), then infinities to 0; no NULL numbers remain."""
    numeric = numeric_columns(df)
    finite = df.withColumns({c: F.when(F.abs(col(c).cast("double")) != F.lit(float("inf")), col(c)) for c in numeric})
    medians = quantiles(finite, numeric, [0.5])
    made: dict[str, Column] = {}
    for c in numeric:
        value = col(c).cast("double")
        filled = F.coalesce(value, F.lit(float(medians[c][0.5] or 0.0)))
        made[c] = F.when(F.abs(filled) == F.lit(float("inf")), F.lit(0.0)).otherwise(filled)
    return df.withColumns(made)


def resolve_target(df: DataFrame, target: str) -> str:
    """Column named like the target: first that equals it ignoring case or contains it, else the last column."""
    wanted = target.lower().strip()
    for c in df.columns:
        if c.lower().strip() == wanted or target.lower() in c.lower():
            return c
    return df.columns[-1]


def prepare_target(df: DataFrame, target: str) -> DataFrame:
    """Fill the target with mode (text) or median (number); text becomes sorted label codes."""
    c = resolve_target(df, target)
    if c in string_columns(df):
        filled = _fill(df, mode_values(df, [c]))
        return join_lookup(filled, label_codes(filled, c), [c]).withColumn(c, F.col("code")).drop("code")
    return _fill(df.withColumn(c, col(c).cast("double")), {c: quantiles(df, [c], [0.5])[c][0.5]})


def impute_by_hierarchy(df: DataFrame, column: str, keys: list[str], name: str | None = None) -> DataFrame:
    """Mean of the full key group, else of the first key, else of the table."""
    name, value = name or column, col(column).cast("double")
    by_all = df.groupBy(*[col(k) for k in keys]).agg(F.avg(value).alias("__m_all"))
    by_first = df.groupBy(col(keys[0])).agg(F.avg(value).alias("__m_first"))
    overall = df.agg(F.avg(value).alias("m")).first()["m"]
    out = join_lookup(join_lookup(df, by_all, keys), by_first, keys[:1])
    filled = F.coalesce(value, F.col("__m_all"), F.col("__m_first"), F.lit(overall).cast("double"))
    return out.withColumn(name, filled).drop("__m_all", "__m_first")


def impute_by_group_median(df: DataFrame, column: str, key: str) -> DataFrame:
    """Median of the row's group, else of the table; a NULL group takes the table median."""
    medians = median_by(df.filter(col(key).isNotNull()), [key], column, "__m")
    overall = quantiles(df, [column], [0.5])[column][0.5]
    out = join_lookup(df, medians, [key])
    filled = F.coalesce(col(column).cast("double"), F.col("__m"), F.lit(overall).cast("double"))
    return out.withColumn(column, filled).drop("__m")
