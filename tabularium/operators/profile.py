"""Column and table profiles: every figure comes from fused aggregations over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import col, date_columns, numeric_columns, sample_kurtosis, sample_skew, string_columns, wide_to_long
from .aggregate import duplicate_count
from .quantiles import quantiles

CURRENCY = "[$€£¥,]"
AGGREGATES_PER_PASS = 200


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole.cast("double")), F.lit(0.0)), 2)


def fused(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """One aggregation; very wide requests are cut into several passes joined as single rows."""
    if len(aggs) <= AGGREGATES_PER_PASS:
        return df.agg(*aggs)
    rows = [df.agg(*aggs[i : i + AGGREGATES_PER_PASS]).first().asDict() for i in range(0, len(aggs), AGGREGATES_PER_PASS)]
    merged = {k: v for r in rows for k, v in r.items()}
    schema = df.limit(0).agg(*aggs).schema
    return df.sparkSession.createDataFrame([tuple(merged[f.name] for f in schema.fields)], schema)


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, missing cells and type-family counts."""
    cells = len(df.columns)
    filled = sum((F.count(col(c)) for c in df.columns), F.lit(0))
    base = df.agg(F.count(F.lit(1)).alias("rows"), filled.alias("__filled"))
    dup = duplicate_count(df).select("duplicates")
    both = base.withColumn("__k", F.lit(1)).join(F.broadcast(dup.withColumn("__k", F.lit(1))), "__k")
    missing = F.col("rows") * cells - F.col("__filled")
    return both.select(
        "rows",
        F.lit(cells).cast("bigint").alias("columns"),
        "duplicates",
        percent(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"),
        missing.alias("missing"),
        percent(missing, F.col("rows") * cells).alias("missing_pct"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(string_columns(df))).cast("bigint").alias("text_columns"),
        F.lit(len(date_columns(df))).cast("bigint").alias("date_columns"),
    )


def family(df: DataFrame, column: str) -> str:
    if column in numeric_columns(df):
        return "numeric"
    if column in string_columns(df):
        return "text"
    return "date" if column in date_columns(df) else df.schema[column].dataType.simpleString()


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, type, family, rows, missing, missing_pct, unique, unique_pct); ``exact=False`` sketches the distinct counts."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(col(c)).alias(f"n{i}"), distinct(col(c)).alias(f"d{i}")]
    blocks = {
        f.name: {
            "type": F.lit(f.dataType.simpleString()),
            "family": F.lit(family(df, f.name)),
            "rows": F.col("rows"),
            "missing": F.col("rows") - F.col(f"n{i}"),
            "missing_pct": percent(F.col("rows") - F.col(f"n{i}"), F.col("rows")),
            "unique": F.col(f"d{i}"),
            "unique_pct": percent(F.col(f"d{i}"), F.col("rows")),
        }
        for i, f in enumerate(df.schema.fields)
    }
    return wide_to_long(fused(df, aggs), blocks)


def normality_p(n: Column, g1: Column, g2: Column) -> Column:
    """p-value of the skewness-kurtosis omnibus test from n and the population moments (chi-square, two degrees)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    bottom = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(bottom) * F.cbrt((1 - 2 / a) / F.abs(bottom))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 20, F.exp(-(z1 * z1 + z2 * z2) / 2))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Location, spread, shape, zero and negative counts, percentiles and a normality flag per numeric column."""
    columns = columns or numeric_columns(df)
    probs = [0.25, 0.5, 0.75, 0.95, 0.99]
    q = quantiles(df, columns, probs)
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.avg(v).alias(f"avg{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            sample_skew(v).alias(f"sk{i}"),
            sample_kurtosis(v).alias(f"ku{i}"),
            F.skewness(v).alias(f"g1{i}"),
            F.kurtosis(v).alias(f"g2{i}"),
            F.count_if(v == 0).alias(f"z{i}"),
            F.count_if(v < 0).alias(f"neg{i}"),
        ]
    blocks = {}
    for i, c in enumerate(columns):
        fields = {
            "count": F.col(f"n{i}"),
            "min": F.col(f"min{i}"),
            "max": F.col(f"max{i}"),
            "mean": F.col(f"avg{i}"),
            "std": F.col(f"std{i}"),
            "skewness": F.col(f"sk{i}"),
            "kurtosis": F.col(f"ku{i}"),
            "zeros": F.col(f"z{i}"),
            "zeros_pct": percent(F.col(f"z{i}"), F.col(f"n{i}")),
            "negatives": F.col(f"neg{i}"),
        }
        fields |= {f"p{round(p * 100)}": F.lit(q[c][p]).cast("double") for p in probs}
        fields |= {"__g1": F.col(f"g1{i}"), "__g2": F.col(f"g2{i}")}
        blocks[c] = fields
    long = wide_to_long(fused(df, aggs), blocks)
    long = long.withColumn("normal_p", normality_p(F.col("count").cast("double"), F.col("__g1"), F.col("__g2")))
    return long.withColumn("is_normal", F.col("normal_p") > 0.05).drop("__g1", "__g2")


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) text pairs of the non-null values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


def value_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, unique, cardinality, imbalance_ratio, imbalanced) per text column."""
    counts = value_frequency(df, columns or string_columns(df))
    stats = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.max("count").alias("__hi"), F.min("count").alias("__lo"))
    ratio = F.when(F.col("unique") >= 2, F.col("__hi").cast("double") / F.col("__lo"))
    band = F.when(F.col("unique") <= 10, "low").when(F.col("unique") <= 50, "medium").otherwise("high")
    return stats.select(
        "column",
        "unique",
        band.alias("cardinality"),
        F.round(ratio, 2).alias("imbalance_ratio"),
        F.coalesce(ratio > 10, F.lit(False)).alias("imbalanced"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """(column, rank, value, count): most frequent values of each text column."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = value_frequency(df, columns or string_columns(df)).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def semantic_types(df: DataFrame, binary_first: bool = False) -> DataFrame:
    """(column, semantic_type) from distinct counts and the share of values matching each form, over all rows.

    With ``binary_first`` two-valued numbers are called binary; by default ten or fewer values always mean
    categorical_numeric.
    """
    numeric, text = numeric_columns(df), string_columns(df)
    parsed = {"numeric_string": lambda v: F.regexp_replace(v, CURRENCY, "").try_cast("double"), "datetime_string": lambda v: F.try_to_timestamp(v)}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = col(c)
        if c in text:
            # a form all values must have is ruled out by one that has not; a failed parse costs far more than a passed one
            ends = [(form(F.min(v)).isNotNull() & form(F.max(v)).isNotNull()).alias(f"{kind}{i}") for kind, form in parsed.items()]
            aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(r"@.*\.")).alias(f"mail{i}"), F.count_if(v.rlike("http|www")).alias(f"url{i}"), *ends]
    seen, kinds = df.agg(*aggs).first(), {}
    asked = [(i, c, kind) for i, c in enumerate(df.columns) if c in text for kind in parsed if seen[f"{kind}{i}"]]
    all_of = df.agg(*[F.count(parsed[kind](col(c))).alias(f"{kind}{i}") for i, c, kind in asked]).first().asDict() if asked else {}
    for i, f in enumerate(df.schema.fields):
        if f.name in text:
            n = seen[f"n{i}"]
            forms = {kind: n == 0 or all_of.get(f"{kind}{i}") == n for kind in parsed} | {"email": seen[f"mail{i}"] > n * 0.5, "url": seen[f"url{i}"] > n * 0.5}
            kinds[f.name] = next((kind for kind, found in forms.items() if found), None)
        else:
            kinds[f.name] = None if f.name in numeric else f.dataType.simpleString()
    # values are counted only where a form has not decided, each column by itself: counted together, every row goes through once a column with all of them
    counts = [df.agg(F.lit(c).alias("column"), F.count_distinct(col(c)).alias("d")) for c, kind in kinds.items() if kind is None]
    found = {r["column"]: r["d"] for r in reduce(DataFrame.unionAll, counts).collect()} if counts else {}
    for i, c in enumerate(df.columns):
        if c in found and c in text:
            kinds[c] = "id" if found[c] == seen[f"n{i}"] else "categorical"
        elif c in found:
            few = "binary" if binary_first and found[c] == 2 else "categorical_numeric"
            kinds[c] = few if found[c] <= 10 else "id" if found[c] == seen["rows"] else "numeric"
    return df.sparkSession.createDataFrame(list(kinds.items()), "column string, semantic_type string")


# fixed values: column names never given a role
OUTCOME_NAMES = ["survived", "target", "label"]


def semantic_roles(df: DataFrame) -> DataFrame:
    """(column, role): ID, NUMERIC, GROUP_ID, CATEGORY or TEXT."""
    table = column_profile(df.drop(*[c for c in df.columns if c.lower() in OUTCOME_NAMES]))
    u, n = F.col("unique"), F.col("rows")
    repeats = F.try_divide(n.cast("double"), u)
    role = (
        F.when(u == n, "ID")
        .when((F.col("family") == "numeric") & (u > n * 0.95), "ID")
        .when(F.col("family") == "numeric", "NUMERIC")
        .when((F.col("family") == "text") & (u > 50) & (repeats > 1.1), "GROUP_ID")
        .when((F.col("family") == "text") & (u < 50), "CATEGORY")
        .when(F.col("family") == "text", "TEXT")
    )
    return table.select("column", role.alias("role")).filter(F.col("role").isNotNull())


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    q = quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        low, high = q[c][0.25], q[c][0.75]
        if low is not None:
            out[c] = (low - k * (high - low), high + k * (high - low))
    return out


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """(column, lower_bound, upper_bound, outliers, outlier_pct, warn) for columns with at least four values."""
    columns = columns or numeric_columns(df)
    bounds = iqr_bounds(df, columns, k)
    columns = [c for c in columns if c in bounds]
    aggs = []
    for i, c in enumerate(columns):
        low, high = bounds[c]
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count_if((col(c) < F.lit(low)) | (col(c) > F.lit(high))).alias(f"o{i}")]
    blocks = {
        c: {
            "lower_bound": F.lit(float(bounds[c][0])),
            "upper_bound": F.lit(float(bounds[c][1])),
            "outliers": F.col(f"o{i}"),
            "outlier_pct": percent(F.col(f"o{i}"), F.col(f"n{i}")),
            "warn": F.coalesce(F.try_divide(F.col(f"o{i}") * 100.0, F.col(f"n{i}")) > 5, F.lit(False)),
            "__n": F.col(f"n{i}"),
        }
        for i, c in enumerate(columns)
    }
    return wide_to_long(df.agg(*aggs), blocks).filter("__n >= 4").drop("__n")


def z_outliers(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0, min_distinct: int = 10) -> DataFrame:
    """(column, outliers): values beyond ``threshold`` sample deviations, columns with more than ten values only."""
    columns = columns or numeric_columns(df)
    aggs = [x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_samp(col(c)).alias(f"s{i}"), F.count_distinct(col(c)).alias(f"d{i}"))]
    fit = df.agg(*aggs).first()
    kept = {c: (fit[f"m{i}"], fit[f"s{i}"]) for i, c in enumerate(columns) if fit[f"d{i}"] > min_distinct and fit[f"s{i}"]}
    aggs = [F.count_if(F.abs((col(c) - F.lit(m)) / F.lit(s)) > threshold).alias(f"o{i}") for i, (c, (m, s)) in enumerate(kept.items())]
    return wide_to_long(df.agg(*aggs), {c: {"outliers": F.col(f"o{i}")} for i, c in enumerate(kept)})


def flag_outliers(df: DataFrame, columns: list[str], method: str = "iqr", k: float | None = None, name: str = "is_outlier") -> DataFrame:
    """Row flag: any column outside k*IQR, or beyond k population deviations."""
    if method == "iqr":
        bounds = iqr_bounds(df, columns, 1.5 if k is None else k)
        tests = [(col(c) < F.lit(lo)) | (col(c) > F.lit(hi)) for c, (lo, hi) in bounds.items()]
    else:
        fit = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]).first()
        tests = [
            F.abs(col(c) - F.lit(fit[f"m{i}"])) / F.lit(fit[f"s{i}"]) > (3.0 if k is None else k)
            for i, c in enumerate(columns)
            if fit[f"s{i}"]
        ]
    flag = F.lit(False)
    for test in tests:
        flag = flag | F.coalesce(test, F.lit(False))
    return df.withColumn(name, flag)


def quality_summary(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness and the lists of constant, high-cardinality and id columns."""
    table = column_profile(df)
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("column"))))
    lists = table.agg(
        F.round((1 - F.sum("missing") / F.sum("rows").cast("double")) * 100, 2).alias("completeness"),
        names(F.col("unique") <= 1).alias("constant_columns"),
        names((F.col("family") == "text") & (F.col("unique") > 50)).alias("high_cardinality"),
        names(F.col("unique") == F.col("rows")).alias("id_columns"),
    )
    dup = duplicate_count(df).select(F.round(F.lit(100.0) - F.col("duplicate_pct"), 2).alias("uniqueness"))
    return lists.withColumn("__k", F.lit(1)).join(F.broadcast(dup.withColumn("__k", F.lit(1))), "__k").drop("__k")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """(problem_type, classes, missing, imbalance_ratio, imbalanced) of an outcome column."""
    counts = df.groupBy(col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    some = F.col("v").isNotNull()
    row = counts.agg(
        F.count_if(some).alias("classes"),
        F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("missing"),
        F.max(F.when(some, F.col("n"))).alias("hi"),
        F.min(F.when(some, F.col("n"))).alias("lo"),
    )
    text = F.lit(target in string_columns(df))
    kind = F.when(text | (F.col("classes") <= 20), "classification").otherwise("regression")
    ratio = F.when((kind == "classification") & (F.col("classes") >= 2), F.round(F.col("hi").cast("double") / F.col("lo"), 2))
    return row.select(kind.alias("problem_type"), "classes", "missing", ratio.alias("imbalance_ratio"), F.coalesce(ratio > 3, F.lit(False)).alias("imbalanced"))
