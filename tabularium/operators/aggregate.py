"""Global and grouped aggregation, value counts, correlation, distribution and trend summaries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues
from ..functions.guarded import col, corr, numeric_columns, sample_kurtosis, sample_skew, wide_to_long
from .concordance import kendall
from .lookup import join_lookup
from .ordered import Ordered, row_numbers, running_totals
from .quantiles import quantile_table, quantiles

SIMPLE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}


def _expressions(spec: dict[str, str | list[str]], order_by: list[str] | None) -> list[Column]:
    out = []
    for c, names in spec.items():
        for name in [names] if isinstance(names, str) else names:
            if name in ("first", "last"):
                if not order_by:
                    raise ValueError(f"{name} needs order_by")
                order = F.struct(*[col(o) for o in order_by])
                pick = F.min_by if name == "first" else F.max_by
                value = pick(col(c), F.when(col(c).isNotNull(), order))
            else:
                value = SIMPLE[name](col(c))
            out.append(value.alias(f"{c}_{name}"))
    return out


def aggregate(df: DataFrame, spec: dict[str, str | list[str]], order_by: list[str] | None = None) -> DataFrame:
    """One row of ``column_function`` aggregates."""
    return df.agg(*_expressions(spec, order_by))


class GroupBy:
    """Grouped frame: ``GroupBy(df, keys).agg({...})``; rows with a NULL key are dropped by default."""

    def __init__(self, df: DataFrame, keys: list[str], keep_null_keys: bool = False):
        self.keys = list(keys)
        self.df = df if keep_null_keys else df.na.drop(subset=self.keys)

    def agg(self, spec: dict[str, str | list[str]], order_by: list[str] | None = None) -> DataFrame:
        return self.df.groupBy(*[col(k) for k in self.keys]).agg(*_expressions(spec, order_by))

    def _each(self, name: str, columns: list[str], order_by: list[str] | None = None) -> DataFrame:
        made = _expressions({c: name for c in columns}, order_by)
        return self.df.groupBy(*[col(k) for k in self.keys]).agg(*[e.alias(c) for e, c in zip(made, columns)])

    def sum(self, *columns: str) -> DataFrame:
        return self._each("sum", list(columns))

    def mean(self, *columns: str) -> DataFrame:
        return self._each("mean", list(columns))

    def count(self) -> DataFrame:
        return self.df.groupBy(*[col(k) for k in self.keys]).agg(F.count(F.lit(1)).alias("count"))

    def first(self, *columns: str, order_by: list[str]) -> DataFrame:
        return self._each("first", list(columns), order_by)

    def last(self, *columns: str, order_by: list[str]) -> DataFrame:
        return self._each("last", list(columns), order_by)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) per numeric column."""
    columns = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    blocks = {
        c: {
            "count": F.col(f"n{i}"),
            "mean": F.col(f"m{i}"),
            "std": F.col(f"s{i}"),
            "min": F.col(f"a{i}"),
            "p25": F.lit(q[c][0.25]).cast("double"),
            "p50": F.lit(q[c][0.5]).cast("double"),
            "p75": F.lit(q[c][0.75]).cast("double"),
            "max": F.col(f"z{i}"),
        }
        for i, c in enumerate(columns)
    }
    return wide_to_long(df.agg(*aggs), blocks)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, type, rows, missing) for every column in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    blocks = {
        f.name: {"type": F.lit(f.dataType.simpleString()), "rows": F.col("rows"), "missing": F.col("rows") - F.col(f"n{i}")}
        for i, f in enumerate(df.schema.fields)
    }
    return wide_to_long(row, blocks)


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, count, share) of non-null values, most frequent first."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(col(column)).alias("n")).first()["n"]
    out = counts.withColumn("share", F.try_divide(F.col("count").cast("double"), F.lit(float(total)))).orderBy(F.desc("count"), "value")
    return out.limit(k) if k else out


def top_by_sum(df: DataFrame, category: str, value: str, n: int) -> DataFrame:
    return df.groupBy(col(category)).agg(F.sum(col(value)).alias("total")).orderBy(F.desc("total"), col(category)).limit(n)


def kpi_row(df: DataFrame, condition: Column, total: str, average: str, distinct: str) -> DataFrame:
    """Headline figures on the filtered rows and the difference to all rows, from one scan."""
    hit = F.coalesce(condition, F.lit(False))
    pick = lambda c: F.when(hit, col(c))
    return df.agg(
        F.count_if(hit).alias("records"),
        (F.count_if(hit) - F.count(F.lit(1))).alias("records_delta"),
        F.sum(pick(total)).alias("total"),
        (F.sum(pick(total)) - F.sum(col(total))).alias("total_delta"),
        F.avg(pick(average)).alias("average"),
        (F.avg(pick(average)) - F.avg(col(average))).alias("average_delta"),
        F.count_distinct(pick(distinct)).alias("distinct_values"),
    )


def flows(df: DataFrame, source: str, target: str, value: str, n: int = 50) -> DataFrame:
    """Largest source-to-target totals."""
    grouped = df.groupBy(col(source).alias("source"), col(target).alias("target")).agg(F.sum(col(value)).alias("value"))
    return grouped.orderBy(F.desc("value"), "source", "target").limit(n)


def hierarchy_totals(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Totals of every prefix of the path; ``depth`` counts the columns present (0 is the grand total)."""
    depth = len(path) - reduce(lambda a, b: a + b, [F.grouping(col(c)).cast("int") for c in path])
    return df.rollup(*[col(c) for c in path]).agg(F.sum(col(value)).alias("total"), depth.alias("depth"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count) of equal-width bins, empty bins included, last bin closed."""
    edges = df.agg(F.min(col(column)).cast("double").alias("lo"), F.max(col(column)).cast("double").alias("hi")).first()
    low, high = edges["lo"], edges["hi"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    index = F.least(F.floor((col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(col(column).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
    )


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode, count): most frequent value as text, smallest value on ties.

    Value counts are pre-aggregated, so neither a frequent value nor a high-cardinality column fills one buffer.
    """
    frames = []
    for c in columns:
        counts = df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min_by(F.struct("v", "n"), F.struct(-F.col("n"), F.col("v"))).alias("b"))
        frames.append(best.select(F.lit(c).alias("column"), F.col("b.v").cast("string").alias("mode"), F.col("b.n").alias("count")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def mode_values(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Typed mode of each column as a scalar."""
    out = {}
    for c in columns:
        counts = df.filter(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        out[c] = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("b")).first()["b"]
    return out


def measures(
    df: DataFrame,
    keys: list[str],
    distinct: dict[str, str] | None = None,
    averages: dict[str, str] | None = None,
    variances: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Report measures per group: row count plus named distinct counts, means, population variances and sums."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    aggs += [F.count_distinct(col(c)).alias(n) for n, c in (distinct or {}).items()]
    aggs += [F.avg(col(c)).alias(n) for n, c in (averages or {}).items()]
    aggs += [F.var_pop(col(c)).alias(n) for n, c in (variances or {}).items()]
    aggs += [F.sum(col(c)).alias(n) for n, c in (totals or {}).items()]
    return df.groupBy(*[col(k) for k in keys]).agg(*aggs)


def group_transform(df: DataFrame, category: str, value: str) -> DataFrame:
    """Group mean, std, count and deviation on every row; group statistics are pre-aggregated and joined back."""
    stats = df.groupBy(col(category)).agg(
        F.avg(col(value)).alias(f"{value}_group_mean"),
        F.stddev_samp(col(value)).alias(f"{value}_group_std"),
        F.count(col(value)).alias(f"{value}_group_count"),
    )
    out = join_lookup(df, stats, [category], null_safe=True)
    return out.withColumn(f"{value}_group_deviation", col(value) - col(f"{value}_group_mean"))


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(col1, col2, r) for every pair of columns, one aggregation."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if method == "spearman":
        return reduce(lambda a, b: a.unionByName(b), [_spearman(df, a, b) for a, b in pairs])
    if method == "kendall":
        return df.sparkSession.createDataFrame([(a, b, kendall(df, a, b)) for a, b in pairs], "col1 string, col2 string, r double")
    row = df.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*entries)))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank): average rank of each distinct value, from value counts and running totals."""
    counts = df.filter(col(value).isNotNull()).groupBy(col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ends = running_totals(counts, [], ["__v"], {"__end": F.col("__n")})
    return ends.select(F.col("__v"), (F.col("__end") - (F.col("__n") - 1) / 2.0).alias("__rank"))


def _spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(col(a).alias("__a"), col(b).alias("__b")).na.drop()
    cells = both.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__w"))
    ra = average_ranks(both, "__a").select(F.col("__v").alias("__a"), F.col("__rank").alias("__ra"))
    rb = average_ranks(both, "__b").select(F.col("__v").alias("__b"), F.col("__rank").alias("__rb"))
    ranked = cells.join(ra, "__a").join(rb, "__b")
    w, x, y = F.col("__w"), F.col("__ra"), F.col("__rb")
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    mean = F.try_divide(sx, n)
    cov = F.sum(w * x * y) - sx * sy / n
    spread = F.sqrt((F.sum(w * x * x) - sx * mean) * (F.sum(w * y * y) - sy * F.try_divide(sy, n)))
    return ranked.agg(F.try_divide(cov, spread).alias("r")).select(F.lit(a).alias("col1"), F.lit(b).alias("col2"), "r")


def strong_pairs(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7, very_strong: float = 0.8) -> DataFrame:
    table = correlations(df, columns).filter(F.abs("r") >= threshold)
    strength = F.when(F.abs("r") > very_strong, F.lit("very strong")).otherwise(F.lit("strong"))
    return table.withColumn("strength", strength)


def target_correlations(df: DataFrame, target: str, columns: list[str] | None = None, leakage: float = 0.9) -> DataFrame:
    """(column, r, leakage) ranked by |r|."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    row = df.agg(*[corr(c, target).alias(f"r{i}") for i, c in enumerate(columns)])
    out = wide_to_long(row, {c: {"r": F.col(f"r{i}")} for i, c in enumerate(columns)})
    return out.withColumn("leakage", F.abs("r") > leakage).orderBy(F.abs("r").desc_nulls_last(), "column")


def percentiles(df: DataFrame, columns: list[str], probs: list[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return quantile_table(df, [], columns, list(probs))


def shape_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [x for i, c in enumerate(columns) for x in (sample_skew(c).alias(f"s{i}"), sample_kurtosis(c).alias(f"k{i}"))]
    return wide_to_long(df.agg(*aggs), {c: {"skewness": F.col(f"s{i}"), "kurtosis": F.col(f"k{i}")} for i, c in enumerate(columns)})


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, duplicates, duplicate_pct): rows beyond the first of each identical group."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    out = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("duplicate_pct", F.coalesce(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), F.lit(0.0)))


def year_to_date(df: DataFrame, date: str, value: str) -> DataFrame:
    """Daily totals with the running total of the year; one row per day goes through the window."""
    daily = df.groupBy(F.to_date(col(date)).alias("date")).agg(F.sum(col(value)).alias("total")).withColumn("year", F.year("date"))
    return running_totals(daily, ["year"], ["date"], {"ytd": F.col("total")})


def linear_trend(df: DataFrame, order_by: list[str], value: str, min_points: int = 10) -> DataFrame:
    """(n, slope, r, p_value, direction, significant) of the value against its 0-based position."""
    numbered = row_numbers(df.filter(col(value).isNotNull()), [], order_by, "__rn")
    x = (F.col("__rn") - 1).cast("double")
    row = numbered.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(col(value), x).alias("slope"), corr(x, value).alias("r")).first()
    n, slope, r = row["n"], row["slope"], row["r"]
    enough = n > min_points and r is not None
    p = None
    if enough:
        rest = 1 - r * r
        p = 0.0 if rest <= 0 else pvalues.student_t_two_sided(r * ((n - 2) / rest) ** 0.5, n - 2)
    direction = None if not enough else "increasing" if slope > 0 else "decreasing"
    rows = [(n, slope, abs(r) if r is not None else None, p, direction, bool(enough and p < 0.05))]
    return df.sparkSession.createDataFrame(rows, "n bigint, slope double, strength double, p_value double, direction string, significant boolean")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(col(y), col(x)).alias("slope"), F.regr_intercept(col(y), col(x)).alias("intercept"), F.regr_r2(col(y), col(x)).alias("r2"))


def quota_usage(logs: DataFrame, plans: DataFrame, user: str, ts: str, limit: str) -> DataFrame:
    """Daily actions per user against the plan limit of that user."""
    daily = logs.groupBy(col(user), F.to_date(col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return daily.join(plans, user).withColumn("allowed", F.col("used") < col(limit))


def recent_count(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(col(ts) >= start).agg(F.count(F.lit(1)).alias("recent"))


def purge_before(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    return df.filter(col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def calendar_means(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean by weekday (Monday is 0) and by month."""
    units = F.array(F.struct(F.lit("weekday").alias("unit"), F.weekday(col(ts)).alias("at")), F.struct(F.lit("month").alias("unit"), F.month(col(ts)).alias("at")))
    return df.select(F.inline(units), col(value).alias("__v")).groupBy("unit", "at").agg(F.avg("__v").alias("mean"))


def target_by_category(df: DataFrame, category: str, target: str) -> DataFrame:
    return df.groupBy(col(category)).agg(F.avg(col(target)).alias("mean")).orderBy(F.desc("mean"), col(category))


def rounded_stats(df: DataFrame, keys: list[str], spec: dict[str, list[str]], digits: int = 2) -> DataFrame:
    names = [f"{c}_{n}" for c, ns in spec.items() for n in ns]
    out = GroupBy(df, keys).agg(spec)
    return out.withColumns({n: F.round(col(n), digits) for n in names if not n.endswith("_count")})


def weighted_vector_mean(df: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """(keys, position, mean): element-wise mean of vectors weighted by sample counts."""
    long = df.select(*[col(k) for k in keys], col(weight).alias("__w"), F.posexplode(col(vector)).alias("position", "__v"))
    total = F.sum(F.col("__v").cast("double") * F.col("__w"))
    return long.groupBy(*[col(k) for k in keys], "position").agg(F.try_divide(total, F.sum("__w").cast("double")).alias("mean"))


def monotonic_columns(df: DataFrame, columns: list[str], order_by: list[str]) -> DataFrame:
    """(column, increasing, decreasing) along the order."""
    from pyspark.sql import functions as fn

    steps = Ordered(df, [], order_by).bounded(1, 0, lambda w: {f"__d{i}": fn.lag(col(c)).over(w) for i, c in enumerate(columns)})
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.coalesce(F.bool_and(col(c) >= F.col(f"__d{i}")), F.lit(True)).alias(f"u{i}"), F.coalesce(F.bool_and(col(c) <= F.col(f"__d{i}")), F.lit(True)).alias(f"w{i}")]
    blocks = {c: {"increasing": F.col(f"u{i}"), "decreasing": F.col(f"w{i}")} for i, c in enumerate(columns)}
    return wide_to_long(steps.agg(*aggs), blocks)
