"""Projection, filtering, row and column surgery, joins and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guarded import all_of, col, numeric_columns, safe_divide
from .lookup import join_lookup
from .ordered import Ordered

CAST_ALIASES = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in columns])


def where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Filter by SQL text or Column."""
    return df.filter(F.expr(condition) if isinstance(condition, str) else condition)


def where_rows(df: DataFrame, predicate: Callable, columns: list[str]) -> DataFrame:
    """Filter by a Python predicate over pandas Series; batches stay in the tasks that read them."""
    keep = F.pandas_udf(predicate, T.BooleanType())
    return df.filter(keep(*[col(c) for c in columns]))


def facet_filter(df: DataFrame, facets: dict[str, list]) -> DataFrame:
    """Conjunction of IN lists; an empty list means no restriction."""
    return df.filter(all_of([col(c).isin(values) for c, values in facets.items() if values]))


def facet_values(df: DataFrame, max_columns: int | None = None, max_values: int = 20) -> DataFrame:
    """(column, value) choices offered for filtering: the low-cardinality string columns, or the first of them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    distinct = df.select(*[F.approx_count_distinct(col(c)).alias(c) for c in names]).first() if names else {}
    chosen = [c for c in names if distinct[c] <= max_values * 2]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in chosen])))
    pairs = long.filter(F.col("value").isNotNull()).distinct()
    counts = {r["column"]: r["n"] for r in pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [c for c in chosen if counts.get(c, 0) <= max_values][:max_columns]
    return pairs.filter(F.col("column").isin(kept))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def astype(df: DataFrame, types: dict[str, str], coerce: bool = False) -> DataFrame:
    """Cast columns; ``coerce`` turns unparsable values into NULL instead of failing."""
    named = {c: CAST_ALIASES.get(t, t) for c, t in types.items()}
    return df.withColumns({c: col(c).try_cast(t) if coerce else col(c).cast(t) for c, t in named.items()})


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[col(c).asc() for c in order_by]).limit(n)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[col(c).desc() for c in order_by]).limit(n)


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, reproducible for a key and seed on any cluster layout."""
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    return df.withColumn("__r", rank).orderBy("__r").limit(n).drop("__r")


def keyed_uniform(seed: int | str, keys: list[str | Column]) -> Column:
    """A number in [0, 1) that depends on the seed and the key values only, not on partitions or retries."""
    parts = [F.coalesce((col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Each row with probability ``fraction``, drawn by its key (all columns unless given)."""
    return df.filter(keyed_uniform(seed, key or df.columns) < fraction)


def dropna(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.na.drop(how=how, subset=subset)


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows that are all NULL, then columns that are all NULL."""
    rows = df.na.drop(how="all")
    filled = rows.agg(*[F.count(col(c)).alias(c) for c in df.columns]).first()
    return rows.drop(*[c for c in df.columns if filled[c] == 0])


def fillna(df: DataFrame, value, subset: list[str] | None = None) -> DataFrame:
    return df.na.fill(value) if isinstance(value, dict) else df.na.fill(value, subset=subset)


def fill_direction(df: DataFrame, columns: list[str], order_by: list[str], keys: list[str] = (), method: str = "forward") -> DataFrame:
    """Carry the last (forward) or next (backward) non-null value along the order."""
    ordered = Ordered(df, list(keys), order_by)
    values = {f"__f_{c}": col(c) for c in columns}
    filled = ordered.running(ffill=values) if method == "forward" else ordered.running(bfill=values)
    return filled.withColumns({c: col(f"__f_{c}") for c in columns}).drop(*values)


def sort(df: DataFrame, by: list[str], descending: bool | list[bool] = False) -> DataFrame:
    flags = descending if isinstance(descending, list) else [descending] * len(by)
    return df.orderBy(*[col(c).desc_nulls_last() if d else col(c).asc_nulls_last() for c, d in zip(by, flags)])


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).distinct()


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_duplicates_by(df: DataFrame, keys: list[str], order_by: list[str], keep: str = "first") -> DataFrame:
    """One row per key: partial aggregation keeps a hot key from landing in one task."""
    order = F.struct(*[col(c) for c in order_by])
    whole = F.struct(*[col(c) for c in df.columns])
    pick = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(whole, order).alias("__row"))
    return kept.select("__row.*")


def nlargest(df: DataFrame, n: int, column: str, tiebreak: list[str], largest: bool = True) -> DataFrame:
    first = col(column).desc_nulls_last() if largest else col(column).asc_nulls_last()
    return df.orderBy(first, *[col(c) for c in tiebreak]).limit(n)


INTEGER_RANGES = [("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1)]


def narrow_types(df: DataFrame) -> DataFrame:
    """Downcast integers to the narrowest type that holds the observed range, doubles to float."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType))]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    casts = {c: col(c).cast("float") for c in floats}
    if ints:
        aggs = [f(col(c)).alias(f"{n}_{i}") for i, c in enumerate(ints) for n, f in (("lo", F.min), ("hi", F.max))]
        seen = df.agg(*aggs).first()
        for i, c in enumerate(ints):
            low, high = seen[f"lo_{i}"], seen[f"hi_{i}"]
            fits = [t for t, a, b in INTEGER_RANGES if low is not None and a <= low and high <= b]
            if fits:
                casts[c] = col(c).cast(fits[0])
    return df.withColumns(casts) if casts else df


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested struct fields become top-level columns joined by the separator."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
        return out

    return df.select(
        *[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, ())]
    )


def unflatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Inverse of ``flatten``: columns sharing a prefix are gathered into a struct."""

    def gather(items: list[tuple[list[str], str]]) -> list[Column]:
        groups: dict[str, list[tuple[list[str], str]]] = {}
        for path, source in items:
            groups.setdefault(path[0], []).append((path[1:], source))
        return [
            col(members[0][1]).alias(name) if not members[0][0] else F.struct(*gather(members)).alias(name)
            for name, members in groups.items()
        ]

    return df.select(*gather([(c.split(separator), c) for c in df.columns]))


def with_safe_division(df: DataFrame, name: str, numerator: str, denominator: str, default: float = 0.0) -> DataFrame:
    return df.withColumn(name, safe_divide(numerator, denominator, default))


def merge(
    left: DataFrame,
    right: DataFrame,
    on: list[str] | None = None,
    how: str = "inner",
    left_on: list[str] | None = None,
    right_on: list[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join; clashing non-key columns get suffixes. Strategy and skew handling are left to AQE."""
    how = {"outer": "full", "semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if how == "cross":
        return cross(left, right)
    lkeys, rkeys = (on, on) if on else (left_on, right_on)
    if how not in ("left_semi", "left_anti"):
        clash = (set(left.columns) & set(right.columns)) - (set(on or []))
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
        lkeys = [k + suffixes[0] if k in clash else k for k in lkeys]
        rkeys = [k + suffixes[1] if k in clash else k for k in rkeys]
    if on and not null_safe:
        return left.join(right, on, how)
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in rkeys})
    same = [(left[a].eqNullSafe(right[f"__r_{b}"]) if null_safe else left[a] == right[f"__r_{b}"]) for a, b in zip(lkeys, rkeys)]
    out = left.join(right, all_of(same), how)
    if how in ("left_semi", "left_anti"):
        return out
    if on:
        out = out.withColumns({k: F.coalesce(col(k), F.col(f"__r_{k}")) for k in on})
        return out.drop(*[f"__r_{k}" for k in on])
    return out.withColumnsRenamed({f"__r_{k}": k for k in rkeys})


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row, planned by Spark; the size of the product is the caller's choice."""
    return left.crossJoin(right)


def lookup_map(df: DataFrame, table: DataFrame, key: str, value: str, name: str, default=None) -> DataFrame:
    """Map a column through a (key, value) table, unmatched rows take the default."""
    renamed = table.select(col(key).alias(key), col(value).alias(name))
    out = join_lookup(df, renamed, [key])
    return out if default is None else out.withColumn(name, F.coalesce(col(name), F.lit(default)))


def concat(dfs: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns a table lacks become NULL."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def concat_columns(dfs: list[DataFrame], key: list[str]) -> DataFrame:
    """Side-by-side concatenation aligned on an explicit row key."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.join(df, key, "full")
    return out


def in_small_groups(df: DataFrame, keys: list[str], below: int, name: str = "in_small_group") -> DataFrame:
    """Flag rows whose key group has fewer than ``below`` rows (group counts are pre-aggregated)."""
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__size"))
    out = join_lookup(df, sizes, keys, null_safe=True)
    return out.withColumn(name, F.col("__size") < below).drop("__size")
