"""Numeric, date, text and interaction features as column expressions fitted by one aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import array_sum, col, date_columns, interval_index, numeric_columns, row_mean, safe_divide, string_columns
from .quantiles import quantiles


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    aggs = [x for i, c in enumerate(columns) for x in (F.min(col(c)).cast("double").alias(f"a{i}"), F.max(col(c)).cast("double").alias(f"z{i}"))]
    row = df.agg(*aggs).first()
    return {c: (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(columns) if row[f"a{i}"] is not None}


def numeric_transforms(df: DataFrame, columns: list[str]) -> DataFrame:
    """log and reciprocal (all > 0), log1p and sqrt (all >= 0), chosen by the column minimum."""
    made: dict[str, Column] = {}
    for c, (low, _) in _ranges(df, columns).items():
        v = col(c).cast("double")
        if low > 0:
            made |= {f"{c}_log": F.ln(v), f"{c}_reciprocal": 1 / v}
        if low >= 0:
            made |= {f"{c}_log1p": F.log1p(v), f"{c}_sqrt": F.sqrt(v)}
    return df.withColumns(made) if made else df


def math_features(df: DataFrame, columns: list[str] | None = None, first: int | None = None, squared_below: float = 1e6) -> DataFrame:
    """log1p (all > 0), sqrt (all >= 0) and square (max below a bound) of the numeric columns, or the ``first`` of them."""
    columns = (columns or numeric_columns(df))[:first]
    made: dict[str, Column] = {}
    for c, (low, high) in _ranges(df, columns).items():
        v = col(c).cast("double")
        if low > 0:
            made[f"{c}_log"] = F.log1p(v)
        if low >= 0:
            made[f"{c}_sqrt"] = F.sqrt(v)
        if high < squared_below:
            made[f"{c}_squared"] = v * v
    return df.withColumns(made) if made else df


def quantile_bins(df: DataFrame, column: str, q: int = 5, name: str | None = None) -> DataFrame:
    """0-based quantile bin: exact edges, right-closed, lowest included, repeated edges merged."""
    edges = quantiles(df, [column], [i / q for i in range(q + 1)])[column]
    points = sorted({v for v in edges.values() if v is not None})
    return df.withColumn(name or f"{column}_bin", interval_index(col(column).cast("double"), points))


def width_edges(low: float, high: float, bins: int) -> list[float]:
    """Equal-width edges, the lowest moved down by 0.1 % of the range."""
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - margin, high + margin
        return [low + (high - low) * i / bins for i in range(bins + 1)]
    edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    edges[0] = low - (high - low) * 0.001
    return edges


def width_bins(df: DataFrame, column: str, bins: int = 5, name: str | None = None) -> DataFrame:
    found = _ranges(df, [column])
    edges = width_edges(*found[column], bins) if found else []
    return df.withColumn(name or f"{column}_cut", interval_index(col(column).cast("double"), edges, include_lowest=False))


def cut(df: DataFrame, column: str, edges: list[float], labels: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Fixed right-closed bins; values outside are NULL."""
    index = interval_index(col(column).cast("double"), [float(e) for e in edges], include_lowest=False)
    value = F.get(F.array(*[F.lit(x) for x in labels]), index) if labels else index
    return df.withColumn(name or f"{column}_cut", value)


def row_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row-wise sum, mean, sample std, min, max and range over the non-null values."""
    values = F.filter(F.array(*[col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    n, mean = F.size(values).cast("double"), row_mean(columns)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
    return df.withColumns(
        {
            "row_sum": array_sum(values),
            "row_mean": mean,
            "row_std": F.when(n > 1, F.sqrt(squares / (n - 1))),
            "row_min": F.array_min(values),
            "row_max": F.array_max(values),
            "row_range": F.array_max(values) - F.array_min(values),
        }
    )


def date_parts(df: DataFrame, column: str, cyclic: bool = False) -> DataFrame:
    """Calendar parts (Monday is 0, ISO weeks); ``cyclic`` adds sine and cosine of month, hour and day."""
    c = col(column)
    made = {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.day(c),
        "dayofweek": F.weekday(c),
        "hour": F.hour(c),
        "minute": F.minute(c),
        "quarter": F.quarter(c),
        "dayofyear": F.dayofyear(c),
        "weekofyear": F.weekofyear(c),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
        "is_month_start": (F.day(c) == 1).cast("int"),
        "is_month_end": (F.to_date(c) == F.last_day(c)).cast("int"),
    }
    if cyclic:
        for part, period in (("month", 12), ("hour", 24), ("day", 31)):
            angle = made[part].cast("double") * F.lit(2 * 3.141592653589793 / period)
            made |= {f"{part}_sin": F.sin(angle), f"{part}_cos": F.cos(angle)}
    return df.withColumns({f"{column}_{n}": v for n, v in made.items()})


def parse_dates(df: DataFrame, columns: list[str] | None = None, accept: float = 0.5) -> DataFrame:
    """Text columns of which more than ``accept`` of the values parse become timestamps."""
    columns = columns or string_columns(df)
    parsed = {c: F.try_to_timestamp(col(c)) for c in columns}
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(col(c)).alias(f"n{i}"), F.count(parsed[c]).alias(f"p{i}"))]).first()
    hit = {c: parsed[c].cast("timestamp_ntz") for i, c in enumerate(columns) if row[f"n{i}"] and row[f"p{i}"] / row[f"n{i}"] > accept}
    return df.withColumns(hit) if hit else df


def days_since(df: DataFrame, column: str, as_of: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"days_since_{column}", F.datediff(F.lit(as_of).cast("date"), col(column)))


def text_features(df: DataFrame, column: str) -> DataFrame:
    """Length, whitespace-separated word count and digit flag."""
    trimmed = F.trim(F.regexp_replace(col(column), r"\s+", " "))
    words = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))
    return df.withColumns(
        {
            f"{column}_length": F.length(col(column)),
            f"{column}_word_count": F.when(col(column).isNotNull(), words),
            f"{column}_has_digit": col(column).rlike(r"\d").cast("int"),
        }
    )


def interactions(df: DataFrame, columns: list[str], operations: list[str] = ("multiply", "add", "subtract", "divide"), first: int | None = None, zero: float | None = None) -> DataFrame:
    """Pairwise features of the columns, or the ``first`` of them; division by zero gives ``zero`` (NULL by default)."""
    made: dict[str, Column] = {}
    for a, b in combinations(columns[:first], 2):
        x, y = col(a).cast("double"), col(b).cast("double")
        if "multiply" in operations:
            made[f"{a}_x_{b}"] = x * y
        if "add" in operations:
            made[f"{a}_plus_{b}"] = x + y
        if "subtract" in operations:
            made[f"{a}_minus_{b}"] = x - y
        if "divide" in operations:
            made[f"{a}_div_{b}"] = safe_divide(a, b, zero)
    return df.withColumns(made) if made else df


def ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{a}_ratio_{b}": safe_divide(a, b, 0.0) for a, b in combinations(columns, 2)})


def polynomial(df: DataFrame, columns: list[str], interaction_only: bool = False) -> DataFrame:
    """Degree-2 terms: squares (unless interaction only) and cross products."""
    made: dict[str, Column] = {}
    if not interaction_only:
        made |= {f"{c}_pow2": col(c).cast("double") * col(c).cast("double") for c in columns}
    made |= {f"{a}_x_{b}": col(a).cast("double") * col(b).cast("double") for a, b in combinations(columns, 2)}
    return df.withColumns(made)


def derive(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Declared columns (name, SQL expression), later rules may use earlier ones."""
    for name, text in rules:
        df = df.withColumn(name, F.expr(text))
    return df


def log_target(df: DataFrame, target: str, name: str = "log_target") -> DataFrame:
    return df.withColumn(name, F.ln(col(target)))


def back_transform(df: DataFrame, prediction: str) -> DataFrame:
    return df.withColumn(prediction, F.exp(col(prediction)))


def entity_features(df: DataFrame, name_column: str, title_pattern: str, count_columns: list[str], code_column: str, maps: dict[str, dict]) -> DataFrame:
    """Title by pattern, group size and alone flag from counts, name length, code letter, and value maps."""
    found = F.regexp_extract(col(name_column), title_pattern, 1)
    size = F.lit(1)
    for c in count_columns:
        size = size + F.coalesce(col(c), F.lit(0))
    made = {
        "title": F.when(found != "", found),
        "group_size": size,
        "is_alone": (size == 1).cast("int"),
        "name_length": F.length(col(name_column)),
        "code_letter": F.substring(col(code_column), 1, 1),
    }
    for c, mapping in maps.items():
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        made[f"{c}_mapped"] = F.try_element_at(F.create_map(*pairs), col(c))
    return df.withColumns(made)


def top_variance(df: DataFrame, keep: list[str] = (), limit: int | None = None) -> DataFrame:
    """Keep the ``limit`` numeric columns of largest sample variance (and every non-numeric or listed column)."""
    candidates = [c for c in numeric_columns(df) if c not in keep]
    if limit is None or len(candidates) <= limit:
        return df
    row = df.agg(*[F.var_samp(col(c)).alias(f"v{i}") for i, c in enumerate(candidates)]).first()
    ranked = sorted(range(len(candidates)), key=lambda i: (-(row[f"v{i}"] or 0.0), i))[:limit]
    best = {candidates[i] for i in ranked}
    return df.select(*[col(c) for c in df.columns if c not in candidates or c in best])


def auto_generate(df: DataFrame, target: str | None = None, max_features: int | None = None, with_interactions: bool = True, with_polynomials: bool = True) -> DataFrame:
    """Numeric transforms, category codes, date parts, products and squares, then the variance limit."""
    from .encoders import frequency_encode

    base = [c for c in df.columns if c != target]
    numeric = [c for c in numeric_columns(df) if c in base]
    out = numeric_transforms(df, numeric)
    for c in [c for c in string_columns(df) if c in base]:
        out = frequency_encode(out, c)
    for c in [c for c in date_columns(df) if c in base]:
        out = date_parts(out, c, cyclic=True)
    if with_interactions and len(numeric) >= 2:
        out = interactions(out, numeric, ["multiply"])
    if with_polynomials and numeric:
        out = out.withColumns({f"{c}_pow2": col(c).cast("double") * col(c).cast("double") for c in numeric})
    return top_variance(out, keep=[target] if target else [], limit=max_features)
