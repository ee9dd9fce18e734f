"""Quality scores, issue and insight rules, validation and approval gates over profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guarded import col, corr, date_columns, numeric_columns, string_columns, wide_to_long
from . import profile as P
from .aggregate import correlations, duplicate_count, mode_values
from .quantiles import quantiles
from .windows import monotonic_columns, sequential_ids

ISSUE_FIELDS = ("type", "column", "severity", "value")


def _rules(table: DataFrame, rules: list[tuple[Column, str, Column, str, Column]]) -> DataFrame:
    """One output row per profile row and rule that holds."""
    structs = [
        F.when(
            condition,
            F.struct(F.lit(kind).alias("type"), name.alias("column"), F.lit(severity).alias("severity"), value.cast("double").alias("value")),
        )
        for condition, kind, name, severity, value in rules
    ]
    hits = table.select(F.explode(F.array(*structs)).alias("i")).filter(F.col("i").isNotNull())
    return hits.select("i.*")


def _one_row(df: DataFrame, values: tuple, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([values], schema)


def quality_score(df: DataFrame) -> DataFrame:
    """(missing_pct, duplicate_pct, warnings, score): 100 less weighted missing, duplicate and warning counts, in 0..100."""
    over = P.overview(df).first()
    text, numeric = string_columns(df), numeric_columns(df)
    warnings = P.categorical_profile(df, text).filter("imbalanced").count() if text else 0
    warnings += 1 if P.column_profile(df).filter("unique <= 1").limit(1).count() else 0
    if len(numeric) >= 2:
        warnings += 1 if correlations(df, numeric).filter("abs(r) > 0.8").limit(1).count() else 0
    if numeric:
        warnings += P.iqr_outliers(df, numeric).filter("warn").count()
    score = 100 - over["missing_pct"] * 0.5 - over["duplicate_pct"] * 0.3 - warnings * 2
    values = (over["missing_pct"], over["duplicate_pct"], warnings, max(0.0, min(100.0, round(score, 1))))
    return _one_row(df, values, "missing_pct double, duplicate_pct double, warnings bigint, score double")


def _full_profile(df: DataFrame) -> DataFrame:
    """Column profile with outlier share and skewness of the numeric columns."""
    table, numeric = P.column_profile(df), numeric_columns(df)
    if not numeric:
        return table.withColumns({"outlier_pct": F.lit(None).cast("double"), "skewness": F.lit(None).cast("double")})
    from .aggregate import shape_statistics

    out = P.iqr_outliers(df, numeric).select("column", "outlier_pct")
    shape = shape_statistics(df, numeric).select("column", "skewness")
    # all three tables hold one row per column of the input
    return table.join(F.broadcast(out), "column", "left").join(F.broadcast(shape), "column", "left")


def issues(df: DataFrame, critical: float = 30.0, warning: float = 5.0) -> DataFrame:
    """(type, column, severity, value) of every issue found."""
    table, c = _full_profile(df), F.col("column")
    miss = F.col("missing_pct")
    found = _rules(
        table,
        [
            (miss >= critical, "critical_missing", c, "critical", miss),
            ((miss >= warning) & (miss < critical), "warning_missing", c, "warning", miss),
            (F.col("outlier_pct") > 5, "outliers", c, "warning", F.col("outlier_pct")),
            ((F.col("family") == "text") & (F.col("unique_pct") > 90), "high_cardinality", c, "info", F.col("unique")),
            (F.col("unique") <= 1, "constant_column", c, "warning", F.col("unique")),
            (F.abs("skewness") > 2, "high_skewness", c, "info", F.round("skewness", 4)),
        ],
    )
    none = F.lit(None).cast("string")
    dup = _rules(duplicate_count(df), [(F.col("duplicates") > 0, "duplicates", none, "warning", F.col("duplicates"))])
    return found.unionByName(dup)


def recommendations(df: DataFrame) -> DataFrame:
    """(topic, items, value) of each recommendation that applies; ``good_quality`` when none does."""
    table = _full_profile(df)
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("column"))))
    row = table.agg(
        names(F.col("missing_pct") > 30).alias("missing"),
        names(F.abs("skewness") > 2).alias("skewed"),
        names(F.col("outlier_pct") > 0).alias("outliers"),
    ).first()
    numeric = numeric_columns(df)
    pairs = correlations(df, numeric).filter("abs(r) > 0.8").count() if len(numeric) > 1 else 0
    dup = duplicate_count(df).first()
    rows = []
    if row["missing"]:
        rows.append(("high_missing", row["missing"], float(len(row["missing"]))))
    if dup["duplicate_pct"] > 5:
        rows.append(("duplicates", [], float(dup["duplicates"])))
    if pairs:
        rows.append(("correlated", [], float(pairs)))
    if row["outliers"]:
        rows.append(("outliers", row["outliers"], float(len(row["outliers"]))))
    if row["skewed"]:
        rows.append(("skewed", row["skewed"], float(len(row["skewed"]))))
    return df.sparkSession.createDataFrame(rows or [("good_quality", [], 0.0)], "topic string, items array<string>, value double")


SEVERITY_ORDER = {"critical": 0, "warning": 1, "success": 2, "info": 3}


def insights(df: DataFrame, skew_columns: int | None = None) -> DataFrame:
    """(category, column, severity, value, rank) ranked by severity."""
    over = P.overview(df)
    missing = F.try_divide(F.col("missing") * 100.0, F.col("rows") * F.col("columns"))
    dup = F.try_divide(F.col("duplicates") * 100.0, F.col("rows"))
    none = F.lit(None).cast("string")
    found = _rules(
        over,
        [
            (missing > 10, "high_missing", none, "warning", missing),
            (missing < 1, "excellent_completeness", none, "success", missing),
            (dup > 5, "duplicates", none, "warning", dup),
        ],
    )
    numeric = numeric_columns(df)
    if numeric:
        from .aggregate import shape_statistics

        shape = shape_statistics(df, numeric[:skew_columns])
        found = found.unionByName(_rules(shape, [(F.abs("skewness") > 2, "skewed", F.col("column"), "info", F.col("skewness"))]))
    if len(numeric) > 1:
        pair = F.concat_ws("~", "col1", "col2")
        found = found.unionByName(_rules(correlations(df, numeric), [(F.abs("r") > 0.8, "correlation", pair, "info", F.col("r"))]))
    dated = date_like_columns(df).filter("is_date").agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(_rules(dated, [(F.col("n") > 0, "time_series", none, "info", F.col("n"))]))
    rank = F.lit(4)
    for name, position in SEVERITY_ORDER.items():
        rank = F.when(F.col("severity") == name, position).otherwise(rank)
    return found.withColumn("rank", rank).orderBy("rank", "type", "column")


# fixed values: column-name parts the domain rules look for
PAY_NAMES = ["salary", "comp", "pay"]
REVENUE_NAMES = ["revenue", "sales", "amount"]


def domain_insights(df: DataFrame, domain: str) -> DataFrame:
    """(category, column, value): pay spread above 30 % (hr), revenue totals (retail, finance)."""
    numeric = numeric_columns(df)
    hit = lambda parts: [c for c in numeric if any(p in c.lower() for p in parts)]
    if domain == "hr":
        blocks = {}
        for c in hit(PAY_NAMES):
            cv = F.when(F.avg(col(c)) > 0, F.stddev_samp(col(c)) / F.avg(col(c)) * 100).otherwise(F.lit(0.0))
            blocks[c] = {"category": F.lit("hr_compensation"), "value": cv}
        keep = F.col("value") > 30
    elif domain in ("retail", "finance"):
        blocks = {c: {"category": F.lit("finance_summary"), "value": F.sum(col(c)).cast("double")} for c in hit(REVENUE_NAMES)}
        keep = F.lit(True)
    else:
        blocks, keep = {}, F.lit(True)
    if not blocks:
        return df.sparkSession.createDataFrame([], "column string, category string, value double")
    aggs = [v["value"].alias(f"v{i}") for i, v in enumerate(blocks.values())]
    named = {c: {"category": b["category"], "value": F.col(f"v{i}")} for i, (c, b) in enumerate(blocks.items())}
    return wide_to_long(df.agg(*aggs), named).filter(keep)


def date_like_columns(df: DataFrame, share: float = 1.0) -> DataFrame:
    """(column, date_share, is_date): date types, and text whose values parse as timestamps."""
    text, dates = string_columns(df), date_columns(df)
    aggs = [F.avg(F.when(col(c).isNotNull(), F.try_to_timestamp(col(c)).isNotNull().cast("double"))).alias(f"s{i}") for i, c in enumerate(text)]
    aggs += [F.lit(1.0).alias(f"d{i}") for i, _ in enumerate(dates)]
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, date_share double, is_date boolean")
    blocks = {c: {"date_share": F.col(f"s{i}")} for i, c in enumerate(text)} | {c: {"date_share": F.col(f"d{i}")} for i, c in enumerate(dates)}
    table = wide_to_long(df.agg(*aggs), blocks)
    return table.withColumn("is_date", F.coalesce(F.col("date_share") >= share, F.lit(False)))


DTYPE_GROUPS = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "str": (T.StringType,),
    "bool": (T.BooleanType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def validate_columns(df: DataFrame, required: list[str] = (), optional: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    """(rule, column) violations of the column lists; with ``optional`` given, unknown columns are violations too."""
    have = set(df.columns)
    rows = [("missing_required", c) for c in required if c not in have]
    rows += [("forbidden_present", c) for c in forbidden if c in have]
    if optional:
        rows += [("unexpected", c) for c in df.columns if c not in {*required, *optional, *forbidden}]
    return df.sparkSession.createDataFrame(rows, "rule string, column string")


def validate_dataframe(
    df: DataFrame,
    required: list[str] = (),
    min_rows: int | None = None,
    max_rows: int | None = None,
    dtypes: dict[str, str] | None = None,
) -> DataFrame:
    """(rule, column) violations of required columns, row bounds and type groups."""
    rows = [("missing_required", c) for c in required if c not in df.columns]
    for c, group in (dtypes or {}).items():
        if c in df.columns and not isinstance(df.schema[c].dataType, DTYPE_GROUPS[group]):
            rows.append(("wrong_type", c))
    if min_rows is not None or max_rows is not None:
        n = df.count()
        if min_rows is not None and n < min_rows:
            rows.append(("too_few_rows", None))
        if max_rows is not None and n > max_rows:
            rows.append(("too_many_rows", None))
    return df.sparkSession.createDataFrame(rows, "rule string, column string")


def require_not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def missing_above(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(column, missing_ratio) of columns whose NULL share exceeds the threshold."""
    row = df.agg(*[F.avg(col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return wide_to_long(row, {c: {"missing_ratio": F.col(f"m{i}")} for i, c in enumerate(df.columns)}).filter(F.col("missing_ratio") > threshold)


def batch_gate(df: DataFrame, min_rows: int = 1000) -> DataFrame:
    """(check, passed): no NULLs, enough rows, no duplicates."""
    over = P.overview(df)
    checks = {"no_missing": F.col("missing") == 0, "enough_rows": F.col("rows") >= min_rows, "no_duplicates": F.col("duplicates") == 0}
    return wide_to_long(over, {n: {"passed": c} for n, c in checks.items()}, key="check")


# fixed values: limits of the approval gates
GATE_LIMITS = {
    "min_rows": 100,
    "min_rows_per_feature": 5,
    "max_target_unique_ratio": 0.95,
    "max_missing": 0.30,
    "max_correlation": 0.95,
    "max_id_columns": 2,
}


def _verdict(hard: int, concerns: int, reject_at: int, confidence) -> tuple[str, float]:
    if hard:
        return "rejected", 0.0
    if concerns >= reject_at:
        return "rejected", confidence("rejected")
    return "approved", max(0.0, confidence("approved"))


def problem_gate(df: DataFrame, target: str) -> DataFrame:
    """First gate: (rule, value, limit, failed, hard, status, confidence) for size, width and target rules."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(target)).alias("u")).first()
    n, unique, features = row["n"], row["u"], len(df.columns) - 1
    top = 0.0
    if n and (target in string_columns(df) or unique <= 10):
        counts = df.filter(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("c"))
        share = counts.agg((F.max("c") / F.sum("c")).alias("s")).first()["s"]
        top = share or 0.0
    rules = [
        ("min_rows", float(n), float(GATE_LIMITS["min_rows"]), n < GATE_LIMITS["min_rows"], True),
        ("rows_per_feature", n / max(features, 1), float(GATE_LIMITS["min_rows_per_feature"]), n / max(features, 1) < GATE_LIMITS["min_rows_per_feature"], True),
        ("target_unique_ratio", unique / n if n else 0.0, GATE_LIMITS["max_target_unique_ratio"], bool(n) and unique / n > GATE_LIMITS["max_target_unique_ratio"], True),
        ("majority_share", top, 0.9, top > 0.9, False),
    ]
    failed = [r for r in rules if r[3]]
    score = lambda kind: 0.3 if kind == "rejected" else 0.8 - 0.15 * len(failed)
    status, confidence = _verdict(sum(r[4] for r in failed), len(failed), 2, score)
    return df.sparkSession.createDataFrame(
        [(*r, status, round(confidence, 2)) for r in rules],
        "rule string, value double, limit double, failed boolean, hard boolean, status string, confidence double",
    )


def data_gate(df: DataFrame, target: str, order_by: list[str]) -> DataFrame:
    """Second gate: missing share, leakage, id columns, duplicates and constants."""
    numeric = [c for c in numeric_columns(df) if c != target]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.avg(col(c).isNull().cast("double")).alias(f"m{i}"), F.count_distinct(col(c)).alias(f"d{i}")]
    target_number = col(target).try_cast("double") if target in string_columns(df) else col(target).cast("double")
    aggs += [corr(col(c), target_number).alias(f"r{i}") for i, c in enumerate(numeric)]
    row = df.agg(*aggs).first()
    missing = sum((row[f"m{i}"] or 0.0) > GATE_LIMITS["max_missing"] for i in range(len(df.columns)))
    leaks = sum(abs(row[f"r{i}"] or 0.0) > GATE_LIMITS["max_correlation"] for i in range(len(numeric)))
    unique = [c for i, c in enumerate(df.columns) if row[f"d{i}"] == row["n"] and c in numeric_columns(df)]
    ids = monotonic_columns(df, unique, order_by).filter("increasing OR decreasing").count() if unique else 0
    dup = duplicate_count(df).first()["duplicate_pct"] / 100
    constants = sum(row[f"d{i}"] <= 1 for i in range(len(df.columns)))
    rules = [
        ("missing_columns", float(missing), 0.0, missing > 0, True),
        ("leaking_columns", float(leaks), 0.0, leaks > 0, True),
        ("id_columns", float(ids), float(GATE_LIMITS["max_id_columns"]), ids > GATE_LIMITS["max_id_columns"], True),
        ("duplicate_share", dup, 0.05, dup > 0.05, False),
        ("constant_columns", float(constants), 0.0, constants > 0, False),
    ]
    concerns = (missing > 0) + leaks + ids + (dup > 0.05) + (constants > 0) + (ids > GATE_LIMITS["max_id_columns"])
    score = lambda kind: 0.2 if kind == "rejected" else (0.85 if concerns == 0 else 0.6 - 0.15 * concerns)
    status, confidence = _verdict(sum(r[3] and r[4] for r in rules), concerns, 3, score)
    return df.sparkSession.createDataFrame(
        [(*r, status, round(confidence, 2)) for r in rules],
        "rule string, value double, limit double, failed boolean, hard boolean, status string, confidence double",
    )


def strategy(df: DataFrame, target: str) -> DataFrame:
    """(rows, features, problem_type, size_band, validation, high_dimensional, concerns, status, confidence)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col(target)).alias("u")).first()
    n, features = row["n"], len(df.columns) - 1
    kind = "classification" if target in string_columns(df) or row["u"] <= 20 else "regression"
    band = "small" if n < 1000 else "medium" if n < 10000 else "large"
    validation = "10-fold" if n < 500 else "5-fold" if n < 5000 else "70/15/15 split"
    wide = features > n / 10
    concerns = (n < 1000) + (n < 500) + wide
    status, confidence = ("rejected", 0.3) if concerns >= 3 else ("approved", round(0.75 - 0.1 * concerns, 2))
    return _one_row(
        df,
        (n, features, kind, band, validation, wide, int(concerns), status, confidence),
        "rows bigint, features bigint, problem_type string, size_band string, validation string, high_dimensional boolean, "
        "concerns bigint, status string, confidence double",
    )


# fixed values: names always treated as row identifiers
ID_NAMES = ["id", "Id", "ID", "index", "Index", "INDEX", "Unnamed: 0"]


def fix_plan(df: DataFrame, target: str) -> DataFrame:
    """(class, action, column): what may be fixed automatically and what never is."""
    table = P.column_profile(df).filter(F.col("column") != target)
    none = F.lit(None).cast("string")
    share = F.col("missing") / F.col("rows").cast("double")
    entries = [
        F.when(F.col("column").isin(ID_NAMES), F.struct(F.lit("safe").alias("class"), F.lit("drop_id").alias("action"), F.col("column").alias("column"))),
        F.when(share > 0.30, F.struct(F.lit("safe").alias("class"), F.lit("drop_missing").alias("action"), F.col("column").alias("column"))),
        F.when(F.col("unique") <= 1, F.struct(F.lit("safe").alias("class"), F.lit("drop_constant").alias("action"), F.col("column").alias("column"))),
        F.when((share > 0) & (share <= 0.30), F.struct(F.lit("safe").alias("class"), F.lit("fill_missing").alias("action"), F.col("column").alias("column"))),
    ]
    safe = table.select(F.explode(F.array(*entries)).alias("e")).filter("e IS NOT NULL").select("e.*")
    never = [("never", a, target) for a in ("modify_target", "remove_rows_by_target", "impute_target")]
    return safe.unionByName(df.sparkSession.createDataFrame(never, "class string, action string, column string"))


def reentry_conditions(df: DataFrame, target: str, order_by: list[str]) -> DataFrame:
    """(condition, met): what must hold before the gates are tried again."""
    first = {r["rule"]: r["failed"] for r in problem_gate(df, target).collect()}
    second = {r["rule"]: r for r in data_gate(df, target, order_by).collect()}
    rows = [
        ("min_rows_met", not first["min_rows"]),
        ("samples_per_feature_met", not first["rows_per_feature"]),
        ("missing_rate_acceptable", not second["missing_columns"]["failed"]),
        ("no_leakage", not second["leaking_columns"]["failed"]),
        ("id_columns_removed", second["id_columns"]["value"] == 0),
    ]
    return df.sparkSession.createDataFrame(rows, "condition string, met boolean")


def apply_safe_fixes(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Drop ids, gaps above 30 %, constants and duplicates, then fill the rest; returns (table, change log)."""
    log: list[tuple[str, str | None]] = []

    def drop(frame: DataFrame, names: list[str], why: str) -> DataFrame:
        log.extend((why, c) for c in names)
        return frame.drop(*names)

    out = drop(df, [c for c in df.columns if c in ID_NAMES and c != target], "drop_id")
    ints = [f.name for f in out.schema.fields if isinstance(f.dataType, DTYPE_GROUPS["int"]) and f.name != target]
    if ints:
        found = {r["column"] for r in sequential_ids(out, ints).filter("sequential").collect()}
        out = drop(out, [c for c in ints if c in found], "drop_sequential")
    stats = {r["column"]: r for r in P.column_profile(out).collect()}
    gaps = [c for c in out.columns if c != target and stats[c]["rows"] and stats[c]["missing"] / stats[c]["rows"] > 0.30]
    out = drop(out, gaps, "drop_missing")
    out = drop(out, [c for c in out.columns if c != target and stats[c]["unique"] <= 1], "drop_constant")
    out = out.dropDuplicates()
    log.append(("drop_duplicates", None))
    open_columns = [c for c in out.columns if c != target and stats[c]["missing"] > 0]
    numeric = [c for c in open_columns if c in numeric_columns(out)]
    text = [c for c in open_columns if c in string_columns(out)]
    fills: dict[str, object] = {c: v[0.5] for c, v in quantiles(out, numeric, [0.5]).items()}
    fills |= mode_values(out, text)
    fills = {c: v for c, v in fills.items() if v is not None}
    if fills:
        doubles = {c: col(c).cast("double") for c in numeric}
        out = out.withColumns(doubles).na.fill(fills) if numeric else out.na.fill(fills)
    log += [("fill_median" if c in numeric else "fill_mode", c) for c in fills]
    return out, df.sparkSession.createDataFrame(log, "action string, column string")


# fixed values: name parts -> meaning, first match wins
NAME_MEANINGS = [
    (("name", "اسم"), "entity name"),
    (("age", "عمر"), "age"),
    (("salary", "راتب", "price", "سعر"), "money"),
    (("date", "تاريخ", "time"), "date or time"),
    (("id", "رقم", "code"), "identifier"),
    (("email", "بريد", "phone", "هاتف"), "contact"),
]


def column_meanings(df: DataFrame) -> DataFrame:
    """(column, meaning, missing, unique): meaning from the column name, else from its type family."""
    numeric = set(numeric_columns(df))
    rows = []
    for c in df.columns:
        named = next((m for parts, m in NAME_MEANINGS if any(p in c.lower() for p in parts)), None)
        rows.append((c, named or ("number" if c in numeric else "text or category")))
    meanings = df.sparkSession.createDataFrame(rows, "column string, meaning string")
    return P.column_profile(df).select("column", "missing", "unique").join(F.broadcast(meanings), "column")


def table_flags(df: DataFrame) -> DataFrame:
    """(flag, raised): more than 30 % missing cells, more than 10 % duplicate rows."""
    over = P.overview(df)
    flags = {
        "high_missing": F.col("missing") > F.col("rows") * F.col("columns") * 0.3,
        "high_duplicates": F.col("duplicates") > F.col("rows") * 0.1,
    }
    return wide_to_long(over, {n: {"raised": c} for n, c in flags.items()}, key="flag")


def critique(metrics: DataFrame, importances: DataFrame | None = None, complex_model: bool = False) -> DataFrame:
    """(warning, value): rules over a (metric, value) table and a (feature, importance) table."""
    acc = F.col("value")
    rules = metrics.filter(F.col("metric") == "accuracy").select(
        F.when(acc > 0.95, F.lit("suspiciously_high_accuracy")).when(acc > 0.85, F.lit("accuracy_may_not_transfer")).alias("warning"), "value"
    )
    if importances is not None:
        top = importances.agg(F.max("importance").alias("value")).filter("value > 0.5")
        rules = rules.unionByName(top.select(F.lit("single_feature_dominates").alias("warning"), "value"))
    if complex_model:
        extra = metrics.sparkSession.createDataFrame([("complex_model_may_overfit", None)], "warning string, value double")
        rules = rules.unionByName(extra)
    return rules.filter(F.col("warning").isNotNull())
