"""Fairness, drift, alerts, class balance, splits, A/B assignment and graph propagation."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues
from ..functions.guarded import array_sum, col, string_columns, wide_to_long
from ..session import max_group_rows
from .lookup import join_lookup
from .ordered import row_numbers, running_totals
from .relational import cross


def fairness(df: DataFrame, actual: str, predicted: str, group: str, privileged, positive=1) -> DataFrame:
    """(group, n, selection_rate, tpr, fpr, disparate_impact): rate of the group over the privileged group's."""
    yes, truth = col(predicted) == F.lit(positive), col(actual) == F.lit(positive)
    table = df.groupBy(col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(yes.cast("double")).alias("selection_rate"),
        F.avg(F.when(truth, yes.cast("double"))).alias("tpr"),
        F.avg(F.when(~truth, yes.cast("double"))).alias("fpr"),
    )
    base = df.filter(col(group) == F.lit(privileged)).agg(F.avg(yes.cast("double")).alias("r")).first()["r"]
    return table.withColumn("disparate_impact", F.try_divide("selection_rate", F.lit(base).cast("double")))


def disparate_impact(df: DataFrame, predicted: str, group: str, privileged, positive=1) -> DataFrame:
    """(lowest_rate, privileged_rate, ratio): smallest group selection rate over the privileged one."""
    rates = df.groupBy(col(group).alias("g")).agg(F.avg((col(predicted) == F.lit(positive)).cast("double")).alias("r"))
    row = rates.agg(F.min("r").alias("lowest_rate"), F.max(F.when(F.col("g") == F.lit(privileged), F.col("r"))).alias("privileged_rate"))
    return row.withColumn("ratio", F.try_divide("lowest_rate", F.col("privileged_rate")))


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [x for i, c in enumerate(columns) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]
    return wide_to_long(df.agg(*aggs), {c: {"mean": F.col(f"m{i}"), "std": F.col(f"s{i}")} for i, c in enumerate(columns)})


def mean_drift(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 2.0) -> DataFrame:
    """(column, z_score, drifted): shift of the mean in reference population deviations."""
    ref = _moments(reference, columns).withColumnsRenamed({"mean": "ref_mean", "std": "ref_std"})
    z = F.abs(F.col("mean") - F.col("ref_mean")) / (F.col("ref_std") + F.lit(1e-8))
    both = _moments(current, columns).join(F.broadcast(ref), "column")
    return both.select("column", z.alias("z_score")).withColumn("drifted", F.col("z_score") > threshold)


def ks_drift(reference: DataFrame, current: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(column, n_reference, n_current, statistic, p_value, drifted): largest gap of the two distribution functions."""
    entries = lambda side: F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("v"), F.lit(side).alias("side")) for c in columns])
    )
    both = reference.select(entries(0)).unionByName(current.select(entries(1))).filter("v IS NOT NULL")
    counts = both.groupBy("column", "v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    steps = running_totals(counts, ["column"], ["v"], {"ca": F.col("a"), "cb": F.col("b")})
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    # one row per tested column
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    table = steps.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.max(gap).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb")
    )
    rows = []
    for r in table.collect():
        p = pvalues.kolmogorov(r["d"], r["na"], r["nb"])
        rows.append((r["column"], r["na"], r["nb"], r["d"], p, p < alpha))
    return reference.sparkSession.createDataFrame(
        rows, "column string, n_reference bigint, n_current bigint, statistic double, p_value double, drifted boolean"
    )


# fixed values: default alert limits, (metric, limit, alert when below)
ALERT_LIMITS = [("accuracy", 0.85, True), ("latency_ms", 200.0, False), ("error_rate", 0.05, False)]


def threshold_alerts(metrics: DataFrame, limits: list[tuple[str, float, bool]] = ALERT_LIMITS) -> DataFrame:
    """(.., limit, severity): metric rows beyond their limit."""
    table = metrics.sparkSession.createDataFrame(limits, "metric string, limit double, below boolean")
    joined = metrics.join(F.broadcast(table), "metric")
    bad = F.when(F.col("below"), F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return joined.filter(bad).drop("below").withColumn("severity", F.lit("warning"))


def problem_type(df: DataFrame, target: str, rule: str = "small") -> DataFrame:
    """(distinct, rows, problem_type) by one of three rules."""
    row = df.agg(F.count_distinct(col(target)).alias("distinct_values"), F.count(F.lit(1)).alias("rows"))
    d, share = F.col("distinct_values"), F.try_divide(F.col("distinct_values").cast("double"), F.col("rows"))
    text = F.lit(target in string_columns(df))
    test = {
        "factory": (d <= 2) | ((share < 0.05) & (d <= 20)),
        "small": (d <= 20) | (share < 0.05),
        "engine": (d <= 10) | (share < 0.05),
    }[rule]
    return row.withColumn("problem_type", F.when(text | test, "classification").otherwise("regression"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight, imbalance_ratio): weight n/(k*count), ratio of largest to smallest class."""
    counts = df.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")).first()
    weight = F.lit(float(total["t"])) / (F.lit(float(total["k"])) * F.col("n"))
    ratio = F.lit(float(total["hi"]) / total["lo"]) if total["lo"] else F.lit(None).cast("double")
    return counts.withColumns({"weight": weight, "imbalance_ratio": ratio})


def _hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")))


def _class_ranks(df: DataFrame, target: str, key: str, seed: int) -> DataFrame:
    """Row position inside its class in a reproducible random order, with the class size."""
    ranked = row_numbers(df.withColumn("__h", _hash_order(key, seed)), [target], ["__h", key], "__rn")
    sizes = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("__size"))
    # one row a class: a shuffle by class would put each class into one task
    return join_lookup(ranked, F.broadcast(sizes), [target], null_safe=True).drop("__h")


#: copies of one row that one task makes
COPIES_A_RUN = 10_000


def oversample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Every class reaches the majority count: rows are repeated evenly, the remainder by hashed rank."""
    ranked = _class_ranks(df, target, key, seed)
    top = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()["m"]
    copies = F.floor(F.lit(top) / F.col("__size")) + F.when(F.col("__rn") <= F.lit(top) % F.col("__size"), 1).otherwise(0)
    # a rare row's copies are made in runs, which are dealt to all tasks before they are written out
    run = F.lit(COPIES_A_RUN)
    runs = ranked.withColumn("__copies", copies).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__copies") - 1) / run))))
    if top > COPIES_A_RUN:
        # a fixed number: runs are small now, and adaptive execution would put them together
        runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(col(key), "__run"))
    last = F.least(F.col("__copies"), (F.col("__run") + 1) * run)
    return runs.withColumn("copy", F.explode(F.sequence(F.col("__run") * run + 1, last))).drop("__rn", "__size", "__copies", "__run")


def undersample(df: DataFrame, target: str, key: str, seed: int = 42) -> DataFrame:
    """Every class reduced to the minority count, chosen by hashed rank."""
    ranked = _class_ranks(df, target, key, seed)
    low = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first()["m"]
    return ranked.filter(F.col("__rn") <= low).drop("__rn", "__size")


def stratified_split(df: DataFrame, target: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Column ``split``: the first ``floor(test * n)`` rows of each class by hashed rank are the test set."""
    ranked = _class_ranks(df, target, key, seed)
    is_test = F.col("__rn") <= F.floor(F.col("__size") * F.lit(test))
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("__rn", "__size")


def hash_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Random split without a shuffle: a row's side depends on its key only."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    return df.withColumn("split", F.when(bucket < int(test * 10_000), "test").otherwise("train"))


def ab_bucket(key: str) -> Column:
    """md5(key) as a 128-bit number modulo 100, from four 32-bit pieces (2^32 mod 100 is 96)."""
    digest = F.md5(col(key).cast("string"))
    out = F.lit(0).cast("bigint")
    for i in range(4):
        piece = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
        out = (out * 96 + piece) % 100
    return out


def ab_assign(df: DataFrame, key: str, ratio: float = 0.5) -> DataFrame:
    return df.withColumn("variant", F.when(ab_bucket(key) < F.lit(ratio * 100), "B").otherwise("A"))


def ab_outcome(df: DataFrame, prediction: str, actual: str) -> DataFrame:
    labelled = df.filter(col(actual).isNotNull())
    return labelled.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg((col(prediction) == col(actual)).cast("double")).alias("accuracy"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar_items(df: DataFrame, key: str, vector: str, item, k: int = 10) -> DataFrame:
    """(key, similarity): the k items closest to one item; one pass, the item's vector is the only thing sent around."""
    found = df.filter(col(key) == F.lit(item)).select(col(vector)).head(1)
    if not found:
        raise ValueError(f"no item {item!r}")
    query = F.array(*[F.lit(float(x)) for x in found[0][0]])
    scored = df.filter(col(key) != F.lit(item)).select(col(key), cosine(col(vector), query).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def profile_similarity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(profile_a, profile_b, similarity) between distinct one-hot feature profiles.

    Items with equal features share a profile, so the item-by-item matrix is this table joined to the items. A profile
    is shown as column=value pairs without the NULL ones; profiles are told apart by their typed values.
    """
    shown = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), col(c).cast("string")) for c in columns])
    made = F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    profiles = df.select(made.alias("a"), shown.alias("profile_a")).distinct()
    pairs = cross(profiles, profiles.select(F.col("a").alias("b"), F.col("profile_a").alias("profile_b")))
    same = [F.coalesce((F.col(f"a.v{i}") == F.col(f"b.v{i}")).cast("int"), F.lit(0)) for i in range(len(columns))]
    return pairs.select("profile_a", "profile_b", (sum(same[1:], same[0]) / F.lit(float(len(columns)))).alias("similarity"))


def propagate(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str, features: str) -> DataFrame:
    """(node, features): mean feature vector over a node and its neighbours, edges taken undirected and once."""
    dims = nodes.select(F.size(col(features)).alias("d")).agg(F.max("d").alias("d")).first()["d"]
    a, b = col(src), col(dst)
    pairs = edges.select(F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"), (a != b).alias("__apart")).filter("__apart").drop("__apart")
    # an edge is told from its repeats once, not once a direction, and a task holds so many rows whatever their number
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // max_group_rows(edges.sparkSession)))
    once = pairs.repartition(parts, "__a", "__b").distinct()
    ends = [F.struct(F.col(x).alias("__to"), F.col(y).alias(node)) for x, y in (("__a", "__b"), ("__b", "__a"))]
    loops = nodes.select(col(node).alias("__to"), col(node)).distinct()
    linked = once.select(F.inline(F.array(*ends))).unionByName(loops)
    joined = linked.join(nodes.select(col(node), col(features).alias("__x")), node)
    means = F.array(*[F.avg(F.get("__x", F.lit(i)).cast("double")) for i in range(dims)])
    return joined.groupBy(F.col("__to").alias(node)).agg(means.alias(features))


def interaction_strength(df: DataFrame, importances: dict[str, float]) -> DataFrame:
    """(col1, col2, strength): |correlation| times the mean importance of the pair."""
    from .aggregate import correlations

    table = correlations(df, list(importances))
    weights = df.sparkSession.createDataFrame([(c, float(v)) for c, v in importances.items()], "c string, w double")
    first, second = (F.broadcast(weights.withColumnsRenamed({"c": n, "w": f"w_{n}"})) for n in ("col1", "col2"))
    out = table.join(first, "col1").join(second, "col2")
    return out.select("col1", "col2", (F.abs("r") * (F.col("w_col1") + F.col("w_col2")) / 2).alias("strength"))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, content_hash): order-independent, equal for equal multisets of rows under the same names and types.

    Every value goes in with its length, so values cannot run into each other and NULL differs from every text; nested
    values go in as JSON. 128 bits of each row's digest are summed, and a digest of the schema stands in front.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    text = lambda c: F.to_json(F.struct(col(c))) if re.match("array|map|struct", kinds[c]) else F.hex(col(c)) if kinds[c] == "binary" else col(c).cast("string")
    field = lambda c: F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-"))
    digest = F.md5(F.concat(*[field(c) for c in columns]))
    piece = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    total = lambda i: F.coalesce(F.sum(piece(i)), F.lit(0)).cast("string")
    schema = hashlib.md5(json.dumps([(c, kinds[c]) for c in columns]).encode()).hexdigest()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", F.lit(schema), *[total(i) for i in range(4)]).alias("content_hash"))
