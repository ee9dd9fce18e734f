"""Model metrics from confusion counts, score prefix sums, contingency tables and grouped moments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pvalues
from ..functions.guarded import col
from .aggregate import average_ranks
from .lookup import join_lookup
from .ordered import running_totals
from .relational import cross

def _weight(weight: str | None):
    return F.lit(1.0) if weight is None else col(weight).cast("double")


def confusion_counts(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(actual, predicted, n): the only full pass most classification metrics need."""
    return df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(F.sum(_weight(weight)).alias("n"))


def per_class(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(label, precision, recall, f1, support, tp, predicted): zero where a ratio is undefined."""
    cells = confusion_counts(df, actual, predicted, weight)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("t"), F.lit(0.0).alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0.0)).alias("tp")),
                F.struct(F.col("predicted").alias("label"), F.lit(0.0).alias("t"), F.col("n").alias("p"), F.lit(0.0).alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("tp", F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide("tp", F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero)
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp", "predicted")


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive=None, weight: str | None = None) -> DataFrame:
    """One row of accuracy, balanced accuracy, macro and weighted averages, MCC and kappa; with ``positive`` also the binary set."""
    table = per_class(df, actual, predicted, weight)
    s, n = F.col("support"), F.sum("support")
    correct = F.sum("tp")
    present = F.when(s > 0, F.col("recall"))
    pt, pp, tt = F.sum(F.col("predicted") * s), F.sum(F.col("predicted") * F.col("predicted")), F.sum(s * s)
    aggs = [
        n.alias("n"),
        (correct / n).alias("accuracy"),
        F.avg(present).alias("balanced_accuracy"),
        F.coalesce(F.try_divide(correct * n - pt, F.sqrt((n * n - pp) * (n * n - tt))), F.lit(0.0)).alias("mcc"),
        F.try_divide(correct / n - pt / (n * n), 1 - pt / (n * n)).alias("kappa"),
    ]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * s) / n).alias(f"{m}_weighted")]
    if positive is not None:
        hit, miss = F.col("label") == F.lit(positive), F.col("label") != F.lit(positive)
        for m in ("precision", "recall", "f1"):
            aggs.append(F.coalesce(F.max(F.when(hit, F.col(m))), F.lit(0.0)).alias(m))
        aggs.append(F.coalesce(F.max(F.when(hit, F.col("recall"))), F.lit(0.0)).alias("sensitivity"))
        aggs.append(F.coalesce(F.max(F.when(miss, F.col("recall"))), F.lit(0.0)).alias("specificity"))
    return table.agg(*aggs)


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n, share): every pair of labels, empty cells included, share within the actual label."""
    counts = confusion_counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct()
    grid = cross(labels, labels.withColumnRenamed("actual", "predicted"))
    cells = grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    totals = counts.groupBy("actual").agg(F.sum("n").alias("__t"))
    out = cells.join(totals, "actual", "left")
    return out.select("actual", "predicted", F.col("n").cast("bigint").alias("n"), F.coalesce(F.try_divide("n", F.col("__t")), F.lit(0.0)).alias("share"))


def _score_steps(df: DataFrame, keys: list[str], actual, score: str) -> DataFrame:
    """(keys, threshold, tp, fp, pos, neg, P, N) from the highest score down; ties share one step."""
    positive = F.coalesce(actual.cast("double"), F.lit(0.0))
    counts = df.groupBy(*[col(k) for k in keys], col(score).cast("double").alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    steps = running_totals(
        counts.withColumn("__o", -F.col("threshold")), keys, ["__o"], {"tp": F.col("pos"), "fp": F.col("neg")}
    ).drop("__o")
    if keys:
        totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        return join_lookup(steps, totals, keys, null_safe=True)
    row = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return steps.withColumns({"P": F.lit(row["P"]), "N": F.lit(row["N"])})


def roc_curve(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score."""
    steps = _score_steps(df, [], col(actual) == F.lit(positive), score)
    return steps.select("threshold", F.try_divide("fp", F.col("N")).alias("fpr"), F.try_divide("tp", F.col("P")).alias("tpr"))


def _auc(steps: DataFrame, keys: list[str]) -> DataFrame:
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    out = steps.groupBy(*keys).agg(area.alias("__a"), F.max("P").alias("P"), F.max("N").alias("N"))
    return out.select(*keys, F.try_divide("__a", F.col("P") * F.col("N")).alias("auc"), F.col("P").alias("positives"))


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """(auc): probability that a positive outranks a negative, ties counting half."""
    return _auc(_score_steps(df, [], col(actual) == F.lit(positive), score), []).select("auc")


def roc_auc_ovr(df: DataFrame, actual: str, scores: dict[object, str]) -> DataFrame:
    """(auc): one-vs-rest AUC weighted by class frequency; ``scores`` maps class to its probability column."""
    entries = [F.struct(F.lit(str(k)).alias("cls"), col(c).cast("double").alias("score"), (col(actual) == F.lit(k)).cast("int").alias("hit")) for k, c in scores.items()]
    long = df.select(F.inline(F.array(*entries)))
    table = _auc(_score_steps(long, ["cls"], F.col("hit"), "score"), ["cls"])
    return table.agg(F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum("positives")).alias("auc"))


def pr_curve(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    steps = _score_steps(df, [], col(actual) == F.lit(positive), score)
    return steps.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", F.col("P")).alias("recall"))


def average_precision(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    steps = _score_steps(df, [], col(actual) == F.lit(positive), score)
    gain = F.try_divide("pos", F.col("P")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.agg(F.sum(gain).alias("average_precision"))


def log_loss(df: DataFrame, actual: str, probability: str, positive=1, eps: float = 1e-15, weight: str | None = None) -> DataFrame:
    p = F.least(F.greatest(col(probability).cast("double"), F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(col(actual) == F.lit(positive), F.ln(p)).otherwise(F.ln(1 - p))
    w = _weight(weight)
    return df.agg((F.sum(loss * w) / F.sum(w)).alias("log_loss"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, mae, median absolute error, max error, r2, explained variance, mape, smape, rmsle."""
    from .quantiles import quantiles

    y, p = col(actual).cast("double"), col(predicted).cast("double")
    e = y - p
    rows = df.select(y.alias("y"), p.alias("p"), e.alias("e"), F.abs(e).alias("__ae")).na.drop()
    median = quantiles(rows, ["__ae"], [0.5])["__ae"][0.5]
    y, p, e = F.col("y"), F.col("p"), F.col("e")
    log_gap = F.when((y > -1) & (p > -1), F.log1p(y) - F.log1p(p))
    return rows.agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg("__ae").alias("mae"),
        F.lit(median).cast("double").alias("median_ae"),
        F.max("__ae").alias("max_error"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        (F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
        (F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(p)), F.lit(0.0))) * 100).alias("smape"),
        F.when(F.min(y) < 0, F.lit(None)).when(F.min(p) < 0, F.lit(None)).otherwise(F.sqrt(F.avg(log_gap * log_gap))).alias("rmsle"),
    )


def _vector_moments(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """(label, n, centroid, squares) per cluster."""
    v = col(vector)
    norm = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    means = [F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dims)]
    return df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.array(*means).alias("centroid"), F.sum(norm).alias("squares"))


def _dims(df: DataFrame, vector: str) -> int:
    return df.select(F.size(col(vector)).alias("d")).agg(F.max("d").alias("d")).first()["d"]


def _squared_norm(v):
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def calinski_harabasz(df: DataFrame, label: str, vector: str) -> DataFrame:
    dims = _dims(df, vector)
    groups = _vector_moments(df, label, vector, dims)
    totals = [F.sum(F.get("centroid", F.lit(i)) * F.col("n")) / F.sum("n") for i in range(dims)]
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("squares").alias("squares"),
        F.sum(F.col("n") * _squared_norm(F.col("centroid"))).alias("held"),
        F.array(*totals).alias("centre"),
    )
    between = F.col("held") - F.col("n") * _squared_norm(F.col("centre"))
    within = F.col("squares") - F.col("held")
    return row.select(F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str, vector: str) -> DataFrame:
    groups = _vector_moments(df, label, vector, _dims(df, vector)).select("label", "centroid")
    rows = join_lookup(df.select(col(label).alias("label"), col(vector).alias("v")), groups, ["label"])
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double")))
    spread = rows.groupBy("label").agg(F.avg(gap(F.col("v"), F.col("centroid"))).alias("s"), F.first("centroid").alias("c"))
    other = spread.select(F.col("label").alias("l2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    pairs = cross(spread, other).filter("label <> l2")
    worst = pairs.groupBy("label").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), gap(F.col("c"), F.col("c2")))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def clustering_agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information, homogeneity, completeness, V-measure."""
    cells = df.groupBy(col(truth).alias("a"), col(cluster).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows_a, rows_b = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    pairs = lambda x: x * (x - 1) / 2
    n = F.sum("n")
    base = cells.agg(n.alias("n"), F.sum(pairs(F.col("n"))).alias("cc"), F.sum(F.col("n") * F.ln("n")).alias("ln_cells"))
    a = rows_a.agg(F.sum(pairs(F.col("na"))).alias("ca"), F.sum(F.col("na") * F.ln("na")).alias("ln_a"))
    b = rows_b.agg(F.sum(pairs(F.col("nb"))).alias("cb"), F.sum(F.col("nb") * F.ln("nb")).alias("ln_b"))
    one = lambda d: d.withColumn("__k", F.lit(1))
    t = one(base).join(F.broadcast(one(a)), "__k").join(F.broadcast(one(b)), "__k")
    n, cc, ca, cb = F.col("n"), F.col("cc"), F.col("ca"), F.col("cb")
    expected = ca * cb / pairs(n)
    ari = F.coalesce(F.try_divide(cc - expected, (ca + cb) / 2 - expected), F.lit(1.0))
    ha, hb = F.ln(n) - F.col("ln_a") / n, F.ln(n) - F.col("ln_b") / n
    mi = F.ln(n) + (F.col("ln_cells") - F.col("ln_a") - F.col("ln_b")) / n
    hom = F.when(ha > 1e-12, mi / ha).otherwise(F.lit(1.0))
    com = F.when(hb > 1e-12, mi / hb).otherwise(F.lit(1.0))
    return t.select(
        ari.alias("ari"),
        F.when(ha + hb > 1e-12, 2 * mi / (ha + hb)).otherwise(F.lit(1.0)).alias("nmi"),
        hom.alias("homogeneity"),
        com.alias("completeness"),
        F.coalesce(F.try_divide(2 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"),
    )


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = col(actual).cast("double") - col(predicted).cast("double")
    return df.agg(F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))


def overfit_rules(scores: DataFrame, train: str = "train_score", test: str = "test_score") -> DataFrame:
    """(.., gap, verdict): good_fit below 0.05, slight below 0.1, moderate below 0.2, else severe."""
    gap = col(train) - col(test)
    verdict = F.when(gap < 0.05, "good_fit").when(gap < 0.1, "slight_overfit").when(gap < 0.2, "moderate_overfit").otherwise("severe_overfit")
    return scores.withColumns({"gap": gap, "verdict": verdict})


def mcnemar(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    """(only_first, only_second, statistic, p_value, significant) with continuity correction."""
    a, b = col(first) == col(actual), col(second) == col(actual)
    row = df.agg(F.count_if(a & ~b).alias("x"), F.count_if(~a & b).alias("y")).first()
    x, y = row["x"], row["y"]
    stat = (abs(x - y) - 1) ** 2 / (x + y) if x + y else 0.0
    p = pvalues.chi2_one_df(stat) if x + y else 1.0
    return df.sparkSession.createDataFrame(
        [(x, y, float(stat), p, p < 0.05)], "only_first bigint, only_second bigint, statistic double, p_value double, significant boolean"
    )


def paired_t(df: DataFrame, first: str, second: str) -> DataFrame:
    """(n, mean_difference, statistic, p_value)."""
    d = col(first).cast("double") - col(second).cast("double")
    row = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    stat = row["m"] / (row["s"] / math.sqrt(row["n"])) if row["n"] > 1 and row["s"] else None
    p = pvalues.student_t_two_sided(stat, row["n"] - 1) if stat is not None else None
    return df.sparkSession.createDataFrame([(row["n"], row["m"], stat, p)], "n bigint, mean_difference double, statistic double, p_value double")


def wilcoxon(df: DataFrame, first: str, second: str) -> DataFrame:
    """(n, statistic, p_value): signed-rank sum of the rarer sign, zero differences dropped, normal approximation."""
    d = (col(first).cast("double") - col(second).cast("double")).alias("d")
    signed = df.select(d).filter("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).alias("up"))
    counts = signed.groupBy("m").agg(F.count_if("up").alias("plus"), F.count(F.lit(1)).alias("t"))
    ranks = average_ranks(signed, "m").select(F.col("__v").alias("m"), F.col("__rank").alias("r"))
    row = counts.join(ranks, "m").agg(
        F.sum("t").alias("n"),
        F.sum(F.col("r") * F.col("plus")).alias("wp"),
        F.sum(F.col("r") * (F.col("t") - F.col("plus"))).alias("wm"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"),
    ).first()
    n = row["n"] or 0
    if not n:
        return df.sparkSession.createDataFrame([(0, 0.0, 1.0)], "n bigint, statistic double, p_value double")
    stat = min(row["wp"], row["wm"])
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - row["ties"] / 48)
    p = pvalues.normal_two_sided((stat - n * (n + 1) / 4) / sd) if sd else 1.0
    return df.sparkSession.createDataFrame([(n, float(stat), p)], "n bigint, statistic double, p_value double")


@F.pandas_udf(T.LongType())
def _poisson(mean, seed):
    import numpy as np
    import pandas as pd

    return pd.Series([int(np.random.default_rng(s & 0x7FFFFFFF).poisson(m)) for m, s in zip(mean, seed)])


def bootstrap_accuracy(df: DataFrame, actual: str, first: str, second: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, accuracy_first, accuracy_second, difference) from Poisson weights on the correct/incorrect cells."""
    a, b = (col(first) == col(actual)).alias("a"), (col(second) == col(actual)).alias("b")
    cells = df.select(a, b).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    drawn = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("w", _poisson("n", F.xxhash64(F.lit(seed), "replicate", "a", "b")))
    hit = lambda c: F.try_divide(F.sum(F.when(F.col(c), F.col("w")).otherwise(F.lit(0))).cast("double"), F.sum("w"))
    out = drawn.groupBy("replicate").agg(hit("a").alias("accuracy_first"), hit("b").alias("accuracy_second"))
    return out.withColumn("difference", F.col("accuracy_first") - F.col("accuracy_second"))


def poisson_limits() -> list[float]:
    """Cumulative distribution of Poisson(1) for 0 to 11."""
    out, term = [], math.exp(-1.0)
    for k in range(12):
        out.append((out[-1] if out else 0.0) + term)
        term /= k + 1
    return out


#: draws are fifth powers modulo this prime, a permutation of its residues
PRIME, STEP = 2_147_483_647, 1_000_003


def bootstrap_sums(df: DataFrame, parts: dict[str, Column], key: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, weight, part...): Poisson-weighted row count and sums of the parts in every replicate, in one pass.

    A task holds one row of sums a replicate and adds up its rows batch by batch, so no row is copied and tasks x replicates
    rows are shuffled. The weight of a row depends on its key, the seed and the replicate only; a null part adds nothing.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")))
    values = df.select(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("h"), *[c.cast("double").alias(f"p{i}") for i, c in enumerate(parts.values())])
    limits, names = np.array(poisson_limits()), ["weight", *[f"p{i}" for i in range(len(parts))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps = np.zeros((replicates, len(names))), STEP * np.arange(1, replicates + 1, dtype=np.int64)
        for batch in batches:
            own = np.column_stack([np.ones(batch.num_rows), *[np.nan_to_num(c.to_numpy(zero_copy_only=False)) for c in batch.columns[1:]]])
            h = batch.column(0).to_numpy()
            for at in range(0, len(h), 2048):
                x = (h[at : at + 2048, None] + steps[None, :]) % PRIME
                square = x * x % PRIME
                weights = np.searchsorted(limits, (square * square % PRIME) * x % PRIME / PRIME, side="right")
                total += weights.T @ own[at : at + 2048]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(c) for c in total.T]], ["replicate", *names])

    made = values.mapInArrow(run, "replicate int, " + ", ".join(f"{n} double" for n in names))
    renamed = {"weight": "weight"} | {f"p{i}": name for i, name in enumerate(parts)}
    return made.groupBy("replicate").agg(*[F.sum(n).alias(renamed[n]) for n in names])


def bootstrap_metric(df: DataFrame, parts: dict[str, Column], metric: Callable[[dict[str, Column]], Column], key: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, value): ``metric`` of the weighted sums of named row values and of ``weight``, the weighted row count."""
    sums = bootstrap_sums(df, parts, key, replicates, seed)
    return sums.select("replicate", metric({n: col(n) for n in ["weight", *parts]}).alias("value"))


def bootstrap_interval(replicates: DataFrame, value: str = "difference", level: float = 0.95) -> DataFrame:
    """(mean, lower, upper, significant): the interval excludes zero."""
    tail = (1 - level) / 2
    bounds = F.percentile(col(value), F.array(F.lit(tail), F.lit(1 - tail)))
    # one value per replicate
    row = replicates.agg(F.avg(col(value)).alias("mean"), bounds.alias("b"))
    out = row.select("mean", F.get("b", F.lit(0)).alias("lower"), F.get("b", F.lit(1)).alias("upper"))
    return out.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))
