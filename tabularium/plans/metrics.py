"""Metric, fairness, drift, sampling and versioning queries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import monitoring as D
from ..operators import similarity as SI
from ..operators import versioning as VR
from .registry import Tables, query

SCORED = """(SELECT doc_id, quality AS y, (n_chars % 101) / 100.0::DOUBLE AS score, ((n_chars % 101) / 100.0::DOUBLE > 0.3)::INTEGER AS yhat,
    (doc_id % 4 <> 0)::INTEGER AS alt, lang, source, 1 + doc_id % 3 AS w FROM documents JOIN labels USING (doc_id))"""


def scored(t: Tables):
    score = (F.col("n_chars") % 101) / F.lit(100.0)
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        score.alias("score"),
        (score > 0.3).cast("int").alias("yhat"),
        (F.col("doc_id") % 4 != 0).cast("int").alias("alt"),
        "lang",
        "source",
        (1 + F.col("doc_id") % 3).alias("w"),
    )


# three-class labels over every order
CLASSED = "(SELECT o_orderkey, o_orderstatus AS y, CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS yhat, o_orderpriority AS grp FROM orders)"


def classed(t: Tables):
    guess = F.when(F.col("o_custkey") % 3 == 0, "F").when(F.col("o_custkey") % 3 == 1, "O").otherwise("P")
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("y"), guess.alias("yhat"), F.col("o_orderpriority").alias("grp"))


@query(
    "m01_problem_type",
    """SELECT count(DISTINCT o_orderstatus) AS distinct_values, count(*) AS rows, 'classification' AS problem_type FROM orders
    UNION ALL SELECT count(DISTINCT l_quantity), count(*), 'classification' FROM lineitem
    UNION ALL SELECT count(DISTINCT o_totalprice), count(*), 'regression' FROM orders""",
)
def _(t: Tables):
    a = D.problem_type(t.orders, "o_orderstatus", "factory")
    b = D.problem_type(t.lineitem, "l_quantity", "engine")
    return a.unionByName(b).unionByName(D.problem_type(t.orders, "o_totalprice", "small"))


@query(
    "m02_class_balance",
    """WITH c AS (SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1)
    SELECT class, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n) AS weight, (SELECT max(n)::DOUBLE / min(n) FROM c) AS imbalance_ratio FROM c""",
    floats="weight imbalance_ratio",
)
def _(t: Tables):
    return D.class_balance(t.part, "p_type")


@query("m03_oversample", """SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY 1""")
def _(t: Tables):
    return D.oversample(t.labels, "quality", "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m03_undersample",
    """SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id)
    <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def _(t: Tables):
    return D.undersample(t.labels, "quality", "doc_id").select("doc_id", "quality", "toxic")


@query(
    "m04_stratified_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey)
    <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def _(t: Tables):
    return D.stratified_split(t.orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "split")


@query("m04_hash_split", "SELECT CASE WHEN ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return D.hash_split(t.orders, "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m16_interaction_strength",
    """SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, abs(corr(l_quantity, l_extendedprice)) * 0.4 AS strength FROM lineitem
    UNION ALL SELECT 'l_quantity', 'l_tax', abs(corr(l_quantity, l_tax)) * 0.35 FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_tax', abs(corr(l_extendedprice, l_tax)) * 0.25 FROM lineitem""",
    floats="strength",
)
def _(t: Tables):
    return D.interaction_strength(t.lineitem, {"l_quantity": 0.5, "l_extendedprice": 0.3, "l_tax": 0.2})


BINARY = f"""SELECT sum(w)::DOUBLE AS n, sum(w) FILTER (y = yhat)::DOUBLE AS hit, sum(w) FILTER (y = 1)::DOUBLE AS p, sum(w) FILTER (y = 0)::DOUBLE AS m,
    sum(w) FILTER (yhat = 1)::DOUBLE AS pp, sum(w) FILTER (yhat = 0)::DOUBLE AS pm, sum(w) FILTER (y = 1 AND yhat = 1)::DOUBLE AS tp,
    sum(w) FILTER (y = 0 AND yhat = 0)::DOUBLE AS tn FROM {SCORED}"""
METRICS = "n accuracy balanced_accuracy mcc kappa precision_macro precision_weighted recall_macro recall_weighted f1_macro f1_weighted"


@query(
    "m20_binary_metrics",
    f"""SELECT n, hit / n AS accuracy, (tp / p + tn / m) / 2 AS balanced_accuracy, (tp * tn - (pp - tp) * (pm - tn)) / sqrt(p * m * pp * pm) AS mcc,
    (hit / n - (p * pp + m * pm) / (n * n)) / (1 - (p * pp + m * pm) / (n * n)) AS kappa, (tp / pp + tn / pm) / 2 AS precision_macro,
    (tp / pp * p + tn / pm * m) / n AS precision_weighted, (tp / p + tn / m) / 2 AS recall_macro, hit / n AS recall_weighted,
    (2 * tp / (p + pp) + 2 * tn / (m + pm)) / 2 AS f1_macro, (2 * tp / (p + pp) * p + 2 * tn / (m + pm) * m) / n AS f1_weighted,
    tp / pp AS precision, tp / p AS recall, 2 * tp / (p + pp) AS f1, tp / p AS sensitivity, tn / m AS specificity FROM ({BINARY})""",
    floats=f"{METRICS} precision recall f1 sensitivity specificity",
)
def _(t: Tables):
    return M.classification_metrics(scored(t), "y", "yhat", positive=1, weight="w")


@query(
    "m20_multiclass_metrics",
    f"""WITH k AS (SELECT l, count(*) FILTER (y = l)::DOUBLE AS s, count(*) FILTER (yhat = l)::DOUBLE AS p, count(*) FILTER (y = l AND yhat = l)::DOUBLE AS tp
      FROM {CLASSED}, (VALUES ('F'), ('O'), ('P')) v(l) GROUP BY 1),
    g AS (SELECT sum(s) AS n, sum(tp) AS c, sum(p * s) AS ps, sum(p * p) AS pp, sum(s * s) AS ss, avg(tp / p) AS pm, sum(tp / p * s) / sum(s) AS pw, avg(tp / s) AS rm,
      sum(tp) / sum(s) AS rw, avg(2 * tp / (s + p)) AS fm, sum(2 * tp / (s + p) * s) / sum(s) AS fw FROM k)
    SELECT n, c / n AS accuracy, rm AS balanced_accuracy, (c * n - ps) / sqrt((n * n - pp) * (n * n - ss)) AS mcc, (c / n - ps / (n * n)) / (1 - ps / (n * n)) AS kappa,
    pm AS precision_macro, pw AS precision_weighted, rm AS recall_macro, rw AS recall_weighted, fm AS f1_macro, fw AS f1_weighted FROM g""",
    floats=METRICS,
)
def _(t: Tables):
    return M.classification_metrics(classed(t), "y", "yhat")


@query(
    "m21_confusion_matrix",
    f"""WITH l AS (SELECT DISTINCT y AS l FROM {CLASSED} UNION SELECT DISTINCT yhat FROM {CLASSED}), c AS (SELECT y, yhat, count(*) AS n FROM {CLASSED} GROUP BY 1, 2)
    SELECT a.l AS actual, b.l AS predicted, coalesce(n, 0) AS n, coalesce(n / (sum(n) OVER (PARTITION BY a.l))::DOUBLE, 0) AS share
    FROM l a CROSS JOIN l b LEFT JOIN c ON c.y = a.l AND c.yhat = b.l""",
    floats="share",
)
def _(t: Tables):
    return M.confusion_matrix(classed(t), "y", "yhat")


@query(
    "m21_class_report",
    f"""SELECT l AS label, tp / p AS precision, tp / s AS recall, 2 * tp / (s + p) AS f1, s AS support FROM (SELECT l, count(*) FILTER (y = l)::DOUBLE AS s,
    count(*) FILTER (yhat = l)::DOUBLE AS p, count(*) FILTER (y = l AND yhat = l)::DOUBLE AS tp FROM {CLASSED}, (VALUES ('F'), ('O'), ('P')) v(l) GROUP BY 1)""",
    floats="precision recall f1",
)
def _(t: Tables):
    return M.per_class(classed(t), "y", "yhat").drop("tp", "predicted")


STEPS = f"""(SELECT score AS threshold, sum(sum(y)) OVER w AS tp, sum(sum(1 - y)) OVER w AS fp, sum(y) AS pos, sum(1 - y) AS neg,
    (SELECT sum(y) FROM {SCORED})::DOUBLE AS p, (SELECT sum(1 - y) FROM {SCORED})::DOUBLE AS n FROM {SCORED} GROUP BY score WINDOW w AS (ORDER BY score DESC))"""


@query("m22_roc_curve", f"SELECT threshold, fp / n AS fpr, tp / p AS tpr FROM {STEPS}", floats="fpr tpr")
def _(t: Tables):
    return M.roc_curve(scored(t), "y", "score")


@query("m22_roc_auc", f"SELECT sum(neg * (tp - pos / 2.0)) / (any_value(p) * any_value(n)) AS auc FROM {STEPS}", floats="auc")
def _(t: Tables):
    return M.roc_auc(scored(t), "y", "score")


def probabilities(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(F.col("o_orderstatus").alias("y"), *[((price * k) % 1000 / 1000).alias(f"p_{c}") for c, k in (("F", 1), ("O", 3), ("P", 7))])


def _class_auc_sql(c: str, k: int) -> str:
    steps = f"""SELECT s, sum(sum(h)) OVER (ORDER BY s DESC) AS tp, sum(h) AS pos, sum(1 - h) AS neg FROM
    (SELECT (o_totalprice * {k}) % 1000 / 1000 AS s, (o_orderstatus = '{c}')::INTEGER AS h FROM orders) GROUP BY s"""
    return f"SELECT sum(neg * (tp - pos / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS auc, sum(pos) AS p FROM ({steps})"


@query(
    "m22_roc_auc_ovr",
    f"SELECT sum(auc * p) / sum(p) AS auc FROM ({' UNION ALL '.join(_class_auc_sql(c, k) for c, k in (('F', 1), ('O', 3), ('P', 7)))})",
    floats="auc",
)
def _(t: Tables):
    return M.roc_auc_ovr(probabilities(t), "y", {"F": "p_F", "O": "p_O", "P": "p_P"})


@query("m23_pr_curve", f"SELECT threshold, tp / (tp + fp)::DOUBLE AS precision, tp / p AS recall FROM {STEPS}", floats="precision recall")
def _(t: Tables):
    return M.pr_curve(scored(t), "y", "score")


@query("m23_average_precision", f"SELECT sum(pos / p * tp / (tp + fp)::DOUBLE) AS average_precision FROM {STEPS}", floats="average_precision")
def _(t: Tables):
    return M.average_precision(scored(t), "y", "score")


@query(
    "m24_log_loss",
    f"""SELECT -avg(CASE WHEN y = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS log_loss FROM {SCORED}""",
    floats="log_loss",
)
def _(t: Tables):
    return M.log_loss(scored(t), "y", "score")


REGRESSED = "(SELECT l_extendedprice AS y, l_extendedprice * (0.9 + l_discount) + l_quantity * (l_partkey % 7 - 3) * 100 AS p FROM lineitem)"


def regressed(t: Tables):
    shift = F.col("l_quantity") * (F.col("l_partkey") % 7 - 3) * 100
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    return t.lineitem.select(key, F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (0.9 + F.col("l_discount")) + shift).alias("p"))


@query(
    "m25_regression_metrics",
    f"""SELECT avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, quantile_cont(abs(y - p), 0.5) AS median_ae, max(abs(y - p)) AS max_error,
    1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, 1 - var_pop(y - p) / var_pop(y) AS explained_variance, avg(abs((y - p) / y)) * 100 AS mape,
    avg(2 * abs(y - p) / (abs(y) + abs(p))) * 100 AS smape,
    CASE WHEN min(p) >= 0 THEN sqrt(avg((ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0))) * (ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0))))) END AS rmsle FROM {REGRESSED}""",
    floats="mse rmse mae median_ae max_error r2 explained_variance mape smape rmsle",
    digits=3,
)
def _(t: Tables):
    return M.regression_metrics(regressed(t), "y", "p")


@query(
    "m26_calinski_harabasz",
    """WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2),
    g AS (SELECT i, avg(x) AS m FROM e GROUP BY 1), s AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
    SELECT ((SELECT sum(c.n * (c.m - g.m) * (c.m - g.m)) FROM c JOIN g USING (i)) / (k - 1)) / ((SELECT sum((x - m) * (x - m)) FROM e JOIN c USING (label, i)) / (n - k)) AS calinski_harabasz FROM s""",
    floats="calinski_harabasz",
)
def _(t: Tables):
    return M.calinski_harabasz(t.embeddings, "label", "embedding")


@query(
    "m26_davies_bouldin",
    """WITH e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
    s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS d FROM e JOIN c USING (label, i) GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
    SELECT avg(r) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / d) AS r FROM d JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY 1)""",
    floats="davies_bouldin",
)
def _(t: Tables):
    return M.davies_bouldin(t.embeddings, "label", "embedding")


@query(
    "m26_clustering_agreement",
    """WITH c AS (SELECT p_type AS a, p_size % 5 AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), a AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
    s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS cc, (SELECT sum(n * (n - 1) / 2) FROM a) AS ca, (SELECT sum(n * (n - 1) / 2) FROM b) AS cb),
    h AS (SELECT (SELECT -sum(a.n / s.n * ln(a.n / s.n)) FROM a, s) AS ha, (SELECT -sum(b.n / s.n * ln(b.n / s.n)) FROM b, s) AS hb,
      (SELECT sum(c.n / s.n * ln(c.n * s.n / (a.n * b.n))) FROM c JOIN a USING (a) JOIN b USING (b), s) AS mi)
    SELECT (cc - ca * cb / (n * (n - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (n * (n - 1) / 2)) AS ari, 2 * mi / (ha + hb) AS nmi, mi / ha AS homogeneity, mi / hb AS completeness,
    2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb) AS v_measure FROM s, h""",
    floats="ari nmi homogeneity completeness v_measure",
)
def _(t: Tables):
    return M.clustering_agreement(t.part.withColumn("b", F.col("p_size") % 5), "p_type", "b")


@query(
    "m27_residuals",
    f"SELECT count(*) AS n, avg(y - p) AS mean, stddev_pop(y - p) AS std, min(y - p) AS min, max(y - p) AS max FROM {REGRESSED}",
    floats="mean std min max",
    digits=3,
)
def _(t: Tables):
    return M.residual_summary(regressed(t), "y", "p")


@query(
    "m27_overfit_rules",
    f"""SELECT *, CASE WHEN gap < 0.05 THEN 'good_fit' WHEN gap < 0.1 THEN 'slight_overfit' WHEN gap < 0.2 THEN 'moderate_overfit' ELSE 'severe_overfit' END AS verdict FROM (
    SELECT grp, train_score, test_score, train_score - test_score AS gap FROM (SELECT grp, avg((y = yhat)::INTEGER) FILTER (o_orderkey % 5 <> 0) AS train_score,
    avg((y = yhat)::INTEGER) FILTER (o_orderkey % 5 = 0) AS test_score FROM {CLASSED} GROUP BY 1))""",
    floats="train_score test_score gap",
)
def _(t: Tables):
    hit, fold = (F.col("y") == F.col("yhat")).cast("double"), F.col("o_orderkey") % 5 == 0
    scores = classed(t).groupBy("grp").agg(F.avg(F.when(~fold, hit)).alias("train_score"), F.avg(F.when(fold, hit)).alias("test_score"))
    return M.overfit_rules(scores)


@query(
    "m28_mcnemar",
    f"""SELECT x AS only_first, z AS only_second, (abs(x - z) - 1) * (abs(x - z) - 1) / (x + z)::DOUBLE AS statistic FROM (
    SELECT count(*) FILTER (yhat = y AND alt <> y) AS x, count(*) FILTER (yhat <> y AND alt = y) AS z FROM {SCORED})""",
    floats="statistic",
)
def _(t: Tables):
    return M.mcnemar(scored(t), "y", "yhat", "alt").drop("p_value", "significant")


@query(
    "m29_paired_t",
    f"SELECT count(*) AS n, avg(y - p) AS mean_difference, avg(y - p) / (stddev_samp(y - p) / sqrt(count(*))) AS statistic FROM {REGRESSED}",
    floats="mean_difference statistic",
    digits=3,
)
def _(t: Tables):
    return M.paired_t(regressed(t), "y", "p").drop("p_value")


@query(
    "m29_wilcoxon",
    f"""WITH r AS (SELECT y - p AS d, rank() OVER (ORDER BY abs(y - p)) + (count(*) OVER (PARTITION BY abs(y - p)) - 1) / 2.0 AS r FROM {REGRESSED} WHERE y - p <> 0)
    SELECT count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0))::DOUBLE AS statistic FROM r""",
    floats="statistic",
    digits=1,
)
def _(t: Tables):
    return M.wilcoxon(regressed(t), "y", "p").drop("p_value")


@query("m30_bootstrap")
def _(t: Tables):
    return M.bootstrap_interval(M.bootstrap_accuracy(classed(t).withColumn("alt", F.lit("O")), "y", "yhat", "alt", 500))


def bootstrap_sql(rows: str, key: str, value: str, replicates: int) -> str:
    """The same draws and the interval of a weighted mean, one row per row and replicate."""
    weight = "CASE " + " ".join(f"WHEN u < {limit!r} THEN {k}" for k, limit in enumerate(M.poisson_limits())) + " ELSE 12 END"
    return f"""WITH d AS (SELECT {value} AS v, ('0x' || substr(md5('42|' || {key}), 1, 8))::BIGINT AS h FROM {rows}), x AS (SELECT v, r, (h + (r + 1) * {M.STEP}) % {M.PRIME} AS x FROM d, range({replicates}) AS q(r)),
    s AS (SELECT v, r, x, x * x % {M.PRIME} AS x2 FROM x), u AS (SELECT v, r, (x2 * x2 % {M.PRIME}) * x % {M.PRIME} / {M.PRIME}::DOUBLE AS u FROM s), w AS (SELECT v, r, {weight} AS w FROM u),
    m AS (SELECT sum(v * w) / sum(w) AS value FROM w GROUP BY r)
    SELECT mean, lower, upper, lower > 0 OR upper < 0 AS significant FROM (SELECT avg(value) AS mean, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM m)"""


@query("m30_bootstrap_rows", bootstrap_sql(SCORED, "doc_id", "abs(score - y)", 100), floats="mean lower upper")
def _(t: Tables):
    made = M.bootstrap_metric(scored(t), {"error": F.abs(F.col("score") - F.col("y"))}, lambda s: s["error"] / s["weight"], "doc_id", 100)
    return M.bootstrap_interval(made, "value")


@query(
    "m31_fairness",
    f"""SELECT lang AS "group", count(*) AS n, avg(yhat) AS selection_rate, avg(yhat) FILTER (y = 1) AS tpr, avg(yhat) FILTER (y <> 1) AS fpr,
    avg(yhat) / (SELECT avg(yhat) FROM {SCORED} WHERE lang = 'en') AS disparate_impact FROM {SCORED} GROUP BY 1""",
    floats="selection_rate tpr fpr disparate_impact",
)
def _(t: Tables):
    return D.fairness(scored(t), "y", "yhat", "lang", "en")


@query(
    "m31_disparate_impact",
    f"""SELECT min(r) AS lowest_rate, max(r) FILTER (lang = 'en') AS privileged_rate, min(r) / max(r) FILTER (lang = 'en') AS ratio FROM (SELECT lang, avg(yhat) AS r FROM {SCORED} GROUP BY 1)""",
    floats="lowest_rate privileged_rate ratio",
)
def _(t: Tables):
    return D.disparate_impact(scored(t), "yhat", "lang", "en")


def halves(t: Tables):
    shifted = t.events.withColumn("value", F.col("value") * F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), 1.3).otherwise(1.0))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return shifted.filter(F.col("ts") < cut), shifted.filter(F.col("ts") >= cut)


EARLY = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')"
LATE = "(SELECT event_id, user_id, value * 1.3 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16')"


@query(
    "m32_mean_drift",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", abs((SELECT avg({c}) FROM {LATE}) - avg({c})) / (stddev_pop({c}) + 1e-8) AS z_score,
        abs((SELECT avg({c}) FROM {LATE}) - avg({c})) / (stddev_pop({c}) + 1e-8) > 2 AS drifted FROM {EARLY}"""
        for c in ("value", "user_id")
    ),
    floats="z_score",
)
def _(t: Tables):
    return D.mean_drift(*halves(t), ["value", "user_id"])


@query(
    "m33_ks_drift",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", any_value(na) AS n_reference, any_value(nb) AS n_current, max(abs(ca / na - cb / nb)) AS statistic FROM (
        SELECT sum(sum(a)) OVER w AS ca, sum(sum(b)) OVER w AS cb, (SELECT count(*) FROM {EARLY}) AS na, (SELECT count(*) FROM {LATE}) AS nb FROM
        (SELECT {c} AS v, 1 AS a, 0 AS b FROM {EARLY} UNION ALL SELECT {c}, 0, 1 FROM {LATE}) GROUP BY v WINDOW w AS (ORDER BY v))"""
        for c in ("value", "user_id")
    ),
    floats="statistic",
)
def _(t: Tables):
    return D.ks_drift(*halves(t), ["value", "user_id"]).drop("p_value", "drifted")


@query(
    "m34_alerts",
    f"""WITH m AS (SELECT grp AS model, 'accuracy' AS metric, avg((y = yhat)::INTEGER) AS value FROM {CLASSED} GROUP BY 1
      UNION ALL SELECT grp, 'error_rate', avg((y <> yhat)::INTEGER) FROM {CLASSED} GROUP BY 1)
    SELECT model, metric, value, CASE metric WHEN 'accuracy' THEN 0.85 ELSE 0.05 END::DOUBLE AS "limit", 'warning' AS severity FROM m
    WHERE (metric = 'accuracy' AND value < 0.85) OR (metric = 'error_rate' AND value > 0.05)""",
    floats="value",
)
def _(t: Tables):
    hit = F.avg((F.col("y") == F.col("yhat")).cast("double"))
    wide = classed(t).groupBy(F.col("grp").alias("model")).agg(hit.alias("accuracy"), (1 - hit).alias("error_rate"))
    return D.threshold_alerts(wide.unpivot("model", ["accuracy", "error_rate"], "metric", "value"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(
    "m36_similar_items",
    f"""SELECT vec_id, {DOT.format(a='embedding', b='q')} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a='q', b='q')})) AS similarity
    FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 20""",
    floats="similarity",
)
def _(t: Tables):
    return D.similar_items(t.embeddings, "vec_id", "embedding", 0, 20)


@query(
    "m36_profile_similarity",
    """WITH p AS (SELECT DISTINCT 'p_type=' || p_type AS a, 'band=' || (p_size % 4) AS b FROM part)
    SELECT x.a || '|' || x.b AS profile_a, y.a || '|' || y.b AS profile_b, ((x.a = y.a)::INTEGER + (x.b = y.b)::INTEGER) / 2.0::DOUBLE AS similarity FROM p x CROSS JOIN p y""",
)
def _(t: Tables):
    return D.profile_similarity(t.part.withColumn("band", F.col("p_size") % 4), ["p_type", "band"])


COSINES = f"""SELECT x.vec_id AS a, y.vec_id AS b, {DOT.format(a='x.embedding', b='y.embedding')} / (sqrt({DOT.format(a='x.embedding', b='x.embedding')}) * sqrt({DOT.format(a='y.embedding', b='y.embedding')})) AS similarity
    FROM embeddings AS x JOIN embeddings AS y ON x.vec_id <> y.vec_id"""


@query(
    "m36_most_similar",
    f"""SELECT a AS vec_id, b AS neighbour, similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM ({COSINES})) WHERE rank <= 3""",
    floats="similarity",
    digits=9,
)
def _(t: Tables):
    return SI.most_similar(t.embeddings, "vec_id", "embedding", 3)


@query("m36_similar_pairs", f"SELECT a AS key_a, b AS key_b, similarity FROM ({COSINES}) WHERE a < b AND similarity >= 0.45", floats="similarity", digits=9)
def _(t: Tables):
    return SI.similar_pairs(t.embeddings, "vec_id", "embedding", 0.45)


@query(
    "m36_similar_profiles",
    """WITH p AS (SELECT DISTINCT p_brand, p_type, p_size FROM part), k AS (SELECT *, p_brand || '|' || p_type || '|' || p_size AS shown FROM p)
    SELECT a.shown AS profile_a, b.shown AS profile_b, ((a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT) / 3.0::DOUBLE AS similarity FROM k AS a JOIN k AS b
    ON (a.p_brand, a.p_type, a.p_size) < (b.p_brand, b.p_type, b.p_size) WHERE (a.p_brand = b.p_brand)::INT + (a.p_type = b.p_type)::INT + (a.p_size = b.p_size)::INT >= 2""",
    floats="similarity",
)
def _(t: Tables):
    shown = lambda side: F.concat_ws("|", *[F.col(f"{side}.v{i}").cast("string") for i in range(3)]).alias(side)
    return SI.similar_profiles(t.part, ["p_brand", "p_type", "p_size"], 2 / 3).select(shown("profile_a"), shown("profile_b"), "similarity")


@query(
    "m38_propagate",
    """WITH n AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part UNION ALL SELECT s_suppkey + 1000000000, s_nationkey, s_acctbal FROM supplier),
    e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem),
    u AS (SELECT a AS id, b AS other FROM e UNION SELECT b, a FROM e UNION SELECT id, id FROM n)
    SELECT u.id, avg(x) AS x, avg(y) AS y FROM u JOIN n ON n.id = other GROUP BY 1""",
    floats="x y",
    digits=9,
)
def _(t: Tables):
    offset = F.lit(1_000_000_000)
    parts = t.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("f"))
    suppliers = t.supplier.select((F.col("s_suppkey") + offset).alias("id"), F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal")).alias("f"))
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + offset).alias("b"))
    made = D.propagate(edges, parts.unionByName(suppliers), "a", "b", "id", "f")
    return made.select("id", F.get("f", F.lit(0)).alias("x"), F.get("f", F.lit(1)).alias("y"))


FINGERPRINTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
FIELDS_SQL = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FINGERPRINTED)


def fingerprint_sql(table: str, kinds: list[str]) -> str:
    schema = hashlib.md5(json.dumps(list(zip(FINGERPRINTED, kinds))).encode()).hexdigest()
    sums = " || '-' || ".join(f"sum(('0x' || substr(md5({FIELDS_SQL}), {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))
    return f"SELECT count(*) AS rows, '{schema}-' || {sums} AS content_hash FROM {table}"


@query("m39_fingerprint", fingerprint_sql("orders", ["bigint", "bigint", "string", "string"]))
def _(t: Tables):
    return D.fingerprint(t.orders, FINGERPRINTED)


@query(
    "m39_fingerprint_nulls",
    fingerprint_sql("(SELECT o_orderkey, nullif(o_custkey % 7, 0) AS o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_orderpriority || '|-' AS o_orderpriority FROM orders)", ["bigint", "bigint", "string", "string"]),
)
def _(t: Tables):
    status = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    key = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 7)
    return D.fingerprint(t.orders.withColumns({"o_custkey": key, "o_orderstatus": status, "o_orderpriority": F.concat("o_orderpriority", F.lit("|-"))}), FINGERPRINTED)


@query(
    "m40_feature_retrieval",
    """SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spend FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
    floats="spend",
    digits=2,
)
def _(t: Tables):
    features = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spend"))
    wanted = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return VR.select_entities(features, wanted, "o_custkey")


def _bucket_sql(key: str) -> str:
    out = "0"
    for i in range(4):
        out = f"(({out}) * 96 + ('0x' || substr(md5({key}::VARCHAR), {1 + 8 * i}, 8))::BIGINT) % 100"
    return out


@query("m41_ab_assignment", f"SELECT c_custkey, CASE WHEN {_bucket_sql('c_custkey')} < 30 THEN 'B' ELSE 'A' END AS variant FROM customer")
def _(t: Tables):
    return D.ab_assign(t.customer, "c_custkey", 0.3).select("c_custkey", "variant")


@query(
    "m41_ab_outcome",
    f"""SELECT variant, count(*) AS n, avg((CASE variant WHEN 'B' THEN alt ELSE yhat END = y)::INTEGER) AS accuracy FROM
    (SELECT *, CASE WHEN {_bucket_sql('doc_id')} < 50 THEN 'B' ELSE 'A' END AS variant FROM {SCORED}) GROUP BY 1""",
    floats="accuracy",
)
def _(t: Tables):
    assigned = D.ab_assign(scored(t), "doc_id")
    used = F.when(F.col("variant") == "B", F.col("alt")).otherwise(F.col("yhat"))
    return D.ab_outcome(assigned.withColumn("used", used), "used", "y")
