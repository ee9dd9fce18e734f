"""Training-workflow queries on whole tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import modelling as ML
from ..operators import monitoring as D
from ..operators import similarity as SI
from ..operators import timeseries as TS
from ..operators import versioning as VR
from ..streaming.sources import scratch_folder
from .registry import Tables, query

NUMERIC = ["chars", "words", "digits", "symbols"]


def graded(t: Tables):
    """Labelled documents with simple numeric traits, written once: fits and scores read these rows, not the texts.

    Traits are told before the join, so no text is shuffled.
    """
    count = lambda p: F.length("text") - F.length(F.regexp_replace("text", p, ""))
    traits = t.documents.select(
        "doc_id",
        "lang",
        F.length("text").alias("chars"),
        F.size(F.split("text", r"\s+")).alias("words"),
        count(r"\d+").alias("digits"),
        count(r"[\p{L}\p{N}\s]+").alias("symbols"),
    )
    rows = traits.join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    return SI.saved(rows.select("doc_id", "lang", "label", *NUMERIC), "graded")


def priced(t: Tables):
    """Line items with part traits; the price is the outcome."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "p_retailprice",
        F.col("p_size").cast("double").alias("p_size"),
        F.col("l_extendedprice").alias("label"),
    )


PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_retailprice", "p_size"]


def price_model(t: Tables, name: str = "linear_regression"):
    return ML.TabularModel("regression", name, PRICE_FEATURES).fit(priced(t))


@query("c13_preprocess")
def _(t: Tables):
    rows = graded(t)
    fitted = ML.fit_preprocess(rows, NUMERIC, ["lang"])
    sized = fitted.transform(rows).select("doc_id", ML.vector_to_array("features").alias("v"))
    return sized.select("doc_id", F.size("v").alias("slots"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("m05_preprocess_plan")
def _(t: Tables):
    fitted = ML.fit_preprocess(priced(t), PRICE_FEATURES, [], scale=True)
    v = ML.vector_to_array("features")
    made = fitted.transform(priced(t)).select(*[F.get(v, F.lit(i)).alias(c) for i, c in enumerate(PRICE_FEATURES)])
    return made.agg(*[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in PRICE_FEATURES], *[F.round(F.stddev_samp(c), 6).alias(f"{c}_std") for c in PRICE_FEATURES])


@query("f23_cluster_features")
def _(t: Tables):
    return ML.cluster_features(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], k=4)


@query("f24_skew_transforms")
def _(t: Tables):
    return ML.skew_transforms(t.events.select("event_id", "value"), ["value"]).drop("value")


@query("f28_pca")
def _(t: Tables):
    made, _ = ML.pca(t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]),
                     ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return made.select("l_orderkey", "l_linenumber", F.round(F.abs("pc_1"), 6).alias("pc_1"), F.round(F.abs("pc_2"), 6).alias("pc_2"))


def _named(t: Tables, names: list[str]):
    return t.spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank int, feature string")


@query("l06_forest_selection")
def _(t: Tables):
    return _named(t, ML.forest_selection(graded(t), NUMERIC, "label", 3))


@query("l07_recursive_elimination")
def _(t: Tables):
    return _named(t, ML.recursive_elimination(priced(t), PRICE_FEATURES, "label", 2, "regression"))


@query("l08_l1_selection")
def _(t: Tables):
    return _named(t, ML.l1_selection(priced(t), PRICE_FEATURES, "label", problem="regression", strength=10.0))


@query("m06_model_registry")
def _(t: Tables):
    ready = D.hash_split(ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC), "doc_id")
    models = {n: ML.build("classification", n) for n in ("decision_tree", "logistic_regression", "naive_bayes")}
    return ML.race(ready.filter("split = 'train'"), ready.filter("split = 'test'"), models, "label", "classification")[1]


@query("m07_fit_save_load_predict")
def _(t: Tables):
    rows, path = graded(t), scratch_folder(t.spark, "model")
    ML.TabularModel("classification", "logistic_regression", NUMERIC, ["lang"]).fit(rows).save(path)
    loaded = ML.TabularModel.load(path, "classification", "logistic_regression", NUMERIC, ["lang"])
    return loaded.predict(rows, threshold=0.5).select("doc_id", F.round("probability_1", 6).alias("probability_1"), "prediction")


@query("m08_cross_validation")
def _(t: Tables):
    ready = ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC)
    models = {n: ML.build("classification", n) for n in ("decision_tree", "logistic_regression")}
    return ML.cross_validate(ready, models, "doc_id", "label", "classification", k=3)


@query("m09_random_search")
def _(t: Tables):
    ready = ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC)
    _, trials = ML.search(ready, ML.build("classification", "decision_tree"), ML.SPACES["decision_tree"], "label", "classification", n=4)
    return trials.select("trial", F.to_json("params").alias("params"), "score")


@query("m09_adaptive_search")
def _(t: Tables):
    ready = ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC)
    _, trials = ML.adaptive_search(ready, ML.build("classification", "decision_tree"), ML.SPACES["decision_tree"], "label", "classification", "doc_id", n=6, first=3)
    return trials.select("trial", F.to_json("params").alias("params"), "share", "score")


@query("m10_auto_train")
def _(t: Tables):
    report = ML.auto_train(graded(t), "label", "doc_id", NUMERIC, ["lang"], models=["decision_tree", "logistic_regression"])
    return report.leaderboard


@query("m10_auto_train_text_classes")
def _(t: Tables):
    """The order status, three text classes, from the shares of line states of the order."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("done"), F.count(F.lit(1)).cast("double").alias("lines"))
    report = ML.auto_train(t.orders.join(lines, "o_orderkey"), "o_orderstatus", "o_orderkey", ["done", "lines", "o_totalprice"], ["o_orderpriority"], models=["decision_tree", "logistic_regression"], vote=2)
    return report.scored.groupBy("o_orderstatus", "class").agg(F.count(F.lit(1)).alias("n"))


@query("m11_soft_vote")
def _(t: Tables):
    ready = D.hash_split(ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC), "doc_id")
    fitted = {n: ML.build("classification", n).fit(ready.filter("split = 'train'")) for n in ("decision_tree", "logistic_regression")}
    return ML.soft_vote(ready.filter("split = 'test'"), fitted, "classification").select("doc_id", F.round("vote", 6).alias("vote"), "prediction")


@query("m11_stacking")
def _(t: Tables):
    ready = ML.assemble(graded(t).withColumn("label", F.col("label").cast("double")), NUMERIC)
    models = {n: ML.build("classification", n) for n in ("decision_tree", "logistic_regression")}
    base, top = ML.stack(ready, models, "doc_id", "label", "classification", k=3)
    return ML.stack_predict(ready, base, top).select("doc_id", "prediction")


@query("m12_batch_scoring")
def _(t: Tables):
    model = price_model(t)
    written = ML.score_batch(model.fitted, priced(t), scratch_folder(t.spark, "scores"))
    return written.select("key", F.round("prediction", 4).alias("prediction"))


@query("m13_importance")
def _(t: Tables):
    model = price_model(t, "decision_tree")
    return ML.importances(model.fitted.stages[-1], PRICE_FEATURES, t.spark)


@query("m14_permutation_importance")
def _(t: Tables):
    return ML.permutation_importance(price_model(t).fitted, priced(t), ["l_quantity", "l_tax"], "key", "label", "regression", inputs=PRICE_FEATURES)


@query("m15_partial_dependence")
def _(t: Tables):
    return ML.partial_dependence(price_model(t).fitted, priced(t), "l_quantity", inputs=PRICE_FEATURES)


@query("m17_what_if")
def _(t: Tables):
    made = ML.what_if(price_model(t).fitted, priced(t), "key", {"l_quantity": lambda c: c * 1.1, "l_tax": 0.0})
    return made.select("key", *[F.round(c, 4).alias(c) for c in ("original", "scenario", "difference", "percent")])


@query("m18_sensitivity")
def _(t: Tables):
    return ML.sensitivity(price_model(t).fitted, priced(t), PRICE_FEATURES, "l_quantity", 1.0, 50.0)


@query("m19_learning_curve")
def _(t: Tables):
    ready = D.hash_split(ML.assemble(priced(t), PRICE_FEATURES), "key")
    train, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    return ML.learning_curve(train, test, ML.build("regression", "linear_regression"), "key", "label", "regression", sizes=4)


@query("m26_silhouette")
def _(t: Tables):
    from pyspark.ml.evaluation import ClusteringEvaluator

    ready = t.embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("prediction"))
    return t.spark.createDataFrame([(float(ClusteringEvaluator().evaluate(ready)),)], "silhouette double")


@query("m35_recommendations")
def _(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ratings = joined.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.sum("l_quantity").alias("rating"))
    return ML.recommend(ratings, "user", "item", "rating", k=5, rank=5, iterations=3)


@query("m37_elbow")
def _(t: Tables):
    ready = t.embeddings.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return ML.elbow(ready, "features", [2, 4, 6, 8])


@query("m42_model_versions", """SELECT 'price' AS model, 2::INTEGER AS version, count(*)::DOUBLE AS rows FROM lineitem""")
def _(t: Tables):
    n = t.lineitem.count()
    events = [
        VR.register_model(t.spark, "price", 1, {"rows": n}, "models/price/1", "2024-01-01T00:00:00"),
        VR.transition(t.spark, "price", 1, "production", "2024-01-02T00:00:00"),
        VR.register_model(t.spark, "price", 2, {"rows": n}, "models/price/2", "2024-01-03T00:00:00"),
        VR.transition(t.spark, "price", 1, "archived", "2024-01-04T00:00:00"),
        VR.transition(t.spark, "price", 2, "production", "2024-01-04T00:00:00"),
    ]
    log = events[0]
    for e in events[1:]:
        log = log.unionByName(e)
    return VR.latest_production(log).select("model", "version", F.col("metrics")["rows"].alias("rows"))


@query(
    "m42_version_log",
    """WITH l AS (SELECT user_id::VARCHAR AS model, (event_id % 5)::INTEGER AS version, event_type = 'view' AS registered, CASE event_type WHEN 'purchase' THEN 'production' WHEN 'view' THEN 'none' ELSE 'archived' END AS stage, value, ts FROM events),
    m AS (SELECT model, version, arg_max(stage, ts) AS stage, arg_max(value, ts) FILTER (WHERE registered) AS value FROM l GROUP BY 1, 2)
    SELECT model, version, value FROM m WHERE stage = 'production' QUALIFY row_number() OVER (PARTITION BY model ORDER BY version DESC) = 1""",
)
def _(t: Tables):
    kind = F.col("event_type")
    registered = kind == "view"
    log = t.events.select(
        F.col("user_id").cast("string").alias("model"),
        (F.col("event_id") % 5).cast("int").alias("version"),
        F.when(registered, "register").otherwise("transition").alias("event"),
        F.when(kind == "purchase", "production").when(registered, "none").otherwise("archived").alias("stage"),
        F.when(registered, F.create_map(F.lit("value"), F.col("value"))).alias("metrics"),
        F.when(registered, F.concat(F.lit("models/"), F.col("event_id").cast("string"))).alias("path"),
        F.col("ts").alias("at"),
    )
    return VR.latest_production(log).select("model", "version", F.col("metrics")["value"].alias("value"))


@query("m39_dataset_versions", """SELECT 1::INTEGER AS version, count(*) AS rows FROM customer UNION ALL SELECT 2, count(*) FROM customer WHERE c_acctbal > 0""")
def _(t: Tables):
    store = VR.DatasetVersions(t.spark, scratch_folder(t.spark, "versions"))
    store.save(t.customer, "customer")
    store.save(t.customer.orderBy(F.desc("c_custkey")), "customer")
    store.save(t.customer.filter("c_acctbal > 0"), "customer")
    return store.versions("customer").select("version", "rows")


@query("m40_feature_store", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t: Tables):
    store = VR.FeatureStore(t.spark, scratch_folder(t.spark, "features"))
    store.register("balance", t.customer.select("c_custkey", "c_acctbal"), "c_custkey")
    wanted = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return store.features("balance", wanted)


def lagged(t: Tables):
    made = TS.supervised(t.events, "ts", "value", ["user_id"], ["event_id"], shift=1)
    return TS.temporal_split(made, ["ts", "event_id"], ["user_id"])


@query("t05_forecast_race")
def _(t: Tables):
    made = lagged(t).persist()
    board = ML.forecast_race(made.filter("split = 'train'"), made.filter("split = 'test'"), TS.FEATURES, "value")[2]
    made.unpersist()
    return board


@query("n10_text_race")
def _(t: Tables):
    return ML.text_race(t.documents.join(t.labels, "doc_id"), "text", "quality", "doc_id")


@query("u04_scenario_callable")
def _(t: Tables):
    made = ML.what_if(price_model(t).fitted, priced(t), "key", {"p_retailprice": lambda c: F.greatest(c - 50, F.lit(0.0))})
    return made.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difference"), 4).alias("mean_difference"))
