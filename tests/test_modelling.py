import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tabularium.operators import modelling as ML
from tabularium.operators import selection as L


@pytest.fixture(scope="module")
def table(spark):
    base = spark.range(400).select(
        "id",
        (F.rand(1) * 10).alias("a"),
        (F.rand(2) * 10).alias("noise"),
        F.when(F.col("id") % 3 == 0, "u").when(F.col("id") % 3 == 1, "v").alias("c"),
    )
    return base.withColumns({"label": (F.col("a") > 5).cast("int"), "y": 3 * F.col("a") + 1}).persist()


def test_selection_prefers_the_informative_column(table):
    assert ML.forest_selection(table, ["noise", "a"], "label", 1) == ["a"]
    assert ML.recursive_elimination(table, ["noise", "a"], "label", 1) == ["a"]
    assert ML.l1_selection(table, ["noise", "a"], "label", 1) == ["a"]
    for method in ("anova", "mutual_info", "forest"):
        assert L.select_features(table, ["noise", "a"], "label", method, k=1) == ["a"]


def test_fit_save_load_gives_equal_predictions(table, tmp_path):
    model = ML.TabularModel("classification", "logistic_regression", ["a", "noise"], ["c"]).fit(table)
    first = {r["id"]: r["probability_1"] for r in model.predict(table).collect()}
    model.save(str(tmp_path / "m"))
    again = ML.TabularModel.load(str(tmp_path / "m"), "classification", "logistic_regression", ["a", "noise"], ["c"])
    second = {r["id"]: r["probability_1"] for r in again.predict(table, threshold=0.5).collect()}
    assert first == pytest.approx(second) and all(0 <= p <= 1 for p in first.values())


def test_linear_model_explanations(table):
    model = ML.TabularModel("regression", "linear_regression", ["a", "noise"], label="y").fit(table)
    curve = ML.sensitivity(model.fitted, table, ["a", "noise"], "a", 0.0, 10.0, 3).collect()
    assert [r["prediction"] for r in curve] == pytest.approx([1.0, 16.0, 31.0], abs=1e-3)
    changed = ML.what_if(model.fitted, table, "id", {"a": lambda c: c + 1}).agg(F.avg("difference")).first()[0]
    assert changed == pytest.approx(3.0, abs=1e-3)
    loss = {r["feature"]: r["share"] for r in ML.permutation_importance(model.fitted, table, ["a", "noise"], "id", "y", "regression").collect()}
    assert loss["a"] > 0.99
    grid = ML.partial_dependence(model.fitted, table, "a").collect()
    assert len(grid) == 20 and grid[0]["average"] < grid[-1]["average"]


def test_permutation_importance_moves_only_what_the_model_reads(table):
    model = ML.TabularModel("regression", "linear_regression", ["a", "noise"], label="y").fit(table)
    seen = []

    class Spy:
        def transform(self, df):
            seen.append(df.columns)
            return model.fitted.transform(df)

    plain = ML.permutation_importance(model.fitted, table, ["a", "noise"], "id", "y", "regression").collect()
    got = ML.permutation_importance(Spy(), table, ["a", "noise"], "id", "y", "regression", inputs=["a", "noise"]).collect()
    assert [(r["feature"], r["importance"]) for r in got] == [(r["feature"], pytest.approx(r["importance"])) for r in plain]
    assert len(seen) == 3 and all(sorted(c) == ["a", "noise", "y"] for c in seen)


def test_partial_dependence_scores_equal_inputs_once(spark):
    rows = spark.range(300).select("id", (F.col("id") % 30).cast("double").alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("double").alias("b"))

    class Model:
        def transform(self, df):
            self.scored = df.withColumn("prediction", F.when(F.col("a") < 28, F.col("a") * 2 + F.coalesce("b", F.lit(7.0))))
            return self.scored

    model = Model()
    plain = ML.partial_dependence(model, rows, "a").collect()
    assert model.scored.count() == 300 * 20
    got = ML.partial_dependence(model, rows, "a", inputs=["a", "b"]).collect()
    assert model.scored.count() == 4 * 20 and [r["value"] for r in got] == [r["value"] for r in plain]
    assert all(x["average"] == pytest.approx(y["average"]) for x, y in zip(got, plain))


def test_auto_train_and_vote(table):
    report = ML.auto_train(table, "label", "id", ["a", "noise"], ["c"], models=["decision_tree", "logistic_regression"], vote=2)
    assert report.problem == "classification" and report.leaderboard.agg(F.max("score")).first()[0] > 0.9
    assert report.scored.count() == 80 or abs(report.scored.count() - 80) <= 2


def test_text_classes_are_voted_over_all_of_them(table):
    three = table.withColumn("kind", F.when(F.col("a") < 3, "low").when(F.col("a") < 7, "mid").otherwise("top"))
    report = ML.auto_train(three, "kind", "id", ["a", "noise"], models=["decision_tree", "logistic_regression", "random_forest"], vote=3)
    rows = report.scored.collect()
    assert {r["class"] for r in rows} == {"low", "mid", "top"} and sum(r["class"] == r["kind"] for r in rows) > 0.9 * len(rows)
    model = ML.TabularModel("classification", "decision_tree", ["a"], label="kind").fit(three)
    assert model.predict(three).filter("class = kind").count() > 380
    assert ML.forest_selection(three, ["noise", "a"], "kind", 1) == ["a"] and ML.l1_selection(three, ["noise", "a"], "kind", 1) == ["a"]


def test_medians_are_exact(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(101)] + [(None,)], "v double")
    made = ML.fit_preprocess(df, ["v"], scale=False).transform(df).filter("v IS NULL").select(ML.vector_to_array("features")[0]).first()[0]
    assert made == 2500.0


def test_random_grid_ends_with_repeated_values():
    estimator = ML.build("classification", "decision_tree")
    assert len(ML.random_grid(estimator, {"maxDepth": [3, 3, 5]}, 5)) == 2


def test_cluster_distances(table):
    made = ML.cluster_features(table.select("id", "a", "noise"), ["a", "noise"], 3)
    nearest = F.least("dist_to_cluster_0", "dist_to_cluster_1", "dist_to_cluster_2")
    assert made.filter(F.abs(nearest - F.col("dist_to_nearest_cluster")) > 1e-9).count() == 0


def test_skew_transforms_reduce_skew(spark):
    df = spark.range(2000).select("id", F.exp(F.randn(3)).alias("v"))
    made = ML.skew_transforms(df, ["v"])
    row = made.agg(F.skewness("v_yeo").alias("y"), F.skewness("v_quantile").alias("q"), F.avg("v_yeo").alias("m")).first()
    assert abs(row["y"]) < 0.3 and abs(row["q"]) < 0.3 and abs(row["m"]) < 1e-9


def test_registry(table):
    with pytest.raises(KeyError):
        ML.build("classification", "nothing")
    ML.register("classification", "stump", lambda **p: ML.build("classification", "decision_tree", maxDepth=1, **p))
    assert ML.build("classification", "stump", labelCol="label").getMaxDepth() == 1


@pytest.mark.parametrize("name", ["c13_preprocess", "f28_pca", "m08_cross_validation", "m09_random_search", "m11_stacking", "m12_batch_scoring", "m37_elbow", "n10_text_race"])
def test_unoracled_queries_return_rows(spark, sf_dir, name):
    assert name not in oracle_sql()
    assert queries()[name](spark, sf_dir).count() > 0


def test_permutation_importance_of_a_known_model(spark):
    """A model that doubles one column: the loss is that of the column moved round the hashed order."""
    import hashlib
    import random

    import numpy as np
    from pyspark.ml import Transformer

    class Doubled(Transformer):
        def _transform(self, df):
            return df.withColumn("prediction", 2.0 * F.col("a"))

    rows = [(i, float(i * i % 23), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame([(i, a, n, 2.0 * a) for i, a, n in rows], "id bigint, a double, noise double, y double")
    got = {r["feature"]: r["importance"] for r in ML.permutation_importance(Doubled(), df, ["a", "noise"], "id", "y", "regression").collect()}
    a = np.array([r[1] for r in sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest())])
    moved = np.roll(a, 1 + random.Random(42).randrange(59))
    # the score is r2, at first 1
    assert abs(got["a"] - np.mean((a - moved) ** 2) / np.var(a)) < 1e-9 and abs(got["noise"]) < 1e-12


def test_copies_of_a_rare_row_are_dealt_to_tasks(spark, monkeypatch):
    from tabularium.operators import monitoring as D

    monkeypatch.setattr(D, "COPIES_A_RUN", 100)
    df = spark.range(2001).select("id", (F.col("id") == 0).alias("y"))
    made = D.oversample(df, "y", "id")
    assert {r["y"]: r["n"] for r in made.groupBy("y").agg(F.count("*").alias("n")).collect()} == {True: 2000, False: 2000}
    rare = made.filter("y")
    assert rare.select(F.spark_partition_id()).distinct().count() > 1 and rare.select("copy").distinct().count() == 2000


def test_adaptive_search_needs_fewer_full_fits(spark):
    df = spark.range(1500).select("id", (F.rand(3) * 8).alias("a"), (F.rand(4) * 8).alias("b"))
    df = ML.assemble(df.withColumn("label", (F.floor("a") % 2).cast("double")), ["a", "b"]).persist()
    space, tree = {"maxDepth": [1, 2, 3, 4, 6, 8, 10], "minInstancesPerNode": [1, 2, 5, 50]}, ML.build("classification", "decision_tree")
    runs = [ML.adaptive_search(df, tree, space, "label", "classification", "id", n=14, first=4, shares=(0.3, 0.6, 1.0)) for _ in range(2)]
    tables = [sorted(map(tuple, ((r["trial"], r["share"], r["score"]) for r in t.collect()))) for _, t in runs]
    assert tables[0] == tables[1] and len({t for t, *_ in tables[0]}) == 14
    full = [s for _, share, s in tables[0] if share == 1.0]
    _, grid = ML.search(df, tree, space, "label", "classification", n=14)
    assert len(full) + 1 <= 4 < grid.count() and max(full) >= grid.agg(F.max("score")).first()[0] - 0.05
    assert runs[0][0].getMaxDepth() >= 3


def test_proposals_turn_to_good_values():
    tried = {(i, j): -abs(i - 5) - abs(j - 2) for i in (0, 3, 5, 7) for j in (0, 2, 3)}
    made = [ML.Parzen({"a": list(range(8)), "b": list(range(4))}, seed).propose(tried, set(tried)) for seed in range(20)]
    assert not set(made) & set(tried) and sum(abs(i - 5) <= 1 and abs(j - 2) <= 1 for i, j in made) >= 15
    assert len({ML.Parzen({"a": [1, 2], "b": [1, 2]}, 1).propose({}, {(0, 0), (0, 1), (1, 0)})}) == 1


def test_normal_scores_of_exact_ranks(spark, small_groups):
    from statistics import NormalDist

    import numpy as np
    import pandas as pd

    x = np.r_[np.random.default_rng(2).exponential(size=200).round(1), [np.nan, 50.0]]
    df = spark.createDataFrame([(i, None if i == 7 else float(v)) for i, v in enumerate(x)], "id int, x double")
    x[7] = np.nan
    got = ML.quantile_normal(df, "x").toPandas().sort_values("id")["x_quantile"].to_numpy(float)
    ranks = pd.Series(x).rank()
    share = (ranks - 1) / (ranks.count() - 1)
    want = [np.nan if np.isnan(p) else NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in share]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_classes_are_numbered_without_a_shuffle_of_the_rows(spark):
    df = spark.range(4000, numPartitions=8).selectExpr("id", "CAST(id % 2 AS string) AS label", "CAST(id AS double) AS x")
    adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ML.with_target(df, "label", "classification").persist()
        sizes = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        made.unpersist()
        assert len(sizes) == 8 and max(sizes) == 500
        model = ML.TabularModel("classification", "decision_tree", ["x"]).fit(df)
        plan = model.predict(df)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", adaptive)


def test_learning_curve_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    df = spark.range(1000).select("id", F.col("id").cast("double").alias("y"), counted("id").alias("x"))
    ready = ML.assemble(df, ["x"])
    curve = ML.learning_curve(ready.filter("id < 800"), ready.filter("id >= 800"), ML.build("regression", "linear_regression", labelCol="y"), "id", "y", "regression", sizes=3).collect()
    assert [r["share"] for r in curve] == [1 / 3, 2 / 3, 1.0] and curve[-1]["rows"] == 800
    # each row is made once; the plan calls the function twice a row
    assert seen.value <= 2000


def test_graded_rows_are_written_once(spark, tmp_path):
    from tabularium.plans.modelling import graded
    from tabularium.plans.registry import Tables

    texts = [(1, "Ab 12  3\n x-y!", "en"), (2, "", "de"), (3, " é٣ ..\t", None), (4, None, "en"), (5, "unlabelled", "en")]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3, 4)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = graded(Tables(spark, str(tmp_path)))
    # a fit reads these rows many times, so no plan over them goes back to the texts
    assert not [f for f in rows.inputFiles() if "documents" in f]
    assert sorted(map(tuple, rows.drop("lang").collect())) == [(1, 1, 14, 4, 3, 12), (2, 0, 0, 1, 0, 0), (3, 1, 7, 4, 0, 5), (4, 0, None, None, None, None)]
