"""Edge cases: NULL, NaN, infinities, constants, ties, empty and single-row tables, scripts."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.functions import pvalues
from tabularium.functions.guarded import clip, corr, nan_to_null, sample_kurtosis, sample_skew
from tabularium.operators import versioning as VR
from tabularium.operators import aggregate as A
from tabularium.operators import cleaning as C
from tabularium.operators import encoders as E
from tabularium.operators import features as X
from tabularium.operators import metrics as M
from tabularium.operators import monitoring as D
from tabularium.operators import privacy as V
from tabularium.operators import profile as P
from tabularium.operators import quality as Q
from tabularium.operators import relational as R
from tabularium.operators import text as N


def test_group_sum_example(spark):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), ("B", 40), (None, 5)], "category string, value bigint")
    assert {r["category"]: r["value"] for r in A.GroupBy(df, ["category"]).sum("value").collect()} == {"A": 30, "B": 70}
    assert A.GroupBy(df, ["category"], keep_null_keys=True).count().count() == 3


def test_sum_of_all_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert A.aggregate(df, {"v": ["sum", "mean"]}).first() == (0.0, None)


def test_guarded_moments(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (None, 3.0), (4.0, 3.0)], "x double, c double")
    row = df.agg(corr("x", "c").alias("r"), sample_skew("c").alias("g"), sample_kurtosis("x").alias("k")).first()
    assert row == (None, None, None)
    assert df.select(clip("x", 1.5, 3.0)).collect()[2][0] is None


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "v double")
    assert nan_to_null(df).filter("v IS NULL").count() == 1
    assert [r[0] for r in C.fill_all(nan_to_null(df)).collect()] == [1.0, 1.0, 0.0]


def test_qcut_merges_repeated_edges(spark):
    values = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in X.quantile_bins(df, "v", 5, "b").orderBy("i").select("b").collect()] == [0, 0, 0, 1, 2, 2, 3, 3, 4, 4]
    constant = df.withColumn("v", F.lit(2.0))
    assert X.quantile_bins(constant, "v", 5, "b").filter("b IS NOT NULL").count() == 0


def test_numeric_transforms_respect_the_minimum(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 2.0), (4.0, 9.0, 8.0)], "neg double, zero double, pos double")
    made = set(X.numeric_transforms(df, ["neg", "zero", "pos"]).columns)
    assert {"pos_log", "pos_reciprocal", "zero_sqrt", "zero_log1p"} <= made
    assert not {"neg_log1p", "zero_log", "zero_reciprocal"} & made


def test_scaler_statistics_and_inverse(spark):
    df = spark.createDataFrame([(1.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "a double, c double")
    for method in ("standard", "minmax", "robust"):
        scaler = E.Scaler(["a", "c"], method).fit(df)
        scaled = scaler.transform(df)
        back = scaler.inverse(scaled).orderBy("a").collect()
        assert [r["a"] for r in back] == pytest.approx([1.0, 4.0, 9.0])
    mean, std = E.Scaler(["a"]).fit(df).transform(df).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(mean) < 1e-12 and std == pytest.approx(1.0)


def test_label_encoder_round_trip_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    encoder = E.LabelEncoder("v").fit(df)
    coded = {r["v"]: r["v_code"] for r in encoder.transform(df).collect()}
    assert coded == {"a": 0, "b": 1, "c": 2, None: -1}
    unseen = spark.createDataFrame([("z",)], "v string")
    assert encoder.transform(unseen).first()["v_code"] == -1


def test_leave_one_out_singleton(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "g string, y int")
    got = {(r["g"], r["y"]): r["loo_rate"] for r in E.leave_one_out(df, None, "g", "y").collect()}
    assert got[("a", 1)] == 0.0 and got[("a", 0)] == 1.0 and got[("b", 1)] == pytest.approx(2 / 3)


def test_binary_type_order_flag(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(30)], "two int, many int")
    assert {r[0]: r[1] for r in P.semantic_types(df).collect()} == {"two": "categorical_numeric", "many": "id"}
    assert {r[0]: r[1] for r in P.semantic_types(df, binary_first=True).collect()}["two"] == "binary"


def test_normality_flag(spark):
    rng = spark.range(4000).select(F.randn(5).alias("n"), F.exp(F.randn(6)).alias("skewed"))
    flags = {r["column"]: r["is_normal"] for r in P.numeric_profile(rng).collect()}
    assert flags["skewed"] is False
    assert P.numeric_profile(rng.limit(10)).first()["is_normal"] is None


def test_wide_profiles_are_cut_into_passes(spark, monkeypatch):
    monkeypatch.setattr(P, "AGGREGATES_PER_PASS", 3)
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 2.0)], "a int, b string, c double")
    got = {r["column"]: (r["missing"], r["unique"]) for r in P.column_profile(df).collect()}
    assert got == {"a": (0, 2), "b": (1, 1), "c": (0, 1)}


def test_gate_rejects_small_table(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "x int, y int")
    rows = {r["rule"]: r for r in Q.problem_gate(df, "y").collect()}
    assert rows["min_rows"]["failed"] and rows["min_rows"]["status"] == "rejected" and rows["min_rows"]["confidence"] == 0.0


def test_leakage_is_found(spark):
    df = spark.range(200).select("id", (F.col("id") * 2.0 + 1).alias("leak"), (F.col("id") % 7).alias("noise"), F.col("id").cast("double").alias("y"))
    rows = {r["rule"]: r for r in Q.data_gate(df, "y", ["id"]).collect()}
    assert rows["leaking_columns"]["value"] >= 1 and rows["leaking_columns"]["status"] == "rejected"


def test_pii_overlaps_and_scripts(spark):
    text = "mail a.b@c.org, card 1234-5678-9012-3456, call 555-123-4567, ip 10.0.0.1, ssn 123-45-6789, born 1/2/1990, é123-45-6789"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    found = V.detect_pii(df, "t").first()["pii"]
    assert found["email"] == ["a.b@c.org"] and found["ssn"] == ["123-45-6789"] and found["ip_address"] == ["10.0.0.1"]
    assert "1234-5678-9012-3456" in found["credit_card"]
    masked = V.mask_pii(df, "t", "ssn").first()["t"]
    assert "[SSN_MASKED]" in masked and "é123-45-6789" in masked


def test_k_anonymity_borders(spark):
    rows = [("a", 1)] * 4 + [("b", 1)] * 5 + [("c", None)] * 6
    df = spark.createDataFrame(rows, "q string, r int")
    got = V.k_anonymise(df, ["q", "r"], 5)
    assert got.filter("q = '*'").count() == 4 and got.filter("r = '*'").count() == 4
    assert got.filter("q = 'c' AND r IS NULL").count() == 6


def test_randomised_response_rate(spark):
    df = spark.range(20_000).select("id", F.lit(True).alias("b"))
    p = math.e / (1 + math.e)
    share = V.randomised_response(df, "b", ["id"]).agg(F.avg(F.col("b").cast("int"))).first()[0]
    assert share == pytest.approx(p + (1 - p) / 2, abs=0.02)


def test_private_mean_is_near_the_clipped_mean(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 100).alias("v"))
    exact = V.clipped_means(df, ["g"], "v", (0.0, 50.0)).first()["clipped_mean"]
    for delta in (None, 1e-5):
        released = V.private_means(df, ["g"], "v", (0.0, 50.0), delta=delta)
        assert released.columns == ["g", "private_mean"] and abs(released.first()["private_mean"] - exact) < 1.0
    assert V.private_counts(df, ["g"]).columns == ["g", "private_count"]
    # without a seed no two releases share their noise
    assert V.private_means(df, ["g"], "v", (0.0, 50.0)).first() != V.private_means(df, ["g"], "v", (0.0, 50.0)).first()


def test_arabic_text(spark):
    df = spark.createDataFrame([("هذا المنتج ممتاز رائع جدا",), ("خدمة سيء مشكلة",), ("plain words",)], "t string")
    assert [r[0] for r in N.detect_language(df, "t").select("language").collect()] == ["ar", "ar", "en"]
    s = N.sentiment_summary(df, "t", "ar").first()
    assert (s["positive"], s["negative"], s["neutral"]) == (1, 1, 1)


def test_bigrams(spark):
    df = spark.createDataFrame([(1, "red green blue"), (2, "red"), (3, "")], "k int, t string")
    got = {r["k"]: r["x"] for r in df.select("k", N.terms("t", 2, []).alias("x")).collect()}
    assert got == {1: ["red", "green", "blue", "red green", "green blue"], 2: ["red"], 3: []}


def test_auc_bounds_and_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first()["auc"] == 1.0
    assert M.roc_auc(df.withColumn("s", F.lit(0.5)), "y", "s").first()["auc"] == 0.5
    one_class = df.filter("y = 1")
    assert M.roc_auc(one_class, "y", "s").first()["auc"] is None


def test_roc_auc_ovr_against_pairs(spark):
    rows = [("a", 0.7, 0.2, 0.1), ("a", 0.3, 0.4, 0.3), ("b", 0.2, 0.5, 0.3), ("c", 0.1, 0.3, 0.6), ("c", 0.5, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "y string, a double, b double, c double")
    total = 0.0
    for i, c in enumerate("abc"):
        pos = [r[i + 1] for r in rows if r[0] == c]
        neg = [r[i + 1] for r in rows if r[0] != c]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        total += wins * len(pos) / len(rows)
    assert M.roc_auc_ovr(df, "y", {"a": "a", "b": "b", "c": "c"}).first()["auc"] == pytest.approx(total)


def test_p_values():
    assert pvalues.student_t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert pvalues.student_t_two_sided(2.0, 1) == pytest.approx(0.29516724, abs=1e-6)
    assert pvalues.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.kolmogorov(0.0, 10, 10) == 1.0
    assert pvalues.kolmogorov(0.5, 100, 100) < 1e-6


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(i % 2, i % 2, 0) for i in range(400)], "y int, a int, b int")
    first = M.bootstrap_interval(M.bootstrap_accuracy(df, "y", "a", "b", 200)).first()
    assert first == M.bootstrap_interval(M.bootstrap_accuracy(df, "y", "a", "b", 200)).first()
    assert first["significant"] and first["mean"] == pytest.approx(0.5, abs=0.05)


def test_bootstrap_sums_equal_row_by_row(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    got = sorted(M.bootstrap_sums(df, {"a": F.col("a"), "b": F.col("b")}, "k", 40, seed=3).collect())
    limits, want = M.poisson_limits(), [[0.0, 0.0, 0.0] for _ in range(40)]
    for k, a, b in rows:
        h = int(hashlib.md5(f"3|{k}".encode()).hexdigest()[:8], 16)
        for r in range(40):
            u = pow(h + (r + 1) * M.STEP, 5, M.PRIME) / M.PRIME
            w = sum(u >= limit for limit in limits)
            want[r] = [want[r][0] + w, want[r][1] + w * a, want[r][2] + w * (b or 0.0)]
    assert all(list(g)[1:] == pytest.approx(w) for g, w in zip(got, want))
    weights = [r["weight"] for r in got]
    assert 2850 < sum(weights) / 40 < 3150 and 20 < pd.Series(weights).std() < 110


def test_balancing_counts(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("small").alias("c"))
    over = {r["c"]: r["count"] for r in D.oversample(df, "c", "id").groupBy("c").count().collect()}
    under = {r["c"]: r["count"] for r in D.undersample(df, "c", "id").groupBy("c").count().collect()}
    assert over == {"big": 90, "small": 90} and under == {"big": 10, "small": 10}


def test_ab_bucket_matches_md5_modulo(spark):
    import hashlib

    df = spark.range(50)
    got = {r[0]: r[1] for r in df.select("id", D.ab_bucket("id")).collect()}
    assert got == {i: int(hashlib.md5(str(i).encode()).hexdigest(), 16) % 100 for i in range(50)}


def test_fingerprint_tells_values_types_and_nulls_apart(spark):
    tables = [
        spark.createDataFrame([("a|b", "c")], "x string, y string"), spark.createDataFrame([("a", "b|c")], "x string, y string"),
        spark.createDataFrame([(None, "\\N")], "x string, y string"), spark.createDataFrame([("\\N", None)], "x string, y string"),
        spark.createDataFrame([("a|b", "c")], "x string, z string"), spark.createDataFrame([("1", "2")], "x string, y string"), spark.createDataFrame([("1", 2)], "x string, y int"),
    ]
    assert len({D.fingerprint(t).first()["content_hash"] for t in tables}) == len(tables)


def test_versions_keep_tables_with_close_content(spark, tmp_path):
    store = VR.DatasetVersions(spark, str(tmp_path))
    a, b = spark.createDataFrame([("a|b", "c")], "x string, y string"), spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert [store.save(t, "t") for t in (a, b, a)] == [1, 2, 1] and store.load("t").collect() == b.collect()


def test_as_of_join_with_nulls_and_ties(spark):
    from tabularium.operators import sqlsurface as S

    long = "k" * 21
    right = spark.createDataFrame([("u", 5, long + "1", 1.0), ("u", 5, long + "2", 2.0), (None, 1, "a", 9.0), ("u", None, "a", 8.0), ("v", 1, "a", 7.0)], "k string, ts int, tie string, x double")
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 4), (3, None, 9), (4, "u", None), (5, "v", 1)], "id int, k string, ts int")
    want = {1: 2.0, 2: None, 3: None, 4: None, 5: 7.0}
    for frame in (right, right.orderBy(F.desc("tie")).repartition(3)):
        assert {r["id"]: r["x"] for r in S.as_of_join(left, frame, ["k"], "ts", "ts", ["id"], ["tie"], ["x"]).collect()} == want
    # negative keys compare as numbers
    numbers = spark.createDataFrame([("u", 5, -5, 1.0), ("u", 5, -1, 2.0)], "k string, ts int, tie int, x double")
    assert S.as_of_join(left, numbers, ["k"], "ts", "ts", ["id"], ["tie"], ["x"]).filter("id = 1").first()["x"] == 2.0


def test_semantic_types_of_odd_columns(spark, monkeypatch):
    rows = [(str(i), f"{i}.5" if i != 4 else "4x", f"2024-01-0{i + 1}", "2024-01-01" if i != 3 else "3rd", None, f"k{i}", 0.0 if i % 2 else -0.0, "a@b.c" if i else None) for i in range(8)]
    df = spark.createDataFrame(rows, "num string, broken string, day string, broken_day string, none string, code string, zero double, mail string")
    counted, real = [], F.count_distinct
    monkeypatch.setattr(F, "count_distinct", lambda c, *more: counted.append(c) or real(c, *more))
    got = {r[0]: r[1] for r in P.semantic_types(df).collect()}
    # the ends of both broken columns have the form, one value between them has not
    assert got == {"num": "numeric_string", "broken": "id", "day": "datetime_string", "broken_day": "categorical", "none": "numeric_string", "code": "id", "zero": "categorical_numeric", "mail": "email"}
    # values are counted only where no form has decided
    assert len(counted) == 4
    assert {r[1] for r in P.semantic_types(df.limit(0)).collect()} == {"numeric_string", "categorical_numeric"}


def test_propagate_small_graph(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 3), (3, 0)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id bigint, x array<double>")
    got = {r["id"]: r["x"] for r in D.propagate(edges, nodes, "src", "dst", "id", "x").collect()}
    assert got[0] == pytest.approx([(0 + 1 + 3) / 3, 1.0]) and got[2] == pytest.approx([2.0, 1.0])


def test_propagate_deals_edges_by_their_number(spark, small_groups):
    # 1,000 edges, each given twice in both directions, one loop, one open end, and a neighbour that is no node
    ring = spark.range(1000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 1000).alias("dst"))
    odd = spark.createDataFrame([(5, 5), (7, None), (3, 5000)], "src bigint, dst bigint")
    edges = ring.union(ring).union(ring.select("dst", "src")).union(odd)
    nodes = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    made = D.propagate(edges, nodes, "src", "dst", "id", "x")
    # 3,003 rows at 25 a task, whatever the session's number of partitions
    assert "RepartitionByExpression [__a" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and ", 121" in plan
    got = {r["id"]: r["x"][0] for r in made.collect()}
    assert len(got) == 1001 and got[5000] == 3.0 and got[3] == 3.0 and got[5] == 5.0 and got[0] == pytest.approx(1000 / 3)


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") % 3)
    assert D.fingerprint(a).first() == D.fingerprint(a.orderBy(F.desc("id")).repartition(5)).first()
    assert D.fingerprint(a).first() != D.fingerprint(a.withColumn("v", F.lit(0))).first()


def test_empty_table_profiles(spark):
    df = spark.createDataFrame([], "a double, b string")
    over = P.overview(df).first()
    assert over["rows"] == 0 and over["missing_pct"] == 0.0
    assert A.describe(df).first()["count"] == 0
    assert A.histogram(df, "a").count() == 0


@pytest.mark.parametrize("texts, k", [(["a1 b1 c1 a1 b1", "a1 b1 d1", None, "c1 c1 d1 e1 a1 b1", "b1", ""], 4), (["aa bb cc", "cc dd", "ee ff"], 5), (["aa bb"], 50)])
def test_tfidf_counts_the_kept_terms_alone(spark, monkeypatch, texts, k):
    from collections import Counter

    kept = {}
    plain = N.saved
    monkeypatch.setattr(N, "saved", lambda df, label: kept.setdefault(label, plain(df, label)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["i"], r["term"]): (r["tf"], r["df"]) for r in N.tfidf(df, "i", "t", ngrams=2, max_features=k, stop=[]).collect()}
    grams = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in ((i, (t or "").split()) for i, t in enumerate(texts))}
    total = sum(grams.values(), Counter())
    terms = sorted(total, key=lambda t: (-total[t], t))[:k]
    assert got == {(i, t): (g[t], sum(t in o for o in grams.values())) for i, g in grams.items() for t in terms if t in g}
    assert kept["tfidf"].count() == len(got)
