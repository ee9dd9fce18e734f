import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from __spark_entry__ import queries
from tabularium.functions import lexicon
from tabularium.operators import modelling as ML
from tabularium.operators import text as N
from tabularium.operators.forest import SparseForest


def test_the_query_races_all_four_models(spark, sf_dir):
    board = queries()["n10_text_race"](spark, sf_dir).collect()
    assert {r["model"] for r in board} == {"naive_bayes", "logistic_regression", "linear_svc", "random_forest"}
    assert [r["f1"] for r in board] == sorted((r["f1"] for r in board), reverse=True) and all(0 <= r["score"] <= 1 for r in board)


def test_pairs_of_words_decide(spark):
    # each class holds the same words
    rows = [(i, f"Red, FOX {i}!" if i % 2 else f"fox red... {i}", i % 2) for i in range(100)]
    board = ML.text_race(spark.createDataFrame(rows, "id int, text string, y int"), "text", "y", "id", models=["logistic_regression", "linear_svc"]).collect()
    assert [(r["score"], r["f1"]) for r in board] == [(1.0, 1.0)] * 2


def test_three_classes_are_raced_by_all_models(spark):
    words = {"bad": "awful broken", "mid": "plain usual", "top": "great lovely"}
    rows = [(i, f"{words[c]} thing" if i % 30 else None, c) for i, c in enumerate(list(words) * 40)]
    board = {r["model"]: r for r in ML.text_race(spark.createDataFrame(rows, "id int, text string, y string"), "text", "y", "id").collect()}
    assert len(board) == 4 and all(board[m]["score"] > 0.9 and board[m]["f1"] > 0.9 for m in ("naive_bayes", "logistic_regression", "linear_svc"))


def grams(text):
    words = [w for w in re.sub(r"\d+", "", re.sub(r"[^\w\s]", "", (text or "").lower())).split() if len(w) >= 2 and w not in lexicon.STOP_EN]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("features", [None, 25])
def test_weights_and_split_of_the_race(spark, monkeypatch, features):
    draw = np.random.default_rng(5)
    words = np.array(["alpha", "Beta", "gamma's", "delta", "the", "x", "eps1lon", "zeta", "été"])
    rows = [(i, " ".join(draw.choice(words, draw.integers(0, 9))), int(i % 10 < 3)) for i in range(120)] + [(120, None, 0)]
    seen = {}

    def race(train, test, *rest):
        seen["train"], seen["test"] = train.collect(), test.collect()
        return {}, spark.createDataFrame([], "model string, score double")

    monkeypatch.setattr(ML, "race", race)
    ML.text_race(spark.createDataFrame(rows, "id int, text string, y int"), "text", "y", "id", features=features)
    # the hold-out takes a fifth of each class
    assert Counter(r["__y"] for r in seen["test"]) == {0.0: 17, 1.0: 7} and len(seen["train"]) == 97
    text = {i: t for i, t, _ in rows}
    train = [grams(text[r["__k"]]) for r in seen["train"]]
    total, df_of = Counter(g for t in train for g in t), Counter(g for t in train for g in set(t))
    kept = sorted(total, key=lambda g: (-total[g], g))[:features]
    for r in seen["train"] + seen["test"]:
        tf = Counter(g for g in grams(text[r["__k"]]) if g in set(kept))
        raw = [n * (math.log((1 + len(train)) / (1 + df_of[g])) + 1) for g, n in tf.items()]
        norm = math.sqrt(sum(w * w for w in raw)) or 1.0
        assert r["features"].size == len(kept)
        assert sorted(r["features"].values) == pytest.approx(sorted(w / norm for w in raw))


@pytest.mark.parametrize("ranges", [False, True])
def test_vocabulary_is_cut_at_the_last_tie(spark, request, ranges):
    if ranges:
        request.getfixturevalue("small_groups")
    rows = [(i, " ".join(f"w{j:02d}" for j in range(60) if j % 20 >= i % 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    total = Counter(g for _, t in rows for g in grams_of(t))
    order = sorted(total, key=lambda g: (-total[g], g))
    for k in (1, 10, 47, len(order), len(order) + 5, None):
        assert sorted(r["term"] for r in N.vocabulary(df, "id", "text", 2, k, []).collect()) == sorted(order[:k])


def grams_of(text):
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def sparse(x, y):
    return [(i, float(c), Vectors.sparse(len(r), np.flatnonzero(r).tolist(), r[r != 0].tolist())) for i, (r, c) in enumerate(zip(x, y))]


def gini_tree(x, y, edges, depth):
    """Predictions of a tree that tries every feature and edge."""
    best, counts = None, np.bincount(y, minlength=3)
    if depth and (counts > 0).sum() > 1:
        for f in range(x.shape[1]):
            for e in edges:
                left = x[:, f] <= e
                if left.any() and not left.all():
                    score = sum((np.bincount(y[s], minlength=3) ** 2).sum() / s.sum() for s in (left, ~left))
                    if score > (counts**2).sum() / len(y) * (1 + 1e-12) and (best is None or score > best[0]):
                        best = (score, left)
    out = np.full(len(y), counts.argmax())
    if best:
        for side in (best[1], ~best[1]):
            out[side] = gini_tree(x[side], y[side], edges, depth - 1)
    return out


def test_one_tree_of_the_forest_is_the_greedy_tree(spark):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(150, 6)) * (draw.random((150, 6)) < 0.4)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.3) + (draw.random(150) < 0.1)
    y = np.minimum(y, 2)
    df = spark.createDataFrame(sparse(x, y), ["id", "y", "x"]).repartition(3)
    forest = SparseForest("y", "x", "id", numTrees=1, maxDepth=4, bins=16, subset=6, bootstrap=False)
    got = {r["id"]: r["prediction"] for r in forest.fit(df).transform(df).collect()}
    edges = np.unique([0.0, *np.quantile(x[x != 0], [i / 16 for i in range(1, 16)])])
    assert [got[i] for i in range(150)] == gini_tree(x, y, edges, 4).tolist()
    # a vector with all its values given is the same row
    dense = spark.createDataFrame([(i, float(c), Vectors.dense(r)) for i, (r, c) in enumerate(zip(x, y))], ["id", "y", "x"])
    assert {r["id"]: r["prediction"] for r in forest.fit(df).transform(dense).collect()} == got


def test_forest_of_many_features(spark):
    # 60 of 40,000 features tell the class; a row has 30
    draw = np.random.default_rng(3)
    rows = []
    for i in range(600):
        c = i % 2
        own = np.unique(np.r_[draw.choice(30, 6, replace=False) * 2 + c, draw.integers(60, 40_000, 24)])
        rows.append((i, float(c), Vectors.sparse(40_000, own.tolist(), draw.random(len(own)).tolist())))
    df = spark.createDataFrame(rows, ["id", "y", "x"])
    forest = SparseForest("y", "x", "id", numTrees=20, maxDepth=4, subset=4_000)
    scores = [forest.fit(d.filter("id < 400")).transform(d.filter("id >= 400")).select("id", "prediction").collect() for d in (df, df.repartition(5))]
    assert np.mean([r["prediction"] == r["id"] % 2 for r in scores[0]]) > 0.9
    # trees do not depend on where the rows lie
    assert sorted(scores[0]) == sorted(scores[1])
    # nor on the numbers of the features, if an order of theirs is given
    turned = df.rdd.map(lambda r: (r["id"], r["y"], Vectors.sparse(40_000, {39_999 - int(j): float(v) for j, v in zip(r["x"].indices, r["x"].values)}))).toDF(["id", "y", "x"])
    same = SparseForest("y", "x", "id", numTrees=20, maxDepth=4, subset=4_000, order=np.arange(40_000)[::-1])
    again = same.fit(turned.filter("id < 400")).transform(turned.filter("id >= 400")).select("id", "prediction").collect()
    assert sorted(again) == sorted(scores[0])
