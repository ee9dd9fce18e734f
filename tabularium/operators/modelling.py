"""MLlib training workflow: preprocessing, registry, races, search, ensembles and explanations.

All fits read the whole training table; scaling and selection are fitted on the training side only.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as MC
from pyspark.ml import clustering as ML
from pyspark.ml import evaluation as ME
from pyspark.ml import feature as MF
from pyspark.ml import recommendation as MREC
from pyspark.ml import regression as MR
from pyspark.ml import tuning as MT
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.guarded import col
from ..session import ensure_checkpoint_dir
from . import metrics, monitoring, similarity
from .forest import SparseForest
from .lookup import join_lookup
from .ordered import row_numbers
from .quantiles import quantiles
from .windows import category_codes

REGISTRY: dict[str, dict[str, object]] = {
    "classification": {
        "random_forest": lambda **p: MC.RandomForestClassifier(**{"numTrees": 50, "seed": 42, **p}),
        "gradient_boosting": lambda **p: MC.GBTClassifier(**{"maxIter": 20, "seed": 42, **p}),
        "logistic_regression": lambda **p: MC.LogisticRegression(**{"maxIter": 50, **p}),
        "decision_tree": lambda **p: MC.DecisionTreeClassifier(**{"maxDepth": 5, "seed": 42, **p}),
        "naive_bayes": lambda **p: MC.NaiveBayes(**p),
        "linear_svc": lambda **p: MC.LinearSVC(**{"maxIter": 30, **p}),
    },
    "regression": {
        "random_forest": lambda **p: MR.RandomForestRegressor(**{"numTrees": 50, "seed": 42, **p}),
        "gradient_boosting": lambda **p: MR.GBTRegressor(**{"maxIter": 20, "seed": 42, **p}),
        "linear_regression": lambda **p: MR.LinearRegression(**p),
        "ridge": lambda **p: MR.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
        "lasso": lambda **p: MR.LinearRegression(**{"regParam": 0.1, "elasticNetParam": 1.0, **p}),
        "decision_tree": lambda **p: MR.DecisionTreeRegressor(**{"maxDepth": 5, "seed": 42, **p}),
    },
    "clustering": {"kmeans": lambda **p: ML.KMeans(**{"k": 5, "seed": 42, **p})},
}


def register(problem: str, name: str, builder) -> None:
    """Add a model builder: ``builder(**params)`` returns an estimator."""
    REGISTRY.setdefault(problem, {})[name] = builder


def build(problem: str, name: str, **params) -> Estimator:
    if name not in REGISTRY.get(problem, {}):
        raise KeyError(f"no {problem} model {name!r}; known: {sorted(REGISTRY.get(problem, {}))}")
    return REGISTRY[problem][name](**params)


def target_codes(df: DataFrame, target: str) -> DataFrame:
    """(target, __y): each class of a label of any type, numbered from 0 in sorted order; NULL is no class."""
    return category_codes(df, [target], "__y").withColumn("__y", F.col("__y").cast("double"))


def with_target(df: DataFrame, target: str, problem: str) -> DataFrame:
    """Adds ``__y``: the class number, joined, or the number itself; rows without target go."""
    known = df.filter(col(target).isNotNull())
    if problem == "classification":
        # a model holds numbers for each class, so their table is small; a shuffle by class would put each class into one task
        return join_lookup(known, F.broadcast(target_codes(known, target)), [target], "inner")
    return known.withColumn("__y", col(target).cast("double"))


def preprocess_stages(df: DataFrame, numeric: list[str], categorical: list[str], output: str = "features", scale: bool = True) -> list:
    """Exact-median imputation and scaling of numbers, ``missing`` fill and one-hot of categories, one vector column."""
    stages, inputs = [], []
    if numeric:
        medians = quantiles(df, numeric, [0.5])
        fill = lambda c: f"CASE WHEN `{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) THEN CAST('{medians[c][0.5] or 0.0!r}' AS DOUBLE) ELSE CAST(`{c}` AS DOUBLE) END AS `{c}__n`"
        stages.append(MF.SQLTransformer(statement=f"SELECT *, {', '.join(fill(c) for c in numeric)} FROM __THIS__"))
        stages.append(MF.VectorAssembler(inputCols=[f"{c}__n" for c in numeric], outputCol="__numeric", handleInvalid="keep"))
        if scale:
            stages.append(MF.StandardScaler(inputCol="__numeric", outputCol="__scaled", withMean=True))
        inputs.append("__scaled" if scale else "__numeric")
    if categorical:
        fills = ", ".join(f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `{c}__c`" for c in categorical)
        stages.append(MF.SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"))
        codes = [f"{c}__i" for c in categorical]
        stages.append(MF.StringIndexer(inputCols=[f"{c}__c" for c in categorical], outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(MF.OneHotEncoder(inputCols=codes, outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep"))
        inputs += [f"{c}__o" for c in categorical]
    stages.append(MF.VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    return stages


def fit_preprocess(df: DataFrame, numeric: list[str], categorical: list[str] = (), scale: bool = True) -> PipelineModel:
    return Pipeline(stages=preprocess_stages(df, list(numeric), list(categorical), scale=scale)).fit(df)


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return MF.VectorAssembler(inputCols=columns, outputCol=output, handleInvalid="keep").transform(df)


@dataclass
class TabularModel:
    """Preprocessing plus one model behind fit, predict, save and load."""

    problem: str
    name: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    label: str = "label"
    params: dict = field(default_factory=dict)
    fitted: PipelineModel | None = None
    classes: DataFrame | None = None

    def fit(self, df: DataFrame) -> "TabularModel":
        """Classes may be of any type; they are numbered in sorted order and ``predict`` gives them back."""
        labelled = with_target(df, self.label, self.problem)
        if self.problem == "classification":
            self.classes = target_codes(df, self.label).withColumnsRenamed({self.label: "class", "__y": "prediction"})
        model = build(self.problem, self.name, labelCol="__y", featuresCol="features", **self.params)
        self.fitted = Pipeline(stages=[*preprocess_stages(labelled, self.numeric, self.categorical, scale=self.name != "naive_bayes"), model]).fit(labelled)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fitted.transform(df)
        return out.drop(*[c for c in out.columns if c not in df.columns and c.endswith(("__d", "__n", "__c", "__i", "__o"))], "__numeric", "__scaled")

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Add ``prediction`` (a class number), its ``class``, and, for classifiers that give one, ``probability_1``."""
        out = self.transform(df)
        if self.problem == "classification" and "probability" in out.columns:
            out = out.withColumn("probability_1", F.get(vector_to_array("probability"), F.lit(1)))
            if threshold is not None:
                out = out.withColumn("prediction", (F.col("probability_1") >= threshold).cast("double"))
        out = out.drop("features", "rawPrediction", "probability")
        return out if self.classes is None else join_lookup(out, F.broadcast(self.classes), ["prediction"])

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(f"{path}/pipeline")
        if self.classes is not None:
            self.classes.write.mode("overwrite").parquet(f"{path}/classes")

    @classmethod
    def load(cls, path: str, problem: str, name: str, numeric: list[str], categorical: list[str] = (), label: str = "label") -> "TabularModel":
        fitted = PipelineModel.load(f"{path}/pipeline")
        classes = SparkSession.active().read.parquet(f"{path}/classes") if problem == "classification" else None
        return cls(problem, name, list(numeric), list(categorical), label, fitted=fitted, classes=classes)


def evaluator(problem: str, label: str, metric: str | None = None):
    if problem == "classification":
        return ME.MulticlassClassificationEvaluator(labelCol=label, metricName=metric or "accuracy")
    return ME.RegressionEvaluator(labelCol=label, metricName=metric or "r2")


def with_fold(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Fold number by key hash: the same row is in the same fold in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), col(key)), F.lit(k)).cast("int"))


def cross_validate(df: DataFrame, models: dict[str, Estimator], key: str, label: str, problem: str, k: int = 5, metric: str | None = None) -> DataFrame:
    """(model, mean, std, min, max, rank) leaderboard; ``df`` holds the features vector.

    Each fit reads all rows of the other folds; only the k x models scores reach the driver.
    """
    folded = with_fold(df, key, k).persist()
    score = evaluator(problem, label, metric)
    rows = []
    for name, estimator in models.items():
        for i in range(k):
            fitted = estimator.fit(folded.filter(F.col("fold") != i))
            rows.append((name, i, score.evaluate(fitted.transform(folded.filter(F.col("fold") == i)))))
    folded.unpersist()
    table = df.sparkSession.createDataFrame(rows, "model string, fold int, score double")
    stats = table.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return stats.orderBy(F.desc("mean"), "model")


def race(train: DataFrame, test: DataFrame, models: dict[str, Estimator], label: str, problem: str, metric: str | None = None) -> tuple[dict[str, Model], DataFrame]:
    """Fit every model once; returns the fitted models and a (model, score) table."""
    score, fitted, rows = evaluator(problem, label, metric), {}, []
    for name, estimator in models.items():
        fitted[name] = estimator.fit(train)
        rows.append((name, float(score.evaluate(fitted[name].transform(test)))))
    return fitted, train.sparkSession.createDataFrame(rows, "model string, score double")


def random_grid(estimator: Estimator, space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n distinct seeded draws from the product of the listed values."""
    rng, seen = random.Random(seed), {}
    space = {name: list(dict.fromkeys(values)) for name, values in space.items()}
    size = 1
    for values in space.values():
        size *= len(values)
    while len(seen) < min(n, size):
        draw = tuple(rng.choice(v) for v in space.values())
        seen[draw] = {estimator.getParam(p): v for p, v in zip(space, draw)}
    return list(seen.values())


def search(train: DataFrame, estimator: Estimator, space: dict[str, list], label: str, problem: str, n: int = 10, parallelism: int = 4, seed: int = 42) -> tuple[Model, DataFrame]:
    """Random search on one train/validation split; returns the best model and a (trial, params, score) table."""
    grid = random_grid(estimator, space, n, seed)
    tuner = MT.TrainValidationSplit(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator(problem, label), trainRatio=0.8, parallelism=parallelism, seed=seed)
    found = tuner.fit(train)
    rows = [(i, {p.name: str(v) for p, v in g.items()}, float(s)) for i, (g, s) in enumerate(zip(grid, found.validationMetrics))]
    return found.bestModel, train.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, score double")


class Parzen:
    """Proposals from finished trials: values that good trials have more often than the others.

    Each parameter has a density over its listed values for the best quarter of the trials and one for the rest; a trial adds
    weight to its value and less to those listed beside it, and every value has some. Draws come from the first density, and
    the draw with the largest ratio of the two is proposed.
    """

    def __init__(self, space: dict[str, list], seed: int, draws: int = 24):
        self.space = {name: list(dict.fromkeys(values)) for name, values in space.items()}
        self.rng, self.draws = random.Random(seed), draws

    def densities(self, name: str, trials: list[tuple]) -> list[float]:
        n, place = len(self.space[name]), list(self.space).index(name)
        weight = [1.0] * n
        for t in trials:
            for i in range(n):
                weight[i] += 2.0 * 0.25 ** abs(i - t[place])
        return [w / sum(weight) for w in weight]

    def propose(self, scores: dict[tuple, float], taken: set[tuple]) -> tuple:
        """Places of the values of a trial that is not taken; without scores a random one."""
        ranked = sorted(scores, key=lambda t: (-scores[t], t))
        good, rest = ranked[: -(-len(ranked) // 4)], ranked[-(-len(ranked) // 4) :]
        tables = [(self.densities(name, good), self.densities(name, rest)) for name in self.space]
        best = None
        while best is None:
            for _ in range(self.draws):
                draw = tuple(self.rng.choices(range(len(a)), a)[0] for a, _ in tables)
                if draw not in taken:
                    gain = math.prod(a[i] / b[i] for i, (a, b) in zip(draw, tables))
                    if best is None or gain > best[0]:
                        best = (gain, draw)
        return best[1]


def adaptive_search(
    train: DataFrame,
    estimator: Estimator,
    space: dict[str, list],
    label: str,
    problem: str,
    key: str,
    n: int = 12,
    first: int = 4,
    shares: tuple[float, ...] = (1 / 9, 1 / 3, 1.0),
    parallelism: int = 4,
    seed: int = 42,
) -> tuple[Model, DataFrame]:
    """Parzen proposals with successive halving; returns the best model, fitted on all rows, and (trial, params, share, score).

    ``n`` trials are fitted on the first share of the training rows, ``first`` of them drawn at random, the others proposed
    ``parallelism`` at a time from the scores so far. The better third goes on to the next share, and its better third to
    all rows. A fifth of the rows, by a hash of the key, scores all of them; shares are nested and keyed too, so a seed gives
    one result whatever the layout or the order in which trials end.
    """
    bucket = lambda what: (F.shiftrightunsigned(F.xxhash64(F.lit(f"{what}{seed}"), col(key)), 11).cast("double")) / F.lit(float(2**53))
    rows = train.withColumns({"__side": bucket("side"), "__share": bucket("share")}).persist()
    held, score = rows.filter("__side < 0.2"), evaluator(problem, label)
    proposals = Parzen(space, seed)
    size = math.prod(len(v) for v in proposals.space.values())
    numbers: dict[tuple, int] = {}
    done: list[tuple] = []

    def params(trial: tuple) -> dict:
        return {estimator.getParam(name): values[i] for i, (name, values) in zip(trial, proposals.space.items())}

    def run(trials: list[tuple], share: float) -> dict[tuple, float]:
        part = rows.filter((F.col("__side") >= 0.2) & (F.col("__share") < share))
        fitted = inheritable_thread_target(train.sparkSession)(lambda t: float(score.evaluate(estimator.fit(part, params(t)).transform(held))))
        with ThreadPool(parallelism) as pool:
            scores = dict(zip(trials, pool.map(fitted, trials)))
        done.extend((numbers[t], {p.name: str(v) for p, v in params(t).items()}, float(share), s) for t, s in scores.items())
        return scores

    try:
        scores: dict[tuple, float] = {}
        while len(numbers) < min(n, size):
            batch = []
            for _ in range(min(first if not scores else parallelism, min(n, size) - len(numbers))):
                trial = proposals.propose(scores, set(numbers))
                numbers[trial] = len(numbers)
                batch.append(trial)
            scores |= run(batch, shares[0])
        for share in shares[1:]:
            kept = sorted(scores, key=lambda t: (-scores[t], numbers[t]))[: -(-len(scores) // 3)]
            scores = run(kept, share)
        best = min(scores, key=lambda t: (-scores[t], numbers[t]))
        model = estimator.fit(train, params(best))
    finally:
        rows.unpersist()
    return model, train.sparkSession.createDataFrame(done, "trial int, params map<string,string>, share double, score double")


# fixed values: search spaces
SPACES = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 8, 10], "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.2]},
    "logistic_regression": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "decision_tree": {"maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [1, 2, 5]},
}


def soft_vote(df: DataFrame, models: dict[str, Model], problem: str) -> DataFrame:
    """Average of all class probabilities of several models, added without joins.

    ``prediction`` is the class of the highest average, the first of equal ones, and ``vote`` that average; a model
    without probabilities votes for its class alone. For regression both are the mean prediction.
    """
    keep, parts, out = list(df.columns), [], df
    classes = max([2, *(int(m.numClasses) for m in models.values() if hasattr(m, "numClasses"))])
    for i, model in enumerate(models.values()):
        scored = model.transform(out)
        part = f"__m{i}"
        if problem != "classification":
            value = F.col("prediction")
        elif "probability" in scored.columns:
            value = vector_to_array("probability")
        else:
            value = F.array(*[(F.col("prediction") == c).cast("double") for c in range(classes)])
        out = scored.withColumn(part, value).select(*[col(c) for c in keep], *parts, part)
        parts.append(part)
    if problem != "classification":
        mean = sum((F.col(p) for p in parts), F.lit(0.0)) / len(parts)
        return out.withColumns({"vote": mean, "prediction": mean}).drop(*parts)
    share = lambda c: sum((F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)) for p in parts), F.lit(0.0)) / len(parts)
    out = out.withColumn("__all", F.array(*[share(c) for c in range(classes)])).withColumn("vote", F.array_max("__all"))
    return out.withColumn("prediction", (F.array_position("__all", F.col("vote")) - 1).cast("double")).drop("__all", *parts)


def _opinion(scored: DataFrame) -> Column:
    """What a model says of a row: all class probabilities, else its prediction."""
    return F.col("probability" if "probability" in scored.columns else "prediction")


def stack(df: DataFrame, models: dict[str, Estimator], key: str, label: str, problem: str, k: int = 5) -> tuple[dict[str, Model], Model]:
    """Second-level model on out-of-fold predictions of the base models."""
    folded = with_fold(df, key, k).persist()
    names = list(models)
    columns = [f"oof_{n}" for n in names]

    def add(frame: DataFrame, fitted: list[Model]) -> DataFrame:
        keep, out = list(frame.columns), frame
        for n, m in zip(names, fitted):
            scored = m.transform(out)
            out = scored.withColumn(f"oof_{n}", _opinion(scored)).select(*[col(c) for c in keep], f"oof_{n}")
            keep.append(f"oof_{n}")
        return out

    parts = None
    for i in range(k):
        train, hold = folded.filter(F.col("fold") != i), folded.filter(F.col("fold") == i)
        part = add(hold, [e.fit(train) for e in models.values()])
        parts = part if parts is None else parts.unionByName(part)
    second = build(problem, "logistic_regression" if problem == "classification" else "ridge", labelCol=label, featuresCol="__stack")
    top = second.fit(assemble(parts, columns, "__stack"))
    base = {n: e.fit(folded) for n, e in models.items()}
    folded.unpersist()
    return base, top


def stack_predict(df: DataFrame, base: dict[str, Model], top: Model) -> DataFrame:
    keep, out = list(df.columns), df
    for n, m in base.items():
        scored = m.transform(out)
        out = scored.withColumn(f"oof_{n}", _opinion(scored)).select(*[col(c) for c in keep], *[f"oof_{b}" for b in base if f"oof_{b}" in scored.columns], f"oof_{n}")
    scored = top.transform(assemble(out, [f"oof_{n}" for n in base], "__stack"))
    return scored.select(*[col(c) for c in df.columns], "prediction")


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Slot names the assembler left in the vector column."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for group in attrs.values() for a in group)
    return [n for _, n in slots]


def _weights(model: Model) -> list[float]:
    """Absolute coefficients; with several classes the largest over them."""
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).max(axis=0)]
    return [abs(float(v)) for v in model.coefficients.toArray()]


def importances(model: Model, names: list[str], spark, k: int | None = None) -> DataFrame:
    """(feature, importance, share, rank) from tree importances or absolute coefficients."""
    if hasattr(model, "featureImportances"):
        values = [float(v) for v in model.featureImportances.toArray()]
    else:
        values = _weights(model)
    names = names if len(names) == len(values) else [f"f{i}" for i in range(len(values))]
    total = sum(values) or 1.0
    ranked = sorted(zip(names, values), key=lambda x: (-x[1], x[0]))
    rows = [(n, v, v / total, i + 1) for i, (n, v) in enumerate(ranked)][: k or len(ranked)]
    return spark.createDataFrame(rows, "feature string, importance double, share double, rank int")


def forest_selection(df: DataFrame, columns: list[str], target: str, k: int = 10, problem: str = "classification") -> list[str]:
    ready = assemble(with_target(df, target, problem), columns, "__f")
    model = build(problem, "random_forest", labelCol="__y", featuresCol="__f").fit(ready)
    ranked = sorted(zip(columns, model.featureImportances.toArray()), key=lambda x: (-x[1], x[0]))
    return [c for c, _ in ranked[:k]]


def recursive_elimination(df: DataFrame, columns: list[str], target: str, k: int = 5, problem: str = "classification") -> list[str]:
    """Drop the weakest feature and refit until k remain."""
    ready, left = with_target(df, target, problem).persist(), list(columns)
    while len(left) > k:
        model = build(problem, "decision_tree", labelCol="__y", featuresCol="__f").fit(assemble(ready, left, "__f"))
        weights = model.featureImportances.toArray()
        left.pop(min(range(len(left)), key=lambda i: (weights[i], -i)))
    ready.unpersist()
    return left


def l1_selection(df: DataFrame, columns: list[str], target: str, k: int | None = None, problem: str = "classification", strength: float = 0.01) -> list[str]:
    """Columns an L1-penalised linear model keeps, largest standardised weight first."""
    ready = assemble(with_target(df, target, problem), columns, "__raw")
    scaled = MF.StandardScaler(inputCol="__raw", outputCol="__f", withMean=True).fit(ready).transform(ready)
    name = "logistic_regression" if problem == "classification" else "linear_regression"
    model = build(problem, name, labelCol="__y", featuresCol="__f", regParam=strength, elasticNetParam=1.0).fit(scaled)
    kept = [(c, w) for c, w in zip(columns, _weights(model)) if w > 1e-9]
    ranked = [c for c, _ in sorted(kept, key=lambda x: (-x[1], x[0]))]
    return ranked[:k] if k else ranked


def permutation_importance(model: Transformer, df: DataFrame, columns: list[str], key: str, label: str, problem: str, seed: int = 42, inputs: list[str] | None = None) -> DataFrame:
    """(feature, importance, share): loss of the score when one column is shuffled.

    Rows are numbered once, in a hashed order of the unique ``key``, and each gets the columns of the row a fixed number of
    places further round: one order and one join for all columns, written once, then one evaluation a column. ``inputs``
    names the columns the model reads: other ones are not moved, nor is the key once rows are numbered.
    """
    score = evaluator(problem, label)
    kept = df.columns if inputs is None else [c for c in df.columns if c in {*inputs, *columns, label}]
    df = df.select(*[col(c) for c in dict.fromkeys([*kept, key])])
    base = score.evaluate(model.transform(df.select(*[col(c) for c in kept])))
    # the digest's bytes sort like its digits and are half as long
    order = F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string"))))
    numbered = row_numbers(df.withColumn("__h", order), [], ["__h", key], "__rn").select(*[col(c) for c in kept], "__rn")
    n = df.count()
    step = 1 + random.Random(seed).randrange(max(1, n - 1))
    other = numbered.select((F.pmod(F.col("__rn") - 1 + F.lit(step), F.lit(max(1, n))) + 1).alias("__rn"), F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(columns)]).alias("__other"))
    ensure_checkpoint_dir(df.sparkSession)
    mixed = numbered.join(other, "__rn").checkpoint()
    rows = []
    for i, c in enumerate(columns):
        rows.append((c, float(base - score.evaluate(model.transform(mixed.withColumn(c, F.col(f"__other.v{i}")).select(*[col(x) for x in kept]))))))
    total = sum(abs(v) for _, v in rows) or 1.0
    return df.sparkSession.createDataFrame([(c, v, abs(v) / total) for c, v in rows], "feature string, importance double, share double")


def partial_dependence(model: Transformer, df: DataFrame, column: str, points: int = 20, class_number: int = 1, inputs: list[str] | None = None) -> DataFrame:
    """(value, average): mean prediction over all rows with the column set to each grid value between p5 and p95.

    For a classifier it is the mean probability of one class. ``inputs`` names the columns the model reads: rows that agree in
    all of them but ``column`` are scored once and count as often as they occur.
    """
    distinct = [r[0] for r in df.select(col(column).cast("double")).distinct().limit(points + 1).collect()]
    if len(distinct) <= points:
        grid = sorted(v for v in distinct if v is not None)
    else:
        q = quantiles(df, [column], [0.05, 0.95])[column]
        step = (q[0.95] - q[0.05]) / (points - 1)
        grid = [q[0.05] + step * i for i in range(points)]
    if inputs is None:
        rows = df.withColumn("__times", F.lit(1))
    else:
        rows = df.groupBy(*[col(c) for c in inputs if c != column]).agg(F.count(F.lit(1)).alias("__times"))
    spread = rows.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    scored = model.transform(spread)
    value = F.get(vector_to_array("probability"), F.lit(class_number)) if "probability" in scored.columns else F.col("prediction")
    # a null prediction counts for nothing, as in a plain mean
    average = F.sum(value * F.col("__times")) / F.sum(F.when(value.isNotNull(), F.col("__times")))
    return scored.groupBy(col(column).alias("value")).agg(average.alias("average")).orderBy("value")


def what_if(model: Transformer, df: DataFrame, key: str, changes: dict) -> DataFrame:
    """(key, original, scenario, difference, percent): prediction before and after setting or transforming columns.

    A change is a value or a function from Column to Column.
    """
    before = model.transform(df).withColumnRenamed("prediction", "original")
    before = before.select(*[col(c) for c in df.columns], "original")
    made = {c: v(col(c)) if callable(v) else F.lit(v) for c, v in changes.items()}
    after = model.transform(before.withColumns(made))
    difference = F.col("prediction") - F.col("original")
    return after.select(
        col(key),
        "original",
        F.col("prediction").alias("scenario"),
        difference.alias("difference"),
        (difference / (F.col("original") + F.lit(1e-10)) * 100).alias("percent"),
    )


def sensitivity(model: Transformer, df: DataFrame, columns: list[str], feature: str, low: float, high: float, steps: int = 10) -> DataFrame:
    """(value, prediction) along one feature with every other column at its mean."""
    mean_row = df.agg(*[F.avg(col(c)).alias(c) for c in columns])
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    rows = mean_row.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    return model.transform(rows).select(col(feature).alias("value"), "prediction").orderBy("value")


def learning_curve(train: DataFrame, test: DataFrame, estimator: Estimator, key: str, label: str, problem: str, sizes: int = 10) -> DataFrame:
    """(share, rows, train_score, test_score) on growing hash-threshold subsets."""
    score = evaluator(problem, label)
    bucket = F.pmod(F.xxhash64(F.lit(7), col(key)), F.lit(1_000_000))
    columns = list(train.columns)
    if hasattr(estimator, "getFeaturesCol"):
        weight = [estimator.getWeightCol()] if estimator.hasParam("weightCol") and estimator.isSet("weightCol") else []
        columns = list(dict.fromkeys([estimator.getFeaturesCol(), label, *weight]))
    # written once: every fit and every score reads these rows, not the joins behind them
    train = similarity.saved(train.select(*[col(c) for c in columns], bucket.alias("__bucket")), "curve-train")
    test = similarity.saved(test.select(*[col(c) for c in columns]), "curve-test")
    rows = []
    for i in range(1, sizes + 1):
        part = train.filter(F.col("__bucket") < 1_000_000 * i // sizes).drop("__bucket")
        n = part.count()
        if n == 0:
            continue
        fitted = estimator.fit(part)
        rows.append((i / sizes, n, score.evaluate(fitted.transform(part)), score.evaluate(fitted.transform(test))))
    return train.sparkSession.createDataFrame(rows, "share double, rows bigint, train_score double, test_score double")


def score_batch(model: Transformer, df: DataFrame, output: str, format: str = "parquet", mode: str = "overwrite") -> DataFrame:
    """Score a table and write predictions; the source never passes the driver."""
    scored = model.transform(df).select(*[col(c) for c in df.columns], "prediction")
    scored.write.format(format).mode(mode).save(output)
    return df.sparkSession.read.schema(scored.schema).format(format).load(output)


def recommend(ratings: DataFrame, user: str, item: str, rating: str, k: int = 10, rank: int = 10, iterations: int = 5, seed: int = 42, users: DataFrame | None = None) -> DataFrame:
    """(user, item, score, rank): top-k items per user by alternating least squares, for all users or those of ``users``.

    Scores are products of the factors; items are visited by bounds (see ``similarity.top_products``), so users are not
    compared with every item, and the ranking is exact.
    """
    als = MREC.ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=iterations, regParam=0.1, seed=seed, coldStartStrategy="drop")
    model = als.fit(ratings)
    asked = similarity.vector_rows(model.userFactors, "id", "features", "query")
    if users is not None:
        asked = asked.join(users.select(col(user).alias("query")).distinct(), "query", "left_semi")
    top = similarity.top_products(asked, similarity.vector_rows(model.itemFactors, "id", "features", "item"), k)
    return top.select(F.col("query").alias(user), F.col("item").alias(item), F.col("score").cast("float").alias("score"), "rank")


def elbow(df: DataFrame, features: str, ks: list[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette) for each cluster count."""
    kept = df.select(features).persist()
    silhouette = ME.ClusteringEvaluator(featuresCol=features)
    rows = []
    for k in ks:
        model = ML.KMeans(featuresCol=features, k=k, seed=seed).fit(kept)
        rows.append((k, float(model.summary.trainingCost), float(silhouette.evaluate(model.transform(kept)))))
    kept.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def cluster_features(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Cluster id and distance to each and the nearest centre in standardised space."""
    medians = quantiles(df, columns, [0.5])
    filled = df.withColumns({f"__c_{c}": F.coalesce(col(c).cast("double"), F.lit(float(medians[c][0.5] or 0.0))) for c in columns})
    raw = assemble(filled, [f"__c_{c}" for c in columns], "__raw")
    scaler = MF.StandardScaler(inputCol="__raw", outputCol="__f", withMean=True).fit(raw)
    scaled = scaler.transform(raw)
    model = ML.KMeans(featuresCol="__f", k=k, seed=seed, predictionCol="cluster").fit(scaled)
    values = vector_to_array("__f")
    made: dict[str, Column] = {}
    for i, centre in enumerate(model.clusterCenters()):
        literal = F.array(*[F.lit(float(x)) for x in centre])
        squares = F.aggregate(F.zip_with(values, literal, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        made[f"dist_to_cluster_{i}"] = F.sqrt(squares)
    out = model.transform(scaled).withColumns(made)
    nearest = F.least(*[col(c) for c in made]) if len(made) > 1 else col(next(iter(made)))
    return out.withColumn("dist_to_nearest_cluster", nearest).drop("__raw", "__f", *[f"__c_{c}" for c in columns])


def pca(df: DataFrame, columns: list[str], k: int) -> tuple[DataFrame, list[float]]:
    """Component columns ``pc_1..k`` of the standardised columns and their explained variance shares."""
    raw = assemble(df, columns, "__raw")
    scaled = MF.StandardScaler(inputCol="__raw", outputCol="__f", withMean=True).fit(raw).transform(raw)
    model = MF.PCA(k=k, inputCol="__f", outputCol="__p").fit(scaled)
    parts = vector_to_array("__p")
    out = model.transform(scaled).withColumns({f"pc_{i + 1}": F.get(parts, F.lit(i)) for i in range(k)})
    return out.drop("__raw", "__f", "__p"), [float(v) for v in model.explainedVariance.toArray()]


def _yeo_johnson(v: Column, lam: float) -> Column:
    up = F.log1p(v) if abs(lam) < 1e-9 else (F.pow(v + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-v) if abs(lam - 2) < 1e-9 else -(F.pow(1 - v, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(v >= 0, up).otherwise(down)


def yeo_johnson(df: DataFrame, column: str, name: str | None = None) -> tuple[DataFrame, float]:
    """Standardised power transform; the exponent maximises the profile likelihood on a 0.1 grid, all in one pass."""
    v = col(column).cast("double")
    grid = [round(-2 + 0.1 * i, 1) for i in range(41)]
    aggs = [F.var_pop(_yeo_johnson(v, lam)).alias(f"v{i}") for i, lam in enumerate(grid)]
    slope = F.sum(F.signum(v) * F.log1p(F.abs(v))).alias("s")
    row = df.agg(F.count(v).alias("n"), slope, *aggs).first()

    def likelihood(i: int) -> float:
        spread = row[f"v{i}"]
        return -math.inf if not spread or spread != spread or spread == math.inf else -row["n"] / 2 * math.log(spread) + (grid[i] - 1) * row["s"]

    lam = grid[max(range(len(grid)), key=likelihood)]
    made = _yeo_johnson(v, lam)
    fit = df.agg(F.avg(made).alias("m"), F.stddev_pop(made).alias("s")).first()
    return df.withColumn(name or f"{column}_yeo", (made - F.lit(fit["m"])) / F.lit(fit["s"] or 1.0)), lam


def quantile_normal(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Map values to normal scores of their exact rank: equal values share their average rank, missing ones stay null.

    Ranks come from value counts and running totals over ranges, and are joined back by value; the score of the share
    (rank - 1) / (n - 1), kept 1e-7 from 0 and 1, is computed once a distinct value.
    """
    from statistics import NormalDist

    import pandas as pd

    from .aggregate import average_ranks

    known = F.when(~F.isnan(col(column).cast("double")), col(column).cast("double") + 0.0)
    values = df.select(known.alias("__v")).filter("__v IS NOT NULL")
    n = values.count()

    def scores(share):
        normal = NormalDist().inv_cdf
        return pd.Series([normal(min(max(p, 1e-7), 1 - 1e-7)) for p in share], index=share.index, dtype=float)

    share = (F.col("__rank") - 1) / F.lit(float(n - 1)) if n > 1 else F.lit(0.5) + F.col("__rank") * 0
    table = average_ranks(values, "__v").select(F.col("__v").alias("__key"), F.pandas_udf(scores, "double")(share).alias("__score"))
    made = join_lookup(df.withColumn("__key", known), table, ["__key"])
    return made.select(*[col(c) for c in df.columns if c != name], F.col("__score").alias(name or f"{column}_quantile"))


def skew_transforms(df: DataFrame, columns: list[str], limit: float = 1.0) -> DataFrame:
    """For columns with |skewness| above the limit: power transform when all positive, and normal scores."""
    from ..functions.guarded import sample_skew

    row = df.agg(*[x for i, c in enumerate(columns) for x in (sample_skew(c).alias(f"s{i}"), F.min(col(c)).alias(f"m{i}"))]).first()
    for i, c in enumerate(columns):
        if row[f"s{i}"] is not None and abs(row[f"s{i}"]) > limit:
            if row[f"m{i}"] > 0:
                df, _ = yeo_johnson(df, c)
            df = quantile_normal(df, c)
    return df


@dataclass
class TrainingReport:
    """Outcome of ``auto_train``: fitted parts and small result tables."""

    problem: str
    features: list[str]
    best: str
    models: dict[str, Model]
    preprocess: PipelineModel
    leaderboard: DataFrame
    importance: DataFrame | None
    scored: DataFrame


def auto_train(
    df: DataFrame,
    target: str,
    key: str,
    numeric: list[str],
    categorical: list[str] = (),
    models: list[str] | None = None,
    max_features: int | None = None,
    tune: int = 0,
    balance: bool = True,
    test: float = 0.2,
    vote: int = 3,
) -> TrainingReport:
    """Problem type, split, selection on train, class weights, race, optional tuning, vote, hold-out scores.

    Classes may be of any type and number; ``scored`` holds them and, for classification, the predicted ``class``.
    """
    from . import selection

    problem = monitoring.problem_type(df, target, "small").first()["problem_type"]
    labelled = with_target(df, target, problem)
    split = monitoring.stratified_split(labelled, target, key, test) if problem == "classification" else monitoring.hash_split(labelled, key, test)
    split = split.persist()
    train, hold = split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")
    scorer = selection.anova_scores if problem == "classification" else selection.regression_scores
    chosen = selection.top_scores(scorer(train, list(numeric), "__y"), max_features or max(1, len(numeric)))
    preprocess = fit_preprocess(train, chosen, list(categorical))
    ready, ready_hold = preprocess.transform(train), preprocess.transform(hold)
    options: dict = {"labelCol": "__y", "featuresCol": "features"}
    if balance and problem == "classification":
        weights = monitoring.class_balance(train, "__y").select(F.col("class").alias("__y"), F.col("weight").alias("__weight"))
        ready = join_lookup(ready, F.broadcast(weights), ["__y"])
        options["weightCol"] = "__weight"
    ready = ready.persist()
    names = models or (["random_forest", "logistic_regression", "decision_tree"] if problem == "classification" else ["random_forest", "ridge", "decision_tree"])
    estimators = {n: build(problem, n, **options) for n in names}
    fitted, board = race(ready, ready_hold, estimators, "__y", problem)
    ranked = [r["model"] for r in board.orderBy(F.desc("score"), "model").collect()]
    best = ranked[0]
    if tune and best in SPACES:
        tuned, _ = search(ready, estimators[best], SPACES[best], "__y", problem, tune)
        better = evaluator(problem, "__y").evaluate(tuned.transform(ready_hold))
        if better > board.filter(F.col("model") == best).first()["score"]:
            fitted[best] = tuned
    ready.unpersist()
    top = {n: fitted[n] for n in ranked[:vote]}
    scored = soft_vote(ready_hold, top, problem) if vote > 1 else fitted[best].transform(ready_hold)
    model = fitted[best]
    has_weights = any(hasattr(model, a) for a in ("featureImportances", "coefficientMatrix", "coefficients"))
    table = importances(model, feature_names(ready), df.sparkSession) if has_weights else None
    kept = scored.select(col(key), col(target), "prediction")
    if problem == "classification":
        kept = join_lookup(kept, F.broadcast(target_codes(df, target)).withColumnsRenamed({target: "class", "__y": "prediction"}), ["prediction"])
    split.unpersist()
    return TrainingReport(problem, chosen, best, fitted, preprocess, board, table, kept)


def forecast_race(train: DataFrame, test: DataFrame, features: list[str], value: str) -> tuple[str, Model, DataFrame]:
    """Lag-feature regressors by hold-out MAE; returns the best and a (model, mae, rmse, r2) table."""
    ready, hold = (assemble(d.withColumn("__y", col(value).cast("double")), features) for d in (train, test))
    models = {n: build("regression", n, labelCol="__y", featuresCol="features") for n in ("random_forest", "gradient_boosting", "ridge")}
    rows, fitted = [], {}
    for n, e in models.items():
        fitted[n] = e.fit(ready)
        scored = fitted[n].transform(hold)
        rows.append((n, *[float(evaluator("regression", "__y", m).evaluate(scored)) for m in ("mae", "rmse", "r2")]))
    best = min(rows, key=lambda r: r[1])[0]
    return best, fitted[best], train.sparkSession.createDataFrame(rows, "model string, mae double, rmse double, r2 double")


def text_race(df: DataFrame, text: str, label: str, key: str, features: int | None = 1 << 18, test: float = 0.2, models: list[str] | None = None) -> DataFrame:
    """(model, score, f1), best F1 first: naive Bayes, logistic regression, linear SVM and forest on TF-IDF of the whole texts.

    Texts are cleaned and the hold-out takes its share of every class. The vocabulary is that of the training side: the
    ``features`` most frequent words and pairs of neighbouring words, without stop words; None keeps all. Their weights are count *
    (ln((1+N)/(1+df)) + 1), L2-normalised. ``score`` is the accuracy; F1 is that of the second of two classes, else the mean
    weighted by class.
    """
    from . import text as N

    labelled = with_target(df, label, "classification").withColumn("__k", col(key))
    # the split moves keys only, and a key that repeats stays on one side
    sides = monitoring.stratified_split(labelled.select("__k", "__y"), "__y", "__k", test).groupBy("__k").agg(F.min("split").alias("split"))
    texts = labelled.select("__k", "__y", F.coalesce(N.cleaned(text), F.lit("")).alias("__t"))
    split = similarity.saved(join_lookup(texts, sides, ["__k"], "inner", null_safe=True), "texts")
    words = N.vocabulary(split.filter("split = 'train'"), "__k", "__t", 2, features, lexicon.STOP_EN)
    counter = MF.CountVectorizer(inputCol="__w", outputCol="__tf", vocabSize=max(1, words.count())).fit(words.select(F.array("term").alias("__w")))
    counted = counter.transform(split.withColumn("__w", N.terms("__t", 2, lexicon.STOP_EN))).select("__k", "__y", "split", "__tf").persist()
    train, hold = (counted.filter(F.col("split") == side) for side in ("train", "test"))
    idf = MF.IDF(inputCol="__tf").fit(train).idf.toArray()
    weigh = PipelineModel([
        MF.ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="__tf", outputCol="__weighed"),
        MF.Normalizer(p=2.0, inputCol="__weighed", outputCol="features"),
    ])
    ready, ready_hold = (weigh.transform(side).select("__k", "__y", "features").persist() for side in (train, hold))
    # both are held before the counts are let go
    for side in (ready, ready_hold):
        side.count()
    counted.unpersist()
    two = split.agg(F.max("__y")).first()[0] < 2
    options = {"labelCol": "__y", "featuresCol": "features"}

    def model(name: str) -> Estimator:
        if name == "random_forest":
            # MLlib numbers the terms in no fixed order; an array of strings would be as wide as the longest
            terms = counter.vocabulary
            return SparseForest(**options, key="__k", order=np.array(sorted(range(len(terms)), key=terms.__getitem__)))
        made = build("classification", name, **options)
        return made if two or name != "linear_svc" else MC.OneVsRest(classifier=made, **options)

    names = models or ["naive_bayes", "logistic_regression", "linear_svc", "random_forest"]
    fitted, board = race(ready, ready_hold, {n: model(n) for n in names}, "__y", "classification")
    scores = {n: metrics.classification_metrics(m.transform(ready_hold), "__y", "prediction", positive=1.0).first() for n, m in fitted.items()}
    ready.unpersist()
    ready_hold.unpersist()
    f1 = df.sparkSession.createDataFrame([(n, float(s["f1" if two else "f1_weighted"])) for n, s in scores.items()], "model string, f1 double")
    return board.join(f1, "model").orderBy(F.desc("f1"), "model")
