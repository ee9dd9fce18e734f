"""Random forest over rows with few of very many features, such as weighed words.

MLlib's forest holds a number for every feature of every row, so a vocabulary of 2^18 terms takes a megabyte a row. This one
counts the features a row has and finds those it lacks by subtraction from the node. All trees grow level by level: tasks place their
rows in the nodes, count the drawn features of each node by bin and class, and one group a node, of bounded size, finds the
split. The driver keeps the trees. As with MLlib, rows are drawn with repeats for each tree, each node draws the square root
of the features, splits are by Gini impurity and the trees vote by the class shares of their leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import col
from .metrics import poisson_limits
from .quantiles import quantiles

#: values of the rows that a task places at once, if one row has no more
SLICE_VALUES = 1 << 18


def sparse_parts(vector: str) -> list[Column]:
    """(indices, values) of a vector column; a dense vector has all indices."""
    parts = F.unwrap_udt(col(vector))
    values = parts["values"]
    whole = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return [F.coalesce(parts["indices"], whole).alias("indices"), values.alias("values")]


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with about ``SLICE_VALUES`` values."""
    run = np.cumsum(column.value_lengths().to_numpy()) // SLICE_VALUES
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return zip(starts.tolist(), np.diff(np.r_[starts, len(column)]).tolist())


@dataclass
class Rows:
    """Rows of a slice: ``keys`` are row * width + index in ascending order, one for each value."""

    n: int
    width: int
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, indices: pa.Array, values: pa.Array, width: int) -> "Rows":
        row = np.repeat(np.arange(len(indices)), indices.value_lengths().to_numpy())
        keys = row * width + indices.flatten().to_numpy().astype(np.int64)
        return cls(len(indices), width, keys, values.flatten().to_numpy())

    def value(self, features: np.ndarray) -> np.ndarray:
        """Values at ``features``, an array with a line a row; 0 where a row lacks the feature."""
        if not len(self.keys):
            return np.zeros(features.shape)
        wanted = np.arange(self.n)[:, None] * self.width + features
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], 0.0)


@dataclass
class Trees:
    """Nodes of all trees: children of node i are 2i + 1 and 2i + 2; a feature of -1 marks a leaf."""

    feature: np.ndarray
    limit: np.ndarray
    #: weight of each class in each node
    counts: np.ndarray

    def place(self, rows: Rows, depth: int) -> np.ndarray:
        """The node of each row in each tree, at most ``depth`` steps from the root."""
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((rows.n, len(self.feature)), np.int64)
        for _ in range(depth):
            feature = self.feature[tree, node]
            right = rows.value(feature) > self.limit[tree, node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node


def drawn(seed: int, tree: int, node: int, width: int, size: int) -> np.ndarray:
    """The places of the features a node may split by, in ascending order."""
    return np.sort(np.random.default_rng([seed, tree, node]).choice(width, size, replace=False))


def repeats(ids: np.ndarray, trees: int) -> np.ndarray:
    """How often each tree draws each row: Poisson numbers from a hash of the row's id and the tree."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(np.array(poisson_limits()), share, side="right")


def best_split(cells: np.ndarray, totals: np.ndarray, absent: int) -> tuple[int, int, np.ndarray] | None:
    """(feature, bin, weights on the left) of the split that lowers Gini impurity most; ``cells`` are feature x bin x class.

    What a node holds beyond the cells of a feature lacks it and lies in the bin ``absent``.
    """
    cells = cells.astype(float)
    cells[:, absent] += totals - cells.sum(axis=1)
    left = cells.cumsum(axis=1)[:, :-1]
    right = totals - left
    a, b = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(axis=2) / a + (right * right).sum(axis=2) / b
    score[(a <= 0) | (b <= 0)] = -np.inf
    if not score.size:
        return None
    at = int(score.argmax())
    feature, split = divmod(at, score.shape[1])
    whole = (totals * totals).sum() / totals.sum()
    if not score.flat[at] > whole * (1 + 1e-12):
        return None
    return feature, split, left[feature, split]


class SparseForest(Estimator):
    """Classes are numbered from 0; ``key`` tells the rows apart, so that a tree draws the same ones in every run.

    ``order`` lists the features in an order that does not change, if their numbers may: nodes draw places in it.
    """

    def __init__(
        self,
        labelCol: str,
        featuresCol: str,
        key: str,
        numTrees: int = 50,
        maxDepth: int = 5,
        bins: int = 64,
        subset: int | None = None,
        bootstrap: bool = True,
        order: np.ndarray | None = None,
        seed: int = 42,
    ):
        super().__init__()
        self.order = order
        self.label, self.features, self.key = labelCol, featuresCol, key
        self.trees, self.depth, self.bins, self.subset, self.bootstrap, self.seed = numTrees, maxDepth, bins, subset, bootstrap, seed

    def _fit(self, dataset: DataFrame) -> "SparseForestModel":
        rows = dataset.select(F.xxhash64(F.lit(self.seed), col(self.key)).alias("id"), col(self.label).cast("int").alias("y"), *sparse_parts(self.features))
        classes = rows.agg(F.max("y")).first()[0] + 1
        width = dataset.select(col(self.features)).first()[0].size
        size = min(width, self.subset or int(np.ceil(np.sqrt(width))))
        spread = quantiles(rows.select(F.explode("values").alias("v")), ["v"], [i / self.bins for i in range(1, self.bins)])["v"]
        # zero is an edge, so a split can tell the rows that have a feature from those without
        edges = np.unique([0.0, *(v for v in spread.values() if v is not None)])
        nodes = 2 ** (self.depth + 1) - 1
        trees = Trees(np.full((self.trees, nodes), -1), np.zeros((self.trees, nodes)), np.zeros((self.trees, nodes, classes)))
        for r in self._roots(rows, classes).collect():
            trees.counts[r["tree"], 0, r["y"]] = r["w"]
        for level in range(self.depth):
            mixed = (trees.counts > 0).sum(axis=2) > 1
            open_nodes = [(t, n) for t in range(self.trees) for n in range(2**level - 1, 2 ** (level + 1) - 1) if mixed[t, n]]
            if not open_nodes:
                break
            # a row for each open node
            for r in self._splits(rows, trees, open_nodes, level, edges, width, size, classes).collect():
                t, n = open_nodes[r["node"]]
                trees.feature[t, n], trees.limit[t, n] = r["feature"], edges[r["bin"]]
                trees.counts[t, 2 * n + 1] = r["left"]
                trees.counts[t, 2 * n + 2] = trees.counts[t, n] - trees.counts[t, 2 * n + 1]
        return SparseForestModel(trees, self.features, width, self.depth)

    def _weights(self):
        """Function from row ids to the weights of the rows in each tree."""
        n_trees, bootstrap = self.trees, self.bootstrap
        return lambda ids: repeats(ids, n_trees) if bootstrap else np.ones((len(ids), n_trees), np.int64)

    def _roots(self, rows: DataFrame, classes: int) -> DataFrame:
        """(tree, y, w): weight of each class in each tree."""
        n_trees, weights = self.trees, self._weights()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((classes, n_trees), np.int64)
            for batch in batches:
                y, w = batch.column(1).to_numpy(), weights(batch.column(0).to_numpy())
                for c in range(classes):
                    sums[c] += w[y == c].sum(axis=0)
            own = [np.tile(np.arange(n_trees, dtype=np.int32), classes), np.repeat(np.arange(classes, dtype=np.int32), n_trees), sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in own], ["tree", "y", "w"])

        return rows.select("id", "y").mapInArrow(run, "tree int, y int, w bigint").groupBy("tree", "y").agg(F.sum("w").alias("w"))

    def _splits(self, rows: DataFrame, trees: Trees, open_nodes: list[tuple[int, int]], level: int, edges: np.ndarray, width: int, size: int, classes: int) -> DataFrame:
        """(node, feature, bin, left) for those of ``open_nodes``, all of one level, that can be split."""
        seed, weights = self.seed, self._weights()
        order = (np.arange(width) if self.order is None else np.asarray(self.order)).astype(np.int32)
        bins = len(edges) + 1
        absent = int(np.searchsorted(edges, 0.0))
        tree_of = np.array([t for t, _ in open_nodes])
        place_of = np.full(trees.feature.shape, -1)
        place_of[tuple(np.array(open_nodes).T)] = np.arange(len(open_nodes))
        totals = np.array([trees.counts[t, n] for t, n in open_nodes])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # slots are the drawn features of all nodes; those of one feature stand together
            features = order[np.concatenate([drawn(seed, t, n, width, size) for t, n in open_nodes])]
            slots = np.argsort(features, kind="stable")
            begins = np.r_[0, np.cumsum(np.bincount(features, minlength=width))]
            tree = np.arange(len(trees.feature))[None, :]
            keys, sums, held = [], [], 0

            def packed() -> tuple[np.ndarray, np.ndarray]:
                own, at = np.unique(np.concatenate(keys), return_inverse=True)
                return own, np.bincount(at, np.concatenate(sums)).astype(np.int64)

            for batch in batches:
                for start, n in slices(batch.column(2)):
                    part = batch.slice(start, n)
                    own = Rows.of(part.column(2), part.column(3), width)
                    w, y = weights(part.column(0).to_numpy()), part.column(1).to_numpy().astype(np.int64)
                    open_of = place_of[tree, trees.place(own, level)]
                    row, feature = np.divmod(own.keys, width)
                    many = begins[feature + 1] - begins[feature]
                    value = np.repeat(np.arange(len(row)), many)
                    first = np.repeat(begins[feature] - np.r_[0, np.cumsum(many)[:-1]], many) if len(row) else value
                    slot = slots[first + np.arange(len(value))]
                    node = slot // size
                    t, r = tree_of[node], row[value]
                    kept = np.flatnonzero((open_of[r, t] == node) & (w[r, t] > 0))
                    slot, r, t = slot[kept], r[kept], t[kept]
                    cell = np.searchsorted(edges, own.values[value[kept]])
                    keys.append((slot * bins + cell) * classes + y[r])
                    sums.append(w[r, t])
                    held += len(kept)
                    if held > 1 << 21:
                        keys, sums = [[x] for x in packed()]
                        held = len(keys[0])
            if held:
                own, total = packed()
                node, cell = np.divmod(own, size * bins * classes)
                for at in range(0, len(own), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(node[cut].astype(np.int32)), pa.array(cell[cut]), pa.array(total[cut])], ["node", "cell", "w"])

        def choose(table: pa.Table) -> pa.Table:
            node = table["node"][0].as_py()
            cells = np.zeros(size * bins * classes)
            cells[table["cell"].to_numpy()] = table["w"].to_numpy()
            found = best_split(cells.reshape(size, bins, classes), totals[node], absent)
            made = []
            if found:
                feature = int(order[drawn(seed, *open_nodes[node], width, size)[found[0]]])
                made = [{"node": node, "feature": feature, "bin": found[1], "left": found[2].tolist()}]
            kinds = [("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.list_(pa.float64()))]
            return pa.Table.from_pylist(made, schema=pa.schema(kinds))

        # a node has at most size x bins x classes cells, whatever the number of rows
        cells = rows.mapInArrow(count, "node int, cell bigint, w bigint").groupBy("node", "cell").agg(F.sum("w").alias("w"))
        return cells.groupBy("node").applyInArrow(choose, "node int, feature int, bin int, left array<double>")


class SparseForestModel(Model):
    """Adds ``prediction``: the class with the largest mean share in the leaves of a row."""

    def __init__(self, trees: Trees, featuresCol: str, width: int, depth: int):
        super().__init__()
        self.trees, self.features, self.width, self.depth = trees, featuresCol, width, depth

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, width, depth = self.trees, self.width, self.depth
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = np.nan_to_num(trees.counts / trees.counts.sum(axis=2, keepdims=True))

        @F.arrow_udf("double")
        def predicted(indices: pa.Array, values: pa.Array) -> pa.Array:
            made = [np.empty(0)]
            for start, n in slices(indices):
                rows = Rows.of(indices.slice(start, n), values.slice(start, n), width)
                node = trees.place(rows, depth)
                made.append(shares[np.arange(len(trees.feature))[None, :], node].sum(axis=1).argmax(axis=1).astype(float))
            return pa.array(np.concatenate(made))

        return dataset.withColumn("prediction", predicted(*sparse_parts(self.features)))
