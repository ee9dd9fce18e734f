"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one class. Each class keeps a list of its ``k`` nearest neighbours, started from blocks of
vectors that fall on the same side of random hyperplanes and refined by joins of neighbours of neighbours. Lists whose
every entry is a link are saturated: more links may lie beyond them. They are enlarged by further rounds of the same
search among saturated classes in which members of one part no longer take each other's places, until no round joins
two parts. A sample of classes compared with all vectors audits the recall; below the target, a round runs over all
classes again. The links of each part are then counted exactly, block by block, and never written out as pairs.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import map_arrow, slices, task_number, whole_groups, written

EDGES = "src bigint, dst bigint, sim double"


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, vec_id, key, kind, unit: unit vectors; key and unit are null where a vector links with nothing.

    ``kind`` hashes label and dimension, ``key`` label and unit vector.
    """
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = task_number() << 33
        for batch in slices(batches):
            keys, kinds, units = [], [], []
            for vector, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                unit = unit_of(vector) if label is not None else None
                if unit is None:
                    keys.append(None), kinds.append(None), units.append(None)
                    continue
                kind = f"{len(unit)}|{label}".encode("utf-8", "surrogatepass")
                keys.append(hashlib.blake2b(kind + b"|" + unit.tobytes(), digest_size=16).digest())
                kinds.append(int.from_bytes(hashlib.blake2b(kind, digest_size=8).digest(), "little", signed=True))
                units.append(unit.tobytes())
            yield {"row": list(range(row, row + batch.num_rows)), "vec_id": batch.column(0), "key": keys, "kind": kinds, "unit": units}
            row += batch.num_rows

    return written(map_arrow(source, run, f"row bigint, vec_id {dict(source.dtypes)['vec_id']}, key binary, kind bigint, unit binary"), "vectors")


def unit_of(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    own = np.array(vector, dtype=np.float64)
    largest = np.abs(own).max()
    if not np.isfinite(own).all() or largest == 0:
        return None
    own = own / largest  # no square overflows or vanishes
    return own / np.sqrt((own * own).sum())


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def best(own: np.ndarray, ids: np.ndarray, parts: np.ndarray, k: int, least: np.ndarray | float) -> tuple[list, list, list]:
    """(src, dst, sim): up to ``k`` nearest members of other parts for each member, above its ``least`` similarity."""
    sims = own @ own.T
    sims[parts[:, None] == parts[None, :]] = -2.0
    n = min(k, len(ids) - 1)
    if n < 1:
        return [], [], []
    near = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    values = np.take_along_axis(sims, near, axis=1)
    i, j = np.nonzero((values > -2.0) & (values > np.reshape(least, (-1, 1))))
    return ids[i].tolist(), ids[near[i, j]].tolist(), values[i, j].tolist()


def top(edges: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= k).drop("_n")


def started(nodes: DataFrame, k: int, block: int, orders: int, seed: int) -> DataFrame:
    """First lists of (id, kind, part, unit): the nearest within blocks on the same side of random hyperplanes."""
    sizes = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("in_kind"))
    rows = nodes.join(sizes, "kind").select("id", "kind", "part", "unit", "in_kind")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict = {c: [] for c in ("id", "part", "unit", "bucket")}
            ids, kinds, parts, units, sizes = (batch.column(i).to_pylist() for i in range(5))
            lengths = np.array([len(u) for u in units])
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                data = np.frombuffer(b"".join(units[i] for i in own), np.float64).reshape(len(own), -1)
                planes = np.random.default_rng(seed).standard_normal((orders, data.shape[1], 20))
                for order in range(orders):
                    bits = (data @ planes[order] > 0) @ (1 << np.arange(20))
                    for at, i in enumerate(own):
                        # as many bits as leave about a block in each bucket
                        n = max(0, int(np.ceil(np.log2(max(1, sizes[i] / block)))))
                        bucket = hashlib.blake2b(f"{kinds[i]}|{order}|{bits[at] & ((1 << min(20, n)) - 1)}".encode(), digest_size=8).digest()
                        out["bucket"].append(int.from_bytes(bucket, "little", signed=True))
                        out["id"].append(ids[i]), out["part"].append(parts[i]), out["unit"].append(units[i])
            yield out

    placed = written(map_arrow(rows, sides, "id bigint, part bigint, unit binary, bucket bigint"), "sides")
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("id", "bucket"), F.ceil(F.col("n") / (2 * block)))
    salted = placed.join(counts, "bucket").select("id", "part", "unit", F.xxhash64("bucket", salt).alias("bucket"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, groups in whole_groups(batches, "bucket"):
            ids, parts = table.column("id").to_numpy(), table.column("part").to_numpy()
            src, dst, sim = [], [], []
            for lo, hi in groups:
                found = best(matrix(table.column("unit").slice(lo, hi - lo)), ids[lo:hi], parts[lo:hi], k, -1.5)
                for out, more in zip((src, dst, sim), found):
                    out += more
            yield {"src": src, "dst": dst, "sim": sim}

    made = map_arrow(salted.repartition("bucket").sortWithinPartitions("bucket"), nearest, EDGES)
    return written(top(made, k), "lists")


def refined(lists: DataFrame, nodes: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Lists after one join of neighbours of neighbours, and how many entries came in."""
    reverse = Window.partitionBy("centre").orderBy(F.desc("sim"), "id")
    back = lists.select(F.col("dst").alias("centre"), F.col("src").alias("id"), "sim").withColumn("_n", F.row_number().over(reverse)).filter(F.col("_n") <= k)
    around = lists.select(F.col("src").alias("centre"), F.col("dst").alias("id")).union(back.select("centre", "id"))
    around = around.union(nodes.select(F.col("id").alias("centre"), "id")).distinct()
    # a member takes in what is nearer than the last entry of its full list
    full = lists.groupBy("src").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("src").alias("id"), "low")
    members = nodes.join(full, "id", "left").select("id", "part", "unit", F.coalesce("low", F.lit(-1.5)).alias("low"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, groups in whole_groups(batches, "centre"):
            ids, parts, low = (table.column(c).to_numpy() for c in ("id", "part", "low"))
            src, dst, sim = [], [], []
            for lo, hi in groups:
                found = best(matrix(table.column("unit").slice(lo, hi - lo)), ids[lo:hi], parts[lo:hi], k, low[lo:hi])
                for out, more in zip((src, dst, sim), found):
                    out += more
            yield {"src": src, "dst": dst, "sim": sim}

    placed = around.join(members, "id").select("centre", "id", "part", "unit", "low").repartition("centre").sortWithinPartitions("centre")
    fresh = map_arrow(placed, joined, EDGES)
    made = written(top(lists.unionByName(fresh), k), "lists")
    return made, made.join(lists, ["src", "dst"], "left_anti").count()


def searched(nodes: DataFrame, k: int, block: int, orders: int, rounds: int, seed: int) -> DataFrame:
    lists = started(nodes, k, block, orders, seed)
    n = nodes.count()
    for _ in range(rounds):
        lists, moved = refined(lists, nodes, k)
        if moved <= 0.01 * k * n:
            break
    return lists


def audit(nodes: DataFrame, threshold: float, sample: int, few: int, enough: int = 64) -> tuple[float, float, int]:
    """(recall, recall of classes with at most ``few`` links, classes with links) by classes compared with all vectors.

    Recall is the mean over sampled classes with links of the share of their links whose ends are in one part, so a
    class of a large group counts like one of a pair; 1 where no class has a link. At first about ``sample`` classes are
    drawn, then up to 16 times as many until ``enough`` of them have links.
    """
    n = nodes.count()
    share = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) / (1 << 30)
    size, most = sample, 16 * sample
    while True:
        # a bounded query set against all rows
        drawn: dict[int, list] = {}
        for id_, kind, part, unit in nodes.filter(share * n < size).select("id", "kind", "part", "unit").collect():
            drawn.setdefault(kind, []).append((id_, part, bytes(unit)))
        shared = nodes.sparkSession.sparkContext.broadcast(drawn)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[dict]:
            chosen = {k: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)) for k, rows in shared.value.items()}
            links, together = ({k: np.zeros(len(v[0]), np.int64) for k, v in chosen.items()} for _ in range(2))
            for batch in slices(batches, 256 << 10):
                ids, kinds, parts = (batch.column(i).to_numpy() for i in range(3))
                for kind in np.unique(kinds):
                    if kind not in chosen:
                        continue
                    own, part, units = chosen[kind]
                    at = np.flatnonzero(kinds == kind)
                    near = (matrix(batch.column(3).take(pa.array(at))) @ units.T >= threshold) & (ids[at][:, None] != own[None, :])
                    links[kind] += near.sum(axis=0)
                    together[kind] += (near & (parts[at][:, None] == part[None, :])).sum(axis=0)
            for kind, (own, _, _) in chosen.items():
                some = np.flatnonzero(links[kind])
                yield {"id": own[some], "links": links[kind][some], "together": together[kind][some]}

        made = map_arrow(nodes.select("id", "kind", "part", "unit"), run, "id bigint, links bigint, together bigint")
        found = made.groupBy("id").agg(F.sum("links"), F.sum("together")).collect()
        if len(found) >= enough or size >= min(n, most):
            break
        size *= 4
    mean = lambda rows: float(np.mean([r[2] / r[1] for r in rows])) if rows else 1.0
    return mean(found), mean([r for r in found if r[1] <= few]), len(found)


def count_links(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, n_links): rows of other classes of the same part that each class links with, counted block against block."""
    sizes = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    n = F.ceil(F.col("size") / block).cast("int")
    rows = nodes.join(sizes, "part").select("part", "id", "rows", "unit", n.alias("n"), F.pmod(F.xxhash64("id"), n).cast("int").alias("mine"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("part", "id", "rows", "unit", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        ids, weight, mine = (table[c].to_numpy() for c in ("id", "rows", "mine"))
        units, i, j = matrix(table["unit"]), table["i"][0].as_py(), table["j"][0].as_py()
        first, second = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        near = units[first] @ units[second].T >= threshold
        near[ids[first][:, None] == ids[second][None, :]] = False
        out = [(ids[first], near @ weight[second])] + ([] if i == j else [(ids[second], weight[first] @ near)])
        return pa.table({"id": pa.array(np.concatenate([x[0] for x in out]), pa.int64()), "n_links": pa.array(np.concatenate([x[1] for x in out]), pa.int64())})

    # else all blocks of a part would stay where the join put the part
    return met.repartition("part", "i", "j").groupBy("part", "i", "j").applyInArrow(run, "id bigint, n_links bigint").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    k: int = 12,
    block: int = 64,
    orders: int = 4,
    rounds: int = 3,
    target: float = 0.99,
    most_repeats: int = 8,
    sample: int = 256,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Only vectors of one label and length are compared, by cosine in double precision. Vectors that are null, empty or
    zero, hold null or non-finite components, or have no label link with nothing. component_id is the smallest vec_id
    that links reach, kept marks rows that carry it; a null vec_id is larger than any other. Equal and repeated vectors
    are linked. An empty table gives no rows; other columns are not read. ``target`` is the audited recall, of all
    classes and of those with few links, that stops the search, ``most_repeats`` how often it runs over all classes again
    to reach it; where it is not reached, a warning gives the measured recall.
    """
    rows = prepared(vectors, id_col, vector_col, label_col)
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("kind").alias("kind"), F.first("unit").alias("unit"))
    nodes = written(classes.withColumn("part", F.col("id")), "classes")
    links = None
    chosen, search, repeats = nodes, 0, 0
    while True:
        lists = searched(chosen, k, block, orders, rounds, seed + search)
        found = written(lists.filter(F.col("sim") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b")), "links")
        grew = found.limit(1).count() > 0
        links = found if links is None else links.unionByName(found)
        if grew:
            parts = connected_components(links).select("id", F.col("component").alias("_part"))
            nodes = written(nodes.join(parts, "id", "left").withColumn("part", F.coalesce("_part", "part")).drop("_part"), "classes")
        # a list without room for more links may hide some
        saturated = lists.groupBy("src").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).filter((F.col("low") >= threshold) & (F.col("n") >= k))
        more = saturated.select(F.col("src").alias("id"))
        search += 1
        if more.limit(1).count() > 0:
            # every such list joins parts, so this ends
            chosen = written(nodes.join(more, "id", "left_semi"), "saturated")
            continue
        whole, small, linked = audit(nodes, threshold, sample, k)
        if min(whole, small) >= target:
            break
        if repeats >= most_repeats:
            warnings.warn(f"near_vectors: audited recall {whole:.4f}, {small:.4f} of classes with at most {k} links, over {linked} classes, is below the target {target} after {repeats} repeats")
            break
        chosen, repeats = nodes, repeats + 1
    counted = count_links(nodes, threshold, 512)
    per_class = written(nodes.join(counted, "id", "left").select("key", "part", (F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1).alias("n_links")), "counted")
    joined = written(rows.select("row", "vec_id", "key").join(per_class, "key", "left"), "joined")
    low = joined.filter(F.col("part").isNotNull()).groupBy("part").agg(F.min("vec_id").alias("low"))
    out = joined.join(low, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col("vec_id")).otherwise(F.col("low")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
