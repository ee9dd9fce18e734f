"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Each distinct shingle set is a class with a sketch of minwise tokens. A tree sends a class down ``branches`` paths per
level, each path extended by the sketch's token at a coordinate chosen for that tree and level. A node of few classes
is compared exhaustively on sketches; a larger node branches again. Trees are independent, so a pair of similarity s is
missed by all of them with a probability that falls geometrically. Every link is confirmed on full sets.

Crowded nodes are folded first: their classes are linked to representatives, confirmed on full sets, and the parts
these links join are the homes of the classes. From then on only classes of different homes need to meet. A node of one
home ends there, so a group of near copies takes no further path; a node where one home meets few others compares these
with all of it; a node whose other classes stay half or more of its parent's is compared on full sets in blocks.
Every class stays in the search, and links between homes are looked for as before.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .decontaminate import WordHashes, run_hashes
from .shared import map_arrow, row_keys, slices, whole_groups, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITMAP_BITS = 23


def shingles(text: str | None, memo: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; ASCII white space separates words, A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.unique(run_hashes(memo.of(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def signature(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def multipliers(n: int, seed: int) -> np.ndarray:
    draw = random.Random(seed)
    return np.array([draw.getrandbits(64) | 1 for _ in range(n)], dtype=np.uint64)


def sketch(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minwise token at each coordinate, as 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 2048):
        low = np.minimum(low, (factors[:, None] * own[None, at : at + 2048]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def sketched(documents: DataFrame, coordinates: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key_a, key_b (of id and text), n_shingles, sig (null without words), sketch."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    factors = multipliers(coordinates, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo = WordHashes()
        for batch in slices(batches):
            counts, sigs, made = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, memo)
                counts.append(len(own))
                sigs.append(signature(own) if len(own) else None)
                made.append(sketch(own, factors).view(np.int32).tolist() if len(own) else None)
            yield {"doc_id": batch.column(0), "key_a": batch.column(2), "key_b": batch.column(3), "n_shingles": counts, "sig": sigs, "sketch": made}

    kind = dict(docs.dtypes)["doc_id"]
    return written(map_arrow(docs, run, f"doc_id {kind}, key_a bigint, key_b bigint, n_shingles bigint, sig binary, sketch array<int>"), "sketches")


def first_paths(classes: DataFrame, trees: int, branches: int, coordinates: int, seed: int) -> DataFrame:
    """(sig, tree, node, cell) of the first level, which takes other coordinates in every tree.

    A cell holds the classes of a node that share two more tokens. It is told from the sketch at hand, so no sketch is joined.
    """
    order = random.Random(seed).sample(range(coordinates), coordinates)
    first = [(tree, order[(tree * branches + i) % coordinates]) for tree in range(trees) for i in range(branches)]
    draw = random.Random(seed + 1)
    tables = [[draw.randrange(coordinates) for _ in range(trees)] for _ in range(2)]
    node = lambda t, c: F.xxhash64(F.lit(t), F.lit(c), F.get("sketch", F.lit(c)))
    cell = lambda t, c: F.xxhash64(node(t, c), *[F.get("sketch", F.lit(table[t])) for table in tables])
    keys = [F.struct(F.lit(t).alias("tree"), node(t, c).alias("node"), cell(t, c).alias("cell")) for t, c in first]
    return classes.select("sig", F.inline(F.array(*keys)))


def attach(pairs: DataFrame, table: DataFrame, value: str, heavy: int = 512) -> DataFrame:
    """The pairs with ``value`` of both sides, ``value_a`` and ``value_b``; a class of more than ``heavy`` pairs is dealt over copies of its row.

    Such classes are counted once for both sides and written, so neither join is planned again to count the other side.
    """
    sides = [F.struct(F.col(side).alias("sig"), F.lit(side).alias("side")) for side in "ab"]
    counted = pairs.select(F.inline(F.array(*sides))).groupBy("sig", "side").agg(F.ceil(F.count(F.lit(1)) / heavy).cast("int").alias("parts"))
    hot = written(counted.filter("parts > 1"), "hot")
    for side, other in ("ab", "ba"):
        own = hot.filter(F.col("side") == side).select(F.col("sig").alias(side), "parts")
        salted = pairs.join(own, side, "left").withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")).drop("parts")
        held = table.select(F.col("sig").alias(side), F.col(value).alias(f"{value}_{side}")).join(own, side, "left")
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        pairs = salted.join(held, [side, "salt"]).drop("salt")
    return pairs


def star_pairs(paths: DataFrame, classes: DataFrame, leaf: int, trees: int, coordinates: int, floor: float, seed: int) -> DataFrame:
    """Distinct pairs (a, b) of classes in crowded nodes with representatives whose sketches agree in ``floor`` or more.

    A representative is the least or the largest class that shares two more tokens in the node, so every group inside a
    node has its own, and a class takes part in at most two pairs a node.
    Cells come with the paths; ``trees`` and ``seed`` are those the paths were made with.
    """
    crowded = paths.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > leaf)
    cells = written(paths.join(crowded, "node", "left_semi").select("sig", "cell"), "cells")
    ends = cells.groupBy("cell").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).filter("low < high")
    met = cells.join(ends, "cell")
    pairs = met.select(F.col("low").alias("a"), F.col("sig").alias("b")).union(met.select(F.col("sig").alias("a"), F.col("high").alias("b")))
    pairs = written(pairs.filter("a < b").distinct(), "stars")
    both = attach(pairs, classes, "sketch")
    agree = F.size(F.filter(F.arrays_zip("sketch_a", "sketch_b"), lambda t: t["sketch_a"] == t["sketch_b"]))
    return both.filter(agree >= floor * coordinates).select("a", "b")


def grow(
    paths: DataFrame, classes: DataFrame, trees: int, branches: int, leaf: int, coordinates: int, depth: int, seed: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """(node, sig, home) of nodes to compare on sketches, and (node, i, j, mine, sig, home) of those to compare on full sets.

    ``paths`` has the first level with homes. Groups (node, i, j) hold the classes of blocks i and j; block -1 are the
    classes outside the largest home of a node that has few of them.
    """
    draw = random.Random(seed)
    leaves, thinned, dense = [], [], []
    paths = paths.withColumn("parent", F.lit(1 << 62))
    for level in range(depth):
        homes = paths.groupBy("node", "home").agg(F.count(F.lit(1)).alias("n"))
        nodes = homes.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "home")).alias("top"))
        nodes = nodes.select("node", "size", (F.col("size") - F.col("top.n")).alias("others"), F.col("top.home").alias("top")).filter("others > 0")
        members = written(paths.join(nodes, "node"), "nodes")
        leaves.append(members.filter(F.col("size") <= leaf).select("node", "sig", "home"))
        large = members.filter(F.col("size") > leaf)
        few = F.col("others") < leaf
        parts = F.ceil((F.col("size") - F.col("others")) / block).cast("int")
        own = F.when(F.col("home") == F.col("top"), F.pmod(F.xxhash64("sig"), parts).cast("int")).otherwise(-1)
        thin = large.filter(few).withColumns({"mine": own, "parts": parts})
        to = F.when(F.col("mine") >= 0, F.array(F.col("mine"))).otherwise(F.sequence(F.lit(-1), F.col("parts") - 1))
        thinned.append(thin.select("node", F.lit(-1).alias("i"), F.explode(to).alias("j"), "mine", "sig", "home"))
        alike = F.lit(level == depth - 1) | (F.col("others") * 2 >= F.col("parent"))
        dense.append(large.filter(~few & alike).select("node", "sig", "home", "size"))
        rest = large.filter(~few & ~alike)
        if level == depth - 1 or rest.limit(1).count() == 0:
            break
        table = F.array(*[F.array(*[F.lit(c) for c in draw.sample(range(coordinates), branches)]) for _ in range(trees)])
        grown = rest.join(classes, "sig").withColumn("at", F.explode(F.get(table, F.col("tree"))))
        # one path per node and coordinate: two coordinates drawn alike give one child
        child = F.xxhash64("node", "at", F.get("sketch", F.col("at"))).alias("node")
        paths = grown.select("sig", "home", "tree", child, F.col("others").alias("parent")).distinct()
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    # the nodes of all levels are dealt at once: a plan of few joins, whatever the depth
    return union(leaves), written(union(thinned).unionByName(dense_blocks(union(dense), block)), "blocks")


def dense_blocks(dense: DataFrame, block: int) -> DataFrame:
    """(node, i, j, mine, sig, home): every two classes of a node meet in a group (i, j), unless they meet in another node.

    Each class names the largest node that holds it. Classes of a node that name one other node meet there, as both name
    it; the most numerous of these meet only the rest of the node, which is left out if there is none.
    """
    named = written(dense.withColumn("first", F.max(F.struct("size", "node")).over(Window.partitionBy("sig"))["node"]), "dense")
    done = named.filter("first != node").groupBy("node", "first").agg(F.count(F.lit(1)).alias("n"))
    done = done.groupBy("node").agg(F.max(F.struct("n", "first")).alias("done"))
    cut = lambda n: F.ceil(n / block).cast("int")
    known, others = F.coalesce("done.n", F.lit(0)), F.col("size") - F.coalesce("done.n", F.lit(0))
    spared = known * cut(others) + others * (cut(others) + cut(known)) < F.col("size") * cut(F.col("size"))
    dealt = named.join(done, "node", "left").withColumn("known", F.when(spared, known).otherwise(0))
    dealt = dealt.filter("size > known").withColumns({"few": cut(F.col("size") - F.col("known")), "many": cut(F.col("known"))})
    apart = (F.col("known") > 0) & (F.col("first") == F.col("done.first"))
    place = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    dealt = dealt.withColumn("mine", F.when(apart, F.col("few") + place("many")).otherwise(place("few")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(apart, 0).otherwise(F.col("many")))))
    return met.select("node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sig", "home")


def leaf_pairs(leaves: DataFrame, classes: DataFrame, coordinates: int, floor: float) -> DataFrame:
    """Distinct pairs (a, b) of a leaf with different homes whose sketches agree in ``floor`` of the coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part, groups in whole_groups(batches, "node"):
            sigs, rows = part.column("sig").to_pylist(), np.array(part.column("sketch").to_pylist(), dtype=np.int32)
            homes = part.column("home").to_pylist()
            out_a, out_b = [], []
            for lo, hi in groups:
                own = rows[lo:hi]
                same = (own[:, None, :] == own[None, :, :]).sum(axis=2)
                for i, j in zip(*np.nonzero(np.triu(same >= floor * coordinates, 1))):
                    if homes[lo + i] != homes[lo + j]:
                        a, b = sorted((sigs[lo + i], sigs[lo + j]))
                        out_a.append(a)
                        out_b.append(b)
            yield {"a": out_a, "b": out_b}

    placed = leaves.join(classes, "sig").select("node", "sig", "home", "sketch").repartition("node").sortWithinPartitions("node")
    return map_arrow(placed, run, "a binary, b binary").distinct()


def full_sets(documents: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """(sig, own) with the whole shingle set of each needed class; a bitmap of 1 MB spares most others the way."""
    spark = documents.sparkSession
    head = F.conv(F.substring(F.hex("sig"), 1, 8), 16, 10).cast("bigint")
    slot = F.shiftright(head, 32 - BITMAP_BITS)
    masks = needed.select(F.shiftright(slot, 6).alias("w"), (slot % 64).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for w, bits in masks.collect():  # at most 2^17 rows whatever is needed
        bitmap[w] = bits
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo, known, seen = WordHashes(), shared.value, set()
        for batch in slices(batches):
            sigs, sets = [], []
            for text in batch.column(0).to_pylist():
                own = shingles(text, memo)
                if not len(own):
                    continue
                sig = signature(own)
                at = int.from_bytes(sig[:4], "big") >> (32 - BITMAP_BITS)
                if sig not in seen and int(known[at >> 6]) >> (at & 63) & 1:
                    seen.add(sig)
                    sigs.append(sig)
                    sets.append(own.tobytes())
            yield {"sig": sigs, "own": sets}

    made = map_arrow(documents.select(F.col(text_col).cast("string")), run, "sig binary, own binary")
    # equal classes have equal sets; a task gives each class once
    return written(made.join(needed, "sig", "left_semi").groupBy("sig").agg(F.first("own").alias("own")), "sets")


def alike(common, size_a, size_b, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (size_a + size_b - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            out_a, out_b = [], []
            for a, b, own_a, own_b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(own_a, np.uint64), np.frombuffer(own_b, np.uint64)
                if alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    out_a.append(a)
                    out_b.append(b)
            yield {"a": out_a, "b": out_b}

    return map_arrow(attach(pairs, sets, "own").select("a", "b", "own_a", "own_b"), run, "a binary, b binary")


def block_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of large nodes: every two blocks meet in one task, which emits links that join homes not yet joined there."""
    met = blocks.join(sets, "sig")

    def run(table: pa.Table) -> pa.Table:
        sigs, mine = table["sig"].to_pylist(), table["mine"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sets_here = [np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()]
        lengths = np.array([len(x) for x in sets_here])
        indexed = np.flatnonzero(mine == j)
        # shingle -> texts of the second block that hold it
        owners = np.repeat(indexed, lengths[indexed])
        tokens = np.concatenate([sets_here[x] for x in indexed]) if len(indexed) else np.empty(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        # classes of one home are joined already
        homes: dict[bytes, int] = {}
        parent = [homes.setdefault(home, at) for at, home in enumerate(table["home"].to_pylist())]

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        for x in np.flatnonzero(mine == i):
            lo, hi = np.searchsorted(tokens, sets_here[x]), np.searchsorted(tokens, sets_here[x], side="right")
            spans = [owners[a:b] for a, b in zip(lo, hi) if b > a]
            if not spans:
                continue
            common = np.bincount(np.concatenate(spans), minlength=len(sigs))
            for y in np.flatnonzero(alike(common, lengths[x], lengths, percent) & (common > 0)):
                a, b = root(int(x)), root(int(y))
                if a != b:
                    parent[a] = b
                    out_a.append(sigs[x])
                    out_b.append(sigs[y])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return met.groupBy("node", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(
    documents: DataFrame,
    percent: int = 75,
    trees: int = 6,
    branches: int = 2,
    leaf: int = 32,
    coordinates: int = 64,
    depth: int = 8,
    block: int = 512,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, with key_a and key_b (hashes of id and text).

    component_id is the smallest doc_id that links of similarity ``percent`` or more reach; kept marks rows that carry
    it. Null, empty and wordless texts have no shingles and stay alone. Equal texts are one class and are compared once;
    repeated rows get equal results. A null id is larger than any other. An empty table gives no rows; other columns are
    not read. Sketch agreement may fall ``3.5`` standard deviations short before a pair of a leaf is left out.
    """
    rows = sketched(documents, coordinates, seed, id_col, text_col)
    classes = written(rows.filter("sig IS NOT NULL").groupBy("sig").agg(F.first("sketch").alias("sketch")), "classes")
    s = percent / 100
    floor = s - 3.5 * (s * (1 - s) / coordinates) ** 0.5
    paths = first_paths(classes, trees, branches, coordinates, seed)
    stars = written(star_pairs(paths, classes, leaf, trees, coordinates, floor, seed), "stars")
    ends = lambda pairs: pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    folded = full_sets(documents, written(ends(stars).distinct(), "needed"), text_col)
    star_links = written(confirm(stars, folded, percent), "links")
    homes = connected_components(star_links).select(F.col("id").alias("sig"), "component")
    placed = paths.join(homes, "sig", "left").select("sig", "tree", "node", F.coalesce("component", "sig").alias("home"))
    leaves, blocks = grow(placed, classes, trees, branches, leaf, coordinates, depth, seed, block)
    pairs = written(leaf_pairs(leaves, classes, coordinates, floor), "pairs")
    needed = ends(pairs).union(blocks.select("sig")).distinct().join(folded, "sig", "left_anti")
    sets = folded.unionByName(full_sets(documents, written(needed, "needed"), text_col))
    # each kind of links is written by itself, so the driver plans and runs the joins of one kind at a time
    links = [star_links, written(confirm(pairs, sets, percent), "links"), written(block_links(blocks, sets, percent), "links")]
    links = links[0].unionByName(links[1]).unionByName(links[2])
    parts = connected_components(links).select(F.col("id").alias("sig"), "component")
    joined = rows.select("doc_id", "key_a", "key_b", "n_shingles", "sig").join(parts, "sig", "left")
    group = F.coalesce("component", "sig")
    joined = written(joined.select("doc_id", "key_a", "key_b", "n_shingles", group.alias("group")), "grouped")
    # rows without words have no group; partial aggregation keeps a large group from one task
    low = joined.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("low"))
    out = joined.join(low, "group", "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "key_a", "key_b")


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, columns unchanged; of repeated rows one stays."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = near_duplicates(documents, **options).filter("kept").select("key_a", "key_b").distinct()
    # the row goes along as one struct, so its column names meet no others
    keyed = documents.select(F.struct("*").alias("doc"), *row_keys(id_col, text_col))
    return keyed.join(kept, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"]).select("doc.*")
