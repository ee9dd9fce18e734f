"""Centroid clustering on bit planes.

A vector of 64 integers is kept as one 64-bit word per bit of its two's complement: word i holds bit i of every component.
The dot product of a vector and a centroid is then a sum over pairs of their words: 2^i * 2^j times the number of ones the
two words share, negative where one of the two is a sign word. Distances and sums of components are exact integers.

Vectors are packed once and written; every round reads the words, and a task adds up one count and 64 sums a cluster. Only
those sums reach the driver, so a cluster may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_vectors, map_arrow, slices, summed, written

WIDTH = 64
#: distances of larger components need not fit in a long
LARGEST = 1 << 27


def planes_of(x: np.ndarray, n_planes: int) -> np.ndarray:
    """Words of rows of 64 integers, lowest bit first, the sign last."""
    bits = ((x[:, None, :] >> np.arange(n_planes)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def weights(n_planes: int) -> np.ndarray:
    out = np.left_shift(np.int64(1), np.arange(n_planes, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def component_sums(words: np.ndarray) -> np.ndarray:
    """Sum of each of the 64 components over rows of words."""
    total = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(words), 4096):
        part = np.ascontiguousarray(words[at : at + 4096])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), part.shape[1], 8), axis=2, bitorder="little")
        total += weights(words.shape[1]) @ bits.sum(axis=0, dtype=np.int64)
    return total


def dots(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Dot product of each row of words with one centre's words, by counts of shared ones."""
    scale = weights(words.shape[1])
    total = np.zeros(len(words), dtype=np.int64)
    for weight, word in zip(scale, centre):
        if word:
            total += weight * (np.bitwise_count(words & word).astype(np.int64) @ scale)
    return total


def nearest(words: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row (of two as near the first) and its squared distance."""
    own = planes_of(centres, words.shape[1])
    squares = (centres * centres).sum(axis=1)
    apart = np.stack([norms + s - 2 * dots(words, c) for s, c in zip(squares, own)], axis=1)
    cluster = apart.argmin(axis=1)
    return cluster, apart[np.arange(len(words)), cluster]


def packed(rows: DataFrame, scale: float) -> tuple[DataFrame, int]:
    """Written table (vec_id, words, norm) of clean vectors of 64 components, and the number of planes."""
    largest = rows.agg(F.max(F.array_max(F.transform("vector", lambda c: F.abs(c)))).alias("most")).first()["most"] or 0.0
    reach = math.floor(scale * largest) + 1
    if reach > LARGEST:
        raise ValueError(f"a component of {largest} is too large: squared distances would not fit in a long")
    n_planes = reach.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 2 << 20):
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            x = np.floor(scale * values).astype(np.int64)
            yield {"vec_id": batch.column(0), "words": planes_of(x, n_planes).view(np.int64).tolist(), "norm": (x * x).sum(axis=1)}

    kind = dict(rows.dtypes)["vec_id"]
    return written(map_arrow(rows, run, f"vec_id {kind}, words array<bigint>, norm bigint"), "planes"), n_planes


def words_of(column: pa.Array, n_planes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, n_planes)


def first_centres(table: DataFrame, k: int, n_planes: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id, in hash order; repeated ids by their words."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    found = table.select("words", order.alias("drawn")).orderBy(F.asc_nulls_last("drawn"), "words").limit(k).collect()
    words = np.array([r["words"] for r in found], dtype=np.int64).view(np.uint64).reshape(len(found), n_planes)
    return np.array([component_sums(row[None, :]) for row in words], dtype=np.int64).reshape(len(found), WIDTH)


def cluster_totals(table: DataFrame, centres: np.ndarray, n_planes: int) -> np.ndarray:
    """Per cluster: rows, summed squared distance, sums of the 64 components; exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((len(centres), 2 + WIDTH), dtype=object)
        for batch in slices(batches, 2 << 20):
            words = words_of(batch.column(0), n_planes)
            cluster, apart = nearest(words, batch.column(1).to_numpy(), centres)
            for k in np.unique(cluster):
                mine = cluster == k
                near = apart[mine]
                # sums of a slice may leave 64 bits only where distances do nearly
                spread = int(near.sum()) if int(near.max()) * len(near) < 1 << 62 else sum(map(int, near))
                total[k] += np.array([int(mine.sum()), spread, *map(int, component_sums(words[mine]))], dtype=object)
        yield {"part": [total.ravel().tolist()]}

    sums, _ = summed(table.select("words", "norm"), run, "decimal(38,0)")
    return np.array([int(s) for s in sums], dtype=object).reshape(len(centres), 2 + WIDTH)


def cluster(
    embeddings: DataFrame,
    k: int = 8,
    rounds: int = 10,
    scale: float = 1024.0,
    salt: str = "3:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector of 64 components.

    Components become integers floor(scale * c). Centroids start as the k vectors with the smallest sha256 of salt and id
    and move ``rounds`` times to the floored mean of their vectors; an empty one stays. Distances are squared, inertias
    their exact sums; centroid_sha256 hashes the components in decimal, joined by commas.

    Vectors that are null, of another width, or hold null or non-finite entries are left out. Of two centroids as near the
    smaller number wins. Fewer than k vectors make fewer centroids; repeated rows are vectors of their own, and several
    may be centroids; null ids are drawn last. A component whose distances need not fit in a long is an error. An empty
    table gives no rows; other columns are not read.
    """
    clean = clean_vectors(embeddings, id_col, vector_col)
    table, n_planes = packed(clean.filter(F.size("vector") == WIDTH), scale)
    centres = first_centres(table, k, n_planes, salt)
    for _ in range(rounds if len(centres) else 0):
        totals = cluster_totals(table, centres, n_planes)
        moved = np.array([[s // t[0] for s in t[2:]] if t[0] else own for t, own in zip(totals, centres)], dtype=np.int64)
        if (moved == centres).all():
            # further rounds would change nothing
            break
        centres = moved
    inertia = [int(t[1]) for t in cluster_totals(table, centres, n_planes)] if len(centres) else []
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 2 << 20):
            own, apart = nearest(words_of(batch.column(1), n_planes), batch.column(2).to_numpy(), centres)
            yield {
                "vec_id": batch.column(0),
                "cluster": own.astype(np.int32),
                "distance": apart,
                "cluster_inertia": np.array(inertia)[own],
                "inertia": np.full(len(own), sum(inertia)),
                "centroid_sha256": [digests[i] for i in own],
            }

    kind = dict(table.dtypes)["vec_id"]
    return map_arrow(table, run, f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
