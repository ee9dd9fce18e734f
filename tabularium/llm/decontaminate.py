"""Benchmark decontamination by winnowing fingerprints.

Both sides hash every k-gram of words and keep the smallest hash of each run of ``window - k + 1`` consecutive k-grams,
so two texts that share ``window`` consecutive words share a kept fingerprint. Documents and items are joined on
fingerprints; each hit is then extended to every position where the words of a whole window agree. Items shorter than a
window are one window of all their words; for them the documents also keep the hashes of all runs of that length.
Only a bitmap of fixed size is broadcast; it lets through every fingerprint of an item and few others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, slices, written

#: bytes that belong to no word become spaces, A-Z become a-z
WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BITMAP_BITS = 23


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class WordHashes(dict):
    """64-bit hash of each word, kept while there are at most ``most`` of them."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return words[:0]
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Distinct smallest hashes of each ``run`` consecutive ones."""
    if len(hashes) < run:
        return hashes[:0]
    low = hashes
    have = 1
    while have < run:
        step = min(have, run - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return np.unique(low)


def fingerprints(words: np.ndarray, k: int, window: int, short: list[int]) -> np.ndarray:
    """Winnowed k-grams, with all runs of the lengths in ``short``."""
    kept = [winnow(run_hashes(words, k), window - k + 1)] + [run_hashes(words, n) for n in short]
    return np.unique(np.concatenate(kept))


class Item:
    """Words, window length and windows of a benchmark text."""

    def __init__(self, text: str, window: int, memo: WordHashes):
        self.words = words_of(text)
        self.n = min(window, len(self.words))
        self.hashes = run_hashes(memo.of(self.words), self.n) if self.n else np.empty(0, np.uint64)
        self.windows = {tuple(self.words[at : at + self.n]) for at in range(len(self.hashes))}


def hits(words: list[bytes], hashes: np.ndarray, items: list[tuple[str, Item]]) -> tuple[int, list[str]]:
    """(words inside occurrences, ids of items that occur); hash matches are confirmed on the words."""
    inside, found = np.zeros(len(words) + 1, dtype=np.int64), set()
    for n in {item.n for _, item in items if item.n}:
        alike = [(name, item) for name, item in items if item.n == n]
        wanted = np.concatenate([item.hashes for _, item in alike])
        for at in np.flatnonzero(np.isin(run_hashes(hashes, n), wanted)):
            run = tuple(words[at : at + n])
            owners = {name for name, item in alike if run in item.windows}
            if owners:
                found |= owners
                inside[at] += 1
                inside[at + n] -= 1
    return int((np.cumsum(inside) > 0).sum()), sorted(found)


def text_key(*cols: str) -> Column:
    """Key that repeated rows share: their results are the same."""
    return F.xxhash64(*[F.col(c) for c in cols])


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    k: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (sorted ids of items of which a window occurs), key (``text_key``).

    Null and empty texts have no words and no hits, and a null or empty item no windows; a null item id counts as ''.
    Repeated documents get equal rows, repeated items count once per id. Empty tables give no rows or no hits. Columns
    beside ids and texts are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("key", text_key("doc_id", "text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("item_text"))
    items = items.filter(F.col("item_text").isNotNull()).distinct()

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo = WordHashes()
        for batch in slices(batches):
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = memo.of(words_of(text))
                # a short item is one window: its whole run is its fingerprint
                made = fingerprints(words, k, window, []) if len(words) >= window else run_hashes(words, max(1, len(words)))
                rows += [(name, p, len(words)) for p in made.view(np.int64).tolist()]
            yield dict(zip(("item", "print", "n"), zip(*rows))) if rows else {"item": [], "print": [], "n": []}

    prints = written(map_arrow(items, item_prints, "item string, print bigint, n bigint"), "winnow-items")
    # lengths below a window only: at most window - 1 values
    short = sorted(r[0] for r in prints.filter(F.col("n") < window).select("n").distinct().collect())
    slot = F.shiftrightunsigned("print", 64 - BITMAP_BITS)
    masks = prints.select(F.shiftright(slot, 6).alias("w"), (slot % 64).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    for w, bits in masks.collect():  # at most 2^17 rows of a bitmap of 1 MB, whatever the benchmark holds
        bitmap[w] = bits
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo, known = WordHashes(), shared.value
        for batch in slices(batches):
            counts, found, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                made = fingerprints(memo.of(words), k, window, short)
                at = made >> np.uint64(64 - BITMAP_BITS)
                seen = (known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
                counts.append(len(words))
                found.append(made[seen == 1].view(np.int64).tolist())
                texts.append(text if found[-1] else None)
            yield {"doc_id": batch.column(0), "key": batch.column(2), "n_words": counts, "prints": found, "text": texts}

    kind = dict(docs.dtypes)["doc_id"]
    # texts go along only where a fingerprint passed the bitmap
    counted = written(map_arrow(docs, doc_prints, f"doc_id {kind}, key bigint, n_words bigint, prints array<bigint>, text string"), "winnow-documents")
    met = counted.select("doc_id", "key", F.explode("prints").alias("print")).join(prints.select("print", "item").distinct(), "print")
    # the items of one document are no more than its own fingerprints meet
    wanted = met.select("doc_id", "key", "item").distinct().join(items, "item")
    wanted = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item", "item_text")).alias("met"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        memo, known = WordHashes(), {}
        for batch in slices(batches, 4 << 20):
            n_hit, found = [], []
            for text, met in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = words_of(text)
                if len(known) > 5_000:
                    known.clear()
                for x in met:
                    if x["item_text"] not in known:
                        known[x["item_text"]] = Item(x["item_text"], window, memo)
                hit, names = hits(words, memo.of(words), [(x["item"], known[x["item_text"]]) for x in met])
                n_hit.append(hit)
                found.append(names)
            yield {"doc_id": batch.column(0), "key": batch.column(1), "n_hit": n_hit, "items": found}

    texts = counted.filter(F.col("text").isNotNull()).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.key") == F.col("w.key"))
    candidates = texts.join(wanted.alias("w"), same).select("t.doc_id", "t.key", "t.text", "w.met")
    confirmed = map_arrow(candidates, extend, f"doc_id {kind}, key bigint, n_hit bigint, items array<string>").dropDuplicates(["doc_id", "key"])
    same = F.col("c.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("c.key") == F.col("h.key"))
    return counted.alias("c").join(confirmed.alias("h"), same, "left").select(
        "c.doc_id", "c.n_words", F.coalesce("h.n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("h.items", F.array().cast("array<string>")).alias("items"), "c.key")


def verdict(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds ``contaminated``: at least one hit, and hits are ``percent`` per cent of the words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """Documents without the contaminated ones, columns unchanged."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = verdict(contamination(documents, benchmark, **options), percent).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    # the row goes along as one struct, so its column names meet no others
    keyed = documents.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("own_key"))
    return keyed.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key")), "left_anti").select("doc.*")
