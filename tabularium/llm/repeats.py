"""Long repeated byte strings over a corpus, by sorting suffixes that start at anchors of the content.

A window is ``length`` bytes at any position of a text. Its anchor is the position, among the first ``spread`` of the
window, whose eight bytes hash lowest, so equal windows have their anchors at equal places. Positions in a row with one
anchor are a piece: the bytes from its first window's start to its last one's end. Equal windows lie in pieces with the same
context, the ``length - spread + 1`` bytes behind the anchor, which all windows of a piece cover.

Contexts met once end there. Pieces that are equal throughout are counted: all their windows repeat. What is left are
different pieces with one context, of which only one copy each is sorted, with its neighbours of the same context: a suffix
array of the anchors by deep-shallow sorting (multikey quicksort on words to a shallow depth, then a blind trie for each set
that is still equal there), and one of the reversed bytes before them. Two windows at the same distance o before their
anchors are equal where the suffixes share length - o bytes and the reversed prefixes o, which both arrays' shared lengths
tell for all pieces at once. A context with more than ``most`` different pieces is not brought to one task: its windows are
counted by 128-bit hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, row_keys, slices, whole_groups, written

SHALLOW = 32
#: positions of a long text that are handled at once
STRIDE = 4 << 20
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(buffer: np.ndarray, spread: int) -> np.ndarray:
    """For each position the one among it and the next ``spread - 1`` whose eight bytes hash lowest, the first of equal ones."""
    n = len(buffer)
    padded = np.concatenate([buffer, np.zeros(16 + (-n) % 8, np.uint8)])
    grams = np.empty(n + (-n) % 8, dtype=np.uint64)
    for at in range(8):
        own = grams[at::8]
        own[:] = padded[at : at + 8 * len(own)].view(np.uint64)
    grams = grams[:n] * MIX_A
    grams ^= grams >> np.uint64(32)
    grams *= MIX_B
    # hash above, position below: the least is the first of the lowest
    grams &= np.uint64(0xFFFFFFFF00000000)
    grams |= np.arange(n, dtype=np.uint64)
    rows = np.concatenate([grams, np.full(2 * spread - n % spread, np.iinfo(np.uint64).max)]).reshape(-1, spread)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[spread - 1 : spread - 1 + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def cut(texts: list[bytes], length: int, spread: int) -> tuple[bytes, list[np.ndarray]]:
    """All texts as one buffer, and of each piece: text, start in it, windows, nearest window's distance to the anchor, place."""
    buffer = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.r_[0, ends[:-1]]
    at = anchors(np.frombuffer(buffer, np.uint8), spread)
    heads = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, starts[ends > starts])
    text = np.searchsorted(ends, heads, side="right")
    # a window does not leave its text
    stops = np.minimum(np.r_[heads[1:], len(buffer)], ends[text] - length + 1)
    whole = heads < stops
    heads, stops, text = heads[whole], stops[whole], text[whole]
    return buffer, [text, heads - starts[text], stops - heads, at[heads] - stops + 1, heads]


def segments(texts: list[bytes | None], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, first positions, bytes) of about one stride at a time; a longer text comes in parts that share no window."""
    rows, firsts, parts, held = [], [], [], 0
    for row, text in enumerate(texts):
        for first in range(0, len(text or b"") - length + 1, STRIDE):
            rows.append(row)
            firsts.append(first)
            parts.append(text[first : first + STRIDE + length - 1])
            held += len(parts[-1])
            if held >= STRIDE:
                yield rows, firsts, parts
                rows, firsts, parts, held = [], [], [], 0
    if rows:
        yield rows, firsts, parts


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def pieces(docs: DataFrame, length: int, spread: int) -> DataFrame:
    """Written (key_a, key_b, start, windows, near, context, content) of all pieces; the last two are hashes."""
    tail, seen = length - 1, length - spread + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for rows, firsts, parts in segments(batch.column(2).to_pylist(), length):
                buffer, (text, start, windows, near, place) = cut(parts, length, spread)
                view = memoryview(buffer)
                origin = (place + windows - 1 + near).tolist()
                stops = (place + windows + tail).tolist()
                row = np.array(rows)[text]
                yield {
                    "key_a": keys[0][row],
                    "key_b": keys[1][row],
                    "start": (start + np.array(firsts)[text]).astype(np.int32),
                    "windows": windows.astype(np.int32),
                    "near": near.astype(np.int32),
                    "context": signed([xxhash.xxh3_64_intdigest(view[a : a + seen], 1) for a in origin]),
                    "content": signed([xxhash.xxh3_64_intdigest(view[a:b], 2) for a, b in zip(place.tolist(), stops)]),
                }

    long_enough = docs.select("key_a", "key_b", "bytes").filter(F.octet_length("bytes") >= length)
    return written(map_arrow(long_enough, run, "key_a bigint, key_b bigint, start int, windows int, near int, context bigint, content bigint"), "pieces")


def shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (apart.bit_length() + 7) // 8


def multikey_quicksort(words: np.ndarray) -> list[np.ndarray]:
    """Rows of words in ascending order, as sets that are equal in all words."""
    out, todo = [], [(np.arange(len(words)), 0)]
    while todo:
        ids, depth = todo.pop()
        if len(ids) < 2 or depth == words.shape[1]:
            if len(ids):
                out.append(ids)
            continue
        own = words[ids, depth]
        pivot = own[len(own) // 2]
        todo += [(ids[own > pivot], depth), (ids[own == pivot], depth + 1), (ids[own < pivot], depth)]
    return out


class BlindTrie:
    """Order of distinct strings by the places where they branch: a descent looks at those bytes only, and one comparison
    with the leaf it ends at tells where the string leaves the trie. A node is [depth, {byte: node or string number}]."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def byte(self, number: int, depth: int) -> int:
        s = self.strings[number]
        return s[depth] if depth < len(s) else -1

    def insert(self, number: int) -> None:
        if self.root is None:
            self.root = number
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(self.byte(number, node[0]), next(iter(node[1].values())))
        depth = shared_bytes(self.strings[node], self.strings[number])
        old, parent, node = self.byte(node, depth), None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][self.byte(number, node[0])]
        if isinstance(node, list) and node[0] == depth:
            node[1][self.byte(number, depth)] = number
            return
        made = [depth, {old: node, self.byte(number, depth): number}]
        if parent is None:
            self.root = made
        else:
            parent[1][self.byte(number, parent[0])] = made

    def in_order(self) -> Iterator[tuple[int, int]]:
        """(string number, bytes it shares with the one before) in ascending order; the first shares 0."""
        todo = [(self.root, 0)]
        while todo:
            node, common = todo.pop()
            if not isinstance(node, list):
                yield node, common
                continue
            children = [node[1][c] for c in sorted(node[1])]
            todo += [(child, node[0]) for child in reversed(children[1:])]
            todo.append((children[0], common))


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending order of distinct strings, and the bytes each shares with the one before (0 for the first)."""
    heads = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(heads, dtype=">u8").reshape(len(strings), SHALLOW // 8).astype(np.uint64)
    order, common = [], []
    for ids in multikey_quicksort(words):
        trie = BlindTrie(strings)
        for number in ids.tolist():
            trie.insert(number)
        for place, (number, shares) in enumerate(trie.in_order()):
            # a set's first string meets the last one of the set before
            common.append(shares if place or not order else shared_bytes(strings[order[-1]], strings[number]))
            order.append(number)
    return np.array(order), np.array(common)


class Sorted:
    """A suffix array of strings that may repeat; ``classes`` tells which of them share a number of first bytes."""

    def __init__(self, strings: list[bytes]):
        distinct: dict[bytes, int] = {}
        self.own = np.array([distinct.setdefault(s, len(distinct)) for s in strings])
        self.order, self.common = deep_shallow(list(distinct))

    def classes(self, depth: int) -> np.ndarray:
        """Strings of at least ``depth`` bytes have one class where their first ``depth`` bytes are equal."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out[self.own]


def repeated_windows(texts: list[bytes], windows: np.ndarray, near: np.ndarray, length: int, spread: int) -> np.ndarray:
    """Matrix (piece, distance to the anchor) of the windows that occur in two of the pieces or more."""
    origin = (windows - 1 + near).tolist()
    after = Sorted([t[at:] for t, at in zip(texts, origin)])
    before = Sorted([t[:at][::-1] for t, at in zip(texts, origin)])
    out = np.zeros((len(texts), spread), dtype=bool)
    for o in range(spread):
        has = np.flatnonzero((near <= o) & (o < near + windows))
        if len(has) > 1:
            both = after.classes(length - o)[has] * (len(texts) + 1) + before.classes(o)[has]
            _, at, times = np.unique(both, return_inverse=True, return_counts=True)
            out[has, o] = times[at] > 1
    return out


def runs_of(marked: np.ndarray, windows: np.ndarray, near: np.ndarray) -> list[list[dict]]:
    """Per piece, the runs of marked windows by their place in it, from the first window on."""
    edges = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    out: list[list[dict]] = [[] for _ in range(len(marked))]
    for (piece, a), (_, b) in zip(np.argwhere(edges > 0).tolist(), np.argwhere(edges < 0).tolist()):
        # a larger distance to the anchor is an earlier window
        last = int(near[piece] + windows[piece])
        out[piece].append({"first": last - b, "stop": last - a})
    return out


RUNS = "array<struct<first:int,stop:int>>"


def with_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(context, content, windows, near, own): the bytes of one copy of each wanted piece; ``wanted`` names where it is."""
    kept = "start int, windows int, near int, context bigint, content bigint, own binary"
    names = [field.split()[0] for field in kept.split(", ")]
    by_text = wanted.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "windows", "near", "context", "content")).alias("parts"))
    one_each = docs.select("key_a", "key_b", "bytes").dropDuplicates(["key_a", "key_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            out, held = {name: [] for name in names}, 0
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part in parts:
                    out["own"].append(text[part["start"] : part["start"] + part["windows"] + length - 1])
                    for name, value in part.items():
                        out[name].append(value)
                    held += len(out["own"][-1])
                    if held > 8 << 20:
                        yield out
                        out, held = {name: [] for name in names}, 0
            yield out

    return map_arrow(one_each.join(by_text, ["key_a", "key_b"]).select("bytes", "parts"), run, kept).drop("start")


def sorted_runs(texts: DataFrame, length: int, spread: int) -> DataFrame:
    """(context, content, runs) of pieces that have windows in common with others of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part, _ in whole_groups(batches, "context"):
            windows, near = part.column("windows").to_numpy(), part.column("near").to_numpy()
            found = runs_of(repeated_windows(part.column("own").to_pylist(), windows, near, length, spread), windows, near)
            some = np.array([i for i, runs in enumerate(found) if runs], dtype=np.int64)
            yield {"context": part.column("context").to_numpy()[some], "content": part.column("content").to_numpy()[some], "runs": [found[i] for i in some]}

    placed = texts.repartition("context").sortWithinPartitions("context")
    return map_arrow(placed, run, f"context bigint, content bigint, runs {RUNS}")


def counted_runs(texts: DataFrame, length: int) -> DataFrame:
    """The same for crowded contexts: every window's hash is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 64 << 10):
            out = {"context": [], "content": [], "first": [], "high": [], "low": []}
            for context, content, windows, own in zip(*(c.to_pylist() for c in batch.columns)):
                for first in range(windows):
                    digest = xxhash.xxh3_128_intdigest(own[first : first + length])
                    out["high"].append(digest >> 64)
                    out["low"].append(digest & 0xFFFFFFFFFFFFFFFF)
                    out["first"].append(first)
                    out["context"].append(context)
                    out["content"].append(content)
            yield out | {"high": signed(out["high"]), "low": signed(out["low"])}

    made = written(map_arrow(texts.select("context", "content", "windows", "own"), run, "context bigint, content bigint, first int, high bigint, low bigint"), "windows")
    often = made.groupBy("high", "low").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    met = made.join(often, ["high", "low"]).withColumn("run", F.struct("first", (F.col("first") + 1).alias("stop")))
    return met.groupBy("context", "content").agg(F.collect_list("run").alias("runs"))


def repeats(docs: DataFrame, length: int, spread: int, most: int) -> DataFrame:
    """Written (key_a, key_b, found): by text, the runs of windows that occur twice or more, as lists of first and stop by piece."""
    made = pieces(docs, length, spread)
    # written counts leave the joins' own exchanges as the last ones, so that a context with many rows is split there
    often = written(made.groupBy("context").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("context"), "often")
    met = written(made.join(often, "context"), "met")
    one = F.min(F.struct("key_a", "key_b", "start")).alias("one")
    distinct = met.groupBy("context", "content").agg(F.count(F.lit(1)).alias("copies"), F.first("windows").alias("windows"), F.first("near").alias("near"), one)
    distinct = written(distinct.select("context", "content", "copies", "windows", "near", "one.*"), "distinct")
    crowds = written(distinct.groupBy("context").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "crowds")
    texts = written(with_texts(docs, distinct.join(crowds, "context"), length).join(crowds, "context"), "texts")
    whole = distinct.filter("copies > 1").select("context", "content", F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("stop"))).alias("runs"))
    parts = [sorted_runs(texts.filter(F.col("crowd") <= most).drop("crowd"), length, spread)]
    if crowds.filter(F.col("crowd") > most).limit(1).count():
        parts.append(counted_runs(texts.filter(F.col("crowd") > most), length))
    some = distinct.filter("copies = 1").select("context", "content")
    for part in parts:
        whole = whole.unionByName(part.join(some, ["context", "content"], "left_semi"))
    runs = written(whole, "runs")
    # repeated rows share keys, and a set holds their pieces once
    return written(met.join(runs, ["context", "content"]).groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "runs")).alias("found")), "found")


def find_repeats(documents: DataFrame, length: int = 400, spread: int = 200, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans, kept: per document the byte ranges [start, stop) that repeats cover, and the other bytes.

    A byte is covered if it lies in ``length`` bytes that also start anywhere else, in this document or another; strings do
    not cross documents, may overlap and are judged on the input. Spans do not touch one another.

    Null and empty texts have no bytes, and texts below ``length`` bytes no spans. Repeated rows are documents of their own,
    so all of a long enough one goes. Nothing depends on order or ties. A long text is read in parts; one of its kind
    throughout ("aaaa") has a piece for every byte. An empty table gives no rows; other columns are not read.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("bytes"))
    found = repeats(docs, length, spread, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            spans, kept, sizes = [], [], []
            for text, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, merged = text or b"", []
                starts = sorted((x["start"] + r["first"], x["start"] + r["stop"] + length - 1) for x in lists or () for r in x["runs"])
                for a, b in starts:
                    if merged and a <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(b, merged[-1]["stop"])
                    else:
                        merged.append({"start": a, "stop": b})
                edges = [0, *(x for span in merged for x in (span["start"], span["stop"])), len(text)]
                spans.append(merged)
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
            yield {"doc_id": batch.column(0), "n_bytes": sizes, "spans": spans, "kept": kept}

    joined = docs.join(found, ["key_a", "key_b"], "left").select("doc_id", "bytes", "found")
    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(joined, run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
