"""Unigram piece models over a fixed vocabulary, scored by dynamic programming on a trie of distinct pre-tokens.

A pre-token is a white-space separated word with a leading word mark; ``pretokens`` lower-cases them. Words of more than
``MAX_CHARS`` characters are scored whole, one by one along their characters instead of on a trie. The
probability of a prefix is the sum over its last piece of the probability of what precedes it times the piece's; it is
computed once per trie node, so words that share a prefix share its scores. Characters outside the vocabulary count as a
piece of small fixed weight.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, slices, written

MARK = "▁"
MAX_CHARS = 32
UNKNOWN = 1e-7
FACTOR = 0x9E3779B97F4A7C15
#: pre-tokens of one trie, and pre-tokens a task remembers; both bound memory only
TRIE_WORDS = 100_000
MEMO_WORDS = 400_000


def pretokens(text: str) -> list[str]:
    """Lower-case words."""
    return text.lower().split()


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """Finds pieces by the hash of their characters, taken from the last one backwards."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.by_text = {p: i for i, p in enumerate(pieces)}
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(self.longest - 1, FACTOR, np.uint64)], dtype=np.uint64)
            hashes = np.array([(np.array([ord(c) for c in reversed(p)], np.uint64) * self.powers[: len(p)]).sum(dtype=np.uint64) for p in pieces], np.uint64)
        self.ids = np.argsort(hashes).astype(np.int64)
        self.hashes = hashes[self.ids]
        self.size = len(pieces)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)


class Trie:
    """Levels of a trie of words: per node its parent in the level above and its character."""

    def __init__(self, words: list[str]):
        marked = [MARK + w for w in words]
        lengths = np.array([len(w) for w in marked])
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        self.parents, self.chars = [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)]
        self.depth, self.end = lengths, np.zeros(len(words), np.int64)
        alive, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        for d in range(1, int(lengths.max(initial=0)) + 1):
            keep = lengths[alive] >= d
            alive, node = alive[keep], node[keep]
            keys, node = np.unique((node << 21) | chars[starts[alive] + d - 1], return_inverse=True)
            self.parents.append(keys >> 21)
            self.chars.append((keys & ((1 << 21) - 1)).astype(np.uint64))
            done = lengths[alive] == d
            self.end[alive[done]] = node[done]

    def last_pieces(self, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, length, nodes, ancestors, piece) of every piece that ends at a node; piece -1: an unknown character."""
        for d in range(1, len(self.parents)):
            anc, h = np.arange(len(self.parents[d])), np.zeros(len(self.parents[d]), np.uint64)
            for length in range(1, min(d, pieces.longest) + 1):
                h = h + self.chars[d - length + 1][anc] * pieces.powers[length - 1]
                anc = self.parents[d - length + 1][anc]
                found = pieces.find(h)
                at = np.arange(len(found)) if length == 1 else np.flatnonzero(found >= 0)
                yield d, length, at, anc[at], found[at]


def forward(trie: Trie, pieces: Pieces, weights: np.ndarray) -> list[np.ndarray]:
    """Per level the probability of each prefix under each column of ``weights``, whose last row is the unknown piece."""
    alpha = [np.ones((1, weights.shape[1]))] + [np.zeros((len(p), weights.shape[1])) for p in trie.parents[1:]]
    for d, length, at, anc, piece in trie.last_pieces(pieces):
        alpha[d][at] += alpha[d - length][anc] * weights[piece]
    return alpha


def long_word_score(word: str, pieces: Pieces, log_weights: np.ndarray) -> np.ndarray:
    """Natural log probability of a word of any length under each column; no more prefixes are held than a piece is long."""
    marked, held = MARK + word, pieces.longest + 1
    total = np.zeros((held, log_weights.shape[1]))
    for end in range(1, len(marked) + 1):
        starts, found = zip(*last_pieces_of(marked, end, pieces.by_text, pieces.longest))
        logs = total[np.array(starts) % held] + log_weights[list(found)]
        high = logs.max(axis=0)
        total[end % held] = high + np.log(np.exp(logs - high).sum(axis=0))
    return total[len(marked) % held].copy()


def word_scores(words: list[str], pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Natural log probability of each word under each column."""
    out = np.empty((len(words), weights.shape[1]))
    short = np.array([i for i, w in enumerate(words) if len(w) <= MAX_CHARS], np.int64)
    if len(short) < len(words):
        log_weights = np.log(weights)
        for i, word in enumerate(words):
            if len(word) > MAX_CHARS:
                out[i] = long_word_score(word, pieces, log_weights)
    for at in range(0, len(short), TRIE_WORDS):
        part = short[at : at + TRIE_WORDS]
        trie = Trie([words[i] for i in part])
        alpha = forward(trie, pieces, weights)
        for d in range(1, len(alpha)):
            ends = np.flatnonzero(trie.depth == d)
            out[part[ends]] = np.log(alpha[d][trie.end[ends]])
    return out


def last_pieces_of(marked: str, end: int, ids: dict[str, int], longest: int) -> Iterator[tuple[int, int]]:
    """(start, piece) of the pieces of a marked word that end before ``end``; piece -1: an unknown character."""
    for start in range(end - 1, max(0, end - longest) - 1, -1):
        piece = ids.get(marked[start:end], -1)
        if piece >= 0 or start == end - 1:
            yield start, piece


def along(word: str, ids: dict[str, int], longest: int, log_weight: list[float]) -> tuple[list[float], list[float], list[int], list[float]]:
    """Per prefix of a word of any length, marked: log probability, expected pieces, and pieces and log of the best way."""
    marked = MARK + word
    total, mean, best_n, best = [0.0], [0.0], [0], [0.0]
    for end in range(1, len(marked) + 1):
        ways = [(start, log_weight[piece]) for start, piece in last_pieces_of(marked, end, ids, longest)]
        logs = [total[start] + w for start, w in ways]
        high = max(logs)
        parts = [math.exp(x - high) for x in logs]
        whole = sum(parts)
        total.append(high + math.log(whole))
        mean.append(1 + sum(p * mean[start] for p, (start, _) in zip(parts, ways)) / whole)
        # equal scores: fewer pieces
        top, n = max((best[start] + w, -best_n[start] - 1) for start, w in ways)
        best.append(top), best_n.append(-n)
    return total, mean, best_n, best


def expected_along(word: str, ids: dict[str, int], longest: int, log_weight: list[float], count: float, out: np.ndarray) -> None:
    """Add the expected uses of each piece in one word of any length."""
    marked, total = MARK + word, along(word, ids, longest, log_weight)[0]
    # share of all ways that pass a position
    flow = [0.0] * len(marked) + [count]
    for end in range(len(marked), 0, -1):
        for start, piece in last_pieces_of(marked, end, ids, longest):
            used = flow[end] * math.exp(total[start] + log_weight[piece] - total[end])
            out[piece] += used
            flow[start] += used


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words over all segmentations, for one column of weights."""
    out = np.zeros(pieces.size + 1)
    long = [i for i, w in enumerate(words) if len(w) > MAX_CHARS]
    if long:
        log_weight = np.log(weights[:, 0]).tolist()
        for i in long:
            expected_along(words[i], pieces.by_text, pieces.longest, log_weight, float(counts[i]), out)
        short = np.array([i for i, w in enumerate(words) if len(w) <= MAX_CHARS], np.int64)
        words, counts = [words[i] for i in short], counts[short]
    for at in range(0, len(words), TRIE_WORDS):
        trie = Trie(words[at : at + TRIE_WORDS])
        alpha = [a[:, 0] for a in forward(trie, pieces, weights)]
        back = [np.zeros(len(a)) for a in alpha]
        for d in range(1, len(alpha)):
            ends = np.flatnonzero(trie.depth == d)
            np.add.at(back[d], trie.end[ends], counts[at + ends] / alpha[d][trie.end[ends]])
        for d, length, nodes, anc, piece in reversed(list(trie.last_pieces(pieces))):
            flow = back[d][nodes] * weights[piece, 0]
            out += np.bincount(np.where(piece < 0, pieces.size, piece), flow * alpha[d - length][anc], minlength=pieces.size + 1)
            back[d - length] += np.bincount(anc, flow, minlength=len(back[d - length]))
    return out


def count_words(labelled: DataFrame, split: Callable[[str], list[str]] = pretokens) -> DataFrame:
    """(label, word, n) over whole texts of (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 16 << 20):
            found: dict[str, Counter] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(label, Counter()).update(split(text or ""))
            rows = [(label, w, n) for label, words in found.items() for w, n in words.items()]
            yield dict(zip(("label", "word", "n"), zip(*rows))) if rows else {"label": [], "word": [], "n": []}

    made = map_arrow(labelled.select("label", "text"), run, "label string, word string, n bigint")
    return made.groupBy("label", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, pieces: list[str], rounds: int = 2, smoothing: float = 0.1, split: Callable[[str], list[str]] = pretokens) -> tuple[list[str], np.ndarray]:
    """(labels, weights): per label the probability of each piece, by expectation maximisation from equal weights.

    What comes to the driver is labels x pieces numbers, both fixed by the labels and the vocabulary.
    """
    words = written(count_words(labelled, split), "words")
    labels = sorted(r[0] for r in words.select("label").distinct().collect())
    size = len(pieces)
    spark = labelled.sparkSession
    weights = np.full((size + 1, len(labels)), 1.0 / size)
    weights[size] = UNKNOWN
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, labels, weights))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[dict]:
            known, names, now = shared.value
            finder = Pieces(known)
            total = np.zeros((len(known) + 1, len(names)))
            for batch in slices(batches):
                label, word = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
                counts = np.array(batch.column(2).to_pylist(), dtype=np.float64)
                for i, name in enumerate(names):
                    own = np.flatnonzero(label == name) if len(label) else []
                    if len(own):
                        total[:, i] += expected_counts([word[j] for j in own], counts[own], finder, now[:, [i]])
            piece, label = np.nonzero(total[:-1])
            yield {"piece": piece.tolist(), "label": label.tolist(), "n": total[piece, label].tolist()}

        found = map_arrow(words.select("label", "word", "n").repartition(F.col("word")), step, "piece bigint, label bigint, n double")
        total = np.zeros((size, len(labels)))
        for piece, label, n in found.groupBy("piece", "label").agg(F.sum("n")).collect():
            total[piece, label] = n
        weights = np.vstack([(total + smoothing) / (total.sum(axis=0) + smoothing * size), np.full((1, len(labels)), UNKNOWN)])
        shared.unpersist()
    return labels, weights


def bounded_sample(rows: DataFrame, label: str, id_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id.

    The shares by label are literals, like the model one value per label, so no text is moved to draw the sample.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return rows
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / (1 << 30)
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col(label)]
    return rows.filter(share * size < per_label)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


class WordMemo:
    """Row numbers of words in a growing table of their scores."""

    def __init__(self, score):
        self.score, self.rows, self.table, self.chars = score, {}, None, 0

    def lookup(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        texts = list(texts)
        if len(self.rows) > MEMO_WORDS or self.chars > MEMO_WORDS * MAX_CHARS:
            self.rows, self.table, self.chars = {}, None, 0
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.rows))
        if new or self.table is None:
            scores = self.score(new)
            self.chars += sum(map(len, new))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = scores if self.table is None else np.concatenate([self.table, scores])
        return [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in texts]
