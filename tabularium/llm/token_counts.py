"""Token counts from unigram scores computed once per shared prefix of a trie of distinct pre-tokens.

Each trie node holds the probability of its prefix over all segmentations, the expected number of pieces, and the
number of pieces of the most probable segmentation; the values at a word's last node are its terminal counts. A
document's counts are the sums over its pre-tokens: its words as they stand, at any length and in their own case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MAX_CHARS, TRIE_WORDS, Pieces, Trie, WordMemo, along, fit, load_pieces
from .shared import map_arrow, slices


def terminal_counts(words: list[str], pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    """Per word: pieces of the best segmentation, expected pieces, natural log probability."""
    out = np.empty((len(words), 3))
    weight = weights[:, 0]
    with np.errstate(divide="ignore"):
        log_weight = np.log(weight)
    long = np.array([len(w) > MAX_CHARS for w in words], dtype=bool)
    if long.any():
        plain = log_weight.tolist()
        for i in np.flatnonzero(long):
            total, mean, best_n, _ = along(words[i], pieces.by_text, pieces.longest, plain)
            out[i] = best_n[-1], mean[-1], total[-1]
        out[~long] = terminal_counts([w for w in words if len(w) <= MAX_CHARS], pieces, weights)
        return out
    for at in range(0, len(words), TRIE_WORDS):
        trie = Trie(words[at : at + TRIE_WORDS])
        sizes = [len(p) for p in trie.parents]
        total = [np.ones(1)] + [np.zeros(n) for n in sizes[1:]]
        pieces_sum = [np.zeros(n) for n in sizes]
        best = [np.zeros(1)] + [np.full(n, -np.inf) for n in sizes[1:]]
        best_n = [np.zeros(n) for n in sizes]
        for d, length, nodes, anc, piece in trie.last_pieces(pieces):
            before = total[d - length][anc]
            total[d][nodes] += before * weight[piece]
            pieces_sum[d][nodes] += (pieces_sum[d - length][anc] + before) * weight[piece]
            score, n = best[d - length][anc] + log_weight[piece], best_n[d - length][anc] + 1
            # equal scores: fewer pieces
            better = (score > best[d][nodes]) | ((score == best[d][nodes]) & (n < best_n[d][nodes]))
            best[d][nodes[better]], best_n[d][nodes[better]] = score[better], n[better]
        for d in range(1, len(sizes)):
            ends = np.flatnonzero(trie.depth == d)
            node = trie.end[ends]
            out[at + ends] = np.stack([best_n[d][node], pieces_sum[d][node] / total[d][node], np.log(total[d][node])], axis=1)
    return out


def count_tokens(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, expected_tokens, log10_prob of every whole text.

    Piece probabilities are fitted on the word counts of all documents. Null and empty texts have no tokens and log
    probability 0. Repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = load_pieces(vocabulary)
    labels, weights = fit(docs.withColumn("label", F.lit("all")), pieces, split=str.split)
    if not labels:
        weights = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
    shared = documents.sparkSession.sparkContext.broadcast((pieces, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, own = shared.value
        finder = Pieces(known)
        memo = WordMemo(lambda words: terminal_counts(words, finder, own))
        for batch in slices(batches):
            found = memo.lookup((t or "").split() for t in batch.column(1).to_pylist())
            sums = np.array([memo.table[rows].sum(axis=0) for rows in found]).reshape(-1, 3)
            yield {"doc_id": batch.column(0), "n_pretokens": [len(r) for r in found], "n_tokens": sums[:, 0].astype(np.int64),
                   "expected_tokens": sums[:, 1], "log10_prob": sums[:, 2] / np.log(10)}

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs, run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, expected_tokens double, log10_prob double")
