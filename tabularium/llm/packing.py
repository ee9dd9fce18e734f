"""Harmonic packing of tokenised documents into fixed-length training sequences.

Each piece length falls into a reciprocal class: class k holds lengths in (capacity/(k+1), capacity/k], and every bin of
class k takes exactly k pieces. Which bin a piece goes to depends on its class and its running number only, so each task
fills its own bins. A document is cut into whole sequences and a remainder. The remainder is cut again at the largest
class size below it while it is at least ``min_cut`` long and would waste more than ``slack`` per bin; only short tails
and lengths that fit their class keep their own length. Bins a task could not fill are packed again for ``fan_in`` tasks
together: once more by class, and what still is not full by first fit over decreasing lengths.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, slices, task_number, written

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, pool bigint"
#: bit that marks sequences filled from the left-over pieces of several tasks
POOLED = 1 << 62
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def encoder(path: str):
    """(encoding, special texts) of a byte-level BPE file of ``tokenizers``; a token's merge rank is its id there."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # byte-level files show each byte as one printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    # fixed value: the published split pattern of this vocabulary
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def token_ids(text: str, encoding, special: tuple[str, ...]) -> np.ndarray:
    """Ids of a whole text as ``tokenizers`` gives them; the texts of special tokens become their ids there too."""
    if any(s in text for s in special):
        return np.array(encoding.encode(text, allowed_special="all"), dtype="<u4")
    return np.array(encoding.encode_ordinary(text), dtype="<u4")


def cuts(length: int, capacity: int, min_cut: int, slack: int) -> list[int]:
    """Piece lengths of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest < min_cut or capacity - k * rest <= slack:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """Open bins of each class; ``add`` returns the pieces of a bin when it is full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple] | None:
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        return self.open.pop(k) if len(pieces) == k else None

    def rest(self) -> list[tuple]:
        return [p for pieces in self.open.values() for p in pieces]


def placed(pieces: list[tuple], sequence: int | None, pool: int | None) -> list[tuple]:
    out, offset = [], 0
    for piece in pieces:
        out.append((*piece, sequence, offset if sequence is not None else None, pool))
        offset += piece[2]
    return out


def first_fit_decreasing(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Longest first, each into the fullest bin that still takes it; null ids come first."""
    bins: list[list[tuple]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for piece in sorted(pieces, key=lambda p: (-p[2], *by_document(p))):
        room = next((r for r in range(piece[2], capacity + 1) if free[r]), None)
        if room is None:
            bins.append([])
            at, room = len(bins) - 1, capacity
        else:
            at = free[room].pop()
        bins[at].append(piece)
        free[room - piece[2]].append(at)
    return bins


def by_document(piece: tuple) -> tuple:
    """Order of pieces; null ids come first."""
    return (piece[0] is not None, piece[0] or 0, piece[1])


def columns_of(rows: list[tuple]) -> dict:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}


def pack(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 0,
    min_cut: int = 64,
    slack: int = 8,
    fan_in: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    A row per piece: doc_id, start, length, ids_crc32 (of the piece's little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Repeated rows and null ids are packed row by row like
    any others; an empty table gives no rows; other columns are not read. Sequences are full except the last ones of
    each pool of ``fan_in`` tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoding, special = encoder(tokenizer)
        task, made, bins, rows = task_number(), 0, Bins(capacity), []
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(token_ids(text or "", encoding, special), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in cuts(len(ids), capacity, min_cut, slack):
                    full = bins.add((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                    start += n
                    if full:
                        rows += placed(full, (task << 33) + made, None)
                        made += 1
            if len(rows) > 20_000:
                yield columns_of(rows)
                rows = []
        yield columns_of(rows + placed(bins.rest(), None, task // fan_in))

    def pool(group: pa.Table) -> pa.Table:
        # one pool holds at most fan_in times the open bins of a task, whatever the input size
        number, made, bins, rows = group["pool"][0].as_py(), 0, Bins(capacity), []
        items = sorted(zip(*(group[c].to_pylist() for c in FIELDS)), key=by_document)
        for full in [f for f in map(bins.add, items) if f] + first_fit_decreasing(bins.rest(), capacity):
            rows += placed(full, POOLED + (number << 33) + made, number)
            made += 1
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns_of(rows).items()})

    pieces = written(map_arrow(documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), cut, PIECES), "packing")
    whole = pieces.filter(F.col("sequence_id").isNotNull())
    left = pieces.filter(F.col("sequence_id").isNull())
    return whole.unionByName(left.groupBy("pool").applyInArrow(pool, PIECES)).drop("pool")
