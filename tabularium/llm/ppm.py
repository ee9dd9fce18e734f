"""Language-model scores by prediction by partial matching over bytes.

A document's words, lower-cased, joined by a space and closed by a line feed, are predicted byte by byte from up to
``order`` bytes before. The context trie holds, for every training document, how often each byte follows each context.
A context predicts a byte seen n times after it with n less a fixed discount of its total and escapes to the next
shorter context with the discounts; shorter contexts exclude what longer ones could have said. Below the empty context
all remaining bytes are equally likely. All counts of all depths stay, in written tables: only the code lengths of the
most frequent grams are looked up in tasks, those of all other grams of the texts come by joins. Grams never seen in
training go down the depths together, one join a depth, until the depth is small enough to be looked up as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import crc_mod
from .shared import map_arrow, slices, task_number, written

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"
#: what a byte seen leaves to the escape of its context
DISCOUNT = 0.3


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def grams(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): for each byte of each stream, the byte with the ``order`` bytes before it as one number."""
    pad = END * order
    data = np.frombuffer(pad + pad.join(streams), dtype=np.uint8)
    keys = np.zeros(len(data) - order, dtype=np.int64)
    for i in range(order + 1):
        keys <<= 8
        keys |= data[i : len(data) - order + i]
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    # the padding before each further stream is predicted by nobody
    inside = np.ones(len(keys), dtype=bool)
    starts = np.cumsum(lengths[:-1] + order) - order
    inside[(starts[:, None] + np.arange(order)[None, :]).ravel()] = False
    return keys[inside], lengths


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(key, n) of the longest grams of all texts, counted in each task and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0
        for batch in slices(batches, 2 << 20):
            keys = np.sort(grams([stream(tokens(t)) for t in batch.column(0).to_pylist()], order)[0])
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            held.append((keys[starts], np.diff(np.r_[starts, len(keys)])))
            size += len(starts)
            if size > 2_000_000:
                held = [merged(held)]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield from chunks(held.pop())
                    size = 0
        if held:
            yield from chunks(merged(held))

    def chunks(part: tuple[np.ndarray, np.ndarray]) -> Iterator[dict]:
        for at in range(0, len(part[0]), 200_000):
            yield {"key": part[0][at : at + 200_000], "n": part[1][at : at + 200_000]}

    return map_arrow(texts, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class Trie:
    """Kept branches and contexts per depth as sorted arrays, with what a prediction needs."""

    def __init__(self, order: int):
        self.order = order
        self.nodes: list[np.ndarray] = []
        self.log_n: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.total: list[np.ndarray] = []  # log of the denominator without exclusion
        self.escape: list[np.ndarray] = []  # cost of leaving the context without exclusion
        self.reduced: list[np.ndarray] = []  # log of the shorter context's denominator under this one's exclusion
        self.chain: list[np.ndarray] = []  # escape costs of all shorter contexts under exclusion
        self.floor = 0.0

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Natural code length of the last byte of each key after its other bytes."""
        m = len(keys)
        out = np.zeros(m)
        k = np.full(m, -1)
        at_k, left = np.zeros(m, np.int64), np.arange(m)
        for i in range(self.order, -1, -1):
            own, at = find(self.contexts[i], (keys[left] >> 8) & mask(i))
            k[left[own]], at_k[left[own]] = i, at[own]
            left = left[~own]
        left = np.arange(m)
        for j in range(self.order, -1, -1):
            own, at = find(self.nodes[j], keys[left] & mask(j + 1))
            hit = left[own]
            out[hit] -= self.log_n[j][at[own]]
            self._add(out, hit, keys, k, at_k, j)
            left = left[~own]
        out[left] += self.floor
        self._add(out, left, keys, k, at_k, -1)
        return out

    def _add(self, out, hit, keys, k, at_k, j: int) -> None:
        """Denominators and escapes for keys whose byte is found at depth ``j``."""
        for i in np.unique(k[hit]):
            own = hit[k[hit] == i]
            if i == j:
                out[own] += self.total[i][at_k[own]]
            elif i >= 0:
                out[own] += self.escape[i][at_k[own]] + self.chain[i][at_k[own]]
                if j >= 0:
                    at = np.searchsorted(self.contexts[j + 1], (keys[own] >> 8) & mask(j + 1))
                    out[own] += self.reduced[j + 1][at] - self.chain[j + 1][at]


def mask(n_bytes: int) -> np.int64:
    return np.int64((1 << (8 * n_bytes)) - 1)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether, where) keys are in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def build(levels: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, ...]], order: int) -> Trie:
    """A trie from per-depth (key, n) of kept branches and (key, total, branches, kept) of contexts, each sorted by key.

    ``branches`` counts a context's kept branches and ``kept`` their bytes.
    """
    trie = Trie(order)
    for j in range(order + 1):
        keys, n = levels[j]
        ctx, total, branches, kept = contexts[j]
        trie.nodes.append(keys)
        trie.log_n.append(np.log(n - DISCOUNT))
        trie.contexts.append(ctx)
        trie.total.append(np.log(total))
        trie.escape.append(np.log(total) - np.log(total - kept + DISCOUNT * branches))
        if j == 0:
            trie.reduced.append(np.zeros(len(ctx)))
            trie.chain.append(np.zeros(len(ctx)))
            continue
        shorter_keys, shorter_n = levels[j - 1]
        in_shorter = np.searchsorted(shorter_keys, keys & mask(j))
        said = np.bincount(np.searchsorted(ctx, keys >> 8), shorter_n[in_shorter] - DISCOUNT, minlength=len(ctx))
        suffix = np.searchsorted(contexts[j - 1][0], ctx & mask(j - 1))
        _, t, b, kept_short = (c[suffix] for c in contexts[j - 1])
        trie.reduced.append(np.log(t - said))
        trie.chain.append(np.log(t - said) - np.log(t - kept_short + DISCOUNT * b) + trie.chain[j - 1][suffix])
    trie.floor = float(np.log(max(1, 256 - len(trie.nodes[0]))))
    return trie


def train(texts: DataFrame, order: int = 6, share: float = 0.0) -> Trie:
    """The model of ``texts`` (one text column) on the driver, for small tables and to compare ``score`` with.

    A branch of less than ``share`` of the bytes goes to the escape of its context, so probabilities still add up to one.
    """
    counts = written(count_grams(texts, order), "grams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1.0, total * share)
    levels, contexts = [], []
    for j in range(order, -1, -1):
        if j < order:
            # shorter grams are sums of the next longer ones, of which there are fewer at each step
            counts = written(counts.groupBy(F.col("key").bitwiseAND(F.lit(int(mask(j + 1)))).alias("key")).agg(F.sum("n").alias("n")), "grams")
        stats = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.when(F.col("n") >= least, 1)).alias("branches"), F.sum(F.when(F.col("n") >= least, F.col("n"))).alias("kept"))
        kept = counts.filter(F.col("n") >= least).toArrow()
        order_by = np.argsort(kept["key"].to_numpy())
        levels.append(tuple(kept[c].to_numpy()[order_by] for c in ("key", "n")))
        own = stats.filter("kept IS NOT NULL").toArrow()
        order_by = np.argsort(own["context"].to_numpy())
        contexts.append(tuple(own[c].to_numpy()[order_by] for c in ("context", "total", "branches", "kept")))
    return build(levels[::-1], contexts[::-1], order)


def count_levels(texts: DataFrame, order: int) -> list[DataFrame]:
    """Per depth the written (key, n) of all grams; shorter ones are sums of the next longer, of which there are fewer."""
    levels = [written(count_grams(texts, order), "grams")]
    for j in range(order - 1, -1, -1):
        levels.append(written(levels[-1].groupBy(F.col("key").bitwiseAND(F.lit(int(mask(j + 1)))).alias("key")).agg(F.sum("n").alias("n")), "grams"))
    return levels[::-1]


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach."""
    seen = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toArrow()
    n, rows = seen["n"].to_numpy(), seen["rows"].to_numpy()
    order = np.argsort(-n)
    fit = int(np.searchsorted(np.cumsum(rows[order]), most, side="right"))
    return 1 if fit == len(n) else int(n[order][fit]) + 1


def descended(keys: np.ndarray, cost: np.ndarray, said: np.ndarray, row: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, said, found) after one depth, at which context ``row`` has the branches (byte, n).

    ``said`` holds a bit for each byte the longer context has said: none while no context was found.
    """
    m = len(keys)
    total, branches = np.bincount(row, n, m), np.bincount(row, minlength=m)
    mine = np.bincount(row, n * (byte == (keys & 255)[row]), m)
    left = total - np.bincount(row, (n - DISCOUNT) * (said[row, byte >> 3] >> (7 - (byte & 7)) & 1), m)
    found, gone = mine > 0, (mine == 0) & (total > 0)
    cost = cost.copy()
    cost[found] += np.log(left[found]) - np.log(mine[found] - DISCOUNT)
    cost[gone] += np.log(left[gone]) - np.log(DISCOUNT * branches[gone])
    now = np.zeros((m, 256), dtype=bool)
    now[row, byte] = True
    return cost, np.packbits(now, axis=1), found


def unseen_costs(keys: DataFrame, levels: list[DataFrame], most: int) -> DataFrame:
    """(key, cost) of distinct grams, by depths: those of at most ``most`` branches in tasks, longer ones by a join."""
    small, held = 0, []
    for level in levels:
        if level.count() > most:
            break
        got = level.toArrow()
        at = np.argsort(got["key"].to_numpy())
        held.append((got["key"].to_numpy()[at], got["n"].to_numpy()[at]))
        small += 1
    floor = float(np.log(max(1, 256 - levels[0].count())))
    state = "key bigint, cost double, said binary"
    now, done = keys.select("key", F.lit(0.0).alias("cost"), F.lit(bytes(32)).alias("said")), []
    for depth in range(len(levels) - 1, small - 1, -1):
        now = now.withColumn("context", F.shiftright("key", 8).bitwiseAND(F.lit(int(mask(depth)))))
        # at most 256 branches in a group
        own = levels[depth].withColumn("context", F.shiftright("key", 8)).join(now.select("context").distinct(), "context", "left_semi")
        own = own.groupBy("context").agg(F.collect_list(F.col("key").bitwiseAND(F.lit(255))).alias("byte"), F.collect_list("n").alias("n"))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                own, byte, n = (batch.column(c) for c in ("key", "byte", "n"))
                own = own.to_numpy()
                row = np.repeat(np.arange(len(own)), np.nan_to_num(pc.list_value_length(byte).to_numpy(zero_copy_only=False).astype(float)).astype(int))
                cost, said, found = descended(own, batch.column("cost").to_numpy(), unpacked(batch.column("said")), row, byte.flatten().to_numpy(), n.flatten().to_numpy())
                yield {"key": own, "cost": cost, "said": [s.tobytes() for s in said], "found": found}

        stepped = written(map_arrow(now.join(own, "context", "left").select("key", "cost", "said", "byte", "n"), step, f"{state}, found boolean"), "unseen")
        done.append(stepped.filter("found").select("key", "cost"))
        now = stepped.filter(~F.col("found")).drop("found")
    shared = keys.sparkSession.sparkContext.broadcast(held)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tables = shared.value
        for batch in slices(batches, 256 << 10):
            own, cost, said = batch.column("key").to_numpy(), batch.column("cost").to_numpy().copy(), unpacked(batch.column("said"))
            left = np.arange(len(own))
            for depth in range(len(tables) - 1, -1, -1):
                known, n = tables[depth]
                context = (own[left] >> 8) & mask(depth)
                first, last = np.searchsorted(known, context << 8), np.searchsorted(known, (context + 1) << 8)
                row = np.repeat(np.arange(len(left)), last - first)
                at = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[row]
                cost[left], said, found = descended(own[left], cost[left], said, row, known[at] & 255, n[at])
                left, said = left[~found], said[~found]
            cost[left] += floor
            yield {"key": own, "cost": cost}

    made = map_arrow(now, rest, "key bigint, cost double")
    for more in done:
        made = made.unionByName(more)
    return written(made, "unseen")


def unpacked(said: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(said.to_pylist()), dtype=np.uint8).reshape(len(said), 32)


class Coder:
    """Code lengths of grams in a sorted table, with a table of the grams met last so that most lookups take one step."""

    slots = 20

    def __init__(self, known: np.ndarray, known_costs: np.ndarray, order: int):
        self.known, self.known_costs, self.order = known, known_costs, order
        self.keys = np.full(1 << self.slots, -1, dtype=np.int64)
        self.costs = np.zeros(1 << self.slots)

    def lengths(self, streams: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Natural code length of each stream's known grams, and the (keys, counts) of its other ones."""
        keys, sizes = grams(streams, self.order)
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).view(np.int64)
        costs = self.costs[slot]
        unknown = np.flatnonzero(self.keys[slot] != keys)
        if len(unknown):
            new, back = np.unique(keys[unknown], return_inverse=True)
            hit, at = find(self.known, new)
            made = np.full(len(new), np.nan)
            made[hit] = self.known_costs[at[hit]]
            costs[unknown] = made[back]
            self.keys[slot[unknown]] = keys[unknown]
            # the last of the keys of one slot wins in both tables
            self.costs[slot[unknown]] = costs[unknown]
        ends = np.cumsum(sizes)
        rare = np.flatnonzero(np.isnan(costs))
        costs[rare] = 0.0
        cuts = np.searchsorted(rare, np.r_[0, ends])
        others = [np.unique(keys[rare[lo:hi]], return_counts=True) for lo, hi in zip(cuts[:-1], cuts[1:])]
        return np.add.reduceat(costs, ends - sizes), others


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: Counter = Counter()
        for batch in slices(batches, 2 << 20):
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
            if len(found) > 300_000:
                yield {"word": list(found), "n": list(found.values())}
                found = Counter()
        yield {"word": list(found), "n": list(found.values())}

    return map_arrow(texts, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(documents: DataFrame, folds: int = 10, held_out_fold: int = 0, order: int = 6, head_grams: int = 1 << 22, head_share: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    The model learns from documents outside the held-out fold (crc32 of the id as text modulo ``folds``). ``score`` is
    its log10 probability of a document's tokens. ``base_score`` adds log10((c + 0.1) / (N + 0.1 (V + 1))) over words
    and one end token. Null and empty texts are the end token alone; repeated rows get equal results; an empty table
    gives no rows; other columns are not read. Words of at least ``head_share`` of all training tokens, at most its
    inverse, are looked up in tasks; counts of all other words come by a join, where none of them is a hot key. So are
    at most ``head_grams`` grams seen most often and all others, which changes no score.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, folds) == held_out_fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learn = docs.filter(~F.col("held_out")).select("text")
    words = written(count_words(learn), "word-counts")
    ends = learn.count()
    n_words, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n_words + ends
    scale = float(np.log10(total + 0.1 * (types + (ends > 0) + 1)))
    least = max(1.0, total * head_share)
    frequent = words.filter(F.col("n") >= least).toArrow()
    head = {w: i for i, w in enumerate(frequent["word"].to_pylist())}
    head_score = np.log10(frequent["n"].to_numpy() + 0.1) - scale
    end_score = float(np.log10(ends + 0.1) - scale)
    levels = count_levels(learn, order)
    # at most 256 branches in a group
    whole = F.sum("n").over(Window.partitionBy(F.shiftright("key", 8)))
    costs = written(levels[order].select("key", "n", (F.log(whole) - F.log(F.col("n") - DISCOUNT)).alias("cost")), "gram-costs")
    # what is seen a few times only is no head, however small the table
    often = max(4, frequent_from(costs, head_grams))
    top = costs.filter(F.col("n") >= often).select("key", "cost").toArrow()
    by_key = np.argsort(top["key"].to_numpy())
    shared = spark.sparkContext.broadcast((head, head_score, top["key"].to_numpy()[by_key], top["cost"].to_numpy()[by_key]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        where, known_score, keys, key_costs = shared.value
        coder, row = Coder(keys, key_costs, order), task_number() << 33
        for batch in slices(batches, 1 << 20):
            made = [tokens(t) for t in batch.column(2).to_pylist()]
            lengths, others = coder.lengths([stream(w) for w in made])
            base, known, rest = [], [], []
            for own_words in made:
                at = np.fromiter((where.get(w, -1) for w in own_words), np.int64, len(own_words))
                base.append(float(known_score[at[at >= 0]].sum()) + end_score)
                known.append(int((at >= 0).sum()) + (ends > 0))
                rare = Counter(own_words[i] for i in np.flatnonzero(at < 0))
                rest.append([{"word": w, "tf": n} for w, n in rare.items()])
            yield {"row": list(range(row, row + len(made))), "doc_id": batch.column(0), "held_out": batch.column(1), "n_tokens": [len(w) + 1 for w in made],
                   "n_known": known, "base_score": base, "score": -lengths / np.log(10), "rare": rest,
                   "keys": [k.tobytes() for k, _ in others], "times": [n.astype(np.int32).tobytes() for _, n in others]}
            row += len(made)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:binary,tf:bigint>>, keys binary, times binary"
    scored = written(map_arrow(docs, run, schema), "scored")
    tail = words.filter(F.col("n") < least)
    rare = scored.select("row", F.inline("rare")).join(tail, "word", "left")
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * (F.log10(c + 0.1) - scale)).alias("more_base"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 2 << 20):
            keys = [np.frombuffer(k, np.int64) for k in batch.column(1).to_pylist()]
            yield {"row": np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys]), "key": np.concatenate(keys), "tf": np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32)}

    others = lambda rows: map_arrow(rows.filter(F.length("keys") > 0).select("row", "keys", "times"), listed, "row bigint, key bigint, tf int")
    # every gram of a training text has been counted
    unseen = others(scored.filter("held_out")).select("key").distinct().join(costs, "key", "left_anti")
    tail_costs = costs.filter(F.col("n") < often).select("key", "cost").unionByName(unseen_costs(written(unseen, "unseen"), levels, most=1 << 20))
    more = others(scored).join(tail_costs, "key").groupBy("row").agg((F.sum(F.col("tf") * F.col("cost")) / float(np.log(10))).alias("more_cost"))
    return scored.join(sums, "row", "left").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") - F.coalesce("more_cost", F.lit(0.0))).alias("score"))
