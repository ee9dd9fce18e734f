"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tabularium.llm import repeats

from .conftest import prose


def brute(texts, length):
    """(bytes, removed, spans, kept) by looking at every window."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        marked = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if times[t[p : p + length]] > 1:
                marked[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, marked) if not m)
        spans = sum(m and not (i and marked[i - 1]) for i, m in enumerate(marked))
        out.append((len(t), len(t) - len(kept), spans, kept))
    return out


def found(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in repeats.find_repeats(rows, **options).collect()}
    assert len(got) == len(texts)
    return [(got[i].n_bytes, sum(s.stop - s.start for s in got[i].spans), len(got[i].spans), bytes(got[i].kept)) for i in range(len(texts))]


def corpus():
    """Copies, near copies, passages in other surroundings, periodic and small texts, several scripts."""
    draw = random.Random(4)
    base, passage = prose(50, 400), prose(91, 60)
    texts = [prose(100 + i, 30) + passage + prose(200 + i, 30) for i in range(12)]
    for i in range(25):
        words = base.split()
        for at in draw.sample(range(len(words)), draw.randint(0, 12)):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    texts += [base] * 3 + ["ab" * 600, "a" * 900, "ü" * 450, passage, passage[:100], "", None, "ab" * 600 + base[:300]]
    return texts + ["".join(draw.choice("ab") for _ in range(700)) for _ in range(8)]


@pytest.mark.parametrize("length, spread, most", [(400, 200, 20_000), (400, 200, 2), (50, 25, 20_000), (120, 8, 3)])
def test_repeats_equal_brute_force(spark, length, spread, most):
    texts = corpus()
    assert found(spark, texts, length=length, spread=spread, most=most) == brute(texts, length)


def test_exactly_one_window(spark):
    shared = prose(7, 80)[:400]
    texts = ["1" + shared + "2", "3" + shared + "4", "5" + shared[:399] + "6"]
    assert [r[1] for r in found(spark, texts)] == [400, 400, 0]


def test_spans_that_touch_are_one(spark):
    a, b = prose(7, 90)[:400], prose(8, 90)[:400]
    assert found(spark, [a + b, "x" + a, "y" + b])[0][1:3] == (800, 1)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    texts = [prose(3, 4000), prose(9, 200) + prose(3, 1500), None]
    parts = list(repeats.segments([t.encode() if t else None for t in texts], 400))
    assert sum(len(p[0]) for p in parts) == 2
    monkeypatch.setattr(repeats, "STRIDE", 3000)
    cuts = [row for rows, _, _ in repeats.segments([t.encode() if t else None for t in texts], 400) for row in rows]
    assert cuts.count(0) > 5
    # the same windows by anchor, wherever a part begins
    whole = repeats.cut([texts[0].encode()], 400, 200)[1]
    marks = lambda at, n, near: {int(p + i): int(n - 1 - i + near) for p, n, near in zip(at, n, near) for i in range(n)}
    want, got = marks(whole[1], whole[2], whole[3]), {}
    for _, firsts, held in repeats.segments([texts[0].encode()], 400):
        text, start, windows, near, _ = repeats.cut(held, 400, 200)[1]
        got |= marks(start + np.array(firsts)[text], windows, near)
    assert got == want


def test_unusual_rows(spark, edge_documents, no_documents):
    got = repeats.find_repeats(edge_documents).collect()
    assert len(got) == 10 and repeats.find_repeats(no_documents).count() == 0
    # short texts have no window of 400 bytes; rows 7, 7 and 8 hold equal texts
    sizes = {r.doc_id: r for r in edge_documents.select("doc_id", "text").collect()}
    for r in got:
        text = (sizes[r.doc_id].text or "").encode()
        gone = len(text) if r.doc_id in (7, 8) and len(text) >= 400 else None
        assert r.n_bytes == len(text)
        if gone is not None:
            assert not r.kept and len(r.spans) == 1


def test_deep_shallow_order():
    draw = random.Random(6)
    strings = list({bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 60))) for _ in range(400)} | {b"", b"a", b"a\0", b"a" * 200, b"a" * 201, b"\0" * 40, b"\0" * 41})
    order, common = repeats.deep_shallow(strings)
    want = sorted(strings)
    assert [strings[i] for i in order] == want
    assert common.tolist() == [0] + [repeats.shared_bytes(a, b) for a, b in zip(want, want[1:])]
