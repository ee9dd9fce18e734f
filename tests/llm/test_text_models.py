"""Language ID, PPM scores, token counts and packing against plain Python."""

import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabularium.llm import language_id, packing, pieces, ppm, token_counts
from tabularium.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def segmentations(word: str, weights: dict[str, float]):
    if not word:
        yield 1.0, 0
    for n in range(1, len(word) + 1):
        p = weights.get(word[:n], pieces.UNKNOWN if n == 1 else 0.0)
        if p:
            for q, count in segmentations(word[n:], weights):
                yield p * q, count + 1


def test_trie_scores_equal_the_sum_over_all_segmentations():
    known = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    weights = np.array([[0.1, 0.2, 0.05, 0.3, 0.1, 0.05, 0.1, 0.1, pieces.UNKNOWN]]).T
    table = dict(zip(known, weights[:-1, 0]))
    words = ["ab", "aba", "abab", "b", "axb", "é"]
    finder = pieces.Pieces(known)
    scores, counts = pieces.word_scores(words, finder, weights), token_counts.terminal_counts(words, finder, weights)
    expected = pieces.expected_counts(words, np.ones(len(words)), finder, weights)
    uses = 0.0
    for word, score, (best, mean, total) in zip(words, scores[:, 0], counts):
        ways = list(segmentations("▁" + word, table))
        whole = sum(p for p, _ in ways)
        assert score == pytest.approx(math.log(whole)) and total == pytest.approx(math.log(whole))
        assert mean == pytest.approx(sum(p * n for p, n in ways) / whole)
        top = max(p for p, _ in ways)
        assert best == min(n for p, n in ways if p == pytest.approx(top))
        uses += sum(p * n for p, n in ways) / whole
    assert expected.sum() == pytest.approx(uses)


def test_a_long_word_is_one_word():
    known = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    weights = np.array([[0.1, 0.2, 0.05, 0.3, 0.1, 0.05, 0.1, 0.1, pieces.UNKNOWN], [0.2, 0.1, 0.3, 0.05, 0.05, 0.1, 0.1, 0.1, pieces.UNKNOWN]]).T
    finder = pieces.Pieces(known)
    long = "abaxbab" * 1_500
    words = ["ab", long, "aba", long[:40]]
    scores = pieces.word_scores(words, finder, weights)
    for column in (0, 1):
        log_weight = np.log(weights[:, column]).tolist()
        for word, score in zip(words, scores[:, column]):
            assert score == pytest.approx(pieces.along(word, finder.by_text, finder.longest, log_weight)[0][-1], rel=1e-9)
    assert pieces.pretokens("Ab " + long) == ["ab", long]


def test_language_of_texts_equals_the_recursion(spark):
    rows = [(i, f"{'der die das' if i % 2 else 'the and of'} w{i} {'q' * 50}", "de" if i % 2 else "en") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(frame, VOCABULARY)
    ids, longest = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    logs = [np.log(model.weights[:, k]).tolist() for k in range(len(model.labels))]
    for row in language_id.predict(frame, model).collect():
        total = [p + sum(pieces.along(w, ids, longest, logs[k])[0][-1] for w in row.text.split()) for k, p in enumerate(model.prior)]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        assert row.lang_pred == model.labels[best] and row.score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total))


def test_language_is_found_on_held_out_documents(spark, sf_dir):
    found = QUERIES["op1_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, edge_documents, no_documents):
    found = language_id.identify(edge_documents, VOCABULARY)
    rows = found.collect()
    assert len(rows) == 10 and found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.identify(no_documents, VOCABULARY).count() == 0
    model = language_id.train(edge_documents, VOCABULARY)
    kept = language_id.predict(edge_documents, model)
    assert kept.columns == [*edge_documents.columns, "lang_pred", "score"] and kept.agg(F.sum("key_a")).first()[0] == 20


def test_ppm_probabilities_add_up_to_one(spark):
    texts = spark.createDataFrame([("the cat sat on the mat " * 5,), ("a cat and a dog",), (None,)], "text string")
    for share in (0.0, 0.01):
        trie = ppm.train(texts, order=3, share=share)
        for context in (b"the", b" ca", b"xyz", b"\n\n\n", b"eth"):
            keys = (np.int64(int.from_bytes(context, "big")) << 8) | np.arange(256, dtype=np.int64)
            assert np.exp(-trie.cost(keys)).sum() == pytest.approx(1.0)


def test_ppm_scores_and_base(spark):
    # at a thousand documents the trie has seen enough to beat word counts on held-out text
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op2_ppm_scores"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learn = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 10]
    counts = Counter(w for d in learn for w in ppm.tokens(d.text))
    total = sum(counts.values()) + len(learn)
    scale = math.log10(total + 0.1 * (len(counts) + 2))
    held = [0.0, 0.0]
    for d in docs:
        r, words = rows[d.doc_id], ppm.tokens(d.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - scale for w in words) + math.log10(len(learn) + 0.1) - scale)
        assert r.score < 0
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > held[0]


def test_ppm_keeps_rare_grams_whatever_the_size(spark):
    # 9 MB of training text: what is seen once is below 2^-22 of it
    rare = ["zyx wvu tsr", "zyx wvu tsrq ponm", "quite other words \u00e9\u0142"]
    rows = [(i, "the cat sat on the mat " * 200_000 if i < 2 else f"{rare[i % 3]} {i * i * i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    learn = docs.filter(pieces.crc_mod("doc_id", 10) != 0).select("text")
    trie = ppm.train(learn, share=0.0)
    want = {i: -trie.cost(ppm.grams([ppm.stream(ppm.tokens(t))], 6)[0]).sum() / math.log(10) for i, t in rows if i >= 2}
    assert {r.doc_id: r.score for r in ppm.score(docs).collect() if r.doc_id >= 2} == pytest.approx(want)


@pytest.mark.parametrize("head, most", [(0, 0), (40, 30), (1 << 22, 1 << 20)])
def test_ppm_lookups_and_joins_agree(spark, monkeypatch, head, most):
    rows = [(i, f"doc {i * i} says {'abc' * (i % 4)} and {'\u00e9' * (i % 3)} x{i}") for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    trie = ppm.train(docs.filter(pieces.crc_mod("doc_id", 10) != 0).select("text"), share=0.0)
    want = {i: -trie.cost(ppm.grams([ppm.stream(ppm.tokens(t))], 6)[0]).sum() / math.log(10) for i, t in rows}
    original = ppm.unseen_costs
    monkeypatch.setattr(ppm, "unseen_costs", lambda keys, levels, **_: original(keys, levels, most))
    found = ppm.score(docs, head_grams=head).collect()
    assert any(r.held_out for r in found) and {r.doc_id: r.score for r in found} == pytest.approx(want)


def test_ppm_edge_cases(edge_documents, no_documents):
    rows = ppm.score(edge_documents).collect()
    assert len(rows) == 10
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert len({(r.score, r.base_score) for r in rows if r.doc_id == 7}) == 1
    assert ppm.score(no_documents).count() == 0


def test_token_counts_are_fitted_on_all_documents_as_they_stand(spark):
    # a word of one document among 8,000, a long word, and capitals
    long = "https://Example.org/" + "abcde" * 30
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "Quixotic " * 50).when(F.col("id") == 8, long).otherwise("plain words").alias("text"))
    known = pieces.load_pieces(VOCABULARY)
    finder, weights = pieces.Pieces(known), np.r_[np.full(len(known), 1 / len(known)), pieces.UNKNOWN][:, None]
    words, counts = ["Quixotic", "plain", "words", long], np.array([50.0, 7_998, 7_998, 1])
    for _ in range(2):
        total = pieces.expected_counts(words, counts, finder, weights)[:-1]
        weights = np.r_[(total + 0.1) / (total.sum() + 0.1 * len(known)), pieces.UNKNOWN][:, None]
    _, mean, logs = token_counts.terminal_counts(words, finder, weights).T
    found = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCABULARY).filter("doc_id < 9").collect()}
    assert found[7].n_pretokens == 50 and found[7].log10_prob == pytest.approx(50 * logs[0] / math.log(10))
    assert found[8].n_pretokens == 1 and found[8].log10_prob == pytest.approx(logs[3] / math.log(10)) and found[8].expected_tokens == pytest.approx(mean[3])


def test_long_words_are_scored_like_short_ones(monkeypatch):
    known = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    weights = np.array([[0.1, 0.2, 0.05, 0.3, 0.1, 0.05, 0.1, 0.1, pieces.UNKNOWN]]).T
    words, finder = ["abab" * 7, "ab", "axb" * 9], pieces.Pieces(known)
    short = [token_counts.terminal_counts(words, finder, weights), pieces.expected_counts(words, np.array([1.0, 2, 3]), finder, weights)]
    for module in (pieces, token_counts):
        monkeypatch.setattr(module, "MAX_CHARS", 4)
    assert token_counts.terminal_counts(words, finder, weights) == pytest.approx(short[0])
    assert pieces.expected_counts(words, np.array([1.0, 2, 3]), finder, weights) == pytest.approx(short[1])


def test_token_counts_edge_cases(edge_documents, no_documents):
    rows = token_counts.count_tokens(edge_documents, VOCABULARY).collect()
    assert len(rows) == 10 and all((r.n_tokens, r.log10_prob) == (0, 0.0) for r in rows if r.doc_id in (2, 3, 4))
    assert all(r.n_tokens >= r.n_pretokens and r.expected_tokens > 0 for r in rows if r.n_pretokens)
    assert token_counts.count_tokens(no_documents, VOCABULARY).count() == 0


def check_packing(rows, texts: dict, capacity: int = 1024):
    """Every id in one piece, digests of the tokenizer's own ids, sequences gapless and not too long."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_is_whole_and_tight(spark, sf_dir):
    rows = QUERIES["op6_harmonic_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences, total = check_packing(rows, texts)
    assert sequences * 1024 < total * 1.01 + 1024


def test_packing_edge_cases(spark, edge_documents, no_documents):
    distinct = edge_documents.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(packing.pack(distinct, BPE).collect(), {r.doc_id: r.text for r in distinct.collect()})
    assert packing.pack(edge_documents, BPE).agg(F.countDistinct("doc_id")).first()[0] == 8
    special = spark.createDataFrame([(1, "a <|endoftext|> b\n\n  c"), (2, "x   y z")], "doc_id int, text string")
    check_packing(packing.pack(special, BPE).collect(), {1: "a <|endoftext|> b\n\n  c", 2: "x   y z"})
    assert packing.pack(no_documents, BPE).count() == 0


def test_byte_table_is_the_published_one():
    encoding, special = packing.encoder(BPE)
    with open(BPE, encoding="utf-8") as file:
        spec = json.load(file)
    assert encoding.n_vocab == len({*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])}) and special == ("<|endoftext|>",)
