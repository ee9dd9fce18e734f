"""Line spread, chosen-path join, decontamination, NN-descent and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import chosen_path, components, decontaminate, line_spread, nn_descent

from .conftest import prose


def smallest_reachable(ids, links):
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return low


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 1), (5, 6), (6, 5)]
    found = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    ids = {i for link in links for i in link}
    assert {r.id: r.component for r in found.collect()} == smallest_reachable(ids, links)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def copies(seed: int = 3):
    """Documents with exact copies, a star of near copies and a long shared passage."""
    draw = random.Random(seed)
    base, passage = prose(50, 120).split(), prose(90, 40)
    docs = [(i, prose(100 + i, 60) + " " + passage) for i in range(80)]
    for i in range(80, 160):
        words = list(base)
        for at in draw.sample(range(len(words)), draw.randint(0, 9)):
            words[at] = f"x{i}y{at}"
        docs.append((i, " ".join(words)))
    docs += [(160 + i, docs[85][1].upper()) for i in range(40)]
    return docs + [(300, "one two"), (301, "ONE\ttwo"), (302, ""), (303, None)]


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + min(5, len(words))]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, smallest_reachable(sets, links)


def test_near_duplicates_equal_brute_force(spark):
    docs = copies()
    sets, low = brute_near(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    for options in ({}, {"leaf": 4, "block": 16}, {"leaf": 2, "depth": 1, "block": 8}):
        rows = chosen_path.near_duplicates(frame, **options).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


def test_near_duplicate_edge_cases(edge_documents, no_documents):
    rows = chosen_path.near_duplicates(edge_documents).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert all(r.n_shingles == 0 and r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    kept = chosen_path.one_of_each(edge_documents)
    assert kept.columns == edge_documents.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 9]))
    assert kept.agg(F.sum("key_a")).first()[0] == 16
    assert chosen_path.near_duplicates(no_documents).count() == 0 and chosen_path.one_of_each(no_documents).count() == 0


def words_of(text):
    out, word = [], b""
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if b >= 128 or chr(b).isalnum():
            word += bytes([b])
        elif word:
            out, word = out + [word], b""
    return out + [word] if word else out


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        n = min(13, len(own))
        for window in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for at in range(len(words) - n + 1):
                if tuple(words[at : at + n]) == window:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    long, other = prose(11, 30), prose(12, 14)
    items = [(1, long), (2, "Tiny, item"), (3, other), (4, None), (5, "..."), (10, long), (3, other)]
    inside = " ".join(long.split()[5:18])
    docs = [(1, f"{prose(60, 50)} {long.upper()}! tail"), (2, f"start {inside} end"), (3, " ".join(long.split()[5:17])), (4, "a tiny; ITEM here"), (5, prose(61, 200) + " tiny item"),
            (6, None), (7, ""), (8, other), (8, other), (9, f"{other} {other}")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows) == sorted((i, *brute_hits(t, items)) for i, t in docs)


def test_decontamination_edge_cases(spark, edge_documents, no_documents):
    benchmark = spark.createDataFrame([(1, prose(7, 40))], "item_id bigint, text string")
    kept = decontaminate.remove_contaminated(edge_documents, benchmark)
    assert kept.columns == edge_documents.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 9]))
    assert decontaminate.contamination(no_documents, benchmark).count() == 0
    assert decontaminate.contamination(edge_documents, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def brute_lines(docs, min_sites):
    sites, first = {}, {}
    for i, source, text in docs:
        for line in (text or "").split("\n"):
            bare = line.strip(" \t\r")
            sites.setdefault(bare, set()).add(source or "")
            first[bare] = min(first.get(bare, i), i)
    out = {}
    for i, _, text in docs:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (b := x.strip(" \t\r")) or len(sites[b]) < min_sites or first[b] == i]
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_spread_equals_brute_force(spark):
    docs = [(i, f"s{i % 7}" if i % 9 else None, f"Accept cookies\n{prose(i, 5)}\n\n Read more \n{'near ' + str(i % 7 // 4)}") for i in range(40)]
    docs += [(50, "s1", None), (51, "s2", ""), (52, "s3", "Read more\r\nRead more")]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3)
    for least in (2, 4, 5, 8):
        rows = line_spread.remove_boilerplate(frame, min_sites=least).collect()
        assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows} == brute_lines(docs, least)
    # a sketch this small is never sure: the exact counts decide
    rows = line_spread.remove_boilerplate(frame, min_sites=5, log_k=4).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows} == brute_lines(docs, 5)


def test_line_spread_edge_cases(edge_documents, no_documents):
    found = line_spread.remove_boilerplate(edge_documents, min_sites=1)
    assert found.columns == [*edge_documents.columns, "n_lines", "n_removed"] and found.agg(F.sum("key_a")).first()[0] == 20
    assert {r.doc_id: r.text for r in found.collect()}[8] == "" and found.count() == 10
    assert line_spread.remove_boilerplate(no_documents).count() == 0


def brute_vectors(rows, threshold=0.93):
    units = {}
    for i, vector, label in rows:
        if label is not None and vector and not any(x is None or not np.isfinite(x) for x in vector) and any(vector):
            own = np.array(vector) / np.abs(vector).max()
            units[i] = (label, own / np.linalg.norm(own))
    links = [(a, b) for a in units for b in units if a < b and units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= threshold]
    low = smallest_reachable([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in link for link in links), low[r[0]], low[r[0]] == r[0]) for r in rows}


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + draw.standard_normal(16) * (0.02 if i % 6 else 0.25)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, draw.standard_normal(16).tolist(), 1) for i in range(60)] + [(400 + i, rows[1][1], 1) for i in range(5)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] * 16, 1), (505, rows[1][1], None), (506, rows[1][1][:8], 1), (507, [1e200] * 16, 0), (508, [1e-200] * 16, 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    found = nn_descent.near_vectors(frame, k=6, block=24).collect()
    want = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == want
    assert nn_descent.near_vectors(frame.limit(0)).count() == 0


def grouped_nodes(spark):
    """A group of 400 in one part and 40 pairs whose links were missed, as (id, kind, part, unit)."""
    draw = np.random.default_rng(8)
    unit = lambda v: (v / np.linalg.norm(v)).tobytes()
    centre, rows = draw.standard_normal(32), []
    rows = [(i, 1, 0, unit(centre + draw.standard_normal(32) * 0.02)) for i in range(400)]
    for i in range(400, 480, 2):
        pair = draw.standard_normal(32)
        rows += [(i, 1, i, unit(pair)), (i + 1, 1, i + 1, unit(pair + draw.standard_normal(32) * 0.02))]
    return spark.createDataFrame(rows, "id bigint, kind bigint, part bigint, unit binary")


def test_audit_counts_classes_not_links(spark):
    whole, small, linked = nn_descent.audit(grouped_nodes(spark), 0.93, 480, 12)
    assert (whole, small, linked) == (400 / 480, 0.0, 480)
    # draws more until enough classes have links
    assert nn_descent.audit(grouped_nodes(spark), 0.93, 32, 12)[2] >= 64


def test_missed_target_is_reported(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [1.0, 0.01], 3)], "vec_id bigint, embedding array<double>, label int")
    with pytest.warns(UserWarning, match="audited recall 1.0000"):
        nn_descent.near_vectors(frame, target=1.1, most_repeats=0)


def test_repeated_vector_ids(spark):
    rows = nn_descent.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 3), (1, [1.0, 0.0], 3), (None, [1.0, 0.01], 3)], "vec_id bigint, embedding array<double>, label int")).collect()
    assert [(r.n_links, r.component_id) for r in rows] == [(2, 1)] * 3


def test_a_group_of_near_copies_takes_no_paths_once_folded(spark):
    base = prose(70, 150).split()
    docs = [(i, " ".join(f"x{i}" if at == i % 150 else w for at, w in enumerate(base))) for i in range(300)]
    docs += [(300 + i, prose(400 + i, 60)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    rows = chosen_path.sketched(frame, 64, 7, "doc_id", "text")
    classes = rows.select("sig", "sketch")
    paths = chosen_path.first_paths(classes, 6, 2, 64, 7)
    stars = chosen_path.star_pairs(paths, classes, 32, 6, 64, 0.56, 7)
    assert 299 <= stars.count() <= 2 * 12 * 300
    homes = components.connected_components(chosen_path.confirm(stars, chosen_path.full_sets(frame, rows.select("sig"), "text"), 75))
    assert homes.count() == 300 and homes.select("component").distinct().count() == 1
    placed = paths.join(homes.select(F.col("id").alias("sig"), "component"), "sig", "left").select("sig", "tree", "node", F.coalesce("component", "sig").alias("home"))
    leaves, blocks = chosen_path.grow(placed, classes, 6, 2, 32, 64, 8, 7, 512)
    assert leaves.count() == 0 and blocks.count() == 0


def test_cells_come_with_the_paths_and_join_no_sketch(spark):
    classes = spark.range(40).select(F.encode(F.col("id").cast("string"), "utf-8").alias("sig"), F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)).cast("int") for i in range(64)]).alias("sketch"))
    paths = chosen_path.first_paths(classes, 6, 2, 64, 7)
    assert "Join" not in paths._jdf.queryExecution().toString()
    rows = paths.collect()
    # a cell lies in one node, and two tokens of two values part a node into at most four
    assert len(rows) == 40 * 12 and len({(r["node"], r["cell"]) for r in rows}) == len({r["cell"] for r in rows})
    assert all(len({r["cell"] for r in rows if r["node"] == node}) <= 4 for node in {r["node"] for r in rows})
    assert all(len({r["cell"] for r in rows if r["node"] == node}) > 1 for node in {r["node"] for r in rows if sum(x["node"] == r["node"] for x in rows) > 10})


def test_classes_that_met_in_one_dense_node_are_spared_in_another(spark):
    held = {1: range(45), 2: range(2, 46), 3: range(5, 35), 4: [*range(20, 40), *range(50, 70)]}
    rows = [(bytes([c]), node, bytes([c]), len(classes)) for node, classes in held.items() for c in classes]
    dense = spark.createDataFrame(rows, "sig binary, node bigint, home binary, size bigint")
    blocks = chosen_path.dense_blocks(dense, 8).collect()
    met = set()
    for a in blocks:
        assert a["mine"] in (a["i"], a["j"])
        met |= {frozenset((a["sig"], b["sig"])) for b in blocks if (a["node"], a["i"], a["j"]) == (b["node"], b["i"], b["j"]) and {a["mine"], b["mine"]} == {a["i"], a["j"]}}
    assert all(frozenset((bytes([a]), bytes([b]))) in met for classes in held.values() for a in classes for b in classes if a != b)
    # 854 rows if every block of a node meets every other
    assert len(blocks) <= 500 and {r["node"] for r in blocks} == {1, 2, 4}


def test_hot_classes_are_counted_once_for_both_sides(spark):
    table = spark.range(40).select(F.encode(F.col("id").cast("string"), "utf-8").alias("sig"), F.col("id").cast("int").alias("own"))
    name = lambda c: F.encode(c.cast("string"), "utf-8")
    pairs = spark.range(39).select(name(F.lit(0)).alias("a"), name(F.col("id") + 1).alias("b")).union(spark.range(1, 39).select(name(F.col("id")).alias("a"), name(F.lit(39)).alias("b")))
    both = chosen_path.attach(pairs, table, "own", heavy=4)
    assert sorted((int(r["a"]), int(r["b"]), r["own_a"], r["own_b"]) for r in both.collect()) == sorted([(0, i, 0, i) for i in range(1, 40)] + [(i, 39, i, 39) for i in range(1, 39)])
    # a join with the value and two with the hot classes a side; no aggregation is left in the plan
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 6 and "Aggregate" not in plan


def test_dense_nodes_of_all_levels_are_dealt_at_once(spark, monkeypatch):
    # halves of two tokens at the first level, everything alike below
    classes = spark.range(64).select(F.encode(F.col("id").cast("string"), "utf-8").alias("sig"), F.array(*[F.lit(1) for _ in range(64)]).alias("sketch"))
    tokens = [F.struct(F.lit(0).alias("tree"), F.lit(5).cast("bigint").alias("node")), F.struct(F.lit(1).alias("tree"), (F.col("sig") < F.encode(F.lit("4"), "utf-8")).cast("bigint").alias("node"))]
    paths = classes.select("sig", F.col("sig").alias("home"), F.inline(F.array(*tokens)))
    dealt, deal = [], chosen_path.dense_blocks
    monkeypatch.setattr(chosen_path, "dense_blocks", lambda dense, block: dealt.append(dense) or deal(dense, block))
    leaves, blocks = chosen_path.grow(paths, classes, 2, 2, 4, 64, 3, 7, 8)
    assert len(dealt) == 1 and dealt[0].select("node").distinct().count() > 2
    rows, met = blocks.collect(), set()
    for a in rows:
        met |= {frozenset((a["sig"], b["sig"])) for b in rows if (a["node"], a["i"], a["j"]) == (b["node"], b["i"], b["j"]) and {a["mine"], b["mine"]} == {a["i"], a["j"]}}
    assert leaves.count() == 0 and len({x for x in met if len(x) == 2}) == 64 * 63 // 2
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
