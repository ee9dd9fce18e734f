"""The pipeline against brute force of its filtering stages."""

import corpus_pipeline
import pytest
from pyspark.sql import Row

from __spark_entry__ import oracle_sql, queries
from check import canonical, connect
from tabularium.llm.queries import ORACLES, QUERIES

from .conftest import prose
from .test_duplicates import brute_hits, brute_lines, brute_near
from .test_text_models import check_packing


def test_stages_equal_brute_force(spark, tmp_path):
    passage = prose(77, 30)
    docs = [(i, f"{prose(i, 40)}\nSubscribe to our newsletter") for i in range(30)] + [(40, None), (41, "12 34 !?"), (42, prose(3, 40)), (43, f"{prose(43, 30)} {passage}"), (44, "Subscribe to our newsletter"), (45, f"{prose(45, 900)} {passage}")]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, lang="en" if i % 2 else "fr", source=f"s{i % 12}", n_chars=len(t or "")) for i, t in docs],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, now = docs, frame
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        if number == 0:
            want = [(i, t) for i, t in want if any(map(str.isalpha, t or ""))]
        elif number == 1:
            lines = brute_lines([(i, f"s{i % 12}", t) for i, t in want], 10)
            want = [(i, t) for i, (t, _, gone) in lines.items() if not gone or t.strip()]
        elif number == 2:
            low = brute_near(want)[1]
            want = [(i, t) for i, t in want if low[i] == i]
        elif number == 3:
            hits = {i: brute_hits(t, [(1, passage)]) for i, t in want}
            want = [(i, t) for i, t in want if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
        if number < 4:
            assert now.columns == frame.columns, name
            assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(want), name
            assert all(r.n_chars == len(r.text) for r in now.collect())
    ids = {i for i, _ in want}
    assert 45 in ids and not ids & {40, 41, 42, 43, 44}
    check_packing(now.collect(), dict(want))
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(str, now.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = connect("/root/testdata/sf0.001").execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rel.fetchall())


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and {*QUERIES, "pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


def test_columns_of_the_corpus_keep_their_names_and_values(spark, tmp_path):
    """Columns named like those the operators add or use inside, in every stage but the last."""
    extra = {"lang_pred": "mine", "score": 42, "n_removed": -1, "n_lines": -2, "held_out": "h", "component_id": "c", "contaminated": 7, "kept": "k", "doc": 3, "key_a": "a"}
    docs = [(i, f"{prose(i, 40)}\nSubscribe to our newsletter") for i in range(24)] + [(40, None), (41, prose(3, 40)), (41, prose(3, 40)), (42, "")]
    frame = spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source=f"s{i % 12}", n_chars=len(t or ""), **extra) for i, t in docs])
    spark.createDataFrame([(1, prose(77, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns and now.dtypes == frame.dtypes, name
        got = now.collect()
        assert len(got) >= 20 and all(r[c] == v for r in got for c, v in extra.items()), name
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
