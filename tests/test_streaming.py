"""Late rows, restart from a checkpoint, timers, and workers outside the package folder."""

import datetime
import os
import subprocess
import sys

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabularium.streaming import operators as O
from tabularium.streaming import sources as S

SCHEMA = "id bigint, k string, ts timestamp_ntz, v double"


def part(spark, folder, name, rows):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    spark.createDataFrame([(i, k, at(s), float(v)) for i, k, s, v in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    from pyspark.sql.types import StructType

    return S.read_files(spark, f"{folder}/*", StructType.fromDDL(SCHEMA))


def run(df, folder, sink, mode="append"):
    def write(batch, batch_id):
        batch.write.mode("append").parquet(sink)

    q = S.for_each_batch(df, write, f"{folder}-ckpt", mode)
    q.awaitTermination()


def test_late_rows_are_dropped_beyond_the_watermark(spark, tmp_path):
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    aggs = [F.count(F.lit(1)).alias("n")]
    made = lambda: O.tumbling(stream(spark, folder), "ts", "10 seconds", [], aggs, watermark="5 seconds")
    part(spark, folder, "a", [(1, "x", 1, 1), (2, "x", 12, 1)])
    run(made(), folder, sink)
    part(spark, folder, "b", [(3, "x", 40, 1)])
    run(made(), folder, sink)
    part(spark, folder, "c", [(4, "x", 2, 1), (5, "x", 80, 1)])
    run(made(), folder, sink)
    got = {r["window_start"].second: r["n"] for r in spark.read.parquet(sink).collect()}
    assert got[0] == 1 and got[10] == 1


def test_running_state_survives_a_restart(spark, tmp_path):
    O.use_rocksdb(spark)
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    made = lambda: O.buffered_windows(
        stream(spark, folder), "k", ["id", "v"], ["ts", "id"], "k string, window bigint, total double", 3, None,
        [lambda pdf: pd.DataFrame({"total": [pdf["v"].sum()]})],
    )
    part(spark, folder, "a", [(1, "x", 1, 1), (2, "x", 2, 2), (3, "y", 3, 5)])
    run(made(), folder, sink)
    part(spark, folder, "b", [(4, "x", 4, 4), (5, "x", 5, 8), (6, "y", 6, 5)])
    run(made(), folder, sink)
    got = {(r["k"], r["window"]): r["total"] for r in spark.read.parquet(sink).collect()}
    assert got == {("x", 0): 7.0}


def test_processor_chain_gets_the_previous_output(spark, tmp_path):
    folder = str(tmp_path / "in")
    part(spark, folder, "a", [(i, "x", i, i) for i in range(4)])
    double = lambda pdf: pdf.assign(v=pdf["v"] * 2)
    total = lambda pdf: pd.DataFrame({"total": [pdf["v"].sum()]})
    made = O.buffered_windows(stream(spark, folder), "k", ["v"], ["ts", "id"], "k string, window bigint, total double", 4, None, [double, total])
    assert S.drain(made).first()["total"] == 12.0


CLOSE = (10_000, "x", 100_000, 0.0)


def late_first(spark, tmp_path, rows):
    """The later half in the first file, the earlier half in the second, then a closing row."""
    folder = str(tmp_path / "in")
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    part(spark, folder, "a", rows[len(rows) // 2 :])
    part(spark, folder, "b", rows[: len(rows) // 2])
    part(spark, folder, "c", [CLOSE])
    return stream(spark, folder), spark.createDataFrame([(i, k, float(v)) for i, k, _, v in rows], "id bigint, k string, v double"), rows


def test_files_out_of_order_equal_the_batch_forms(spark, tmp_path):
    rows = [(i, "xy"[i % 3 == 0], i * 7 % 400, (i * 37 % 101) / 3 + (300 if i % 50 == 0 else 0)) for i in range(400)]
    made, _, ordered = late_first(spark, tmp_path, rows)
    keys = {k: [r for r in ordered if r[1] == k] for k in "xy"}
    total = lambda pdf: pd.DataFrame({"total": [pdf["v"].sum()]})
    got = S.drain(O.event_windows(made, "k", "ts", ["id"], ["v"], "k string, window bigint, total double", 30, "1 hour", [total])).collect()
    want = {(k, n): sum(r[3] for r in own[30 * n : 30 * n + 30]) for k, own in keys.items() for n in range(len(own) // 30)}
    assert {(r["k"], r["window"]) for r in got} == set(want) and all(abs(r["total"] - want[r["k"], r["window"]]) < 1e-6 for r in got)

    got = {r["id"]: r["score"] for r in S.drain(O.anomaly_scores(made, "k", "id", ["v"], "ts", ["id"], "1 hour", window=40)).collect()}
    for own in keys.values():
        for n, r in enumerate(own):
            seen = np.array([x[3] for x in own[max(0, n - 40) : n]])
            want_score = abs(r[3] - seen.mean()) / (seen.std() + 1e-8) if n >= 10 else 0.0
            assert abs(got[r[0]] - want_score) < 1e-6
    assert len(got) == 400

    marked = made.withColumns({"p": F.lit(1.0), "y": F.when(F.col("id") % 4 > 0, F.floor("v") % 2.0)})
    got = S.drain(O.live_accuracy(marked, "k", "p", "y", "ts", ["id"], "1 hour", last=50))
    last = {r["k"]: r for r in got.groupBy("k").agg(F.max_by(F.struct("labelled", "accuracy"), "upto").alias("s")).select("k", "s.*").collect()}
    for k, own in keys.items():
        known = [int(r[3]) % 2 == 1 for r in own[-50:] if r[0] % 4]
        assert last[k]["labelled"] == len(known) and abs(last[k]["accuracy"] - sum(known) / len(known)) < 1e-9


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    part(spark, folder, "a", [(1, "x", 1000, 1), (2, "x", 1001, 1)])
    part(spark, folder, "b", [(3, "x", 2000, 1)])
    part(spark, folder, "c", [(4, "x", 5, 1), (5, "x", 2001, 1)])
    part(spark, folder, "d", [CLOSE])
    made = O.event_features(stream(spark, folder), "k", ["v"], "ts", ["id"], "10 seconds")
    seen = []
    q = S.for_each_batch(made, lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert O.late_rows(q) == 1 and max(r["events"] for r in seen) == 4


def test_state_is_held_by_buckets_of_keys(spark, tmp_path):
    folder = str(tmp_path / "in")
    n = O.BUCKETS * 4
    part(spark, folder, "a", [(i, str(i % (n // 2)), i, i) for i in range(n)])
    part(spark, folder, "b", [CLOSE])
    # keys that are null and NaN stay apart from each other and from the others, though pandas shows both as null
    name = F.when(F.col("k") == "1", F.lit(float("nan"))).when(F.col("k") != "2", F.expr("try_cast(k AS double)"))
    made = O.event_features(stream(spark, folder).filter("k IS NOT NULL").withColumn("k", name), "k", ["v"], "ts", ["id"], "1 hour")
    seen = []
    q = S.for_each_batch(made.selectExpr("CAST(k AS string) AS k", "events", "v_sum"), lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = sorted((r["k"] or "", r["events"], r["v_sum"]) for r in seen)
    assert got == sorted(("" if k in (1, 2) else f"{k}.0", 2, 2.0 * k + n // 2) for k in range(n // 2))
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert max(held) < n


def test_a_pause_starts_a_key_anew(spark, tmp_path):
    folder = str(tmp_path / "in")
    part(spark, folder, "a", [(1, "x", 1, 1), (2, "x", 5, 2), (3, "x", 500, 4)])
    part(spark, folder, "b", [(4, "x", 400, 8), (5, "y", 3, 16)])
    part(spark, folder, "c", [CLOSE])
    made = O.event_features(stream(spark, folder), "k", ["v"], "ts", ["id"], "1000 seconds", idle=120)
    got = sorted((r["k"], r["events"], r["v_sum"]) for r in S.drain(made).collect())
    assert got == [("x", 2, 3.0), ("x", 2, 12.0), ("y", 1, 16.0)]
    output = "k string, window bigint, total double"
    made = O.event_windows(stream(spark, folder), "k", "ts", ["id"], ["v"], output, 10, "1000 seconds", [lambda pdf: pd.DataFrame({"total": [pdf["v"].sum()]})], seconds=50)
    got = sorted((r["k"], r["window"], r["total"]) for r in S.drain(made).collect())
    assert got == [("x", 0, 3.0), ("x", 1, 8.0), ("x", 2, 4.0), ("y", 0, 16.0)]


def test_alert_when_accuracy_drops(spark, tmp_path):
    folder = str(tmp_path / "in")
    part(spark, folder, "a", [(i, "good", i, 1) for i in range(20)] + [(100 + i, "bad", i, i % 2) for i in range(20)])
    part(spark, folder, "b", [CLOSE])
    df = stream(spark, folder).withColumns({"p": F.lit(1.0), "y": F.col("v")})
    got = {r["k"]: r["alert"] for r in S.drain(O.live_accuracy(df, "k", "p", "y", "ts", ["id"], "5 seconds", last=10)).collect()}
    assert got == {"good": False, "bad": True}


def test_running_average_divisor(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", None)], "k string, v double")
    assert O.running_features(df, "k", ["v"]).first()["v_avg"] == 1.0
    assert O.running_features(df, "k", ["v"], null_aware=True).first()["v_avg"] == 2.0


def test_python_tasks_run_from_another_folder(tmp_path, sf_dir):
    """Workers cannot import the package there, so functions must travel with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from __spark_entry__ import queries
from tabularium.session import create_session
s = create_session("away", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
q = queries()
for n in ("p03_filter_callable", "m30_bootstrap", "st04_count_windows_stream", "u02_apply_rows"):
    q[n](s, {sf_dir!r}).collect()
print("done")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
