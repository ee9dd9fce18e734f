"""Streams replayed from the event files, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import read_in_batches
from ..streaming import operators as O
from ..streaming import sources as S
from .registry import Tables, query
from .windows import PREDICTED, predicted


def event_stream(t: Tables):
    """The events file as a file stream (a glob, because a stream source lists folders and patterns)."""
    return S.read_files(t.spark, t.path("events").replace(".parquet", ".parque[t]"), t.events.schema)


def disordered(t: Tables, shuffle: tuple[int, ...] = (1, 0, 3, 2)):
    """(stream, lateness): all events as files out of order, time slices swapped in pairs, then a closing event far ahead.

    No event is later than two slices. The closing event only moves the watermark past the others; it stays in the
    operators' state and never comes out.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = t.events.agg(F.min(micros), F.max(micros)).first()
    width = (high - low) // len(shuffle) + 1
    folder = S.scratch_folder(t.spark, "disordered")
    for number, at in enumerate(shuffle):
        t.events.filter(F.floor((micros - low) / width) == at).write.parquet(f"{folder}/{number}")
    late = 2 * width // 1_000_000 + 1
    ahead = F.timestamp_micros(F.lit(high) + (2 * late + 2 * 86_400) * 1_000_000)
    t.events.limit(1).withColumn("ts", ahead.cast(t.events.schema["ts"].dataType)).write.parquet(f"{folder}/{len(shuffle)}")
    return S.read_files(t.spark, f"{folder}/*", t.events.schema), f"{late} seconds"


def latest(df, key: str):
    """The last state of each key."""
    fields = [c for c in df.columns if c not in (key, "upto")]
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), "upto").alias("s")).select(key, "s.*")


@query(
    "st01_json_messages",
    """SELECT event_id, user_id, CAST(props->>'k' AS BIGINT) AS k FROM events""",
)
def _(t: Tables):
    schema = "event_id bigint, user_id bigint, k bigint"
    wire = S.kafka_rows(t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), key="user_id")
    from pyspark.sql.types import StructType

    return S.parse_json(wire, StructType.fromDDL(schema))


@query("st02_json_rows", """SELECT user_id::VARCHAR AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def _(t: Tables):
    rows = S.kafka_rows(event_stream(t).select("user_id", "event_id", "event_type"), key="user_id")
    slim = rows.withColumn("value", F.to_json(F.from_json("value", "event_id bigint, event_type string")))
    return S.drain(slim, label="st02")


@query("st03_foreach_batch", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def _(t: Tables):
    return S.drain(event_stream(t).filter("event_type = 'purchase'").select("event_id", "value"), label="st03")


@query(
    "st04_tumbling_stream",
    """SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY 1, 2""",
    floats="total",
    digits=3,
)
def _(t: Tables):
    aggs = [F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")]
    stream, late = disordered(t)
    # a window comes out once the watermark has passed it
    return S.drain(O.tumbling(stream, "ts", "6 hours", ["event_type"], aggs, late), label="st04")


COUNTED = """SELECT user_id, window, count(*) AS events, sum(value) AS total FROM (SELECT user_id, value, floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20)::BIGINT AS window
    FROM events) GROUP BY 1, 2"""


@query("st04_count_windows", COUNTED.replace("window", '"window"'), floats="total", digits=4)
def _(t: Tables):
    return O.count_windows(t.events, "user_id", ["ts", "event_id"], 20, [F.sum("value").alias("total")])


def total_of_window(pdf):
    import pandas as pd

    return pd.DataFrame({"events": [len(pdf)], "total": [float(pdf["value"].sum())]})


@query("st04_count_windows_stream", f"SELECT * FROM ({COUNTED.replace('window', chr(34) + 'window' + chr(34))}) WHERE events = 20", floats="total", digits=4)
def _(t: Tables):
    output = "user_id bigint, window bigint, events bigint, total double"
    stream, late = disordered(t)
    made = O.event_windows(stream, "user_id", "ts", ["event_id"], ["value"], output, 20, late, [lambda pdf: total_of_window(pdf)])
    return S.drain(made, label="st04c")


RUNNING = "SELECT user_id, count(*) AS events, sum(value) AS value_sum, sum(value) / count(*) AS value_avg FROM events GROUP BY 1"


@query("st05_running_features", RUNNING, floats="value_sum value_avg", digits=4)
def _(t: Tables):
    return O.running_features(t.events, "user_id", ["value"])


@query("st05_running_features_stream", RUNNING, floats="value_sum value_avg", digits=4)
def _(t: Tables):
    stream, late = disordered(t)
    made = S.drain(O.event_features(stream, "user_id", ["value"], "ts", ["event_id"], late), label="st05")
    return latest(made, "user_id")


@query(
    "st06_anomaly_stream",
    """SELECT event_id, CASE WHEN count(*) OVER w >= 10 THEN abs(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) ELSE 0.0 END AS score
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
    floats="score",
    digits=4,
)
def _(t: Tables):
    stream, late = disordered(t)
    made = O.anomaly_scores(stream, "user_id", "event_id", ["value"], "ts", ["event_id"], late, window=50)
    return S.drain(made, label="st06").select("event_id", "score")


@query(
    "st07_live_accuracy",
    f"""SELECT *, 1.0 - accuracy > 0.1 AS alert FROM (SELECT user_id, count(actual) AS labelled, avg(CASE WHEN actual IS NOT NULL THEN (prediction = actual)::INTEGER END) AS accuracy FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {PREDICTED}) WHERE rn <= 50 GROUP BY 1)""",
    floats="accuracy",
)
def _(t: Tables):
    stream, late = disordered(t)

    class Streamed:
        events = stream

    made = O.live_accuracy(predicted(Streamed), "user_id", "prediction", "actual", "ts", ["event_id"], late, last=50)
    return latest(S.drain(made, label="st07"), "user_id")


@query(
    "st08_drift_stream",
    """SELECT window_start, 'value' AS "column", m AS mean, abs(m - r) / (s + 1e-8) AS z_score, abs(m - r) / (s + 1e-8) > 2 AS drifted FROM
    (SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, avg(value) AS m FROM events GROUP BY 1), (SELECT avg(value) AS r, stddev_pop(value) AS s FROM events)""",
    floats="mean z_score",
    digits=5,
)
def _(t: Tables):
    stream, late = disordered(t)
    return S.drain(O.windowed_drift(stream, t.events, "ts", "1 day", ["value"], watermark=late), label="st08")


@query("st09_file_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    stream = read_in_batches(t.spark, t.path("events").replace(".parquet", ".parque[t]"), t.events.schema, "parquet")
    return S.drain(stream.select("event_type", "event_id"), label="st09").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
