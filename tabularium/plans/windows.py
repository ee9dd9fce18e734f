"""Window features and time-series queries over events and daily orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as TS
from ..operators import windows as W
from .registry import Tables, query

def daily(t: Tables):
    return t.orders.groupBy(F.col("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))

DAILY_ROUNDED = "(SELECT o_orderdate AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"


@query(
    "w01_lags",
    """SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7, lag(value, 14) OVER w AS value_lag_14,
    lag(value, 30) OVER w AS value_lag_30 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t: Tables):
    made = W.lag_features(t.events, ["value"], ["ts", "event_id"], ["user_id"])
    return made.select("event_id", *[c for c in made.columns if "_lag_" in c])


def _rolling_sql(windows: list[int]) -> str:
    parts = []
    for w in windows:
        frame = f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(f"CASE WHEN count(value) OVER {frame} = {w} THEN {f}(value) OVER {frame} END AS value_rolling_{s}_{w}")
    return f"SELECT event_id, {', '.join(parts)} FROM events"


ROLLED = " ".join(f"value_rolling_{s}_{w}" for w in (7, 14, 30) for s in ("mean", "std"))


@query("w02_rolling", _rolling_sql([7, 14, 30]), floats=ROLLED)
def _(t: Tables):
    made = W.rolling_features(t.events, ["value"], ["ts", "event_id"], ["user_id"])
    return made.select("event_id", *[c for c in made.columns if "_rolling_" in c])


@query(
    "w02_rolling_shifted",
    """SELECT day, CASE WHEN count(total) OVER w = 7 THEN avg(total) OVER w END AS total_rolling_mean_7 FROM
    """ + DAILY_ROUNDED + """ WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    floats="total_rolling_mean_7",
    digits=2,
)
def _(t: Tables):
    return W.rolling_features(daily(t), ["total"], ["day"], windows=[7], stats=["mean"], shift=1).drop("total")


@query(
    "w03_centred_trend",
    f"""WITH a AS (SELECT day, CASE WHEN count(total) OVER w = 7 THEN avg(total) OVER w END AS m FROM {DAILY_ROUNDED}
      WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
    SELECT day, coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM a""",
    floats="trend",
    digits=2,
)
def _(t: Tables):
    return W.centred_trend(daily(t), "total", 7, ["day"]).drop("total")


@query(
    "w04_trailing_anomalies",
    """SELECT event_id, CASE WHEN count(*) OVER w >= 10 THEN abs(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) ELSE 0.0 END AS score
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""",
    floats="score",
    digits=4,
)
def _(t: Tables):
    return W.trailing_anomalies(t.events, ["value"], ["ts", "event_id"], ["user_id"], window=50).select("event_id", "score")


@query(
    "w04_anomaly_flags",
    """SELECT user_id, count(*) AS anomalies FROM (
    SELECT user_id, CASE WHEN count(*) OVER w >= 10 THEN abs(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) ELSE 0.0 END AS score
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) WHERE score > 3 GROUP BY 1""",
)
def _(t: Tables):
    found = W.trailing_anomalies(t.events, ["value"], ["ts", "event_id"], ["user_id"]).filter("is_anomaly = 1")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("anomalies"))


PREDICTED = """(SELECT event_id, user_id, ts, event_id % 3 AS prediction, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 % 3 END AS actual FROM events)"""


def predicted(t: Tables):
    key = F.col("event_id")
    return t.events.select("event_id", "user_id", "ts", (key % 3).alias("prediction"), F.when(key % 5 != 0, key % 7 % 3).alias("actual"))


@query(
    "w05_recent_accuracy",
    f"""SELECT user_id, count(actual) AS labelled, CASE WHEN count(actual) >= 10 THEN
    avg(CASE WHEN actual IS NOT NULL THEN (prediction = actual)::INTEGER END) END AS accuracy FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {PREDICTED}) WHERE rn <= 50 GROUP BY 1""",
    floats="accuracy",
)
def _(t: Tables):
    return W.recent_accuracy(predicted(t), "prediction", "actual", ["ts", "event_id"], ["user_id"], last=50)


@query(
    "w05_rolling_accuracy",
    f"""SELECT event_id, avg(CASE WHEN actual IS NOT NULL THEN (prediction = actual)::INTEGER END)
    OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rolling_accuracy FROM {PREDICTED}""",
    floats="rolling_accuracy",
)
def _(t: Tables):
    return W.rolling_accuracy(predicted(t), "prediction", "actual", ["ts", "event_id"]).select("event_id", "rolling_accuracy")


@query(
    "w06_monotonic",
    """WITH d AS (SELECT event_id - lag(event_id) OVER w AS e, value - lag(value) OVER w AS v FROM events WINDOW w AS (ORDER BY ts, event_id))
    SELECT 'event_id' AS "column", min(e) >= 0 AS increasing, max(e) <= 0 AS decreasing FROM d
    UNION ALL SELECT 'value', min(v) >= 0, max(v) <= 0 FROM d""",
)
def _(t: Tables):
    return W.monotonic_columns(t.events, ["event_id", "value"], ["ts", "event_id"])


@query(
    "w07_sequential_ids",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) = count(*) AND max({c}) - min({c}) = count(*) - 1 AND min({c}) IN (0, 1) AS sequential FROM orders"""
        for c in ("o_orderkey", "o_custkey")
    ),
)
def _(t: Tables):
    return W.sequential_ids(t.orders, ["o_orderkey", "o_custkey"])


@query(
    "w08_category_codes",
    "SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS code FROM (SELECT DISTINCT p_brand, p_type FROM part)",
)
def _(t: Tables):
    return W.category_codes(t.part, ["p_brand", "p_type"])


GAPPY = """(SELECT event_id, user_id, ts, CASE WHEN event_id % 4 <> 1 THEN value END AS value FROM events)"""


def gappy(t: Tables):
    return t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 4 != 1, F.col("value")).alias("value"))


@query(
    "t01_prepare",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {GAPPY}),
    k AS (SELECT *, CASE WHEN value IS NOT NULL THEN rn END AS pos FROM n),
    a AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(pos IGNORE NULLS) OVER p AS pa,
      first_value(value IGNORE NULLS) OVER f AS qv, first_value(pos IGNORE NULLS) OVER f AS qa FROM k
      WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, coalesce(value, pv + (qv - pv) * (rn - pa)::DOUBLE / nullif(qa - pa, 0)::DOUBLE, pv, qv) AS value FROM a""",
    floats="value",
)
def _(t: Tables):
    return TS.prepare(gappy(t), "ts", "value", ["user_id"], ["event_id"]).select("event_id", "value")


@query(
    "t02_frequency",
    """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    m AS (SELECT user_id, quantile_cont(gap, 0.5) AS median_gap_seconds FROM g GROUP BY 1)
    SELECT *, CASE WHEN median_gap_seconds <= 3600 THEN 'hour' WHEN median_gap_seconds <= 86400 THEN 'day'
      WHEN median_gap_seconds <= 7 * 86400 THEN 'week' WHEN median_gap_seconds <= 31 * 86400 THEN 'month' ELSE 'day' END AS frequency FROM m""",
    floats="median_gap_seconds",
    digits=3,
)
def _(t: Tables):
    return TS.frequency(t.events, "ts", ["user_id"], ["event_id"])


@query(
    "t03_supervised",
    """SELECT event_id, lag_1, lag_7, lag_30, rolling_7, rolling_30, day_of_week, month, trend FROM (
    SELECT event_id, value, lag(value, 1) OVER w AS lag_1, lag(value, 7) OVER w AS lag_7, lag(value, 30) OVER w AS lag_30,
    avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_7, avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_30,
    (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month, row_number() OVER w - 1 AS trend
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE lag_30 IS NOT NULL""",
    floats="rolling_7 rolling_30",
)
def _(t: Tables):
    return TS.supervised(t.events, "ts", "value", ["user_id"], ["event_id"]).select("event_id", *TS.FEATURES)


@query(
    "t04_future_rows",
    """WITH n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    l AS (SELECT user_id, max(ts) AS last, any_value(n) AS n, list(value ORDER BY r DESC) FILTER (r <= 30) AS h FROM n GROUP BY 1),
    s AS (SELECT *, list_concat(h, list_transform(range(i), lambda z: h[len(h)])) AS x FROM l, range(7) g(i))
    SELECT user_id, last + (i + 1) * INTERVAL 1 DAY AS date, x[len(x)] AS lag_1, CASE WHEN len(x) >= 7 THEN x[len(x) - 6] ELSE x[len(x)] END AS lag_7,
    CASE WHEN len(x) >= 30 THEN x[len(x) - 29] ELSE x[len(x)] END AS lag_30, list_avg(list_slice(x, greatest(len(x) - 6, 1), len(x))) AS rolling_7,
    list_avg(list_slice(x, greatest(len(x) - 29, 1), len(x))) AS rolling_30, (isodow(last + (i + 1) * INTERVAL 1 DAY) - 1)::INTEGER AS day_of_week,
    month(last + (i + 1) * INTERVAL 1 DAY)::INTEGER AS month, n + i AS trend FROM s""",
    floats="rolling_7 rolling_30",
)
def _(t: Tables):
    return TS.future_rows(t.events, "ts", "value", 7, ["user_id"], ["event_id"])


@query(
    "t06_forecast_interval",
    f"""WITH s AS (SELECT day, total, lag(total) OVER (ORDER BY day) AS yhat FROM {DAILY_ROUNDED}),
    e AS (SELECT 1.96 * stddev_pop(total - yhat) AS h FROM s)
    SELECT day, yhat, yhat - h AS lower, yhat + h AS upper FROM s, e WHERE yhat IS NOT NULL""",
    floats="lower upper",
    digits=2,
)
def _(t: Tables):
    lagged = W.lag_features(daily(t), ["total"], ["day"], lags=[1]).withColumnRenamed("total_lag_1", "yhat").filter("yhat IS NOT NULL")
    return TS.forecast_interval(lagged, lagged, "total", "yhat").select("day", "yhat", "lower", "upper")


@query(
    "t07_decompose",
    f"""WITH a AS (SELECT day, total, CASE WHEN count(total) OVER w = 7 THEN avg(total) OVER w END AS m FROM {DAILY_ROUNDED}
      WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    b AS (SELECT day, total, coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM a)
    SELECT day, total, trend, 0.0::DOUBLE AS seasonal, total - trend AS residual FROM b""",
    floats="trend residual",
    digits=2,
)
def _(t: Tables):
    return TS.decompose(daily(t), "day", "total")


@query(
    "t07_seasonal",
    f"""WITH a AS (SELECT day, total, CASE WHEN count(total) OVER w = 7 THEN avg(total) OVER w END AS m FROM {DAILY_ROUNDED}
      WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    b AS (SELECT day, total, row_number() OVER (ORDER BY day) % 7 AS phase,
      coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(m IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM a)
    SELECT day, avg(total - trend) OVER (PARTITION BY phase) AS seasonal FROM b""",
    floats="seasonal",
    digits=2,
)
def _(t: Tables):
    return TS.decompose(daily(t), "day", "total", period=7).select("day", "seasonal")


@query(
    "t08_temporal_split",
    """SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= floor(count(*) OVER (PARTITION BY user_id) * 0.8)
    THEN 'train' ELSE 'test' END AS split FROM events""",
)
def _(t: Tables):
    return TS.temporal_split(t.events, ["ts", "event_id"], ["user_id"]).select("event_id", "split")
