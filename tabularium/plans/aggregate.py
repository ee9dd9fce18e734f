"""Aggregation, distribution, correlation and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from .registry import Tables, query

PRICED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a01_global_agg",
    """SELECT sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max,
    count(l_discount) AS l_discount_count, stddev_samp(l_extendedprice) AS l_extendedprice_std FROM lineitem""",
    floats="l_quantity_sum l_quantity_mean l_extendedprice_std",
    digits=4,
)
def _(t: Tables):
    spec = {"l_quantity": ["sum", "mean"], "l_tax": ["min", "max"], "l_discount": ["count"], "l_extendedprice": ["std"]}
    return A.aggregate(t.lineitem, spec)


@query(
    "a02_group_agg",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean,
    avg(l_extendedprice) AS l_extendedprice_mean, stddev_samp(l_extendedprice) AS l_extendedprice_std,
    avg(l_discount) AS l_discount_mean, count(l_orderkey) AS l_orderkey_count
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
    floats="l_quantity_sum l_quantity_mean l_extendedprice_mean l_extendedprice_std l_discount_mean",
    digits=4,
)
def _(t: Tables):
    shipped = t.lineitem.filter("l_shipdate <= TIMESTAMP_NTZ '2000-09-02'")
    spec = {
        "l_quantity": ["sum", "mean"],
        "l_extendedprice": ["mean", "std"],
        "l_discount": ["mean"],
        "l_orderkey": ["count"],
    }
    return A.GroupBy(shipped, ["l_returnflag", "l_linestatus"]).agg(spec)


@query(
    "a02_group_first_last",
    """SELECT user_id, arg_min(value, (ts, event_id)) AS value_first, arg_max(value, (ts, event_id)) AS value_last,
    max(value) AS value_max FROM events GROUP BY 1""",
)
def _(t: Tables):
    return A.GroupBy(t.events, ["user_id"]).agg({"value": ["first", "last", "max"]}, order_by=["ts", "event_id"])


@query(
    "a02_null_keys_dropped",
    """SELECT k, sum(o_totalprice) AS o_totalprice_sum FROM (SELECT nullif(o_orderkey % 10, 0) AS k, o_totalprice FROM orders)
    WHERE k IS NOT NULL GROUP BY 1""",
    floats="o_totalprice_sum",
    digits=2,
)
def _(t: Tables):
    keyed = t.orders.withColumn("k", F.nullif(F.col("o_orderkey") % 10, F.lit(0)))
    return A.GroupBy(keyed, ["k"]).agg({"o_totalprice": "sum"})


@query("a03_group_sum", "SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1", floats="l_quantity", digits=2)
def _(t: Tables):
    return A.GroupBy(t.lineitem, ["l_suppkey"]).sum("l_quantity")


@query("a04_group_mean", "SELECT c_mktsegment, avg(c_acctbal) AS c_acctbal FROM customer GROUP BY 1", floats="c_acctbal", digits=4)
def _(t: Tables):
    return A.GroupBy(t.customer, ["c_mktsegment"]).mean("c_acctbal")


@query("a05_group_count", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(t: Tables):
    return A.GroupBy(t.events, ["event_type"]).count()


@query("a06_group_first", "SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def _(t: Tables):
    return A.GroupBy(t.orders, ["o_custkey"]).first("o_totalprice", order_by=["o_orderdate", "o_orderkey"])


@query("a07_group_last", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def _(t: Tables):
    return A.GroupBy(t.orders, ["o_custkey"]).last("o_totalprice", order_by=["o_orderdate", "o_orderkey"])


def _describe_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
        quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75,
        CAST(max({c}) AS DOUBLE) AS max FROM {table}"""
        for c in columns
    )


@query("a08_describe", _describe_sql([*PRICED, "l_linenumber"], "lineitem"), floats="mean std p25 p50 p75", digits=4)
def _(t: Tables):
    return A.describe(t.lineitem, [*PRICED, "l_linenumber"])


@query(
    "a09_null_counts",
    """SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS rows, count(*) - count(o_orderkey) AS missing FROM orders
    UNION ALL SELECT 'status', 'string', count(*), count(*) - count(nullif(o_orderstatus, 'P')) FROM orders
    UNION ALL SELECT 'price', 'double', count(*), count(*) - count(CASE WHEN o_totalprice > 1000 THEN o_totalprice END) FROM orders""",
)
def _(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"),
    )
    return A.null_counts(df)


@query(
    "a10_value_counts",
    """SELECT p_brand AS value, count(*) AS count, count(*) / (SELECT count(p_brand) FROM part)::DOUBLE AS share FROM part
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    floats="share",
)
def _(t: Tables):
    return A.value_counts(t.part, "p_brand", 10)


@query(
    "a11_top_by_sum",
    "SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    floats="total",
    digits=2,
)
def _(t: Tables):
    return A.top_by_sum(t.lineitem, "l_partkey", "l_quantity", 15)


@query(
    "a12_kpi_row",
    """WITH f AS (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
    SELECT (SELECT count(*) FROM f) AS records, (SELECT count(*) FROM f) - (SELECT count(*) FROM orders) AS records_delta,
    (SELECT sum(o_totalprice) FROM f) AS total, (SELECT sum(o_totalprice) FROM f) - (SELECT sum(o_totalprice) FROM orders) AS total_delta,
    (SELECT avg(o_totalprice) FROM f) AS average, (SELECT avg(o_totalprice) FROM f) - (SELECT avg(o_totalprice) FROM orders) AS average_delta,
    (SELECT count(DISTINCT o_orderstatus) FROM f) AS distinct_values""",
    floats="total total_delta average average_delta",
    digits=2,
)
def _(t: Tables):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return A.kpi_row(t.orders, urgent, "o_totalprice", "o_totalprice", "o_orderstatus")


@query(
    "a13_flows",
    """SELECT c_mktsegment AS source, o_orderpriority AS target, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""",
    floats="value",
    digits=2,
)
def _(t: Tables):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return A.flows(joined, "c_mktsegment", "o_orderpriority", "o_totalprice")


@query(
    "a14_hierarchy_totals",
    """SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS total,
    (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::INTEGER AS depth
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
    floats="total",
    digits=2,
)
def _(t: Tables):
    located = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return A.hierarchy_totals(located, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")


@query(
    "a15_histogram",
    """WITH e AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 30 AS w FROM customer),
    c AS (SELECT least(floor((c_acctbal - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM customer, e GROUP BY 1)
    SELECT b.bin::INTEGER AS bin, lo + b.bin * w AS low, lo + (b.bin + 1) * w AS high, coalesce(n, 0) AS count
    FROM range(30) b(bin) CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""",
    floats="low high",
    digits=4,
)
def _(t: Tables):
    return A.histogram(t.customer, "c_acctbal")


@query(
    "a16_modes",
    """(SELECT 'p_brand' AS "column", p_brand AS mode, count(*) AS count FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL
    (SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL
    (SELECT 'p_size', mode, n FROM (SELECT p_size, p_size::VARCHAR AS mode, count(*) AS n FROM part GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1))""",
)
def _(t: Tables):
    return A.modes(t.part, ["p_brand", "p_type", "p_size"])


@query(
    "a17_measures",
    """SELECT o_orderstatus, count(*) AS row_count, count(DISTINCT o_custkey) AS customers, avg(o_totalprice) AS mean_price,
    var_pop(o_totalprice) AS var_price FROM orders GROUP BY 1""",
    floats="mean_price var_price",
    digits=1,
)
def _(t: Tables):
    return A.measures(t.orders, ["o_orderstatus"], {"customers": "o_custkey"}, {"mean_price": "o_totalprice"}, {"var_price": "o_totalprice"})


@query(
    "a18_group_transform",
    """SELECT o_orderkey, avg(o_totalprice) OVER w AS o_totalprice_group_mean, stddev_samp(o_totalprice) OVER w AS o_totalprice_group_std,
    count(o_totalprice) OVER w AS o_totalprice_group_count, o_totalprice - avg(o_totalprice) OVER w AS o_totalprice_group_deviation
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
    floats="o_totalprice_group_mean o_totalprice_group_std o_totalprice_group_deviation",
    digits=3,
)
def _(t: Tables):
    made = A.group_transform(t.orders, "o_orderpriority", "o_totalprice")
    return made.select("o_orderkey", *[c for c in made.columns if "_group_" in c])


def _corr_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1 :]
    )


@query("a19_correlations", _corr_sql(PRICED, "lineitem"), floats="r")
def _(t: Tables):
    return A.correlations(t.lineitem, PRICED)


@query(
    "a19_spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
    SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, corr(a, b) AS r FROM r""",
    floats="r",
)
def _(t: Tables):
    return A.correlations(t.lineitem, ["l_quantity", "l_extendedprice"], "spearman")


def _kendall_sql(a: str, b: str) -> str:
    """All pairs of distinct cells."""
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, (SELECT sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2.0 FROM (SELECT {a} AS x, {b} AS y, count(*) AS w FROM lineitem GROUP BY ALL) AS p,
    (SELECT {a} AS x, {b} AS y, count(*) AS w FROM lineitem GROUP BY ALL) AS q) / sqrt((SELECT sum(n) * (sum(n) - 1) / 2.0 - sum(n * (n - 1)) / 2.0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY {a}))
    * (SELECT sum(n) * (sum(n) - 1) / 2.0 - sum(n * (n - 1)) / 2.0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY {b}))) AS r"""


@query("a19_kendall", " UNION ALL ".join(_kendall_sql(a, b) for a, b in [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]), floats="r", digits=9)
def _(t: Tables):
    return A.correlations(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "kendall")


@query(
    "a20_strong_pairs",
    f"""SELECT *, CASE WHEN abs(r) > 0.8 THEN 'very strong' ELSE 'strong' END AS strength FROM ({_corr_sql(PRICED, 'lineitem')}) WHERE abs(r) >= 0.7""",
    floats="r",
)
def _(t: Tables):
    return A.strong_pairs(t.lineitem, PRICED)


@query(
    "a21_target_correlations",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", corr({c}, l_extendedprice) AS r, abs(corr({c}, l_extendedprice)) > 0.9 AS leakage FROM lineitem"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
    floats="r",
)
def _(t: Tables):
    return A.target_correlations(t.lineitem, "l_extendedprice", PRICED)


@query(
    "a22_percentiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", p::DOUBLE AS p, quantile_cont({c}, p) AS value FROM {tab}, (VALUES ({p})) v(p) GROUP BY p"""
        for c, tab in (("o_totalprice", "orders"),)
        for p in (0.25, 0.5, 0.75, 0.95, 0.99)
    ).replace("quantile_cont(o_totalprice, p)", "quantile_cont(o_totalprice, [0.25,0.5,0.75,0.95,0.99])[list_position([0.25,0.5,0.75,0.95,0.99], p)]"),
    floats="value",
    digits=4,
)
def _(t: Tables):
    return A.percentiles(t.orders, ["o_totalprice"])


@query(
    "a23_shape_statistics",
    """SELECT 'value' AS "column", skewness(value) AS skewness, kurtosis(value) AS kurtosis FROM events""",
    floats="skewness kurtosis",
)
def _(t: Tables):
    return A.shape_statistics(t.events, ["value"])


@query(
    "a24_duplicate_count",
    """WITH d AS (SELECT l_suppkey, l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, sum(n - 1) * 100.0::DOUBLE / sum(n) AS duplicate_pct FROM d""",
    floats="duplicate_pct",
)
def _(t: Tables):
    return A.duplicate_count(t.lineitem.select("l_suppkey", "l_quantity", "l_returnflag"))


@query(
    "a25_year_to_date",
    """SELECT o_orderdate::DATE AS date, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS total,
    sum(sum(o_totalprice)) OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate::DATE) AS ytd FROM orders GROUP BY 1, year(o_orderdate)""",
    floats="total ytd",
    digits=2,
)
def _(t: Tables):
    return A.year_to_date(t.orders, "o_orderdate", "o_totalprice")


@query(
    "a26_linear_trend",
    """SELECT n, slope, strength, strength IS NOT NULL AND n > 10 AS tested FROM (
    SELECT count(*) AS n, regr_slope(value, x) AS slope, abs(corr(value, x)) AS strength FROM (
    SELECT value, (row_number() OVER (ORDER BY ts, event_id) - 1)::DOUBLE AS x FROM events))""",
    floats="slope strength",
    digits=8,
)
def _(t: Tables):
    trend = A.linear_trend(t.events, ["ts", "event_id"], "value")
    return trend.select("n", "slope", "strength", F.col("p_value").isNotNull().alias("tested"))


@query(
    "a27_trend_line",
    """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
    regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem""",
    floats="slope intercept r2",
    digits=4,
)
def _(t: Tables):
    return A.trend_line(t.lineitem, "l_quantity", "l_extendedprice")


@query(
    "a28_quota_usage",
    """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS used FROM events GROUP BY 1, 2),
    p AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 5 ELSE 2 END::BIGINT AS daily_limit FROM events)
    SELECT user_id, day, used, daily_limit, used < daily_limit AS allowed FROM d JOIN p USING (user_id)""",
)
def _(t: Tables):
    plans = t.events.select("user_id").distinct()
    plans = plans.withColumn("daily_limit", F.when(F.col("user_id") % 3 == 0, F.lit(5)).otherwise(F.lit(2)).cast("bigint"))
    return A.quota_usage(t.events, plans, "user_id", "ts", "daily_limit")


@query("a28_recent_signups", "SELECT count(*) AS recent FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def _(t: Tables):
    return A.recent_count(t.events.filter("event_type = 'signup'"), "ts", 7, "2024-01-30")


@query("a28_purge", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _(t: Tables):
    return A.purge_before(t.events, "ts", "2024-01-15").select("event_id", "ts")


@query(
    "a29_calendar_means",
    """SELECT 'weekday' AS unit, (isodow(o_orderdate) - 1)::INTEGER AS at, avg(o_totalprice) AS mean FROM orders GROUP BY 2
    UNION ALL SELECT 'month', month(o_orderdate)::INTEGER, avg(o_totalprice) FROM orders GROUP BY 2""",
    floats="mean",
    digits=3,
)
def _(t: Tables):
    return A.calendar_means(t.orders, "o_orderdate", "o_totalprice")


@query("a30_target_by_category", "SELECT source, avg(toxic) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY 1", floats="mean")
def _(t: Tables):
    return A.target_by_category(t.documents.join(t.labels, "doc_id"), "source", "toxic")


@query(
    "a31_rounded_stats",
    """SELECT n_regionkey, sum(c_acctbal) AS c_acctbal_sum, avg(c_acctbal) AS c_acctbal_mean, count(c_custkey) AS c_custkey_count
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    floats="c_acctbal_sum c_acctbal_mean",
    digits=2,
)
def _(t: Tables):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.rounded_stats(joined, ["n_regionkey"], {"c_acctbal": ["sum", "mean"], "c_custkey": ["count"]})


@query(
    "a32_weighted_vector_mean",
    """SELECT label, (i - 1)::INTEGER AS position, sum(embedding[i]::DOUBLE * (1 + vec_id % 5)) / sum(1 + vec_id % 5) AS mean
    FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""",
    floats="mean",
)
def _(t: Tables):
    weighted = t.embeddings.withColumn("samples", 1 + F.col("vec_id") % 5)
    return A.weighted_vector_mean(weighted, ["label"], "embedding", "samples")
