"""File round trips, catalogue listings and user functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extension as U
from ..operators import metrics as M
from ..sources import catalog, readers, uri, writers
from ..streaming.sources import scratch_folder
from .metrics import bootstrap_sql, regressed
from .registry import Tables, query


def round_trip(t: Tables, df, name: str, **options):
    path = f"{scratch_folder(t.spark, 'files')}/{name}"
    writers.write(df, path)
    return readers.read(t.spark, path, **options)


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("s02_csv_scan", ORDERS)
def _(t: Tables):
    return round_trip(t, t.orders, "orders.csv", schema=t.orders.schema)


@query("s02_csv_inferred", "SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    return round_trip(t, t.customer, "customer.csv")


@query("s03_delimiter_detection", "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t: Tables):
    path = f"{scratch_folder(t.spark, 'files')}/supplier.csv"
    writers.write(t.supplier, path, sep=";")
    return readers.read(t.spark, path)


@query("s04_tsv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    return round_trip(t, t.nation, "nation.tsv")


@query("s05_ndjson_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t: Tables):
    return round_trip(t, t.events, "events.ndjson", schema=t.events.schema).select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("s06_xml_scan", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(t: Tables):
    return round_trip(t, t.region, "region.xml", rowTag="row")


@query("s07_orc_scan", ORDERS)
def _(t: Tables):
    kind = t.orders.schema["o_orderdate"].dataType
    # ORC keeps the time as an instant
    made = round_trip(t, t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "orders.orc")
    return made.withColumn("o_orderdate", F.col("o_orderdate").cast(kind))


@query("s08_format_override", "SELECT * FROM part")
def _(t: Tables):
    path = f"{scratch_folder(t.spark, 'files')}/part.data"
    writers.write(t.part, path, format="parquet")
    return readers.read(t.spark, path, format="parquet")


@query("s09_uri_dispatch", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    return uri.read(t.spark, f"file://{t.path('nation')}")


@query("s13_catalogue_columns", """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column", (SELECT count(*) FROM orders) AS rows""")
def _(t: Tables):
    catalog.register_file(t.spark, t.path("orders"), "orders_catalogue")
    listed = catalog.columns(t.spark, "orders_catalogue").select("column")
    return listed.join(catalog.summary(t.spark, "orders_catalogue").select("column", "rows"), "column")


@query("s18_partitioned_write", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", floats="total", digits=2)
def _(t: Tables):
    path = f"{scratch_folder(t.spark, 'files')}/orders.parquet"
    writers.write(t.orders, path, partition_by=["o_orderstatus"])
    return readers.read(t.spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query(
    "s20_star_export",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total, (SELECT count(*) FROM orders) AS facts, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers FROM orders GROUP BY 1, 2""",
    floats="total",
    digits=2,
)
def _(t: Tables):
    folder = scratch_folder(t.spark, "star")
    measures = writers.export_star(t.orders, folder, {"state": ["o_orderstatus", "o_orderpriority"], "customer": ["o_custkey"]}, [], distinct={"customers": "o_custkey"})
    fact, state = (readers.read(t.spark, f"{folder}/{name}", "csv") for name in ("fact", "state"))
    totals = fact.join(state, "state_id").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return totals.join(F.broadcast(measures.withColumnRenamed("row_count", "facts")))


@query(
    "s19_export_summary",
    """SELECT 'rows' AS item, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'columns', 5 UNION ALL SELECT 'mean_c_custkey', avg(c_custkey) FROM customer
    UNION ALL SELECT 'mean_c_nationkey', avg(c_nationkey) FROM customer UNION ALL SELECT 'mean_c_acctbal', avg(c_acctbal) FROM customer""",
    floats="value",
    digits=4,
)
def _(t: Tables):
    return writers.export_with_summary(t.customer, scratch_folder(t.spark, "export"))


@query("u01_apply_columns", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, round(l_tax * 100) AS l_tax FROM lineitem")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return U.apply_columns(U.apply_columns(df, lambda c: c * 2, ["l_quantity"]), lambda s: (s * 100).round(), ["l_tax"], "double")


@query("u02_apply_rows", "SELECT o_orderkey, o_totalprice / 2 AS half, upper(o_orderstatus) AS status FROM orders", floats="half", digits=4)
def _(t: Tables):
    def halve(frame):
        return frame.assign(half=frame["o_totalprice"] / 2, status=frame["o_orderstatus"].str.upper())[["o_orderkey", "half", "status"]]

    return U.apply_rows(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), halve, "o_orderkey bigint, half double, status string")


@query("u03_chain", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t: Tables):
    return U.chain(t.orders, [lambda d: d.filter("o_totalprice > 100000"), lambda d: d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))])


KEYED = """(SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key, l_extendedprice AS y, l_extendedprice * (0.9 + l_discount) + l_quantity * (l_partkey % 7 - 3) * 100 AS p FROM lineitem)"""


@query("u05_custom_metric", bootstrap_sql(KEYED, "key", "(abs(y - p) < 5000)::INTEGER::DOUBLE", 50), floats="mean lower upper")
def _(t: Tables):
    rows = regressed(t)
    within = (F.abs(F.col("y") - F.col("p")) < 5000).cast("double")
    made = M.bootstrap_metric(rows, {"within": within}, lambda s: s["within"] / s["weight"], "key", 50)
    return M.bootstrap_interval(made, "value")


@query("u07_sql_function", "SELECT c_custkey, length(c_name) * 2 AS doubled FROM customer")
def _(t: Tables):
    U.register_function(t.spark, "double_length", lambda s: s.str.len() * 2, "bigint")
    t.views("customer")
    return catalog.run_sql(t.spark, "SELECT c_custkey, double_length(c_name) AS doubled FROM customer")
