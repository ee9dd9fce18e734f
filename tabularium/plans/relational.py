"""Scans, projection, filtering, surgery, joins and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import catalog, readers
from .registry import Tables, query


@query("s01_parquet_scan", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables):
    return readers.read(t.spark, t.path("region"))


@query("s14_register_file", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def _(t: Tables):
    catalog.register_file(t.spark, t.path("nation"), "nation_file")
    return catalog.run_sql(t.spark, "SELECT n_regionkey, count(*) AS nations FROM nation_file GROUP BY 1")


@query(
    "s15_multi_file_merge",
    """SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name FROM nation
    UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region""",
)
def _(t: Tables):
    return readers.read_many(t.spark, [t.path("nation"), t.path("region")])


@query("s17_schema_preview")
def _(t: Tables):
    return readers.file_info(t.spark, t.path("orders"))


@query(
    "s20_star_measures",
    """SELECT year(l_shipdate)::INTEGER AS year, count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_orders,
    avg(l_extendedprice) AS avg_price, var_pop(l_discount) AS var_discount, sum(l_quantity) AS total_quantity
    FROM lineitem GROUP BY 1""",
    floats="avg_price var_discount total_quantity",
    digits=4,
)
def _(t: Tables):
    from ..operators import aggregate as A

    fact = t.lineitem.withColumn("year", F.year("l_shipdate"))
    return A.measures(
        fact,
        ["year"],
        distinct={"distinct_orders": "l_orderkey"},
        averages={"avg_price": "l_extendedprice"},
        variances={"var_discount": "l_discount"},
        totals={"total_quantity": "l_quantity"},
    )


@query("p01_select", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t: Tables):
    return R.select(t.lineitem, ["l_orderkey", "l_quantity"])


@query(
    "p02_filter_text",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1998-01-01'",
)
def _(t: Tables):
    kept = R.where(t.lineitem, "l_quantity > 45 AND l_shipdate >= TIMESTAMP_NTZ '1998-01-01'")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("p03_filter_callable", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def _(t: Tables):
    kept = R.where_rows(t.orders, lambda price, status: (price > 300000) & (status == "O"), ["o_totalprice", "o_orderstatus"])
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "p04_facet_filter",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def _(t: Tables):
    kept = R.facet_filter(t.orders, {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return kept.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "p04_facet_values",
    """SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders""",
)
def _(t: Tables):
    return R.facet_values(t.orders)


@query("p05_rename", "SELECT n_nationkey AS nation_id, n_name AS nation, n_regionkey FROM nation")
def _(t: Tables):
    return R.rename(t.nation, {"n_nationkey": "nation_id", "n_name": "nation"})


@query("p06_drop", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(t: Tables):
    return R.drop(t.supplier, ["s_name", "s_acctbal"])


@query(
    "p07_astype",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, TRY_CAST(regexp_extract(p_brand, '[0-9]+|[a-z]+$') AS DOUBLE) AS brand_no,
    TRY_CAST(p_name AS DOUBLE) AS p_name FROM part""",
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_size", F.regexp_extract("p_brand", "[0-9]+|[a-z]+$", 0).alias("brand_no"), "p_name")
    return R.astype(R.astype(df, {"p_size": "int"}), {"brand_no": "float", "p_name": "float"}, coerce=True)


@query("p08_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(t: Tables):
    return R.head(t.orders.select("o_orderkey", "o_totalprice"), 25, ["o_orderkey"])


@query("p09_tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def _(t: Tables):
    return R.tail(t.orders.select("o_orderkey", "o_totalprice"), 25, ["o_orderkey"])


@query(
    "p10_sample_n",
    """SELECT c_custkey, c_acctbal FROM customer ORDER BY md5('42|' || CAST(c_custkey AS VARCHAR)) LIMIT 100""",
)
def _(t: Tables):
    return R.sample_n(t.customer.select("c_custkey", "c_acctbal"), 100, ["c_custkey"])


@query(
    "p10_sample_fraction",
    "SELECT c_custkey, c_acctbal FROM customer WHERE ('0x' || substr(md5('42|' || c_custkey), 1, 12))::BIGINT / 281474976710656.0 < 0.1",
)
def _(t: Tables):
    return R.sample_fraction(t.customer, 0.1, key=["c_custkey"]).select("c_custkey", "c_acctbal")


@query(
    "p11_dropna_any",
    """SELECT o_orderkey, a, b FROM (SELECT o_orderkey, nullif(o_orderkey % 10, 0) AS a, nullif(o_orderkey % 4, 0) AS b FROM orders)
    WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(t: Tables):
    return R.dropna(with_gaps(t), ["a", "b"], "any")


@query(
    "p11_dropna_all",
    """SELECT o_orderkey, a, b FROM (SELECT o_orderkey, nullif(o_orderkey % 10, 0) AS a, nullif(o_orderkey % 4, 0) AS b FROM orders)
    WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def _(t: Tables):
    return R.dropna(with_gaps(t), ["a", "b"], "all")


def with_gaps(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.nullif(key % 10, F.lit(0)).alias("a"), F.nullif(key % 4, F.lit(0)).alias("b"))


@query(
    "p12_drop_empty",
    """SELECT a, b FROM (SELECT nullif(o_orderkey % 10, 0) AS a, nullif(o_orderkey % 4, 0) AS b FROM orders)
    WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def _(t: Tables):
    return R.drop_empty(with_gaps(t).drop("o_orderkey").withColumn("nothing", F.lit(None).cast("double")))


@query(
    "p13_fillna",
    """SELECT o_orderkey, coalesce(nullif(o_orderkey % 10, 0), -1) AS a, coalesce(nullif(o_orderkey % 4, 0), -1) AS b FROM orders""",
)
def _(t: Tables):
    return R.fillna(with_gaps(t), -1, ["a", "b"])


@query(
    "p14_fill_forward",
    """SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""",
)
def _(t: Tables):
    return R.fill_direction(gappy_events(t), ["v"], ["ts", "event_id"], ["user_id"]).drop("ts")


@query(
    "p14_fill_backward",
    """SELECT event_id, user_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
    FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""",
)
def _(t: Tables):
    return R.fill_direction(gappy_events(t), ["v"], ["ts", "event_id"], ["user_id"], "backward").drop("ts")


def gappy_events(t: Tables):
    gap = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return t.events.select("event_id", "user_id", "ts", gap.alias("v"))


@query("p15_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal, c_custkey")
def _(t: Tables):
    return R.sort(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment", "c_acctbal", "c_custkey"], [True, False, False])


@query("p16_unique", "SELECT DISTINCT p_type FROM part")
def _(t: Tables):
    return R.unique(t.part, "p_type")


@query("p17_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def _(t: Tables):
    return R.drop_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_discount", "l_tax"))


@query(
    "p18_dedupe_by_key",
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def _(t: Tables):
    kept = R.drop_duplicates_by(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id", "value")


@query("p19_nlargest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t: Tables):
    return R.nlargest(t.orders.select("o_orderkey", "o_totalprice"), 20, "o_totalprice", ["o_orderkey"])


@query(
    "p20_narrow_types",
    "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem",
)
def _(t: Tables):
    narrow = R.narrow_types(t.lineitem.select("l_linenumber", "l_orderkey"))
    return narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"), F.sum("l_orderkey").alias("keys"))


@query(
    "p21_flatten",
    """SELECT event_id, user_id AS actor_id, event_type AS actor_last_action, CAST(props->>'k' AS BIGINT) AS props_k FROM events""",
)
def _(t: Tables):
    nested = t.events.select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("action")).alias("last")).alias("actor"),
        F.from_json("props", "k bigint").alias("props"),
    )
    return R.flatten(nested)


@query("p21_unflatten", "SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS region_key FROM nation")
def _(t: Tables):
    flat = R.rename(t.nation, {"n_nationkey": "nation_key", "n_name": "nation_name", "n_regionkey": "region_key"})
    return R.flatten(R.unflatten(flat))


@query(
    "p22_safe_divide",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN -1.0 ELSE l_tax / l_discount END AS ratio FROM lineitem""",
    floats="ratio",
)
def _(t: Tables):
    return R.with_safe_division(t.lineitem, "ratio", "l_tax", "l_discount", -1.0).select("l_orderkey", "l_linenumber", "ratio")


@query(
    "j01_inner_join",
    """SELECT o_orderpriority, count(*) AS lines, sum(l_quantity) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t: Tables):
    joined = R.merge(t.lineitem, t.orders, left_on=["l_orderkey"], right_on=["o_orderkey"])
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query(
    "j01_suffixes",
    """SELECT a.n_regionkey, a.n_nationkey AS n_nationkey_x, b.n_nationkey AS n_nationkey_y FROM nation a
    JOIN (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1) b ON a.n_regionkey = b.n_regionkey""",
)
def _(t: Tables):
    first = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    return R.merge(t.nation.select("n_regionkey", "n_nationkey"), first, on=["n_regionkey"])


@query(
    "j01_null_keys_match",
    """SELECT a.k, a.n AS left_n, b.n AS right_n FROM
    (SELECT nullif(o_orderkey % 10, 0) AS k, count(*) AS n FROM orders GROUP BY 1) a JOIN
    (SELECT nullif(c_custkey % 10, 0) AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""",
)
def _(t: Tables):
    left = t.orders.groupBy(F.nullif(F.col("o_orderkey") % 10, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("left_n"))
    right = t.customer.groupBy(F.nullif(F.col("c_custkey") % 10, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("right_n"))
    return R.merge(left, right, on=["k"], null_safe=True)


@query(
    "j02_left_join",
    """SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey""",
)
def _(t: Tables):
    pending = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return R.merge(t.customer.select("c_custkey", "c_name"), pending, how="left", left_on=["c_custkey"], right_on=["o_custkey"]).drop("o_custkey")


@query(
    "j02_right_join",
    """SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey""",
)
def _(t: Tables):
    big = t.orders.filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return R.merge(big, t.customer.select("c_custkey"), how="right", left_on=["o_custkey"], right_on=["c_custkey"]).select("o_orderkey", "c_custkey")


@query(
    "j02_full_join",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM
    (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN
    (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k""",
)
def _(t: Tables):
    left = t.customer.filter("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    right = t.supplier.filter("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return R.merge(left, right, on=["k"], how="outer")


@query(
    "j03_semi_join",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
def _(t: Tables):
    big = t.orders.filter("o_totalprice > 400000")
    return R.merge(t.customer.select("c_custkey"), big, how="semi", left_on=["c_custkey"], right_on=["o_custkey"])


@query(
    "j03_anti_join",
    "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)",
)
def _(t: Tables):
    bulk = t.lineitem.filter("l_quantity >= 49")
    return R.merge(t.part.select("p_partkey"), bulk, how="anti", left_on=["p_partkey"], right_on=["l_partkey"])


@query("j04_cross_join", "SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def _(t: Tables):
    return R.merge(t.supplier.select("s_suppkey"), t.region.select("r_name"), how="cross")


@query(
    "j05_lookup_map",
    """SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey""",
)
def _(t: Tables):
    names = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.lookup_map(t.customer, names, "c_nationkey", "n_name", "nation", "unknown").select("c_custkey", "nation")


@query(
    "j06_concat_rows",
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier""",
)
def _(t: Tables):
    a = t.customer.select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return R.concat([a, b])


@query(
    "j07_concat_columns",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents) a
    FULL JOIN (SELECT doc_id, quality FROM labels) b ON a.doc_id = b.doc_id""",
)
def _(t: Tables):
    return R.concat_columns([t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality")], ["doc_id"])


@query(
    "j08_small_groups",
    """SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) < 12 AS in_small_group FROM customer""",
)
def _(t: Tables):
    return R.in_small_groups(t.customer, ["c_nationkey", "c_mktsegment"], 12).select("c_custkey", "in_small_group")
