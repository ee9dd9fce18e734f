"""Cleaning, feature, encoding and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import encoders as E
from ..operators import features as X
from ..operators import selection as L
from .quality import GAPS, gaps
from .registry import Tables, query

MEDIAN_PRICE = f"(SELECT quantile_cont(price, 0.5) FROM {GAPS})"
MODE_STATUS = f"(SELECT status FROM {GAPS} WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    "c01_fill_missing",
    f"""SELECT o_orderkey, coalesce(status, {MODE_STATUS}) AS status, coalesce(price, {MEDIAN_PRICE}) AS price, priority, ordered, constant, customer FROM {GAPS}""",
    floats="price",
    digits=4,
)
def _(t: Tables):
    mostly_null = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1))
    return C.fill_missing(gaps(t).withColumn("sparse", mostly_null))


@query(
    "c02_cap_outliers",
    """SELECT event_id, greatest(least(value, hi), lo) AS value FROM events, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM
    (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events))""",
    floats="value",
)
def _(t: Tables):
    return C.cap_outliers(t.events.select("event_id", "value"), ["value"])


@query(
    "c03_normalised",
    """SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS o_totalprice_normalized FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""",
    floats="o_totalprice_normalized",
)
def _(t: Tables):
    df = t.orders.withColumn("constant", F.lit(3))
    return C.add_normalised(df, ["o_totalprice", "constant"]).select("o_orderkey", "o_totalprice_normalized")


@query(
    "c04_standardised",
    """SELECT o_orderkey, (o_totalprice - m) / s AS o_totalprice_standardized FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)""",
    floats="o_totalprice_standardized",
)
def _(t: Tables):
    return C.add_standardised(t.orders, ["o_totalprice"]).select("o_orderkey", "o_totalprice_standardized")


@query(
    "c05_encode_small",
    """SELECT p_partkey, (list_position(v, p_type) - 1)::INTEGER AS p_type_encoded FROM part, (SELECT list_sort(list(DISTINCT p_type)) AS v FROM part)""",
)
def _(t: Tables):
    return C.encode_small(t.part, ["p_type", "p_brand"]).select("p_partkey", "p_type_encoded")


@query(
    "c06_cleaning_plan",
    f"""WITH m AS (SELECT o_orderkey, coalesce(status, {MODE_STATUS}) AS status, coalesce(price, {MEDIAN_PRICE}) AS price FROM {GAPS}),
    d AS (SELECT DISTINCT * FROM m), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM d),
    c AS (SELECT o_orderkey, status, greatest(least(price, b + 1.5 * (b - a)), a - 1.5 * (b - a)) AS price FROM d, q)
    SELECT o_orderkey, status, price, (price - lo) / (hi - lo) AS price_normalized FROM c, (SELECT min(price) AS lo, max(price) AS hi FROM c)""",
    floats="price price_normalized",
    digits=4,
)
def _(t: Tables):
    plan = ["missing", "duplicates", ("outliers", {"columns": ["price"]}), ("normalize", {"columns": ["price"]})]
    return C.clean(gaps(t).select("o_orderkey", "status", "price"), plan)[0]


@query(
    "c07_coerce_numeric",
    """SELECT n_nationkey, coalesce(TRY_CAST(regexp_replace('EUR ' || n_nationkey || '.50', '[^0-9.\\-]', '', 'g') AS DOUBLE), 0) AS amount,
    dense_rank() OVER (ORDER BY r_name) - 1 AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(t: Tables):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    df = joined.select("n_nationkey", F.concat(F.lit("EUR "), F.col("n_nationkey").cast("string"), F.lit(".50")).alias("amount"), "r_name")
    return C.coerce_numeric(df)


@query(
    "c08_fill_all",
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS price FROM orders),
    m AS (SELECT quantile_cont(price, 0.5) AS med FROM b WHERE price < 'Infinity'::DOUBLE)
    SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN price = 'Infinity'::DOUBLE THEN 0 ELSE coalesce(price, med) END AS price FROM b, m""",
    floats="price",
    digits=3,
)
def _(t: Tables):
    price = F.when(F.col("o_custkey") % 5 == 0, F.lit(None)).when(F.col("o_custkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return C.fill_all(t.orders.select("o_orderkey", price.alias("price")))


@query(
    "c09_prepare_target",
    f"""SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce(status, {MODE_STATUS})) - 1 AS status FROM {GAPS}""",
)
def _(t: Tables):
    return C.prepare_target(gaps(t).select("o_orderkey", "status"), "STAT")


@query(
    "c10_fill_mean",
    f"""SELECT o_orderkey, coalesce(status, {MODE_STATUS}) AS status, coalesce(price, (SELECT avg(price) FROM {GAPS})) AS price FROM {GAPS}""",
    floats="price",
    digits=3,
)
def _(t: Tables):
    return C.fill_missing(gaps(t).select("o_orderkey", "status", "price"), centre="mean")


SPARSE = """(SELECT o_orderkey, o_orderpriority AS priority, o_orderstatus AS status, CASE WHEN o_custkey % 3 <> 0 AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
    THEN o_totalprice END AS price FROM orders)"""


def sparse(t: Tables):
    kept = (F.col("o_custkey") % 3 != 0) & ~((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"))
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(kept, F.col("o_totalprice")).alias("price")
    )


@query(
    "c11_impute_hierarchy",
    f"""SELECT o_orderkey, coalesce(price, avg(price) OVER (PARTITION BY priority, status), avg(price) OVER (PARTITION BY priority), avg(price) OVER ()) AS price FROM {SPARSE}""",
    floats="price",
    digits=3,
)
def _(t: Tables):
    return C.impute_by_hierarchy(sparse(t), "price", ["priority", "status"]).select("o_orderkey", "price")


@query(
    "c12_impute_group_median",
    f"""WITH g AS (SELECT priority, quantile_cont(price, 0.5) AS m FROM {SPARSE} GROUP BY 1)
    SELECT o_orderkey, coalesce(price, m, (SELECT quantile_cont(price, 0.5) FROM {SPARSE})) AS price FROM {SPARSE} JOIN g USING (priority)""",
    floats="price",
    digits=3,
)
def _(t: Tables):
    return C.impute_by_group_median(sparse(t), "price", "priority").select("o_orderkey", "price")


@query(
    "c14_batch_job",
    """WITH d AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS price FROM orders
      UNION ALL SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT DISTINCT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)) AS price, year(o_orderdate)::INTEGER AS o_orderdate_year,
    month(o_orderdate)::INTEGER AS o_orderdate_month, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_dayofweek FROM d""",
    floats="price",
    digits=3,
)
def _(t: Tables):
    from ..operators.batch import prepare_batch

    df = gaps(t).select("o_orderkey", F.col("ordered").alias("o_orderdate"), "price")
    return prepare_batch(df).select("o_orderkey", "price", "o_orderdate_year", "o_orderdate_month", "o_orderdate_dayofweek")


@query(
    "f01_numeric_transforms",
    """SELECT l_orderkey, l_linenumber, ln(l_quantity) AS l_quantity_log, 1 / l_quantity AS l_quantity_reciprocal, ln(1 + l_quantity) AS l_quantity_log1p,
    sqrt(l_quantity) AS l_quantity_sqrt, ln(1 + l_discount) AS l_discount_log1p, sqrt(l_discount) AS l_discount_sqrt FROM lineitem""",
    floats="l_quantity_log l_quantity_reciprocal l_quantity_log1p l_quantity_sqrt l_discount_log1p l_discount_sqrt",
)
def _(t: Tables):
    made = X.numeric_transforms(t.lineitem, ["l_quantity", "l_discount"])
    return made.select("l_orderkey", "l_linenumber", *made.columns[len(t.lineitem.columns) :])


@query(
    "f02_math_features",
    """SELECT p_partkey, ln(1 + p_size) AS p_size_log, sqrt(p_size) AS p_size_sqrt, p_size::DOUBLE * p_size AS p_size_squared,
    ln(1 + p_retailprice) AS p_retailprice_log, sqrt(p_retailprice) AS p_retailprice_sqrt, p_retailprice * p_retailprice AS p_retailprice_squared FROM part""",
    floats="p_size_log p_size_sqrt p_size_squared p_retailprice_log p_retailprice_sqrt p_retailprice_squared",
    digits=4,
)
def _(t: Tables):
    made = X.math_features(t.part, ["p_size", "p_retailprice"])
    return made.select("p_partkey", *made.columns[len(t.part.columns) :])


EDGES5 = "SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM"


@query(
    "f03_quantile_bins",
    f"""SELECT o_orderkey, greatest(len(list_filter(e, lambda x: x < o_totalprice)) - 1, 0)::INTEGER AS o_totalprice_bin FROM orders, ({EDGES5} (SELECT o_totalprice AS v FROM orders))""",
)
def _(t: Tables):
    return X.quantile_bins(t.orders, "o_totalprice").select("o_orderkey", "o_totalprice_bin")


@query(
    "f03_quantile_bins_ties",
    f"""SELECT l_orderkey, l_linenumber, greatest(len(list_filter(e, lambda x: x < l_discount)) - 1, 0)::INTEGER AS l_discount_bin
    FROM lineitem, ({EDGES5} (SELECT l_discount AS v FROM lineitem))""",
)
def _(t: Tables):
    return X.quantile_bins(t.lineitem, "l_discount").select("l_orderkey", "l_linenumber", "l_discount_bin")


@query(
    "f04_width_bins",
    """SELECT p_partkey, greatest(ceil((p_retailprice - lo) / ((hi - lo) / 5)) - 1, 0)::INTEGER AS p_retailprice_cut FROM part,
    (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
)
def _(t: Tables):
    return X.width_bins(t.part, "p_retailprice").select("p_partkey", "p_retailprice_cut")


@query(
    "f05_row_statistics",
    """SELECT l_orderkey, l_linenumber, list_sum(v) AS row_sum, list_avg(v) AS row_mean, list_stddev_samp(v) AS row_std, list_min(v) AS row_min,
    list_max(v) AS row_max, list_max(v) - list_min(v) AS row_range FROM (SELECT l_orderkey, l_linenumber, [l_quantity, l_discount, l_tax, NULL] AS v FROM lineitem)""",
    floats="row_sum row_mean row_std row_range",
    digits=5,
)
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.lit(None).cast("double").alias("gap"))
    made = X.row_statistics(df, ["l_quantity", "l_discount", "l_tax", "gap"])
    return made.drop("l_quantity", "l_discount", "l_tax", "gap")


@query(
    "f06_date_parts",
    """SELECT event_id, year(ts)::INTEGER AS ts_year, month(ts)::INTEGER AS ts_month, day(ts)::INTEGER AS ts_day, (isodow(ts) - 1)::INTEGER AS ts_dayofweek,
    hour(ts)::INTEGER AS ts_hour, minute(ts)::INTEGER AS ts_minute, quarter(ts)::INTEGER AS ts_quarter, dayofyear(ts)::INTEGER AS ts_dayofyear,
    weekofyear(ts)::INTEGER AS ts_weekofyear, (isodow(ts) >= 6)::INTEGER AS ts_is_weekend, (day(ts) = 1)::INTEGER AS ts_is_month_start,
    (ts::DATE = last_day(ts))::INTEGER AS ts_is_month_end FROM events""",
)
def _(t: Tables):
    return X.date_parts(t.events.select("event_id", "ts"), "ts").drop("ts")


@query(
    "f07_cyclic",
    """SELECT event_id, sin(2 * pi() * month(ts) / 12) AS ts_month_sin, cos(2 * pi() * month(ts) / 12) AS ts_month_cos, sin(2 * pi() * hour(ts) / 24) AS ts_hour_sin,
    cos(2 * pi() * hour(ts) / 24) AS ts_hour_cos, sin(2 * pi() * day(ts) / 31) AS ts_day_sin, cos(2 * pi() * day(ts) / 31) AS ts_day_cos FROM events""",
    floats="ts_month_sin ts_month_cos ts_hour_sin ts_hour_cos ts_day_sin ts_day_cos",
)
def _(t: Tables):
    made = X.date_parts(t.events.select("event_id", "ts"), "ts", cyclic=True)
    return made.select("event_id", *[c for c in made.columns if c.endswith(("_sin", "_cos"))])


@query(
    "f08_parse_dates",
    """SELECT o_orderkey, date_trunc('day', o_orderdate) AS day_text, o_orderpriority FROM orders""",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), "o_orderpriority")
    return X.parse_dates(df)


@query("f09_days_since", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INTEGER AS days_since_o_orderdate FROM orders")
def _(t: Tables):
    return X.days_since(t.orders, "o_orderdate", "2002-01-01").select("o_orderkey", "days_since_o_orderdate")


@query(
    "f10_text_features",
    """SELECT doc_id, length(text)::INTEGER AS text_length, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r\\v]+'), lambda w: w <> ''))::INTEGER AS text_word_count,
    regexp_matches(text, '[0-9]')::INTEGER AS text_has_digit FROM documents""",
)
def _(t: Tables):
    return X.text_features(t.documents.select("doc_id", "text"), "text").drop("text")


@query(
    "f11_interactions",
    """SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS l_quantity_x_l_discount, l_quantity + l_discount AS l_quantity_plus_l_discount,
    l_quantity - l_discount AS l_quantity_minus_l_discount, l_quantity / nullif(l_discount, 0) AS l_quantity_div_l_discount FROM lineitem""",
    floats="l_quantity_x_l_discount l_quantity_plus_l_discount l_quantity_minus_l_discount l_quantity_div_l_discount",
)
def _(t: Tables):
    made = X.interactions(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return made.drop("l_quantity", "l_discount")


@query(
    "f12_ratios",
    "SELECT l_orderkey, l_linenumber, coalesce(l_tax / nullif(l_discount, 0), 0) AS l_tax_ratio_l_discount FROM lineitem",
    floats="l_tax_ratio_l_discount",
)
def _(t: Tables):
    return X.ratios(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), ["l_tax", "l_discount"]).drop("l_tax", "l_discount")


@query(
    "f13_polynomial",
    """SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS l_quantity_pow2, l_tax * l_tax AS l_tax_pow2, l_quantity * l_tax AS l_quantity_x_l_tax FROM lineitem""",
    floats="l_tax_pow2 l_quantity_x_l_tax",
)
def _(t: Tables):
    return X.polynomial(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax")


@query(
    "f14_one_hot",
    """SELECT o_orderkey, coalesce(s = 'F', false)::INTEGER AS s_F, coalesce(s = 'O', false)::INTEGER AS s_O, (s IS NULL)::INTEGER AS s_nan
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)""",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return E.one_hot(df, "s").drop("s")


@query(
    "f14_one_hot_drop_first",
    """SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS "o_orderstatus_O", (o_orderstatus = 'P')::INTEGER AS "o_orderstatus_P" FROM orders""",
)
def _(t: Tables):
    return E.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", null_indicator=False, drop_first=True).drop("o_orderstatus")


@query(
    "f15_label_codes",
    """SELECT p_partkey, coalesce(code, -1) AS b_code FROM (SELECT p_partkey, nullif(p_brand, 'Brand#3') AS b FROM part) LEFT JOIN
    (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT nullif(p_brand, 'Brand#3') AS b FROM part) WHERE b IS NOT NULL) USING (b)""",
)
def _(t: Tables):
    df = t.part.select("p_partkey", F.nullif("p_brand", F.lit("Brand#3")).alias("b"))
    return E.LabelEncoder("b").fit(df).transform(df).drop("b")


@query("f15_label_inverse", "SELECT p_partkey, p_type AS restored FROM part")
def _(t: Tables):
    encoder = E.LabelEncoder("p_type").fit(t.part)
    return encoder.inverse(encoder.transform(t.part), "p_type_code", "restored").select("p_partkey", "restored")


@query(
    "f16_frequency",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) / (SELECT count(*) FROM part)::DOUBLE AS p_brand_freq FROM part",
    floats="p_brand_freq",
)
def _(t: Tables):
    return E.frequency_encode(t.part, "p_brand").select("p_partkey", "p_brand_freq")


@query("f16_count_encoding", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS p_brand_count FROM part")
def _(t: Tables):
    return E.count_encode(t.part, "p_brand").select("p_partkey", "p_brand_count")


@query(
    "f17_target_encoding",
    """SELECT o_orderkey, (sum(o_totalprice) OVER w + (SELECT avg(o_totalprice) FROM orders)) / (count(*) OVER w + 1) AS o_custkey_target FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
    floats="o_custkey_target",
    digits=3,
)
def _(t: Tables):
    return E.TargetEncoder("o_custkey", "o_totalprice").fit(t.orders).transform(t.orders).select("o_orderkey", "o_custkey_target")


@query(
    "f18_m_estimate",
    """SELECT doc_id, (sum(quality) OVER w + 10 * (SELECT avg(quality) FROM labels)) / (count(*) OVER w + 10) AS source_m_estimate
    FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source)""",
    floats="source_m_estimate",
)
def _(t: Tables):
    return E.m_estimate_encode(t.documents.join(t.labels, "doc_id"), "source", "quality").select("doc_id", "source_m_estimate")


@query(
    "f19_group_rate",
    """SELECT d.doc_id, coalesce(r, -1) AS group_rate FROM documents d LEFT JOIN (SELECT source, avg(quality) AS r FROM documents JOIN labels USING (doc_id)
    GROUP BY 1 HAVING count(*) > 1) g USING (source)""",
    floats="group_rate",
)
def _(t: Tables):
    return E.group_rate(t.documents.join(t.labels, "doc_id"), t.documents, "source", "quality").select("doc_id", "group_rate")


@query(
    "f20_leave_one_out",
    """SELECT doc_id, CASE WHEN count(*) OVER w > 1 THEN (sum(quality) OVER w - quality) / (count(*) OVER w - 1) ELSE (SELECT avg(quality) FROM labels) END AS loo_rate
    FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source)""",
    floats="loo_rate",
)
def _(t: Tables):
    return E.leave_one_out(t.documents.join(t.labels, "doc_id"), None, "source", "quality").select("doc_id", "loo_rate")


@query(
    "f20_leave_one_out_test",
    """SELECT d.doc_id, coalesce(r, (SELECT avg(quality) FROM labels)) AS loo_rate FROM documents d LEFT JOIN
    (SELECT source, avg(quality) AS r FROM documents JOIN labels USING (doc_id) GROUP BY 1) g USING (source)""",
    floats="loo_rate",
)
def _(t: Tables):
    return E.leave_one_out(t.documents.join(t.labels, "doc_id"), t.documents, "source", "quality").select("doc_id", "loo_rate")


@query(
    "f21_cross_codes",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus || '_' || o_orderpriority) - 1 AS cross_code FROM orders""",
)
def _(t: Tables):
    chosen = E.cross_candidates(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return E.cross_codes(t.orders, chosen).select("o_orderkey", "cross_code")


@query(
    "f22_standard_scaler",
    """SELECT l_orderkey, l_linenumber, (l_quantity - m) / s AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""",
    floats="l_quantity",
)
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return E.Scaler(["l_quantity"]).fit(df).transform(df)


@query(
    "f22_minmax_scaler",
    """SELECT l_orderkey, l_linenumber, (l_tax - a) / (z - a) AS l_tax FROM lineitem, (SELECT min(l_tax) AS a, max(l_tax) AS z FROM lineitem)""",
    floats="l_tax",
)
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_tax")
    return E.Scaler(["l_tax"], "minmax").fit(df).transform(df)


@query(
    "f22_robust_scaler",
    """SELECT o_orderkey, (o_totalprice - m) / (b - a) AS o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS a,
    quantile_cont(o_totalprice, 0.75) AS b FROM orders)""",
    floats="o_totalprice",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return E.Scaler(["o_totalprice"], "robust").fit(df).transform(df)


@query("f22_scaler_inverse", "SELECT o_orderkey, o_totalprice FROM orders", floats="o_totalprice", digits=4)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_totalprice")
    scaler = E.Scaler(["o_totalprice"], "minmax", (-1.0, 1.0)).fit(df)
    return scaler.inverse(scaler.transform(df))


@query(
    "f25_top_variance",
    "SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem",
)
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return X.top_variance(df, keep=["l_orderkey"], limit=2)


@query(
    "f26_auto_features",
    """SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, ln(1 + c_nationkey) AS c_nationkey_log1p, sqrt(c_nationkey) AS c_nationkey_sqrt,
    count(*) OVER (PARTITION BY c_mktsegment) / (SELECT count(*) FROM customer)::DOUBLE AS c_mktsegment_freq,
    c_acctbal * c_nationkey AS c_acctbal_x_c_nationkey, c_acctbal * c_acctbal AS c_acctbal_pow2, c_nationkey::DOUBLE * c_nationkey AS c_nationkey_pow2 FROM customer""",
    floats="c_nationkey_log1p c_nationkey_sqrt c_mktsegment_freq c_acctbal_x_c_nationkey c_acctbal_pow2",
    digits=3,
)
def _(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return X.auto_generate(df, target="c_custkey")


@query(
    "f27_entity_features",
    """SELECT p_partkey, nullif(regexp_extract(p_name, '^([a-z]+) ', 1), '') AS title, (1 + p_size % 3)::INTEGER AS group_size, (p_size % 3 = 0)::INTEGER AS is_alone,
    length(p_name)::INTEGER AS name_length, p_type[1:1] AS code_letter, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END::INTEGER AS p_type_mapped FROM part""",
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_name", "p_type", (F.col("p_size") % 3).alias("others"))
    made = X.entity_features(df, "p_name", "^([a-z]+) ", ["others"], "p_type", {"p_type": {"ECONOMY": 1, "SMALL": 2}})
    return made.drop("p_name", "p_type", "others")


@query(
    "f29_derived_columns",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, (l_discount > 0.05)::INTEGER AS is_discounted,
    l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""",
    floats="unit_price net charge",
    digits=8,
)
def _(t: Tables):
    rules = [
        ("unit_price", "l_extendedprice / l_quantity"),
        ("is_discounted", "int(l_discount > 0.05D)"),
        ("net", "l_extendedprice * (1 - l_discount)"),
        ("charge", "net * (1 + l_tax)"),
    ]
    return X.derive(t.lineitem, rules).select("l_orderkey", "l_linenumber", "unit_price", "is_discounted", "net", "charge")


@query("f30_log_target", "SELECT o_orderkey, ln(o_totalprice) AS log_target, o_totalprice AS back FROM orders", floats="log_target back", digits=4)
def _(t: Tables):
    logged = X.log_target(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return X.back_transform(logged.withColumn("back", F.col("log_target")), "back").drop("o_totalprice")


def _scores_sql(columns: list[str], body) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {body(c)}""" for c in columns)


@query(
    "l01_variance",
    _scores_sql(["l_quantity", "l_discount", "l_tax"], lambda c: f"var_pop({c}) AS variance, var_pop({c}) > 0.01 AS kept FROM lineitem"),
    floats="variance",
)
def _(t: Tables):
    return L.variance_table(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@query("l02_drop_correlated", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def _(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"))
    return L.drop_correlated(df, ["l_quantity", "l_tax", "twice"])


@query(
    "l03_chi2",
    _scores_sql(
        ["l_quantity", "l_tax"],
        lambda c: f"""sum((s - e) * (s - e) / e) AS score FROM (SELECT sum({c}) AS s, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE * (SELECT sum({c}) FROM lineitem) AS e
        FROM lineitem GROUP BY l_returnflag)""",
    ),
    floats="score",
)
def _(t: Tables):
    return L.chi2_scores(t.lineitem, ["l_quantity", "l_tax"], "l_returnflag")


@query(
    "l04_anova",
    _scores_sql(
        ["l_quantity", "l_tax", "l_discount"],
        lambda c: f"""(SELECT sum(n * (m - g) * (m - g)) / (count(*) - 1) FROM (SELECT count(*) AS n, avg({c}) AS m, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag))
        / (SELECT sum(({c} - m) * ({c} - m)) / (count(*) - count(DISTINCT l_returnflag)) FROM (SELECT {c}, l_returnflag, avg({c}) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)) AS score""",
    ),
    floats="score",
)
def _(t: Tables):
    return L.anova_scores(t.lineitem, ["l_quantity", "l_tax", "l_discount"], "l_returnflag")


@query(
    "l04_regression_f",
    _scores_sql(["l_quantity", "l_tax"], lambda c: f"r * r / (1 - r * r) * (n - 2) AS score FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)"),
    floats="score",
    digits=4,
)
def _(t: Tables):
    return L.regression_scores(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice")


EDGES10 = "list_sort(list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])))"


@query(
    "l05_mutual_information",
    _scores_sql(
        ["l_quantity", "l_extendedprice"],
        lambda c: f"""(WITH b AS (SELECT l_returnflag AS y, greatest(len(list_filter(e, lambda x: x < {c})) - 1, 0) AS bin FROM lineitem, (SELECT {EDGES10.format(c=c)} AS e FROM lineitem)),
        j AS (SELECT y, bin, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT n, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
        SELECT sum(n / t::DOUBLE * ln(n * t / (nb * ny)::DOUBLE)) FROM k) AS score""",
    ),
    floats="score",
)
def _(t: Tables):
    return L.mutual_information(t.lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag")


PSI = "(ln(n + 10.0) - 0.5 / (n + 10) - 1 / (12 * pow(n + 10.0, 2)) + 1 / (120 * pow(n + 10.0, 4)) - 1 / (252 * pow(n + 10.0, 6)) + 1 / (240 * pow(n + 10.0, 8)) - list_sum(list_transform(range(0, 10), lambda i: 1.0::DOUBLE / (n + i))))"


def _psi(n: str) -> str:
    """psi of a whole number in SQL."""
    return f"""(ln({n} + 10.0) - 0.5 / ({n} + 10) - 1 / (12 * pow({n} + 10.0, 2)) + 1 / (120 * pow({n} + 10.0, 4)) - 1 / (252 * pow({n} + 10.0, 6)) + 1 / (240 * pow({n} + 10.0, 8))
        - list_sum(list_transform(range(0, 10), lambda i: 1.0::DOUBLE / ({n} + i))))"""


@query(
    "l05_neighbour_information",
    f"""WITH r AS (SELECT c_custkey AS id, round(c_acctbal * 100)::BIGINT AS x, c_mktsegment AS y FROM customer),
    w AS (SELECT *, count(*) OVER (PARTITION BY y) AS c, lag(x, 3) OVER o AS l3, lag(x, 2) OVER o AS l2, lag(x, 1) OVER o AS l1, lead(x, 1) OVER o AS r1, lead(x, 2) OVER o AS r2, lead(x, 3) OVER o AS r3
        FROM r WINDOW o AS (PARTITION BY y ORDER BY x, id)),
    d AS (SELECT *, list_min(list_filter([x - l3, greatest(x - l2, r1 - x) + 0 * l2 + 0 * r1, greatest(x - l1, r2 - x) + 0 * l1 + 0 * r2, r3 - x], lambda f: f IS NOT NULL)) AS far FROM w),
    m AS (SELECT c, count(*) OVER (ORDER BY x RANGE BETWEEN greatest(far - 1, 0) PRECEDING AND greatest(far - 1, 0) FOLLOWING) AS m FROM d),
    s AS (SELECT count(*) AS n, avg({_psi('c')}) AS pc, avg({_psi('m')}) AS pm FROM m)
    SELECT 'cents' AS "column", greatest(0.0, {_psi('n')} + {_psi('3')} - pc - pm) AS score FROM s""",
    floats="score",
    digits=9,
)
def _(t: Tables):
    cents = t.customer.withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("bigint"))
    return L.neighbour_information(cents, ["cents"], "c_mktsegment", "c_custkey")


@query("l09_select_top", "SELECT l_orderkey, l_linenumber, l_extendedprice / 2 + l_quantity AS half FROM lineitem", floats="half", digits=4)
def _(t: Tables):
    df = t.lineitem.withColumn("half", F.col("l_extendedprice") / 2 + F.col("l_quantity"))
    best = L.select_features(df, ["l_quantity", "l_tax", "half"], "l_extendedprice", "regression", k=1)
    return df.select("l_orderkey", "l_linenumber", *best)
