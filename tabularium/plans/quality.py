"""Profile and quality queries over orders with injected gaps and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import quality as Q
from .registry import Tables, query

# gaps by expression and duplicates by a second copy of one priority, the same on both sides
_COLUMNS = """o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS price,
    o_orderpriority AS priority, o_orderdate AS ordered, 7 AS constant, o_custkey AS customer"""
GAPS = f"(SELECT {_COLUMNS} FROM orders UNION ALL SELECT {_COLUMNS} FROM orders WHERE o_orderpriority = '1-URGENT')"
ALL = ["o_orderkey", "status", "price", "priority", "ordered", "constant", "customer"]
NUMBERS = ["o_orderkey", "price", "constant", "customer"]
TEXTS = ["status", "priority"]
TYPES = {"o_orderkey": "bigint", "status": "string", "price": "double", "priority": "string", "ordered": "timestamp_ntz", "constant": "int", "customer": "bigint"}


def gaps(t: Tables):
    df = t.orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("ordered"),
        F.lit(7).alias("constant"),
        F.col("o_custkey").alias("customer"),
    )
    return df.unionByName(df.filter("priority = '1-URGENT'"))


def family(c: str) -> str:
    return "numeric" if c in NUMBERS else "text" if c in TEXTS else "date"


MISSING_CELLS = " + ".join(f"(count(*) - count({c}))" for c in ALL)
OVERVIEW_SQL = f"""SELECT count(*) AS rows, 7::BIGINT AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GAPS})) AS duplicates,
    round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {GAPS}))) * 100.0::DOUBLE / count(*), 2) AS duplicate_pct,
    {MISSING_CELLS} AS missing, round(({MISSING_CELLS}) * 100.0::DOUBLE / (count(*) * 7), 2) AS missing_pct,
    4::BIGINT AS numeric_columns, 2::BIGINT AS text_columns, 1::BIGINT AS date_columns FROM {GAPS}"""


@query("q01_overview", OVERVIEW_SQL)
def _(t: Tables):
    return P.overview(gaps(t))


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS type, '{family(c)}' AS family, count(*) AS rows, count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
    round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 2) AS unique_pct FROM {GAPS}"""
    for c in ALL
)


@query("q02_column_profile", PROFILE_SQL)
def _(t: Tables):
    return P.column_profile(gaps(t))


def _numeric_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean,
        stddev_samp({c}) AS std, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, count(*) FILTER ({c} = 0) AS zeros,
        round(count(*) FILTER ({c} = 0) * 100.0::DOUBLE / count({c}), 2) AS zeros_pct, count(*) FILTER ({c} < 0) AS negatives,
        quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75,
        quantile_cont({c}::DOUBLE, 0.95) AS p95, quantile_cont({c}::DOUBLE, 0.99) AS p99 FROM {table}"""
        for c in columns
    )


@query(
    "q03_numeric_profile",
    _numeric_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"),
    floats="mean std skewness kurtosis p25 p50 p75 p95 p99",
    digits=4,
)
def _(t: Tables):
    return P.numeric_profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).drop("normal_p", "is_normal")


def _normality_sql(table: str, c: str) -> str:
    """The published skewness and kurtosis tests, spelled out step by step."""
    return f"""(WITH m AS (SELECT count({c})::DOUBLE AS n, avg({c}) AS mu FROM {table}),
    c AS (SELECT n, avg(power({c} - mu, 2)) AS m2, avg(power({c} - mu, 3)) AS m3, avg(power({c} - mu, 4)) AS m4 FROM {table}, m GROUP BY n),
    g AS (SELECT n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM c),
    a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM g),
    b AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS k FROM a),
    z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
      (1 - 2 / (9 * k) - cbrt((1 - 2 / k) / (1 + x * sqrt(2 / (k - 4))))) / sqrt(2 / (9 * k)) AS z2 FROM b)
    SELECT '{c}' AS "column", n::BIGINT AS count, exp(-(z1 * z1 + z2 * z2) / 2) AS normal_p, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM z)"""


@query("q04_normality", f"{_normality_sql('events', 'value')} UNION ALL {_normality_sql('customer', 'c_acctbal')} UNION ALL {_normality_sql('labels', 'doc_id')}", floats="normal_p")
def _(t: Tables):
    made = P.numeric_profile(t.events, ["value"]).unionByName(P.numeric_profile(t.customer, ["c_acctbal"]))
    made = made.unionByName(P.numeric_profile(t.labels, ["doc_id"]))
    return made.select("column", "count", "normal_p", "is_normal")


@query(
    "q05_categorical_profile",
    """WITH c AS (SELECT 'p_brand' AS "column", p_brand AS v, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
      UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)
    SELECT "column", count(*) AS "unique", CASE WHEN count(*) <= 10 THEN 'low' WHEN count(*) <= 50 THEN 'medium' ELSE 'high' END AS cardinality,
    round(CASE WHEN count(*) >= 2 THEN max(n)::DOUBLE / min(n) END, 2) AS imbalance_ratio, count(*) >= 2 AND max(n)::DOUBLE / min(n) > 10 AS imbalanced
    FROM c GROUP BY 1""",
)
def _(t: Tables):
    return P.categorical_profile(t.part, ["p_brand", "p_type", "p_name"])


@query(
    "q05_top_values",
    """WITH c AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS count FROM part GROUP BY 2
      UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)
    SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INTEGER AS rank FROM c
    QUALIFY rank <= 10""",
)
def _(t: Tables):
    return P.top_values(t.part, ["p_brand", "p_name"])


def typed_table(t: Tables):
    return t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 7).alias("few"),
        "o_totalprice",
        F.concat(F.lit("$"), F.col("o_custkey").cast("string")).alias("money_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@mail.test")).alias("contact"),
        F.concat(F.lit("http://x/"), F.col("o_custkey").cast("string")).alias("link"),
        F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("code"),
        "o_orderpriority",
        "o_orderdate",
    )


@query(
    "q06_semantic_types",
    """WITH t AS (SELECT o_orderkey, o_custkey % 7 AS few, o_totalprice, '$' || o_custkey AS money_text, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
      'u' || o_custkey || '@mail.test' AS contact, 'http://x/' || o_custkey AS link, 'key-' || o_orderkey AS code, o_orderpriority FROM orders),
    n AS (SELECT c, count(DISTINCT v) AS d, count(*) AS n FROM (UNPIVOT (SELECT o_orderkey::DOUBLE AS o_orderkey, few::DOUBLE AS few, o_totalprice FROM t)
      ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY 1),
    s AS (SELECT c, count(DISTINCT v) AS d, count(v) AS n, count(TRY_CAST(regexp_replace(v, '[$€£¥,]', '', 'g') AS DOUBLE)) AS num,
      count(TRY_CAST(v AS TIMESTAMP)) AS ts, count(*) FILTER (regexp_matches(v, '@.*\\.')) AS mail, count(*) FILTER (regexp_matches(v, 'http|www')) AS url
      FROM (UNPIVOT (SELECT money_text, day_text, contact, link, code, o_orderpriority FROM t) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY 1)
    SELECT c AS "column", CASE WHEN d <= 10 THEN 'categorical_numeric' WHEN d = n THEN 'id' ELSE 'numeric' END AS semantic_type FROM n
    UNION ALL SELECT c, CASE WHEN num = n THEN 'numeric_string' WHEN ts = n THEN 'datetime_string' WHEN mail > n * 0.5 THEN 'email'
      WHEN url > n * 0.5 THEN 'url' WHEN d = n THEN 'id' ELSE 'categorical' END FROM s
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz'""",
)
def _(t: Tables):
    return P.semantic_types(typed_table(t))


@query(
    "q07_semantic_roles",
    """WITH p AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS k, count(DISTINCT c_name) AS m, count(DISTINCT c_nationkey) AS g,
      count(DISTINCT c_acctbal) AS b, count(DISTINCT c_mktsegment) AS s FROM customer),
    u AS (SELECT 'c_custkey' AS "column", 'num' AS f, n, k AS d FROM p UNION ALL SELECT 'c_name', 'txt', n, m FROM p UNION ALL SELECT 'c_nationkey', 'num', n, g FROM p
      UNION ALL SELECT 'c_acctbal', 'num', n, b FROM p UNION ALL SELECT 'c_mktsegment', 'txt', n, s FROM p)
    SELECT "column", CASE WHEN d = n THEN 'ID' WHEN f = 'num' AND d > n * 0.95 THEN 'ID' WHEN f = 'num' THEN 'NUMERIC'
      WHEN d > 50 AND n / d > 1.1 THEN 'GROUP_ID' WHEN d < 50 THEN 'CATEGORY' ELSE 'TEXT' END AS role FROM u""",
)
def _(t: Tables):
    return P.semantic_roles(t.customer)


def _outlier_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", lo AS lower_bound, hi AS upper_bound, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,
        round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0::DOUBLE / count({c}), 2) AS outlier_pct,
        count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}) > 5 AS warn
        FROM {table}, (SELECT quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS lo,
        quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS hi FROM {table}) GROUP BY lo, hi"""
        for c in columns
    )


@query(
    "q08_iqr_outliers",
    _outlier_sql(["value"], "events") + " UNION ALL " + _outlier_sql(["l_extendedprice"], "lineitem"),
    floats="lower_bound upper_bound",
    digits=3,
)
def _(t: Tables):
    return P.iqr_outliers(t.events, ["value"]).unionByName(P.iqr_outliers(t.lineitem, ["l_extendedprice"]))


@query(
    "q09_z_outliers",
    """SELECT 'value' AS "column", count(*) FILTER (abs((value - m) / s) > 3) AS outliers FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    UNION ALL SELECT 'user_id', count(*) FILTER (abs((user_id - m) / s) > 3) FROM events, (SELECT avg(user_id) AS m, stddev_samp(user_id) AS s FROM events)""",
)
def _(t: Tables):
    return P.z_outliers(t.events, ["value", "user_id"])


@query(
    "q10_flag_outliers",
    """SELECT event_id, coalesce(abs((value - m) / s) > 3, false) OR coalesce(abs((user_id - um) / us) > 3, false) AS is_outlier FROM events,
    (SELECT avg(value) AS m, stddev_pop(value) AS s, avg(user_id) AS um, stddev_pop(user_id) AS us FROM events)""",
)
def _(t: Tables):
    return P.flag_outliers(t.events, ["value", "user_id"], "z").select("event_id", "is_outlier")


@query(
    "q10_flag_outliers_iqr",
    """SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events,
    (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)""",
)
def _(t: Tables):
    return P.flag_outliers(t.events, ["value"]).select("event_id", "is_outlier")


@query(
    "q11_quality_summary",
    f"""WITH p AS ({PROFILE_SQL}) SELECT round((1 - sum(missing) / sum(rows)::DOUBLE) * 100, 2) AS completeness,
    (SELECT round(100.0::DOUBLE - duplicates * 100.0::DOUBLE / rows, 2) FROM ({OVERVIEW_SQL})) AS uniqueness,
    coalesce(list_sort(list("column") FILTER ("unique" <= 1)), []) AS constant_columns,
    coalesce(list_sort(list("column") FILTER (family = 'text' AND "unique" > 50)), []) AS high_cardinality,
    coalesce(list_sort(list("column") FILTER ("unique" = rows)), []) AS id_columns FROM p""",
)
def _(t: Tables):
    return P.quality_summary(gaps(t))


@query(
    "q12_target_profile",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'classification' AS problem_type, count(*) AS classes, 0::BIGINT AS missing, round(max(n)::DOUBLE / min(n), 2) AS imbalance_ratio,
    max(n)::DOUBLE / min(n) > 3 AS imbalanced FROM c UNION ALL
    SELECT 'regression', count(DISTINCT o_totalprice), 0, NULL, false FROM orders""",
)
def _(t: Tables):
    return P.target_profile(t.orders, "o_orderstatus").unionByName(P.target_profile(t.orders, "o_totalprice"))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS r FROM {GAPS}"
    for a, b in PAIRS
    if "constant" not in (a, b)
)
IMBALANCE_SQL = " UNION ALL ".join(
    f"SELECT max(n)::DOUBLE / min(n) AS ratio FROM (SELECT {c}, count(*) AS n FROM {GAPS} WHERE {c} IS NOT NULL GROUP BY 1) HAVING count(*) >= 2" for c in TEXTS
)


@query(
    "q13_quality_score",
    f"""WITH o AS ({OVERVIEW_SQL}), w AS (SELECT (SELECT count(*) FROM ({IMBALANCE_SQL}) WHERE ratio > 10)
      + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM ({PROFILE_SQL}) WHERE "unique" <= 1)
      + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM ({CORR_SQL}) WHERE abs(r) > 0.8)
      + (SELECT count(*) FROM ({_outlier_sql(NUMBERS, GAPS)}) WHERE warn) AS warnings)
    SELECT missing_pct, duplicate_pct, warnings::BIGINT AS warnings,
    greatest(0, least(100, round(100 - missing_pct * 0.5 - duplicate_pct * 0.3 - warnings * 2, 1)))::DOUBLE AS score FROM o, w""",
)
def _(t: Tables):
    return Q.quality_score(gaps(t))


SKEW_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", skewness({c}) AS skewness FROM {GAPS}""" for c in NUMBERS if c != "constant")


@query(
    "q14_issues",
    f"""WITH p AS (SELECT p.*, o.outlier_pct, s.skewness FROM ({PROFILE_SQL}) p LEFT JOIN ({_outlier_sql(NUMBERS, GAPS)}) o USING ("column")
      LEFT JOIN ({SKEW_SQL}) s USING ("column"))
    SELECT 'critical_missing' AS type, "column", 'critical' AS severity, missing_pct AS value FROM p WHERE missing_pct >= 30
    UNION ALL SELECT 'warning_missing', "column", 'warning', missing_pct FROM p WHERE missing_pct >= 5 AND missing_pct < 30
    UNION ALL SELECT 'outliers', "column", 'warning', outlier_pct FROM p WHERE outlier_pct > 5
    UNION ALL SELECT 'high_cardinality', "column", 'info', "unique" FROM p WHERE family = 'text' AND unique_pct > 90
    UNION ALL SELECT 'constant_column', "column", 'warning', "unique" FROM p WHERE "unique" <= 1
    UNION ALL SELECT 'high_skewness', "column", 'info', round(skewness, 4) FROM p WHERE abs(skewness) > 2
    UNION ALL SELECT 'duplicates', NULL, 'warning', duplicates::DOUBLE FROM ({OVERVIEW_SQL}) WHERE duplicates > 0""",
)
def _(t: Tables):
    return Q.issues(gaps(t))


@query(
    "q15_recommendations",
    f"""WITH p AS (SELECT p.*, o.outlier_pct, s.skewness FROM ({PROFILE_SQL}) p LEFT JOIN ({_outlier_sql(NUMBERS, GAPS)}) o USING ("column")
      LEFT JOIN ({SKEW_SQL}) s USING ("column")),
    r AS (SELECT 'high_missing' AS topic, list_sort(list("column") FILTER (missing_pct > 30)) AS items, (count(*) FILTER (missing_pct > 30))::DOUBLE AS value FROM p
      UNION ALL SELECT 'outliers', list_sort(list("column") FILTER (outlier_pct > 0)), count(*) FILTER (outlier_pct > 0) FROM p
      UNION ALL SELECT 'skewed', list_sort(list("column") FILTER (abs(skewness) > 2)), count(*) FILTER (abs(skewness) > 2) FROM p
      UNION ALL SELECT 'correlated', [], count(*) FROM ({CORR_SQL}) WHERE abs(r) > 0.8
      UNION ALL SELECT 'duplicates', [], CASE WHEN duplicates * 100.0 / rows > 5 THEN duplicates ELSE 0 END FROM ({OVERVIEW_SQL}))
    SELECT * FROM r WHERE value > 0""",
)
def _(t: Tables):
    return Q.recommendations(gaps(t))


@query(
    "q16_insights",
    f"""WITH o AS (SELECT missing * 100.0::DOUBLE / (rows * columns) AS m, duplicates * 100.0::DOUBLE / rows AS d FROM ({OVERVIEW_SQL})),
    i AS (SELECT 'high_missing' AS type, NULL AS "column", 'warning' AS severity, m AS value FROM o WHERE m > 10
      UNION ALL SELECT 'excellent_completeness', NULL, 'success', m FROM o WHERE m < 1
      UNION ALL SELECT 'duplicates', NULL, 'warning', d FROM o WHERE d > 5
      UNION ALL SELECT 'skewed', "column", 'info', skewness FROM ({SKEW_SQL}) WHERE abs(skewness) > 2
      UNION ALL SELECT 'correlation', col1 || '~' || col2, 'info', r FROM ({CORR_SQL}) WHERE abs(r) > 0.8
      UNION ALL SELECT 'time_series', NULL, 'info', 1)
    SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'success' THEN 2 ELSE 3 END AS rank FROM i""",
    floats="value",
)
def _(t: Tables):
    return Q.insights(gaps(t))


@query(
    "q17_domain_insights",
    """SELECT 'pay' AS "column", 'hr_compensation' AS category, stddev_samp(c_acctbal) / avg(c_acctbal) * 100 AS value FROM customer
    HAVING stddev_samp(c_acctbal) / avg(c_acctbal) * 100 > 30
    UNION ALL SELECT 'sales_amount', 'finance_summary', sum(o_totalprice) FROM orders""",
    floats="value",
    digits=2,
)
def _(t: Tables):
    hr = Q.domain_insights(t.customer.withColumnRenamed("c_acctbal", "pay"), "hr")
    return hr.unionByName(Q.domain_insights(t.orders.withColumnRenamed("o_totalprice", "sales_amount"), "retail"))


@query(
    "q18_date_columns",
    """SELECT 'day_text' AS "column", 1.0::DOUBLE AS date_share, true AS is_date UNION ALL SELECT 'o_orderpriority',
    avg((TRY_CAST(o_orderpriority AS TIMESTAMP) IS NOT NULL)::INTEGER), false FROM orders UNION ALL SELECT 'o_orderdate', 1.0, true""",
)
def _(t: Tables):
    return Q.date_like_columns(typed_table(t).select("day_text", "o_orderpriority", "o_orderdate"))


@query(
    "q19_validate_dataframe",
    """SELECT * FROM (SELECT 'missing_required' AS rule, 'o_comment' AS "column" UNION ALL SELECT 'wrong_type', 'o_totalprice'
    UNION ALL SELECT CASE WHEN count(*) < 1000000000 THEN 'too_few_rows' END, NULL FROM orders) WHERE rule IS NOT NULL""",
)
def _(t: Tables):
    wanted = {"o_totalprice": "int", "o_orderdate": "datetime", "o_orderstatus": "str"}
    return Q.validate_dataframe(t.orders, ["o_orderkey", "o_comment"], min_rows=1_000_000_000, dtypes=wanted)


@query(
    "q20_validate_columns",
    """SELECT 'missing_required' AS rule, 'o_comment' AS "column", count(*) AS rows FROM orders
    UNION ALL SELECT 'forbidden_present', 'o_custkey', count(*) FROM orders""",
)
def _(t: Tables):
    found = Q.validate_columns(Q.require_not_empty(t.orders), required=["o_orderkey", "o_comment"], forbidden=["o_custkey"])
    return found.withColumn("rows", F.lit(t.orders.count()).cast("bigint"))


@query(
    "q21_missing_above",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg(({c} IS NULL)::INTEGER) AS missing_ratio FROM {GAPS} HAVING avg(({c} IS NULL)::INTEGER) > 0.05""" for c in ALL
    ),
    floats="missing_ratio",
)
def _(t: Tables):
    return Q.missing_above(gaps(t), 0.05)


@query(
    "q22_batch_gate",
    f"""SELECT 'no_missing' AS "check", missing = 0 AS passed FROM ({OVERVIEW_SQL}) UNION ALL SELECT 'enough_rows', rows >= 1000 FROM ({OVERVIEW_SQL})
    UNION ALL SELECT 'no_duplicates', duplicates = 0 FROM ({OVERVIEW_SQL})""",
)
def _(t: Tables):
    return Q.batch_gate(gaps(t))


@query(
    "q23_problem_gate",
    """WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS u FROM orders),
    m AS (SELECT max(c) / sum(c)::DOUBLE AS top FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)),
    r AS (SELECT 'min_rows' AS rule, n::DOUBLE AS value, 100.0::DOUBLE AS "limit", n < 100 AS failed, true AS hard FROM s
      UNION ALL SELECT 'rows_per_feature', n / 5.0, 5, n / 5.0 < 5, true FROM s
      UNION ALL SELECT 'target_unique_ratio', u / n::DOUBLE, 0.95, u / n::DOUBLE > 0.95, true FROM s
      UNION ALL SELECT 'majority_share', top, 0.9, top > 0.9, false FROM m)
    SELECT *, CASE WHEN bool_or(failed AND hard) OVER () OR count(*) FILTER (failed) OVER () >= 2 THEN 'rejected' ELSE 'approved' END AS status,
    CASE WHEN bool_or(failed AND hard) OVER () THEN 0 WHEN count(*) FILTER (failed) OVER () >= 2 THEN 0.3
      ELSE 0.8 - 0.15 * count(*) FILTER (failed) OVER () END::DOUBLE AS confidence FROM r""",
    floats="value confidence",
)
def _(t: Tables):
    return Q.problem_gate(t.orders, "o_orderstatus")


@query(
    "q24_data_gate",
    f"""WITH m AS ({' UNION ALL '.join(f'SELECT avg(({c} IS NULL)::INTEGER) AS miss, count(DISTINCT {c}) AS d FROM {GAPS}' for c in ALL)}),
    k AS (SELECT count(*) AS leaks FROM (SELECT corr(o_orderkey, price) AS r FROM {GAPS} UNION ALL SELECT corr(customer, price) FROM {GAPS}) WHERE abs(r) > 0.95),
    d AS (SELECT duplicates / rows::DOUBLE AS s FROM ({OVERVIEW_SQL})),
    r AS (SELECT 'missing_columns' AS rule, (count(*) FILTER (miss > 0.3))::DOUBLE AS value, 0.0::DOUBLE AS "limit", count(*) FILTER (miss > 0.3) > 0 AS failed, true AS hard FROM m
      UNION ALL SELECT 'leaking_columns', leaks, 0, leaks > 0, true FROM k
      UNION ALL SELECT 'id_columns', 0, 2, false, true
      UNION ALL SELECT 'duplicate_share', s, 0.05, s > 0.05, false FROM d
      UNION ALL SELECT 'constant_columns', count(*) FILTER (d <= 1), 0, count(*) FILTER (d <= 1) > 0, false FROM m)
    SELECT rule, value, "limit", failed, hard, CASE WHEN bool_or(failed AND hard) OVER () THEN 'rejected' ELSE 'approved' END AS status,
    CASE WHEN bool_or(failed AND hard) OVER () THEN 0 ELSE 0.6 - 0.15 * count(*) FILTER (failed) OVER () END::DOUBLE AS confidence FROM r""",
    floats="value confidence",
)
def _(t: Tables):
    return Q.data_gate(gaps(t), "price", ["ordered", "o_orderkey"])


@query(
    "q25_strategy",
    """SELECT count(*) AS rows, 5::BIGINT AS features, 'regression' AS problem_type,
    CASE WHEN count(*) < 1000 THEN 'small' WHEN count(*) < 10000 THEN 'medium' ELSE 'large' END AS size_band,
    CASE WHEN count(*) < 500 THEN '10-fold' WHEN count(*) < 5000 THEN '5-fold' ELSE '70/15/15 split' END AS validation,
    5 > count(*) / 10.0 AS high_dimensional, CASE WHEN count(*) < 500 THEN 2 WHEN count(*) < 1000 THEN 1 ELSE 0 END::BIGINT AS concerns,
    'approved' AS status, round(0.75 - 0.1 * CASE WHEN count(*) < 500 THEN 2 WHEN count(*) < 1000 THEN 1 ELSE 0 END, 2)::DOUBLE AS confidence FROM orders""",
)
def _(t: Tables):
    return Q.strategy(t.orders, "o_totalprice")


@query(
    "q26_fix_plan",
    f"""WITH p AS (SELECT "column", missing / rows::DOUBLE AS s, "unique" FROM ({PROFILE_SQL}) WHERE "column" <> 'price')
    SELECT 'safe' AS class, 'drop_missing' AS action, "column" FROM p WHERE s > 0.3 UNION ALL SELECT 'safe', 'drop_constant', "column" FROM p WHERE "unique" <= 1
    UNION ALL SELECT 'safe', 'fill_missing', "column" FROM p WHERE s > 0 AND s <= 0.3
    UNION ALL SELECT 'never', unnest(['modify_target', 'remove_rows_by_target', 'impute_target']), 'price'""",
)
def _(t: Tables):
    return Q.fix_plan(gaps(t), "price")


@query(
    "q26_reentry_conditions",
    f"""SELECT 'min_rows_met' AS condition, count(*) >= 100 AS met FROM {GAPS} UNION ALL SELECT 'samples_per_feature_met', count(*) / 6.0 >= 5 FROM {GAPS}
    UNION ALL SELECT 'missing_rate_acceptable', {' AND '.join(f'avg(({c} IS NULL)::INTEGER) <= 0.3' for c in ALL)} FROM {GAPS}
    UNION ALL SELECT 'no_leakage', abs(corr(o_orderkey, price)) <= 0.95 AND abs(corr(customer, price)) <= 0.95 FROM {GAPS}
    UNION ALL SELECT 'id_columns_removed', true""",
)
def _(t: Tables):
    return Q.reentry_conditions(gaps(t), "price", ["ordered", "o_orderkey"])


# status misses about a third of its values and is dropped, state misses a quarter and is filled
FIXABLE = f"""(SELECT g.*, CASE WHEN customer % 4 <> 0 THEN priority END AS state FROM {GAPS} AS g)"""


@query(
    "q27_safe_fixes",
    f"""WITH d AS (SELECT DISTINCT o_orderkey, price, priority, ordered, customer, state FROM {FIXABLE}),
    m AS (SELECT state AS mode FROM d WHERE state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, price, priority, ordered, customer, coalesce(state, mode) AS state FROM d, m""",
)
def _(t: Tables):
    state = F.when(F.col("customer") % 4 != 0, F.col("priority"))
    return Q.apply_safe_fixes(gaps(t).withColumn("state", state), "price")[0]


MEANINGS = {"c_custkey": "number", "c_name": "entity name", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text or category"}


@query(
    "q28_column_meanings",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{m}' AS meaning, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique" FROM customer"""
        for c, m in MEANINGS.items()
    ),
)
def _(t: Tables):
    return Q.column_meanings(t.customer)


@query(
    "q28_table_flags",
    f"""SELECT 'high_missing' AS flag, missing > rows * 7 * 0.3 AS raised FROM ({OVERVIEW_SQL}) UNION ALL
    SELECT 'high_duplicates', duplicates > rows * 0.1 FROM ({OVERVIEW_SQL})""",
)
def _(t: Tables):
    return Q.table_flags(gaps(t))


@query(
    "q29_critique",
    """SELECT CASE WHEN acc > 0.95 THEN 'suspiciously_high_accuracy' ELSE 'accuracy_may_not_transfer' END AS warning, acc AS value
    FROM (SELECT avg((quality = 1)::INTEGER) AS acc FROM labels) WHERE acc > 0.85""",
    floats="value",
)
def _(t: Tables):
    hit = F.avg((F.col("quality") == 1).cast("double")).alias("value")
    return Q.critique(t.labels.agg(F.lit("accuracy").alias("metric"), hit))
