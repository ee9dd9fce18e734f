"""Physical plans: pruned scans, fused passes, no single-task exchange where keys or splitting exist."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from tabularium.operators import aggregate as A
from tabularium.operators import profile as P
from tabularium.operators import windows as W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    text = plan(queries()["a02_group_agg"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "LessThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_partkey" not in text.split("ReadSchema")[1]


def test_column_profile_reads_the_table_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert plan(P.column_profile(df)).count("FileScan") == 1
    assert plan(A.correlations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_tax"])).count("FileScan") == 1


def test_keyed_windows_do_not_gather_everything(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(W.rolling_features(df, ["value"], ["ts", "event_id"], ["user_id"]))
    assert "SinglePartition" not in text and text.count("Exchange hashpartitioning") == 1


def test_split_windows_do_not_gather_everything(spark, sf_dir, small_groups):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = plan(W.rolling_features(df, ["value"], ["ts", "event_id"], windows=[7], stats=["mean"]))
    assert "SinglePartition" not in text


def test_rank_limits_are_applied_before_the_shuffle(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert plan(W.last_k(df, ["user_id"], ["ts", "event_id"], 5)).count("WindowGroupLimit") == 2


def test_planning_a_lookup_runs_nothing(spark, sf_dir):
    from tabularium.operators.lookup import join_lookup

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spark.sparkContext.setJobGroup("lookup", "planning only")
    made = join_lookup(orders, orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ["o_custkey"], null_safe=True)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made.count() == orders.count()


def test_quantiles_gather_no_rows(spark, sf_dir):
    from tabularium.operators import quantiles as Q

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(Q.quantile_table(df, ["l_returnflag"], ["l_quantity"], [0.5]))
    assert "SinglePartition" not in text and "collect_list(l_quantity" not in text
