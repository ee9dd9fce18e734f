"""Every query with an SQL oracle, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import canonical, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    rel = duck.execute(oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rel.fetchall())


# order-dependent, quantile and lookup operators again with every group split and every lookup shuffled
SPLIT = [
    "w01_lags", "w02_rolling", "w03_centred_trend", "w04_trailing_anomalies", "w05_rolling_accuracy", "w06_monotonic", "w08_category_codes",
    "t01_prepare", "t02_frequency", "t03_supervised", "t07_decompose", "t08_temporal_split", "p14_fill_forward", "p14_fill_backward",
    "d10_as_of_join", "m22_roc_curve", "m33_ks_drift", "m03_undersample", "m29_wilcoxon", "a19_spearman", "a22_percentiles", "c12_impute_group_median",
    "f15_label_codes", "f17_target_encoding", "j08_small_groups", "v07_k_anonymity", "st04_count_windows",
]


@pytest.mark.parametrize("name", SPLIT)
def test_matches_oracle_when_groups_are_split(spark, duck, small_groups, name):
    test_matches_oracle(spark, duck, name)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
