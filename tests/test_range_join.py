"""Range and overlap joins against all pairs, and the size of covers."""

import random

import pytest
from pyspark.sql import functions as F

from tabularium.operators import sqlsurface as S


def drawn(seed, n, skew):
    draw = random.Random(seed)
    at = lambda: round(draw.gauss(0, 1) ** 3 * 10 if skew else draw.uniform(-50, 50), 1)
    spans = [(at(), draw.choice([0.0, 0.1, 3.0, 500.0])) for _ in range(n)]
    return [at() for _ in range(n)], [(i, a - w / 3, a + w) for i, (a, w) in enumerate(spans)]


@pytest.mark.parametrize("skew", [False, True])
def test_range_join_equals_all_pairs(spark, skew):
    points, spans = drawn(3, 300, skew)
    left = spark.createDataFrame([(i, x) for i, x in enumerate(points)] + [(900, None), (901, float("inf")), (902, points[0])], "p int, x double")
    right = spark.createDataFrame(spans + [(950, None, 1.0), (951, 2.0, None), (952, 5.0, -5.0)], "s int, lo double, hi double")
    got = sorted((r["p"], r["s"]) for r in S.range_join(left, right, "x", "lo", "hi").collect())
    want = sorted((i, s) for i, x in [*enumerate(points), (902, points[0])] for s, a, b in spans if a <= x < b)
    assert got == want
    plan = S.range_join(left, right, "x", "lo", "hi")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert S.range_join(left.limit(0), right, "x", "lo", "hi").count() == 0 and S.range_join(left, right.limit(0), "x", "lo", "hi").count() == 0


def test_a_long_range_makes_few_rows(spark):
    ends = spark.createDataFrame([(a, b) for a in (0, 1, 7, 8, 63, 500, 4095) for b in (0, 7, 8, 511, 512, 4094, 4095) if a <= b], "a int, b int")
    rows = ends.select("a", "b", S._pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        cells = [c for piece in r["p"] for c in range(piece["run"] * 8 ** piece["level"], (piece["run"] + 1) * 8 ** piece["level"])]
        assert sorted(cells) == list(range(r["a"], r["b"] + 1)) and len(r["p"]) <= 50


def test_overlap_join_equals_all_pairs(spark):
    a, b = drawn(5, 120, False)[1], drawn(6, 120, True)[1]
    left, right = spark.createDataFrame(a, "i int, a double, b double"), spark.createDataFrame(b, "j int, c double, d double")
    got = sorted((r["i"], r["j"]) for r in S.overlap_join(left, right, "a", "b", "c", "d").collect())
    assert got == sorted((i, j) for i, p, q in a for j, r, s in b if p < s and r < q and p < q and r < s)


@pytest.mark.parametrize("most", ["25", "1000000"])
def test_overlap_counts_equal_all_pairs_and_list_none(spark, most):
    spark.conf.set("spark.tabularium.maxGroupRows", most)
    try:
        a, b = drawn(7, 150, False)[1], drawn(8, 150, True)[1]
        # the same row twice, touching ranges, an empty one and nulls
        a += [a[0], (900, b[0][2], b[0][2] + 1), (901, b[0][1] - 1, b[0][1]), (902, 3.0, 3.0), (903, None, 1.0), (904, 2.0, None)]
        b += [(900, 3.0, 3.0), (901, None, 9.0), b[1]]
        left, right = spark.createDataFrame(a, "i int, a double, b double"), spark.createDataFrame(b, "j int, c double, d double")
        made = S.overlap_counts(left, right, "a", "b", "c", "d", "n")
        meets = lambda p, q, r, s: None not in (p, q, r, s) and p < s and r < q and p < q and r < s
        want = [(i, sum(meets(p, q, r, s) for _, r, s in b)) for i, p, q in a]
        assert sorted((r["i"], r["n"]) for r in made.collect()) == sorted((i, n) for i, n in want if n)
        plan = made._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "__run" not in plan
    finally:
        spark.conf.unset("spark.tabularium.maxGroupRows")


def test_range_join_of_times_and_whole_numbers(spark):
    left = spark.sql("SELECT id AS p, CAST(id AS BIGINT) AS x, timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS t FROM range(40)")
    right = spark.sql("SELECT id AS s, id AS lo, id + 5 AS hi, timestamp'2024-01-03' AS a, timestamp'2024-01-05' AS b FROM range(3)")
    assert S.range_join(left, right, "x", "lo", "hi").count() == 15
    assert S.range_join(left, right, "t", "a", "b").count() == 6
