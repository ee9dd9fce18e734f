"""Whitening and bit-plane clusters against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Row

from tabularium.llm import bit_planes, whitening

KINDS = "vec_id bigint, embedding array<float>, label int, component string, cluster string, words int, norm string, vector int"


def frame(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v] if v is not None else None, 1, "a", "b", 2, "c", 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KINDS).repartition(3)


def drawn(n, width, seed=5):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, width)) @ draw.normal(size=(width, width)) / 4).astype(np.float32)


def test_whitening_equals_an_eigendecomposition(spark):
    vectors = drawn(400, 12)
    got = whitening.whiten(frame(spark, vectors), components=5).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, sides = np.linalg.eigh(centred.T @ centred / n)
    values, sides = values[::-1], sides[:, ::-1]
    assert got["n"].eq(n).all() and len(got) == 5 * n
    assert got["deviation"].to_numpy()[::5].tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()
    np.testing.assert_allclose(got["explained"].to_numpy()[:5], values[:5] / values.sum(), rtol=1e-9)
    white = got["whitened"].to_numpy().reshape(n, 5)
    want = centred @ sides[:, :5] / np.sqrt(values[:5])
    np.testing.assert_allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-8)
    assert got["identity_error"].max() < 1e-10
    assert np.abs(white.T @ white / n - np.eye(5)).max() < 1e-10


def test_whitening_of_badly_conditioned_rows(spark):
    """Variances 14 orders apart: the small one still whitens."""
    draw = np.random.default_rng(3)
    mixed = np.linalg.qr(draw.normal(size=(3, 3)))[0] @ np.diag([1e7, 1e3, 1.0])
    vectors = draw.normal(size=(500, 3)) @ mixed.T
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(rows).toPandas().sort_values(["vec_id", "component"])
    assert got["component"].max() == 3
    white = got["whitened"].to_numpy().reshape(500, 3)
    assert np.abs(white.T @ white / 500 - np.eye(3)).max() < 1e-6 and got["identity_error"].max() < 1e-6


def test_whitening_leaves_out_what_has_no_variance(spark):
    vectors = drawn(60, 4)
    vectors[:, 2] = 0.5
    vectors[:, 3] = vectors[:, 0]
    got = whitening.whiten(frame(spark, vectors)).toPandas()
    assert got["component"].max() == 2 and got["identity_error"].max() < 1e-9
    assert whitening.whiten(frame(spark, vectors[:1])).count() == 0


def test_whitening_of_large_entries_is_exact(spark):
    vectors = [[1e13, 1.0], [-1e13, 2.0], [3.0, 5.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")).toPandas()
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    own = {r.vec_id: r.deviation for r in got.itertuples()}
    assert all((own[i] == v) if v < 1 << 63 else np.isnan(own[i]) for i, v in enumerate(exact))


@pytest.mark.parametrize("apply", [whitening.whiten, bit_planes.cluster])
def test_unusual_rows(spark, apply):
    good = drawn(40, 64).tolist()
    bad = [None, [], good[0][:63], [float("nan")] * 64, [float("inf")] + good[0][1:], [None] * 64]
    rows = [Row(vec_id=i, embedding=v, label=None, component="x", cluster="y", words=1, norm="z", vector=2) for i, v in enumerate(good)]
    rows += [Row(vec_id=None, embedding=good[1], label=1, component=None, cluster=None, words=None, norm=None, vector=None)] + [rows[3]] * 2
    rows += [Row(vec_id=100 + i, embedding=v, label=1, component="x", cluster="y", words=1, norm="z", vector=2) for i, v in enumerate(bad)]
    got = apply(spark.createDataFrame(rows, KINDS)).toPandas()
    per_row = got["component"].max() if "component" in got else 1
    ids = got["vec_id"].dropna()
    assert set(ids) == set(range(40)) and (ids == 3).sum() == 3 * per_row and len(got) == 43 * per_row
    assert apply(spark.createDataFrame(rows, KINDS).limit(0)).count() == 0
    assert apply(spark.createDataFrame(rows[-len(bad):-3], KINDS)).count() == 0


def test_planes_carry_sums_and_products():
    draw = np.random.default_rng(2)
    x = draw.integers(-1500, 1500, size=(90, 64))
    words = bit_planes.planes_of(x, 12)
    assert bit_planes.component_sums(words).tolist() == x.sum(axis=0).tolist()
    assert bit_planes.dots(words, words[7]).tolist() == (x @ x[7]).tolist()


def test_clusters_equal_plain_rounds(spark):
    vectors = np.r_[drawn(300, 64), drawn(50, 64, seed=8) * 100, np.zeros((30, 64), np.float32)]
    got = bit_planes.cluster(frame(spark, vectors), rounds=6).toPandas().set_index("vec_id").sort_index()
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]
    centres = x[order]
    for _ in range(6):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == k].sum(axis=0) // (own == k).sum() if (own == k).any() else centres[k] for k in range(8)])
    apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    own, near = apart.argmin(axis=1), apart.min(axis=1)
    assert got["cluster"].tolist() == own.tolist() and got["distance"].tolist() == near.tolist()
    assert got["cluster_inertia"].tolist() == [near[own == k].sum() for k in own] and (got["inertia"] == near.sum()).all()
    assert got["centroid_sha256"].tolist() == [hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest() for k in own]


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        bit_planes.cluster(frame(spark, [[1e6] * 64]))
