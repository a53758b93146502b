"""Factorisations that keep small values, wide signals, block products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import lowrank


def rows_of(spark, x):
    return spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "row_id long, x array<double>").repartition(6)


def orthogonal(rng, n, k):
    return np.linalg.qr(rng.standard_normal((n, k)))[0]


def test_small_singular_values_and_left_vectors(spark):
    rng = np.random.default_rng(0)
    sigma = np.logspace(0, -10, 12)
    x = orthogonal(rng, 200, 12) * sigma @ orthogonal(rng, 12, 12).T
    rows = rows_of(spark, x)
    u, s, v = lowrank.svd(rows)
    assert np.allclose(s, sigma, rtol=1e-5) and np.allclose(v.T @ v, np.eye(12), atol=1e-12)
    made = {r["row_id"]: r["u"] for r in u.collect()}
    left = np.array([made[n] for n in range(200)])
    assert np.allclose(left.T @ left, np.eye(12), atol=1e-10) and np.allclose(left * s @ v.T, x, atol=1e-15)
    assert np.allclose([r["sigma"] for r in lowrank.singular_values(rows).orderBy("component").collect()], sigma, rtol=1e-5)


def test_fewer_signals_than_values_and_lost_ranks(spark):
    x = np.random.default_rng(1).standard_normal((3, 7))
    rows = rows_of(spark, np.vstack([x, x]))
    u, s, v = lowrank.svd(rows)
    assert len(s) == 3 and v.shape == (7, 3) and u.where(F.size("u") != 3).count() == 0
    expected = np.linalg.svd(np.vstack([x, x]), compute_uv=False)
    assert np.allclose([r["sigma"] for r in lowrank.singular_values(rows).orderBy("component").collect()], np.append(expected[:3], np.zeros(4)), atol=1e-12)
    u, s, _ = lowrank.svd(rows_of(spark, np.zeros((4, 3))))
    assert len(s) == 0 and u.count() == 4


def test_wide_signals_by_subspace_iteration(spark):
    rng = np.random.default_rng(2)
    sigma = 100.0 / np.arange(1, 41) ** 2
    x = orthogonal(rng, 150, 40) * sigma @ orthogonal(rng, 1200, 40).T
    rows = rows_of(spark, x)
    s, v = lowrank.subspace(rows, 6)
    assert np.allclose(s, sigma[:6], rtol=1e-6) and np.allclose(v.T @ v, np.eye(6))
    best = np.linalg.norm(sigma[6:])
    assert np.linalg.norm(x - x @ v @ v.T) < 1.01 * best
    s, v = lowrank.right_vectors(rows, 6, wide=1000)
    assert np.allclose(s, sigma[:6], rtol=1e-6) and v.shape == (1200, 6)


@pytest.mark.parametrize(("side", "depth"), [(512, 16), (7, 2), (5, 1)])
def test_block_products(spark, side, depth):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((23, 31)), rng.standard_normal((31, 12))
    keep_a, keep_b = rng.random(a.shape) < 0.3, rng.random(b.shape) < 0.1
    cells = lambda m, keep: spark.createDataFrame([(i, j, float(m[i, j])) for i, j in np.argwhere(keep).tolist()], "i int, j int, v double")
    got = {(r["i"], r["j"]): r["v"] for r in lowrank.matrix_multiply(cells(a, keep_a), cells(b, keep_b), side, depth).collect()}
    terms = keep_a.astype(int) @ keep_b.astype(int)
    assert set(got) == {(i, j) for i, j in np.argwhere(terms).tolist()}
    product = (a * keep_a) @ (b * keep_b)
    assert all(np.isclose(v, product[k]) for k, v in got.items())


def test_block_product_of_nothing(spark):
    none = spark.createDataFrame([], "i int, j int, v double")
    some = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, v double")
    assert lowrank.matrix_multiply(none, some).count() == 0 and lowrank.matrix_multiply(some, none).count() == 0
