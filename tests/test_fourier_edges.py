"""Offsets, absent cells, empty tables and draws of any size."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.operators import fourier
from signalframe.sources import first_rows, within


def rows_of(spark, x):
    return spark.createDataFrame([(n, [float(v) for v in r]) for n, r in enumerate(x)], "row_id long, x array<double>").repartition(5)


def cells(df, m):
    out = np.full((m, m), np.nan, complex)
    for r in df.collect():
        out[r[0], r[1]] = r[2] + (1j * r[3] if len(r) > 3 else 0)
    return out


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e8])
def test_moments_lose_no_digits_to_an_offset(spark, offset):
    x = np.random.default_rng(0).standard_normal((500, 6)) @ np.diag(np.arange(1, 7)) + offset
    rows, expected = rows_of(spark, x), np.cov((x - x[0]).T)
    assert np.allclose(cells(fourier.covariance(rows), 6).real, expected, atol=1e-9 * max(1, offset * 1e-7) * 36)
    grouped = {r["row_id"]: r["x"] for r in fourier.covariance_rows(rows.withColumn("g", F.lit(1)), ["g"]).collect()}
    assert np.allclose([grouped[k] for k in range(6)], expected, atol=1e-7)
    u = np.fft.fft(x - x[0], axis=1) / np.sqrt(6)
    u -= u.mean(axis=0)
    s = np.abs(u.conj().T @ u)
    d, o = np.trace(s) / 6, (s.sum() - np.trace(s)) / 30
    assert np.isclose(fourier.kappa_of_signals(rows).first()[0], d / (d + o), rtol=1e-6)


def test_absent_cells_are_zero(spark):
    c = np.diag(np.arange(1.0, 9))
    c[2, 5] = 3
    full = spark.createDataFrame([(a, b, float(c[a, b])) for a in range(8) for b in range(8)], "a int, b int, c double")
    few = full.where("c <> 0")
    for conjugate in (True, False):
        assert np.allclose(cells(fourier.fourier_eig(few, 8, conjugate), 8), cells(fourier.fourier_eig(full, 8, conjugate), 8))
    assert np.isclose(fourier.kappa(fourier.fourier_eig(few, 8)).first()[0], fourier.kappa(fourier.fourier_eig(full, 8)).first()[0])
    with pytest.raises(Exception, match="beyond"):
        fourier.fourier_eig(full, 7).collect()


def test_little_or_nothing(spark):
    none = spark.createDataFrame([], "row_id long, x array<double>")
    for method in ("svd", "eig"):
        assert np.isnan(fourier.kappa_of_signals(none, method=method).first()[0])
    assert fourier.covariance(none).count() == 0
    one = rows_of(spark, [[1, 2, 3, 4]])
    assert all(np.isnan(r["c"]) for r in fourier.covariance(one).collect())
    assert all(np.isnan(r["v"]) for r in fourier.spectrum_inversion(one, 4).collect())
    with pytest.raises(ValueError, match="segment"):
        fourier.welch_psd(one, 1.0, 1)


def test_draws_are_the_least_digests_of_any_size(spark):
    rows = spark.range(6000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    for nested in (False, True):
        got = {}
        for r in fourier.sampled(rows, [5, 3000, 6000, 9000], 2, nested).collect():
            got.setdefault((r["size"], r["rep"]), set()).add(r["row_id"])
        for (size, rep), ids in got.items():
            key = lambda n: hashlib.md5(f"{rep}:{n}".encode() if nested else f"{size}:{rep}:{n}".encode()).hexdigest()  # noqa: B023, E731
            assert ids == set(sorted(range(6000), key=key)[:size])
        assert len(got) == 8
    plan = fourier.sampled(rows, [5, 3000], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 6000") == 1 and "Window" not in plan and "Sort" not in plan
    assert fourier.sampled(rows.where("false"), [5], 2).count() == 0


def test_limits_and_first_rows(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "b", 7.0), (4, None, 1.0), (0, None, 9.0)], "n int, k string, v double")
    assert sorted(r["n"] for r in within(df, v=(2.0, 8.0)).collect()) == [1, 3]
    assert within(df, v=(float("-inf"), float("inf"))).count() == 5
    assert sorted((str(r["k"]), r["n"], r["v"]) for r in first_rows(df, ["n"], ["k"]).collect()) == [("None", 0, 9.0), ("a", 1, 5.0), ("b", 3, 7.0)]
    assert [r["n"] for r in first_rows(df, ["v", "n"]).collect()] == [2]
    assert first_rows(df.where("false"), ["n"]).count() == 0
