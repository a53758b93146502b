"""Singular spectrum analysis of long signals, truncated solver, checks of times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import diagonal_count
from signalframe.operators import ssa

SCHEMA = "signal_id long, t long, x double"


def series(spark, *signals):
    rows = [(k, t, float(v)) for k, x in enumerate(signals) for t, v in enumerate(x)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(int(k), int(t), v) for k, t, v in rows], SCHEMA)


def wave(n, seed=0):
    t = np.arange(n)
    return np.sin(t / 7) + 0.5 * np.sin(t / 3.3) + t / n + 0.1 * np.random.default_rng(seed).standard_normal(n)


def test_lag_covariance_by_the_recurrence(spark):
    x, y = wave(300), wave(41, 1)
    got = {(r["signal_id"], r["i"], r["j"]): r["c"] for r in ssa.lag_covariance(series(spark, x, y), 20, size=50).collect()}
    for k, v in enumerate((x, y)):
        h = np.lib.stride_tricks.sliding_window_view(v, 20)
        assert np.allclose([[got[k, i, j] for j in range(20)] for i in range(20)], h.T @ h)
    one = ssa.lag_covariance(series(spark, y), 1).collect()
    assert len(one) == 1 and np.isclose(one[0]["c"], (y**2).sum())
    assert ssa.lag_covariance(series(spark, y), 41).count() == 41 * 41


@pytest.mark.parametrize("size", [60, 400])
def test_chunks_give_what_one_task_gives(spark, size):
    signals = series(spark, wave(1000), wave(130, 2))
    model = ssa.SSA(30, n_components=5)
    whole = {(r["signal_id"], r["component"]): r for r in model.fit(signals).collect()}
    fitted = model.fit_long(signals, size).cache()
    for r in fitted.collect():
        other = whole[r["signal_id"], r["component"]]
        assert np.isclose(r["sigma"], other["sigma"], rtol=1e-8) and np.isclose(abs(np.dot(r["v"], other["v"])), 1)
    expected = {(r["signal_id"], r["component"], r["t"]): r["y"] for r in model.components(signals).collect()}
    got = {(r["signal_id"], r["component"], r["t"]): r["y"] for r in ssa.long_components(signals, fitted, 30, size).collect()}
    assert got.keys() == expected.keys() and max(abs(got[k] - expected[k]) for k in got) < 1e-6


def test_truncated_solver_equals_lapack():
    x = wave(4000, 3)
    u, s, v = ssa.truncated(x, 300, 12)
    h = np.lib.stride_tricks.sliding_window_view(x, 300)
    expected = np.linalg.svd(h, compute_uv=False)
    assert np.allclose(s, expected[:12], rtol=1e-8) and np.allclose(u.T @ u, np.eye(12), atol=1e-8) and np.allclose(v.T @ v, np.eye(12), atol=1e-8)
    assert np.allclose(h @ v, u * s, atol=1e-6 * s[0])
    for few in (np.sin(np.arange(50) / 3), np.ones(30), np.zeros(20), np.arange(6.0)):
        window = len(few) // 3
        _, s, _ = ssa.truncated(few, window, window)
        assert np.allclose(s, np.linalg.svd(np.lib.stride_tricks.sliding_window_view(few, window), compute_uv=False), atol=1e-8)


def test_truncated_fit_rebuilds_a_signal_of_low_rank(spark):
    signals = series(spark, np.sin(np.arange(500) / 5))
    model = ssa.SSA(100, n_components=2, solver="lanczos")
    y = {r["t"]: r["y"] for r in ssa.reconstruct(model.components(signals)).collect()}
    assert np.allclose([y[t] for t in range(500)], np.sin(np.arange(500) / 5), atol=1e-8)


def test_gaps_repeats_and_nulls_raise(spark):
    signals = series(spark, wave(60))
    for bad in (signals.where("t <> 10"), signals.where("t > 0"), signals.where("t <> 10").unionByName(signals.where("t = 11")), signals.selectExpr("signal_id", "t", "if(t = 3, NULL, x) AS x")):
        for run in (lambda b: ssa.SSA(5).fit(b).collect(), lambda b: ssa.lag_covariance(b, 5).collect()):
            with pytest.raises(Exception, match="times|values"):
                run(bad)


def test_selection_keeps_the_type_of_ids(spark):
    parts = ssa.SSA(12).components(series(spark, wave(120)))
    found = ssa.amplitude_variance(parts, 5)
    assert dict(found.dtypes)["signal_id"] == "bigint" and found.count() == 12
    kept = ssa.reconstruct(parts, ssa.select_oscillations(parts, 0.3, 5))
    assert dict(kept.dtypes)["signal_id"] == "bigint" and kept.count() == 120


def test_compat_counts_of_too_short_series(spark):
    with pytest.raises(Exception, match="2 \\* length"):
        spark.range(60).select(diagonal_count(F.col("id"), F.lit(60), 50, True)).collect()
