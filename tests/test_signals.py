import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalframe.functions import cyclic_shift, gaussian, linspace
from signalframe.operators import epochs, fourier, gabor, lowrank, simulate, ssa
from signalframe.sources import to_long, to_rows, validate_signals

X3 = [[1.0, 2, 3, 4], [4.0, 3, 2, 1], [1.0, 0, 1, 0]]


def rows_of(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(matrix)], "row_id long, x array<double>")


def column(df, by, value):
    return [r[value] for r in df.orderBy(by).collect()]


def test_circulant(spark):
    got = simulate.circulant(rows_of(spark, [[1, 2, 3, 4]])).orderBy("shift").collect()
    assert [r["x"] for r in got] == [[1, 2, 3, 4], [4, 1, 2, 3], [3, 4, 1, 2], [2, 3, 4, 1]]


def test_eigenspectrum_of_one_signal(spark):
    rows = rows_of(spark, [[1, 2, 3, 4]])
    full = fourier.eigenspectrum(rows, 4)
    assert column(full, "k", "freq") == [0, 1, -2, -1] and np.allclose(column(full, "k", "power"), [6.25, 0.5, 0.25, 0.5])
    assert np.allclose(column(fourier.eigenspectrum(rows, 4, negative=False), "k", "power"), [6.25, 0.5])
    with pytest.raises(ValueError, match="fs"):
        fourier.eigenspectrum(rows, 0)


def test_golden_matrix(spark):
    rows = rows_of(spark, X3)
    one = lambda df: df.first()[0]
    assert np.isclose(one(fourier.kappa_of_signals(rows)), 0.7219643056)
    assert np.isclose(one(fourier.kappa_of_signals(rows, method="eig")), 0.7219643056)
    assert np.isclose(one(fourier.kappa_of_signals(rows, normalize=False)), 0.8971910316)
    assert np.isclose(one(fourier.kappa(fourier.gram(rows, fourier=True), part="real")), 0.9489795918)
    cov = fourier.covariance(rows)
    assert np.isclose(one(fourier.kappa_of_signals(fourier.matrix_rows(cov))), 0.5743349822)
    assert np.allclose([r["c"] for r in cov.orderBy("a", "b").collect()], np.cov(np.array(X3).T).ravel())
    assert np.allclose(column(fourier.eigenspectrum(rows, 4), "k", "power"), [12.75, 1, 0.75, 1])
    assert np.allclose(column(fourier.covariance_eigenspectrum(cov, 4, 4), "k", "power"), [5.3333333333, 2])
    assert np.isclose(one(fourier.epsilon(fourier.fourier_eig(cov, 4))), 4.8888888889)
    own = np.fft.fft(np.eye(4)) / 2
    assert np.isclose(one(fourier.kappa_of_signals(rows, basis=own)), 0.7219643056)
    assert np.isclose(one(fourier.kappa_of_signals(rows, basis=np.linalg.eigh(np.cov(np.array(X3).T))[1].astype(complex))), 1.0)
    with pytest.raises(ValueError, match="method"):
        fourier.kappa_of_signals(rows, method="qr")


def test_kappa_bounds(spark):
    delta = rows_of(spark, [[1.0] + [0.0] * 63] * 5)
    assert np.isclose(fourier.kappa_of_signals(delta, normalize=False).first()[0], 0.5)
    shifts = simulate.circulant(rows_of(spark, [list(np.random.default_rng(0).random(9))])).select(("shift"), "x").withColumnRenamed("shift", "row_id")
    assert np.isclose(fourier.kappa_of_signals(shifts).first()[0], 1.0)
    assert np.isnan(fourier.kappa_of_signals(rows_of(spark, [[0.0, 0.0]] * 3)).first()[0])


@pytest.mark.parametrize("m", [7, 8])
def test_transforms_and_relations(spark, m):
    x = np.random.default_rng(m).standard_normal((11, m))
    rows = rows_of(spark, x)
    got = to_rows(fourier.dft_long(rows), "row_id", "k", "re").orderBy("row_id").collect()
    assert np.allclose([r["x"] for r in got], (np.fft.fft(x, axis=1) / np.sqrt(m)).real)
    p = np.array(column(fourier.eigenspectrum(rows, m), "k", "power"))
    assert np.isclose(p.sum(), (x**2).sum() / m) and np.allclose(p[1:], p[1:][::-1])
    centred = x - x.mean(axis=0)
    of_cov = column(fourier.covariance_eigenspectrum(fourier.covariance(rows), m, m), "k", "power")
    of_rows = column(fourier.eigenspectrum(rows_of(spark, centred), m, negative=False), "k", "power")
    assert np.allclose(of_cov, np.array(of_rows) * m / 10)
    both = fourier.fourier_eig(fourier.covariance(rows), m, conjugate=False).orderBy("k", "l").collect()
    assert np.allclose([r["re"] + 1j * r["im"] for r in both], (np.fft.fft2(np.cov(x.T)) / m).ravel())
    assert np.allclose([[r["re"], r["im"]] for r in fourier.dft_basis(m, spark).orderBy("j", "k").collect()], np.stack([(np.fft.fft(np.eye(m)) / np.sqrt(m)).ravel().real, (np.fft.fft(np.eye(m)) / np.sqrt(m)).ravel().imag], 1))


def test_inversion_recovers_what_is_not_locked(spark):
    rng = np.random.default_rng(0)
    m, n = 32, 300
    free = rng.standard_normal((n, m)).cumsum(axis=1)
    free -= free.mean(axis=1, keepdims=True)
    rows = rows_of(spark, free + 40 * np.sin(2 * np.pi * 4 * np.arange(m) / m))
    got = np.array([r["x"] for r in to_rows(fourier.spectrum_inversion(rows, m)).orderBy("row_id").collect()])
    before = np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(free + 40 * np.sin(2 * np.pi * 4 * np.arange(m) / m), free, strict=True)])
    assert np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(got, free, strict=True)]) > before + 0.1


def test_ssa_golden(spark):
    series = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate([1, 2, 3, 4, 5])], "signal_id string, t long, x double")
    model = ssa.SSA(2)
    parts = model.components(series).orderBy("component", "t").collect()
    assert np.allclose([r["y"] for r in parts], [1.314152, 1.957826, 2.936739, 3.915653, 5.134022, -0.314152, 0.042174, 0.063261, 0.084347, -0.134022], atol=1e-6)
    assert np.allclose(column(model.singular(series), "component", "sigma"), [9.152116, 0.488645], atol=1e-6)
    assert np.allclose(column(ssa.reconstruct(model.components(series)), "t", "y"), [1, 2, 3, 4, 5])
    assert np.allclose(column(ssa.SSA(2, solver="gram").grouped(series).where("component = 1"), "t", "y"), [-0.314152, 0.042174, 0.063261, 0.084347, -0.134022], atol=1e-6)
    padded = ssa.SSA(2, n_components=4).components(series)
    assert padded.select("component").distinct().count() == 4 and padded.where("component > 1 and y <> 0").count() == 0
    assert np.allclose(column(ssa.diagonal_average(ssa.hankel(series, 3)), "t", "y"), [1, 2, 3, 4, 5])
    with pytest.raises(ValueError, match="window"):
        ssa.hankel(series, 6)
    with pytest.raises(ValueError, match="group_size"):
        ssa.SSA(2, group_size=0)


def test_diagonal_counts(spark):
    from pyspark.sql import functions as F

    from signalframe.functions import diagonal_count

    def counts(n, length, compat=False):
        return [r[0] for r in spark.range(n).select(diagonal_count(F.col("id"), F.lit(n), length, compat)).collect()]

    assert counts(5, 3) == [1, 2, 3, 2, 1] and counts(6, 3) == [1, 2, 3, 3, 2, 1] and counts(4, 3) == [1, 2, 2, 1]
    assert counts(5, 3, True) == [1, 1, 1, 1, 1] and counts(6, 3, True) == [1, 2, 2, 2, 2, 1] and counts(7, 3, True) == [1, 2, 3, 3, 3, 2, 1]


def test_low_rank(spark):
    x = np.random.default_rng(1).standard_normal((20, 6))
    rows = rows_of(spark, x)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(column(lowrank.singular_values(rows), "component", "sigma"), s)
    got = [r["x"] for r in lowrank.low_rank(rows, 2).orderBy("row_id").collect()]
    assert np.allclose(got, (u[:, :2] * s[:2]) @ vt[:2])
    assert np.allclose(sorted({r["variance"] for r in lowrank.pca(rows, 2).collect()}), np.sort(np.linalg.eigvalsh(np.cov(x.T)))[-2:])


def test_nearest_join(spark):
    rng = np.random.default_rng(2)
    samples = [(k, float(t), float(100 * k + t)) for k in range(2) for t in rng.choice(60, 20, replace=False)]
    wanted = [(k, float(t) / 2, int(n)) for n, (k, t) in enumerate(zip(rng.integers(0, 2, 80), rng.integers(-10, 140, 80), strict=True))]
    s = spark.createDataFrame(samples, "c int, time double, v double")
    w = spark.createDataFrame([(int(k), t, n) for k, t, n in wanted], "c int, time double, n int")
    expected = {n: min(((abs(st - q), -st), v) for c, st, v in samples if c == k)[1] for k, q, n in wanted}
    for parts in (None, 1, 7):
        got = {r["n"]: r["v"] for r in epochs.nearest_join(w, s, "v", by=["c"], parts=parts).collect()}
        assert got == expected


def test_nearest_join_of_nulls_and_equal_times(spark):
    nan = float("nan")
    s = spark.createDataFrame([(1, 1.0, 5.0), (1, 1.0, 7.0), (1, 1.0, None), (None, 2.0, 8.0), (1, None, 9.0), (1, nan, 3.0), (2, 4.0, None)], "c int, time double, v double")
    w = spark.createDataFrame([(1, 0.0, 1), (None, 0.0, 2), (1, None, 3), (1, nan, 4), (3, 1.0, 5), (2, 9.0, 6), (1, 1.0, 7), (1, 1.0, 8)], "c int, time double, n int")
    for parts in (1, 4):
        got = {r["n"]: (r["found_time"], r["v"]) for r in epochs.nearest_join(w, s, "v", by=["c"], parts=parts).collect()}
        assert got == {1: (1.0, 7.0), 2: (2.0, 8.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (4.0, None), 7: (1.0, 7.0), 8: (1.0, 7.0)}
    assert epochs.nearest_join(w, s.where("false"), "v", by=["c"]).where("v IS NULL").count() == 8
    assert epochs.nearest_join(w.where("false"), s, "v", by=["c"]).count() == 0


def test_nearest_join_of_one_long_key(spark):
    samples = spark.range(200_000).select((F.col("id") * 4).alias("time"), F.col("id").alias("v"))
    wanted = spark.range(800_000).select(F.col("id").alias("time"), F.col("id").alias("n"))
    began = time.time()
    found = epochs.nearest_join(wanted, samples, "v", parts=40)
    nearest = F.least(F.floor((F.col("n") + 2) / 4), F.lit(199_999))
    assert found.where(nearest != F.col("v")).count() == 0 and found.count() == 800_000
    assert time.time() - began < 90


def test_gabor(spark):
    learner = gabor.GaborLearner(8, 3, penalty=0.02)
    rng = np.random.default_rng(0)
    p, w, x = rng.standard_normal((5, 3)) + 2, rng.standard_normal((4, 3)), rng.standard_normal((4, 64))
    _, dp, dw = learner._step(p, w, x)
    for value, grad in ((p, dp), (w, dw)):
        for at in [(0, 0), (1, 2), (3, 1), (2, 0)]:
            keep, h = value[at], 1e-6
            value[at] = keep + h
            up = learner._step(p, w, x)[0]
            value[at] = keep - h
            down = learner._step(p, w, x)[0]
            value[at] = keep
            assert np.isclose((up - down) / (2 * h), grad[at], rtol=1e-4, atol=1e-8)
    values = spark.createDataFrame([(1, i, q, float(v)) for i, r in enumerate(x) for q, v in enumerate(r)], "image_id int, window_id int, p int, v double")
    loss = column(gabor.GaborLearner(8, 3, epochs=60).fit(values), "epoch", "loss")
    assert loss[-1] < loss[0]
    w2 = spark.createDataFrame([(0, 0, 3.0), (0, 1, -4.0)], "window_id int, g int, w double")
    assert np.isclose(gabor.sparsity(w2, 1.0).first()[0], 1.4)


def test_sources_and_generators(spark):
    from pyspark.sql import functions as F

    rows = rows_of(spark, X3)
    assert validate_signals(rows) == 4 and [r["x"] for r in to_rows(to_long(rows)).orderBy("row_id").collect()] == X3
    with pytest.raises(ValueError, match="one length"):
        validate_signals(rows_of(spark, [[1], [1, 2]]))
    a = [r["x"] for r in simulate.power_law(spark, 3, 64, -2.0, 5).collect()]
    assert a == [r["x"] for r in simulate.power_law(spark, 3, 64, -2.0, 5).repartition(2).orderBy("row_id").collect()]
    for kind in ("normal", "uniform", "exponential"):
        assert simulate.random_rows(spark, 4, 5, kind, 1).count() == 4
    v = spark.range(5).select(simulate.sine(F.col("id") / 4, 1.0).alias("v")).collect()
    assert np.allclose([r["v"] for r in v], [0, 1, 0, -1, 0])
    assert spark.range(1).select(gaussian(F.lit(0.0), F.lit(2.0)), linspace(F.lit(3), -4.0, 4.0, 8)).first()[1] == pytest.approx(-4 + 24 / 7)
    assert spark.range(1).select(cyclic_shift(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(-1))).first()[0] == [2, 3, 1]
    assert spark.range(1).select(epochs.label(F.lit("natural_movie_one"))).first()[0] == "Natural Movie One"
    assert spark.range(1).select(simulate.pad(F.array(F.lit(1.0)), 1, 2)).first()[0] == [0, 1, 0, 0]


def test_ragged_and_null_signals(spark):
    good = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, [1.0]), (3, [])], "row_id long, x array<double>")
    got = {r["row_id"]: r["re"] for r in fourier.dft_rows(good).collect()}
    assert got[1] is None and got[3] == [] and np.allclose(got[0], np.fft.fft([1, 2, 3]).real / np.sqrt(3)) and got[2] == [1.0]
    for rows in ([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0, 7.0, 8.0])], [(0, [1.0, None])], [(0, None), (1, [1.0])]):
        with pytest.raises(Exception, match="signal"):
            fourier.gram(spark.createDataFrame(rows, "row_id long, x array<double>").coalesce(1)).collect()
    assert fourier.gram(good.where("false")).count() == 0


def test_fourier_eig_of_a_large_matrix(spark):
    m = 1000
    c = np.fromfunction(lambda a, b: np.cos((a * 7 + b * 3) % 11), (m, m))
    long = spark.range(m * m).select(F.floor(F.col("id") / m).cast("int").alias("a"), (F.col("id") % m).cast("int").alias("b")).withColumn("c", F.cos(((F.col("a") * 7 + F.col("b") * 3) % 11).cast("double")))
    v = np.fft.fft(np.eye(m)) / np.sqrt(m)
    expected = v.conj().T @ c @ v
    got = fourier.fourier_eig(long, m).where("k < 3").collect()
    assert len(got) == 3 * m and np.allclose([complex(r["re"], r["im"]) for r in got], [expected[r["k"], r["l"]] for r in got], atol=1e-8)
    few, q = c[:6, :6], np.linalg.qr(np.random.default_rng(1).standard_normal((6, 6)))[0]
    small = spark.createDataFrame([(a, b, float(few[a, b])) for a in range(6) for b in range(6)], "a int, b int, c double")
    got = fourier.fourier_eig(small, 6, basis=q).collect()
    assert np.allclose([r["re"] for r in got], [(q.T @ few @ q)[r["k"], r["l"]] for r in got])


def test_kappa_convergence_is_of_the_covariance(spark):
    x = np.random.default_rng(3).standard_normal((30, 5)).cumsum(axis=1)
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "row_id long, x array<double>")
    c = np.cov(x.T)
    u = np.fft.fft(c - c.mean(axis=0), axis=1) / np.sqrt(5)
    s = np.abs(u.conj().T @ u)
    d, o = np.trace(s) / 5, (s.sum() - np.trace(s)) / 20
    got = fourier.kappa_convergence(rows, [30], 2).first()
    assert np.isclose(got["kappa"], d / (d + o)) and got["ratio"] == 6
    assert fourier.log_sizes(10, 1000, 3) == [10, 100, 1000]


def test_nearest_join_of_many_rows_of_one_key(spark):
    samples = spark.range(50_000).select(F.lit(1).alias("c"), (F.col("id") * 2.0).alias("time"), F.col("id").alias("v"))
    wanted = spark.range(50_000).select(F.lit(1).alias("c"), (F.col("id") * 2.0 + 0.5).alias("time"), F.col("id").alias("n"))
    began = time.time()
    assert epochs.nearest_join(wanted, samples, "v", by=["c"]).where("n <> v").count() == 0
    assert time.time() - began < 60


def test_stacked_shuffles_and_skipped_names(spark):
    rows = spark.range(200).select(F.col("id").alias("row_id"))
    got = epochs.shuffled(rows, [1, 2]).collect()
    for seed in (1, 2):
        order = sorted((hashlib.md5(f"{seed}:{n}".encode()).hexdigest(), n) for n in range(200))
        assert [n for _, n in order] == [r["row_id"] for r in sorted(got, key=lambda r: r["place"]) if r["seed"] == seed]
    names = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, n int")
    assert sorted(r["n"] for r in epochs.unlisted(names, names.where("n = 1")).collect()) == [2, 3]


def test_fitted_gabors_rebuild_the_image(spark):
    x = np.random.default_rng(0).standard_normal((6, 16))
    rows = spark.createDataFrame([(1, n, p, float(x[n, p])) for n in range(6) for p in range(16)], "image_id int, window_id long, p int, v double")
    learner = gabor.GaborLearner(4, 3, epochs=40, normalize=False)
    model = learner.model(rows).cache()
    made = {(r["window_id"], r["p"]): r["v"] for r in gabor.rebuilt(model, 4).collect()}
    error = np.mean([(made[n, p] - x[n, p]) ** 2 for n in range(6) for p in range(16)])
    got = model.first()
    assert np.isclose(error, got["loss"]) and got["loss"] < got["losses"][0] and len(got["losses"]) == 40
    assert gabor.fitted_params(model).count() == 3 and gabor.fitted_weights(model).count() == 18


def test_ssa_from_one_decomposition(spark):
    x = np.sin(np.arange(30)) + np.arange(30) / 10
    signals = spark.createDataFrame([(7, t, float(v)) for t, v in enumerate(x)], "signal_id long, t long, x double")
    fitted = ssa.SSA(6, n_components=9).fit(signals).cache()
    assert fitted.count() == 9 and fitted.where("sigma = 0").count() == 3
    y = {r["t"]: r["y"] for r in ssa.reconstruct(ssa.expanded(fitted)).collect()}
    assert np.allclose([y[t] for t in range(30)], x)


def test_low_rank_of_nothing(spark):
    none = spark.createDataFrame([], "row_id long, x array<double>")
    assert lowrank.singular_values(none).count() == 0 and lowrank.low_rank(none, 2).count() == 0 and lowrank.pca(none, 2).count() == 0
    u, s, v = lowrank.svd(none)
    assert u.count() == 0 and len(s) == 0 and v.size == 0
