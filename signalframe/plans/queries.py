"""Each query applies one operator to whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe import functions as X
from signalframe.operators import epochs, fourier, gabor, lowrank, simulate, ssa
from signalframe.sources import binned_events, embedding_rows, first_rows, read_table, to_long, to_rows, validate_signals, within

FS = 64.0
WINDOW = 12
SIZE = 8
FILTERS = 64
SAMPLE, SEED = 200, 7


def digits(df: DataFrame, **columns: int) -> DataFrame:
    """``df`` with the given columns rounded."""
    return df.select(*[X.rounded(c, columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean signal of each label."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("row_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return to_rows(rows.groupBy("row_id", "j").agg(F.avg("v").alias("v")))


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binned event series as rows: signal_id, x."""
    return to_rows(binned_events(spark, sf_dir), "signal_id", "t", "x")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, v: every embedding as a line of an image."""
    return to_long(embedding_rows(spark, sf_dir)).select(F.col("row_id").alias("y"), F.col("j").alias("x"), "v")


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FILTERS`` Gabor filters, as many as an embedding has values, whose parameters follow the mean size of the parts dealt to each by their key."""
    part = read_table(spark, sf_dir, "part")
    sizes = part.groupBy((F.col("p_partkey") % FILTERS).alias("g")).agg(F.avg("p_size").alias("size"))
    return sizes.select("g", F.lit(0.5).alias("gamma"), (1.0 + F.col("size") / 25.0).alias("sigma_x"), (F.col("size") * F.pi() / 50).alias("theta"), (2.0 + F.col("size") / 10.0).alias("lam"), F.lit(0.1).alias("psi"))


def part_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter for each part, its parameters following the part's size."""
    part = read_table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("g"), F.lit(0.5).alias("gamma"), (1.0 + F.col("p_size") / 25.0).alias("sigma_x"), (F.col("p_size") * F.pi() / 50).alias("theta"), (2.0 + F.col("p_size") / 10.0).alias("lam"), F.lit(0.1).alias("psi"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_id, g, w: the values of every embedding as weights of the filters."""
    return to_long(embedding_rows(spark, sf_dir)).select(F.col("row_id").alias("window_id"), F.col("j").alias("g"), F.col("v").alias("w"))


def image_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gabor.windows(image(spark, sf_dir), 64, SIZE)


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trigger, time (bins): every purchase."""
    events = read_table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return events.select(F.col("event_id").alias("trigger"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 21600000000.0).alias("time"))


def epoch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = binned_events(spark, sf_dir).where("signal_id = 'view'").select(F.col("t").cast("double").alias("time"), F.col("x").alias("lfp"))
    return epochs.nearest_join(epochs.offsets(triggers(spark, sf_dir), -2, 2), views, "lfp")


def planted_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with NaN at place 3 of every fiftieth."""
    rows = embedding_rows(spark, sf_dir)
    return rows.select("row_id", F.transform("x", lambda v, j: F.when((F.col("row_id") % 50 == 0) & (j == 3), F.lit(X.NAN)).otherwise(v)).alias("x"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def _cov(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = embedding_rows(spark, sf_dir)
    return fourier.covariance(rows), validate_signals(rows)


@query
def center_columns(spark, sf_dir):
    return digits(longs(to_long(fourier.center_columns(embedding_rows(spark, sf_dir))), "j"), v=6)


@query
def circulant_matrix(spark, sf_dir):
    found = simulate.circulant(label_means(spark, sf_dir)).select("row_id", "shift", F.posexplode("x").alias("j", "v"))
    return digits(longs(found, "shift", "j"), v=6)


@query
def tile_rows(spark, sf_dir):
    found = simulate.tile(label_means(spark, sf_dir), 20).select("row_id", "copy", F.posexplode("x").alias("j", "v"))
    return digits(longs(found, "copy", "j"), v=6)


@query
def gaussian_pulse(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return parts.select("p_partkey", F.col("i").cast("long").alias("i"), X.rounded(X.gaussian(X.linspace(F.col("i"), -100.0, 100.0, 21), F.col("p_size").cast("double")), 8).alias("v"))


@query
def mix_signals(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    shifted = rows.select("row_id", X.cyclic_shift(F.col("x"), F.lit(1)).alias("x"))
    return digits(longs(to_long(simulate.mix(rows, shifted)), "j"), v=6)


@query
def dft_rows(spark, sf_dir):
    return digits(longs(fourier.dft_long(embedding_rows(spark, sf_dir)), "k"), re=6, im=6)


@query
def dft_basis(spark, sf_dir):
    """The transform of every label's mean signal by the explicit basis, which the signals' length gives."""
    rows = label_means(spark, sf_dir)
    basis = F.broadcast(fourier.dft_basis(validate_signals(rows), spark))
    met = to_long(rows).join(basis, "j").groupBy("row_id", "k").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    return digits(longs(met, "k"), re=6, im=6)


@query
def column_norms(spark, sf_dir):
    return digits(longs(fourier.column_norms(embedding_rows(spark, sf_dir)), "k"), norm=6)


@query
def eigenspectrum_full(spark, sf_dir):
    return digits(longs(fourier.eigenspectrum(embedding_rows(spark, sf_dir), FS), "k"), freq=6, power=6)


@query
def eigenspectrum_pos(spark, sf_dir):
    return digits(longs(fourier.eigenspectrum(embedding_rows(spark, sf_dir), FS, negative=False), "k"), freq=6, power=6)


@query
def spectrum_normalized(spark, sf_dir):
    return digits(longs(fourier.normalized_spectrum(fourier.eigenspectrum(embedding_rows(spark, sf_dir), FS, negative=False)), "k"), freq=6, power=6)


@query
def fft_frequencies(spark, sf_dir):
    rows = series_rows(spark, sf_dir).select("signal_id", F.size("x").alias("m"), F.posexplode("x").alias("k", "v"))
    return rows.select("signal_id", F.col("k").cast("long").alias("k"), X.rounded(X.frequency(F.col("k"), F.col("m"), 4.0), 8).alias("freq"))


@query
def covariance(spark, sf_dir):
    return digits(longs(_cov(spark, sf_dir)[0], "a", "b"), c=8)


@query
def cov_eigenspectrum(spark, sf_dir):
    cov, m = _cov(spark, sf_dir)
    return digits(longs(fourier.covariance_eigenspectrum(cov, m, FS), "k"), freq=6, power=6)


@query
def dft2(spark, sf_dir):
    cov, m = _cov(spark, sf_dir)
    return digits(longs(fourier.fourier_eig(cov, m, conjugate=False), "k", "l"), re=6, im=6)


@query
def fourier_eig(spark, sf_dir):
    cov, m = _cov(spark, sf_dir)
    return digits(longs(fourier.fourier_eig(cov, m), "k", "l"), re=6, im=6)


@query
def fourier_gram(spark, sf_dir):
    return digits(longs(fourier.gram(embedding_rows(spark, sf_dir), fourier=True).select("k", "l", "re", "im"), "k", "l"), re=6, im=6)


@query
def kappa_svd(spark, sf_dir):
    return digits(fourier.kappa_of_signals(embedding_rows(spark, sf_dir)), kappa=6)


@query
def kappa_eig(spark, sf_dir):
    return digits(fourier.kappa_of_signals(embedding_rows(spark, sf_dir), method="eig"), kappa=6)


@query
def kappa_raw(spark, sf_dir):
    return digits(fourier.kappa_of_signals(embedding_rows(spark, sf_dir), normalize=False), kappa=6)


@query
def kappa_fft(spark, sf_dir):
    return digits(fourier.kappa(fourier.gram(embedding_rows(spark, sf_dir), fourier=True), part="real"), kappa=6)


@query
def kappa_of_covariance(spark, sf_dir):
    return digits(fourier.kappa_of_signals(fourier.matrix_rows(_cov(spark, sf_dir)[0])), kappa=6)


@query
def epsilon(spark, sf_dir):
    cov, m = _cov(spark, sf_dir)
    return digits(fourier.epsilon(fourier.fourier_eig(cov, m)), epsilon=6)


@query
def kappa_convergence(spark, sf_dir):
    return digits(longs(fourier.kappa_convergence(embedding_rows(spark, sf_dir), fourier.log_sizes(10, 160, 3), 3), "size"), ratio=6, kappa=6)


@query
def spectrum_inversion(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    return digits(longs(fourier.spectrum_inversion(rows, validate_signals(rows)), "j"), v=6)


@query
def mean_psd(spark, sf_dir):
    return digits(longs(fourier.mean_psd(embedding_rows(spark, sf_dir), FS), "k"), freq=6, power=6)


@query
def welch_psd(spark, sf_dir):
    return digits(longs(fourier.welch_psd(embedding_rows(spark, sf_dir), FS, 16), "k"), freq=6, power=8)


@query
def matrix_multiply(spark, sf_dir):
    """The covariance times itself."""
    cov = _cov(spark, sf_dir)[0].select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("v"))
    return digits(longs(lowrank.matrix_multiply(cov, cov), "i", "j"), v=8)


@query
def matrix_trace(spark, sf_dir):
    return digits(lowrank.matrix_trace(_cov(spark, sf_dir)[0].select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("v"))), trace=8)


@query
def svd_values(spark, sf_dir):
    return digits(lowrank.singular_values(embedding_rows(spark, sf_dir)), sigma=6)


@query
def low_rank(spark, sf_dir):
    return digits(to_long(lowrank.low_rank(embedding_rows(spark, sf_dir), 5)), v=6)


@query
def pca(spark, sf_dir):
    return digits(lowrank.pca(embedding_rows(spark, sf_dir), 5), loading=6, variance=6)


@query
def hankel_embed(spark, sf_dir):
    return digits(longs(ssa.hankel(binned_events(spark, sf_dir), WINDOW), "i", "j"), x=6)


@query
def hankel_average(spark, sf_dir):
    return digits(longs(ssa.diagonal_average(ssa.hankel(binned_events(spark, sf_dir), WINDOW)), "t"), y=6)


@query
def lag_covariance(spark, sf_dir):
    return digits(longs(ssa.lag_covariance(binned_events(spark, sf_dir), WINDOW), "i", "j"), c=4)


@query
def diagonal_counts(spark, sf_dir):
    return _counts(spark, sf_dir, False)


@query
def diagonal_counts_compat(spark, sf_dir):
    return _counts(spark, sf_dir, True)


def _counts(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    rows = series_rows(spark, sf_dir).select("signal_id", F.size("x").cast("long").alias("n"), F.posexplode("x").alias("t", "v"))
    t = F.col("t").cast("long")
    return rows.select("signal_id", t.alias("t"), X.diagonal_count(t, F.col("n"), F.lit(50).cast("long"), compat).alias("cells"))


def _decomposition() -> ssa.SSA:
    return ssa.SSA(WINDOW)


@query
def ssa_components(spark, sf_dir):
    return digits(_decomposition().components(binned_events(spark, sf_dir)), y=4)


@query
def ssa_grouped(spark, sf_dir):
    return digits(ssa.SSA(WINDOW, group_size=3).grouped(binned_events(spark, sf_dir)), y=4)


@query
def ssa_singular_values(spark, sf_dir):
    return digits(_decomposition().singular(binned_events(spark, sf_dir)).select("signal_id", "component", "sigma"), sigma=4)


@query
def ssa_select(spark, sf_dir):
    return digits(ssa.select_oscillations(_decomposition().components(binned_events(spark, sf_dir)), 0.3, 10), amp_var=6)


@query
def ssa_reconstruct_all(spark, sf_dir):
    return digits(ssa.reconstruct(_decomposition().components(binned_events(spark, sf_dir))), y=4)


@query
def ssa_residual(spark, sf_dir):
    series = binned_events(spark, sf_dir)
    return digits(ssa.residual(series, ssa.reconstruct(_decomposition().components(series))), residual=4)


@query
def gabor_grid(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    found = gabor.grid(part, 4 + F.col("p_size") % 5, ["p_partkey"])
    return digits(longs(found, "xi", "yi"), gx=8, gy=8)


@query
def gabor_basis(spark, sf_dir):
    return digits(longs(gabor.basis(part_filters(spark, sf_dir), SIZE), "g", "xi", "yi"), v=8)


@query
def gabor_forward(spark, sf_dir):
    return digits(longs(gabor.forward(weights(spark, sf_dir), gabor.basis(filters(spark, sf_dir), SIZE), SIZE), "p"), v=6)


@query
def gabor_mse(spark, sf_dir):
    made = gabor.forward(weights(spark, sf_dir), gabor.basis(filters(spark, sf_dir), SIZE), SIZE)
    return digits(gabor.mse(made, image_windows(spark, sf_dir)), mse=6)


@query
def gabor_sparsity(spark, sf_dir):
    return digits(gabor.sparsity(weights(spark, sf_dir), 0.01), penalty=6)


def label_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, window_id, p, v: the embeddings of each label as an image."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("window_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))


@query
def gabor_fit(spark, sf_dir):
    """The loss of each epoch of a fit to the embeddings of each label as an image."""
    return digits(gabor.GaborLearner(SIZE, 4, epochs=50).fit(label_images(spark, sf_dir)), loss=4)


@query
def gabor_model(spark, sf_dir):
    """Fitted models, and the error of the windows rebuilt from their filters and weights beside the loss that the fit ended with."""
    values = label_images(spark, sf_dir)
    model = gabor.GaborLearner(SIZE, 4, epochs=50, normalize=False).model(values)
    met = gabor.rebuilt(model, SIZE).withColumnRenamed("v", "made").join(values, ["image_id", "window_id", "p"])
    errors = met.groupBy("image_id").agg(F.avg((F.col("made") - F.col("v")) * (F.col("made") - F.col("v"))).alias("error"))
    return digits(errors.join(model.select("image_id", "loss"), "image_id"), error=4, loss=4)


@query
def global_standardize(spark, sf_dir):
    return digits(longs(gabor.standardize(image_windows(spark, sf_dir)), "p"), v=6)


@query
def image_windows_(spark, sf_dir):
    return digits(longs(gabor.windows(image(spark, sf_dir), 64, SIZE, layout="tile"), "p"), v=6)


Q["image_windows"] = Q.pop("image_windows_")


@query
def image_crop(spark, sf_dir):
    return digits(longs(gabor.crop(image(spark, sf_dir), 1 << 40, 48), "x"), v=6)


@query
def image_mse(spark, sf_dir):
    """The error of the image against its standardised self, rounded as reports show it."""
    plain = image_windows(spark, sf_dir)
    return digits(gabor.mse(gabor.standardize(plain), plain), mse=4)


@query
def distinct_types(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_type").distinct().where("event_type <> 'error'").orderBy("event_type")


@query
def epoch_nearest(spark, sf_dir):
    return digits(longs(epoch_table(spark, sf_dir), "shift"), time=6, found_time=6, lfp=6)


@query
def epoch_rows(spark, sf_dir):
    found = epochs.epoch_rows(epoch_table(spark, sf_dir), "trigger", "lfp").select("trigger", F.posexplode("x").alias("place", "v"))
    return digits(longs(found, "place"), v=6)


@query
def drop_nan_rows(spark, sf_dir):
    return digits(longs(to_long(planted_nan(spark, sf_dir).where(~X.has_nan(F.col("x")))), "j"), v=6)


@query
def limit_rows(spark, sf_dir):
    return read_table(spark, sf_dir, "events").orderBy("event_type", "event_id").limit(500).select("event_type", "event_id")


@query
def sample_rows(spark, sf_dir):
    return epochs.sample_rows(embedding_rows(spark, sf_dir), SAMPLE, SEED).select("row_id")


@query
def label_format(spark, sf_dir):
    names = read_table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit("_of_"), F.col("user_id").cast("string"), F.lit("_users")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", epochs.label(F.col("name")).alias("label"), "n")


@query
def row_gather(spark, sf_dir):
    """Every tenth signal."""
    return digits(longs(to_long(embedding_rows(spark, sf_dir).where("row_id % 10 = 0")), "j"), v=6)


@query
def row_zscore(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir).select("row_id", X.z_score(F.col("x")).alias("x"))
    return digits(longs(to_long(rows), "j"), v=6)


@query
def shuffled_rows(spark, sf_dir):
    return longs(epochs.shuffled(embedding_rows(spark, sf_dir), SEED).select("row_id", "place"), "place")


@query
def stacked_shuffles(spark, sf_dir):
    """Twenty seeded orders of all signals, one above another."""
    return longs(epochs.shuffled(embedding_rows(spark, sf_dir), list(range(20))).select("seed", "row_id", "place"), "seed", "place")


@query
def padded_rows(spark, sf_dir):
    """The binned event series between zeros."""
    rows = series_rows(spark, sf_dir).select("signal_id", simulate.pad(F.col("x"), 20, 30).alias("x"))
    return digits(longs(rows.select("signal_id", F.posexplode("x").alias("j", "v")), "j"), v=6)


@query
def first_row(spark, sf_dir):
    """The first event of each type of those that pass quality limits, of which one is switched off."""
    events = read_table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value")
    found = first_rows(within(events, value=(1.0, math.inf), user_id=(-math.inf, math.inf)), ["event_id"], ["event_type"])
    return digits(found, value=6)


@query
def skipped_names(spark, sf_dir):
    """The events whose type isn't among those of which a series has an empty bin or the type is an error."""
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"))
    empty = binned_events(spark, sf_dir).where("x = 0").select(F.col("signal_id").alias("name"))
    skipped = empty.unionByName(events.where("name = 'error'").select("name"))
    return epochs.unlisted(events, skipped).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query
def svd_energy(spark, sf_dir):
    """The squares of all singular values summed, which are the squares of all values."""
    return lowrank.singular_values(embedding_rows(spark, sf_dir)).agg(X.rounded(F.sum(F.col("sigma") * F.col("sigma")), 4).alias("energy"))


@query
def svd_rebuilt(spark, sf_dir):
    """Every signal rebuilt from left vectors, singular values and right vectors."""
    u, s, v = lowrank.svd(embedding_rows(spark, sf_dir))
    return digits(longs(to_long(lowrank.projected(u.withColumnRenamed("u", "x"), (v * s).T, "x")), "j"), v=4)


@query
def low_rank_full(spark, sf_dir):
    """The approximation of full rank, which is the signals."""
    rows = embedding_rows(spark, sf_dir)
    return digits(longs(to_long(lowrank.low_rank(rows, validate_signals(rows))), "j"), v=4)


@query
def subspace_energy(spark, sf_dir):
    """The energy that randomised subspace iteration finds with as many vectors as signals have values."""
    rows = embedding_rows(spark, sf_dir)
    sigma, _ = lowrank.subspace(rows, validate_signals(rows), rounds=1)
    return spark.createDataFrame([(round(float((sigma**2).sum()), 4),)], "energy double")


@query
def pca_variance(spark, sf_dir):
    """The variances of all principal components summed, which are those of all columns."""
    rows = embedding_rows(spark, sf_dir)
    found = lowrank.pca(rows, validate_signals(rows)).select("component", "variance").distinct()
    return found.agg(X.rounded(F.sum("variance"), 4).alias("variance"))


@query
def ssa_energy(spark, sf_dir):
    """The squared singular values of each series summed, which are the squares of the trajectory matrix."""
    found = _decomposition().singular(binned_events(spark, sf_dir))
    return found.groupBy("signal_id").agg(X.rounded(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


@query
def ssa_long_energy(spark, sf_dir):
    """The same of a decomposition in chunks of 50 values."""
    found = _decomposition().fit_long(binned_events(spark, sf_dir), 50)
    return found.groupBy("signal_id").agg(X.rounded(F.sum(F.col("sigma") * F.col("sigma")), 2).alias("energy"))


@query
def ssa_long_components(spark, sf_dir):
    """The leading components of every series, decomposed and convolved in chunks of 50 values."""
    series = binned_events(spark, sf_dir)
    fitted = ssa.SSA(WINDOW, n_components=3).fit_long(series, 50)
    return digits(ssa.long_components(series, fitted, WINDOW, 50), y=4)


@query
def ssa_truncated(spark, sf_dir):
    """The greatest singular values of every series by Lanczos bidiagonalisation."""
    found = ssa.SSA(WINDOW, n_components=3, solver="lanczos").fit(binned_events(spark, sf_dir))
    return digits(found.select("signal_id", "component", "sigma"), sigma=4)


@query
def gabor_train(spark, sf_dir):
    """The loss of each epoch of a fit of all embeddings as one image, over all tasks."""
    windows = image_windows(spark, sf_dir)
    losses = gabor.GaborLearner(SIZE, 8, epochs=6).train(windows).losses
    return digits(spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double"), loss=6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


