"""Singular spectrum analysis: trajectory matrix, decomposition, grouping, diagonal averaging.

``SSA.fit`` decomposes each signal in one task, many signals side by side. A long signal
is cut into chunks that overlap by a window instead (``SSA.fit_long``): lag products are
summed over chunks, the window * window lag covariance follows from L sums and the values
at both ends, and components are convolved chunk by chunk (``long_components``).
Components come out ungrouped in long form; grouping and sums are aggregations, which
linearity allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.tables import materialise, shuffle_partitions

Solver = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def lapack(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(h, full_matrices=False)
    return u, s, vt.T


def by_gram(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the eigenpairs of H'H: cheaper for long signals, blurring values below about 1e-8 of the largest."""
    values, v = np.linalg.eigh(h.T @ h)
    s, v = np.sqrt(np.maximum(values[::-1], 0)), v[:, ::-1]
    keep = min(h.shape)
    s, v = s[:keep], v[:, :keep]
    return np.divide(h @ v, s, out=np.zeros((len(h), keep)), where=s > 0), s, v


def _products(x: np.ndarray, window: int) -> tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """The products of the trajectory matrix, and of its transpose, with a vector, by transforms."""
    size = 1 << (len(x) + window).bit_length()
    spectrum = np.fft.rfft(x, size)

    def meets(v: np.ndarray, length: int) -> np.ndarray:
        return np.fft.irfft(spectrum * np.fft.rfft(v, size).conj(), size)[:length]

    return lambda v: meets(v, len(x) - window + 1), lambda u: meets(u, window)


def truncated(x: np.ndarray, window: int, most: int, tolerance: float = 1e-11, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, v of the ``most`` greatest singular values of the trajectory matrix, which is never made.

    Lanczos bidiagonalisation with full reorthogonalisation (Golub and Kahan): steps are
    added until the wanted values have an error under ``tolerance`` times the greatest. Where the
    recurrence breaks off, it goes on with a random direction, so repeated values are found.
    """
    ahead, back = _products(x, window)
    rng, whole = np.random.default_rng(seed), min(window, len(x) - window + 1)
    most = min(most, whole)

    def cleared(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for lo in range(0, len(basis), 64):
                some = np.array(basis[lo : lo + 64])
                w = w - (some @ w) @ some
        return w

    def direction(w: np.ndarray, basis: list[np.ndarray], scale: float) -> tuple[float, np.ndarray]:
        w = cleared(w, basis)
        norm = float(np.linalg.norm(w))
        if norm > 1e-14 * scale:
            return norm, w / norm
        w = cleared(rng.standard_normal(len(w)), basis)
        return 0.0, w / np.linalg.norm(w)

    scale = float(np.abs(x).max()) * np.sqrt(whole) or 1.0
    us, alphas, betas = [], [], []
    vs = [direction(rng.standard_normal(window), [], 0.0)[1]]
    while True:
        w = ahead(vs[-1]) - (betas[-1] * us[-1] if us else 0)
        alpha, u = direction(w, us, scale)
        us.append(u)
        alphas.append(alpha)
        done = len(us) == whole
        if not done:
            beta, v = direction(back(u) - alpha * vs[-1], vs, scale)
            betas.append(beta)
        if done or (len(us) >= 2 * most and len(us) % 10 == 0):
            p, s, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(us) - 1], 1))
            if done or (len(s) >= most and np.abs(betas[-1] * p[-1, :most]).max() <= tolerance * s[0]):
                return np.array(us).T @ p[:, :most], s[:most], np.array(vs[: len(us)]).T @ qt[:most].T
        vs.append(v)


SOLVERS: dict[str, Solver] = {"lapack": lapack, "gram": by_gram}
TRUNCATED = "lanczos"


def checked(signals: DataFrame) -> DataFrame:
    """signal_id, n: the lengths. Raises unless the times of every signal run from 0 to n - 1 (repeats are found where a signal is gathered) and no value is null."""
    lengths = materialise(signals.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), F.count("x").alias("known")))
    bad = lengths.where("low IS NULL OR low <> 0 OR high + 1 <> n OR known <> n").first()
    if bad:
        raise ValueError(f"signal {bad['signal_id']!r}: {bad['n']} times from {bad['low']} to {bad['high']}, {bad['known']} values; times must run from 0 without gaps, values must not be null")
    return lengths.select("signal_id", "n")


def in_order(t: np.ndarray, name: object) -> np.ndarray:
    """The order of times; raises if they have a gap or a repeat."""
    order = np.argsort(t, kind="stable")
    if (np.diff(t[order]) != 1).any():
        raise ValueError(f"the times of signal {name!r} have gaps or repeats")
    return order


def hankel(signals: DataFrame, window: int) -> DataFrame:
    """signal_id, i, j, x: the trajectory matrix, x[i + j], of series (signal_id, t, x)."""
    last = signals.groupBy("signal_id").agg((F.max("t") + 1).alias("n"))
    met = signals.join(last, "signal_id")
    if not met.where(F.col("n") < window).isEmpty():
        raise ValueError("the window is longer than a signal")
    low, high = F.greatest(F.lit(0), F.col("t") - (F.col("n") - window)), F.least(F.lit(window - 1), F.col("t"))
    return met.select("signal_id", "t", "x", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("j")).select("signal_id", (F.col("t") - F.col("j")).alias("i"), "j", "x")


def diagonal_average(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by,) t, y: the mean of each anti-diagonal of matrices in long form (i, j, x)."""
    by = by or ["signal_id"]
    return cells.groupBy(*by, (F.col("i") + F.col("j")).alias("t")).agg(F.avg("x").alias("y"))


def in_chunks(signals: DataFrame, size: int, before: int, behind: int) -> DataFrame:
    """``signals`` with chunk: each value in its own chunk of ``size`` times, and in those whose halo of ``before`` and ``behind`` times has it."""
    low, high = F.floor((F.col("t") - behind) / size), F.floor((F.col("t") + before) / size)
    chunk = F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), high.cast("int")))
    return signals.select("signal_id", "t", "x", chunk.alias("chunk"))


def chunk_size(window: int) -> int:
    return max(1 << 14, 4 * window)


def lag_sums(signals: DataFrame, window: int, size: int | None = None) -> DataFrame:
    """signal_id, lag, c, n, head, tail: the first row of the lag covariance, and the first and last window - 1 values that the others follow from."""
    size = size or chunk_size(window)
    lengths = checked(signals)
    if not lengths.where(F.col("n") < window).isEmpty():
        raise ValueError("the window is longer than a signal")
    kind = signals.schema["signal_id"].dataType.simpleString()

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        name, chunk = pdf["signal_id"].iloc[0], int(pdf["chunk"].iloc[0])
        t = pdf["t"].to_numpy()
        order = in_order(t, name)
        first, x = t[order[0]], pdf["x"].to_numpy(float)[order]
        own = min((chunk + 1) * size - first, len(x) - window + 1)  # starts of whole windows
        if own <= 0:
            return pd.DataFrame({"signal_id": [], "lag": [], "c": []})
        return pd.DataFrame({"signal_id": name, "lag": np.arange(window), "c": np.correlate(x[: own + window - 1], x[:own], "valid")})

    parts = in_chunks(signals, size, 0, window - 1).groupBy("signal_id", "chunk").applyInPandas(sums, f"signal_id {kind}, lag int, c double")
    products = parts.groupBy("signal_id", "lag").agg(F.sum("c").alias("c"))
    ends = signals.join(lengths, "signal_id").where((F.col("t") < window - 1) | (F.col("t") > F.col("n") - window)).groupBy("signal_id", "n").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    at = lambda keep: F.transform(F.filter("s", keep), lambda v: v["x"].cast("double"))
    ends = ends.select("signal_id", "n", at(lambda v: v["t"] < window - 1).alias("head"), at(lambda v: v["t"] > F.col("n") - window).alias("tail"))
    if window == 1:
        ends = lengths.select("signal_id", "n", F.array().cast("array<double>").alias("head"), F.array().cast("array<double>").alias("tail"))
    return products.join(ends, "signal_id")


def diagonal(lag: int, c: float, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The cells (i, i + lag) of the lag covariance: each less what leaves and with what enters at the ends."""
    steps = len(head) - lag
    return c + np.append(0.0, np.cumsum(tail[:steps] * tail[lag : lag + steps] - head[:steps] * head[lag : lag + steps])) if steps > 0 else np.array([c])


def lag_covariance(signals: DataFrame, window: int, size: int | None = None) -> DataFrame:
    """signal_id, i, j, c: the products of the trajectory matrix's columns summed over its rows, in work of N * window; a signal of any length, in chunks."""

    @F.pandas_udf("array<double>")
    def cells(lag: pd.Series, c: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([diagonal(*row) for row in zip(lag, c, head, tail, strict=True)], dtype=object)

    rows = lag_sums(signals, window, size).select("signal_id", "lag", F.posexplode(cells("lag", "c", "head", "tail")).alias("i", "c"))
    both = F.when(F.col("lag") == 0, F.array(F.struct(F.col("i").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct(F.col("i").alias("i"), (F.col("i") + F.col("lag")).alias("j")), F.struct((F.col("i") + F.col("lag")).alias("i"), F.col("i").alias("j"))))
    return rows.select("signal_id", F.explode(both).alias("at"), "c").select("signal_id", "at.i", "at.j", "c")


@dataclass(frozen=True)
class SSA:
    """Options of a decomposition; ``fit`` returns its results as DataFrames."""

    window: int
    group_size: int = 1
    n_components: int | None = None
    solver: str | Solver = "lapack"

    def __post_init__(self) -> None:
        if self.group_size < 1 or self.window < 1:
            raise ValueError("window and group_size must be at least 1")

    def fit(self, signals: DataFrame) -> DataFrame:
        """signal_id, component, n (the signal's length), sigma, u, v: one decomposition of each signal, from which all else follows. A signal is decomposed by one task. ``n_components`` beyond the rank are zeros. The solver 'lanczos' makes ``n_components`` only."""
        few = self.solver == TRUNCATED
        solver = None if few else SOLVERS[self.solver] if isinstance(self.solver, str) else self.solver
        window, most = self.window, self.n_components
        checked(signals)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf["x"].to_numpy(float)[in_order(pdf["t"].to_numpy(), pdf["signal_id"].iloc[0])]
            if window > len(x):
                raise ValueError("the window is longer than a signal")
            u, s, v = truncated(x, window, most or window) if few else solver(np.lib.stride_tricks.sliding_window_view(x, window))
            keep = len(s) if most is None else most
            pad = max(0, keep - len(s))
            s = np.append(s, np.zeros(pad))[:keep]
            u, v = (np.pad(a, ((0, 0), (0, pad)))[:, :keep] for a in (u, v))
            return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "component": np.arange(keep), "n": len(x), "sigma": s, "u": list(u.T), "v": list(v.T)})

        kind = signals.schema["signal_id"].dataType.simpleString()
        return signals.groupBy("signal_id").applyInPandas(one, f"signal_id {kind}, component int, n long, sigma double, u array<double>, v array<double>")

    def fit_long(self, signals: DataFrame, size: int | None = None) -> DataFrame:
        """signal_id, component, n, sigma, v of signals of any length: from the lag covariance, whose window * window cells one task for each signal has. Values below about 1e-8 of the greatest blur. ``long_components`` goes on from it."""
        window, most = self.window, self.n_components
        kind = signals.schema["signal_id"].dataType.simpleString()

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            c = np.zeros((window, window))
            for lag, first, head, tail in zip(pdf["lag"], pdf["c"], pdf["head"], pdf["tail"], strict=True):
                at = np.arange(window - lag)
                c[at, at + lag] = c[at + lag, at] = diagonal(lag, first, np.asarray(head), np.asarray(tail))
            values, v = np.linalg.eigh(c)
            keep = min(window, int(pdf["n"].iloc[0]) - window + 1, most or window)
            v = v[:, ::-1][:, :keep]
            return pd.DataFrame({"signal_id": pdf["signal_id"].iloc[0], "component": np.arange(keep), "n": pdf["n"].iloc[0], "sigma": np.sqrt(np.maximum(values[::-1][:keep], 0)), "v": list(v.T)})

        return lag_sums(signals, window, size).groupBy("signal_id").applyInPandas(one, f"signal_id {kind}, component int, n long, sigma double, v array<double>")

    def components(self, signals: DataFrame) -> DataFrame:
        """signal_id, component, t, y, one component for each singular value (0 for those beyond the rank)."""
        return expanded(self.fit(signals))

    def grouped(self, signals: DataFrame) -> DataFrame:
        """``components`` with neighbours summed, ``group_size`` at a time."""
        group = F.floor(F.col("component") / self.group_size).cast("int").alias("component")
        return self.components(signals).groupBy("signal_id", group, "t").agg(F.sum("y").alias("y"))

    def singular(self, signals: DataFrame) -> DataFrame:
        """signal_id, component, sigma, u, v."""
        return self.fit(signals).drop("n")


def expanded(fitted: DataFrame) -> DataFrame:
    """signal_id, component, t, y: the components of ``SSA.fit``, each from its own row."""

    @F.pandas_udf("array<double>")
    def averaged(n: pd.Series, sigma: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for size, s, a, b in zip(n, sigma, u, v, strict=True):
            t = np.arange(size)
            count = np.minimum(np.minimum(t + 1, size - t), min(len(b), size - len(b) + 1))
            out.append(np.convolve(s * np.asarray(a), b) / count)
        return pd.Series(out)

    return fitted.select("signal_id", "component", F.posexplode(averaged("n", "sigma", "u", "v")).alias("t", "y")).withColumn("t", F.col("t").cast("long"))


def long_components(signals: DataFrame, fitted: DataFrame, window: int, size: int | None = None) -> DataFrame:
    """signal_id, component, t, y: the components of ``SSA.fit_long``, chunk by chunk, each with a halo of window - 1 values at both sides."""
    size = size or chunk_size(window)
    kind = signals.schema["signal_id"].dataType.simpleString()
    salts = shuffle_partitions(signals.sparkSession)  # chunks of one signal go to several tasks

    def along(pdf: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        vectors = vectors.sort_values("component")
        for chunk, part in pdf.groupby("chunk"):
            name, t = part["signal_id"].iloc[0], part["t"].to_numpy()
            order = in_order(t, name)
            x, first, n = part["x"].to_numpy(float)[order], int(t[order[0]]), int(vectors["n"].iloc[0]) if len(vectors) else 0
            own = np.arange(chunk * size, min((chunk + 1) * size, n))
            starts = len(x) - window + 1  # whole windows here
            if not len(own) or starts <= 0:
                continue
            count = np.minimum(np.minimum(own + 1, n - own), min(window, n - window + 1))
            ahead, _ = _products(x, window)
            transform = 1 << (len(x) + window).bit_length()
            for component, v in zip(vectors["component"], vectors["v"], strict=True):
                sums = np.fft.irfft(np.fft.rfft(ahead(np.asarray(v)), transform) * np.fft.rfft(np.asarray(v), transform), transform)
                found.append((np.full(len(own), component, np.int32), own, sums[own - first] / count))
        component, t, y = (np.concatenate(c) for c in zip(*found, strict=True))
        some = pdf["signal_id"].iloc[0] if len(t) else None
        return pd.DataFrame({"signal_id": pd.Series([some] * len(t), dtype=object), "component": component, "t": t, "y": y})

    chunks = in_chunks(signals, size, window - 1, window - 1).withColumn("salt", F.col("chunk") % salts)
    copies = fitted.select("signal_id", "component", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return chunks.groupBy("signal_id", "salt").cogroup(copies.groupBy("signal_id", "salt")).applyInPandas(along, f"signal_id {kind}, component int, t long, y double")


def amplitude_variance(components: DataFrame, trim: int) -> DataFrame:
    """signal_id, component, amp_var: the variance of the analytic amplitude of each standardised component, ``trim`` values left out at both ends."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy(float)[in_order(pdf["t"].to_numpy(), pdf["signal_id"].iloc[0])]
        scale = y.std()
        var = np.nan
        if scale > 0:
            z = np.fft.fft((y - y.mean()) / scale)
            n = len(y)
            gain = np.zeros(n)
            gain[0] = 1
            gain[1 : (n + 1) // 2] = 2
            if n % 2 == 0:
                gain[n // 2] = 1
            amplitude = np.abs(np.fft.ifft(z * gain))
            var = amplitude[trim : n - trim].var() if n > 2 * trim else np.nan
        return pd.DataFrame({"signal_id": [pdf["signal_id"].iloc[0]], "component": [pdf["component"].iloc[0]], "amp_var": [var]})

    return components.groupBy("signal_id", "component").applyInPandas(one, f"signal_id {components.schema['signal_id'].dataType.simpleString()}, component int, amp_var double")


def select_oscillations(components: DataFrame, threshold: float, trim: int) -> DataFrame:
    """signal_id, component of those with a steady amplitude; component 0, the trend, never counts."""
    return amplitude_variance(components, trim).where((F.col("component") > 0) & (F.col("amp_var") < threshold)).select("signal_id", "component", "amp_var")


def reconstruct(components: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """signal_id, t, y: the sum of the (selected) components."""
    used = components if selected is None else components.join(selected.select("signal_id", "component"), ["signal_id", "component"], "left_semi")
    return used.groupBy("signal_id", "t").agg(F.sum("y").alias("y"))


def residual(signals: DataFrame, reconstruction: DataFrame) -> DataFrame:
    """signal_id, t, x less the reconstruction."""
    return signals.join(reconstruction, ["signal_id", "t"], "left").select("signal_id", "t", (F.col("x") - F.coalesce("y", F.lit(0.0))).alias("residual"))
