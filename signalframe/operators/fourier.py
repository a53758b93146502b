"""Row-wise Fourier transforms, Gram matrices and what follows from them.

Signals stay rows. A row's transform needs nothing of other rows, so it runs in
Arrow batches without a shuffle; Gram matrices are sums over rows, made by each
task for its own rows (m * m numbers) and merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from signalframe.functions import NAN, divide, frequency
from signalframe.tables import materialise

BATCH = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """The signals of a batch as rows. Raises if one is null, has a null or another length than the first."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    if column.null_count or column.flatten().null_count:
        raise ValueError("a signal is null or has a null value")
    lengths = column.value_lengths().to_numpy()
    if (lengths != lengths[0]).any():
        raise ValueError(f"signals of {lengths.min()} and {lengths.max()} values can't be summed")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _transformed(rows: list[np.ndarray | None], transform) -> list[np.ndarray | None]:
    """``transform`` of the rows, those of one length together; of null it is null."""
    out: list[np.ndarray | None] = [None] * len(rows)
    by_length: dict[int, list[int]] = {}
    for n, v in enumerate(rows):
        if v is not None:
            by_length.setdefault(len(v), []).append(n)
    for length, where in by_length.items():
        made = transform(np.stack([rows[n] for n in where])) if length else np.zeros((len(where), 0), complex)
        for n, v in zip(where, made, strict=True):
            out[n] = v
    return out


def dft_rows(rows: DataFrame) -> DataFrame:
    """row_id, re, im: the unitary transform of each signal, of whatever length; of a null signal null."""

    @F.pandas_udf("re array<double>, im array<double>")
    def transform(x: pd.Series) -> pd.DataFrame:
        u = _transformed(list(x), lambda v: np.fft.fft(v.astype(float), axis=1) / np.sqrt(v.shape[1]))
        return pd.DataFrame({"re": [v if v is None else v.real for v in u], "im": [v if v is None else v.imag for v in u]})

    return rows.withColumn("u", transform("x")).select("row_id", "u.re", "u.im")


def dft_long(rows: DataFrame) -> DataFrame:
    """row_id, k, re, im."""
    return dft_rows(rows).select("row_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c")).select("row_id", "k", "c.re", "c.im")


def dft_basis(m: int, spark) -> DataFrame:
    """j, k, re, im of the unitary basis; j * k is reduced first, which keeps large ones exact."""
    jk = spark.range(m).select(F.col("id").alias("j")).crossJoin(spark.range(m).select(F.col("id").alias("k")))
    angle = F.pmod(F.col("j") * F.col("k"), F.lit(m)) * F.lit(2 * np.pi / m)
    return jk.select("j", "k", (F.cos(angle) / np.sqrt(m)).alias("re"), (-F.sin(angle) / np.sqrt(m)).alias("im"))


def column_sums(rows: DataFrame) -> DataFrame:
    """j, n, total: the sum of each column over all signals; a task sends m numbers."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0)[lo : lo + BATCH])
                if len(x):
                    n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), n)), pa.array(total)], ["j", "n", "total"])

    return rows.select("x").mapInArrow(partial, "j int, n long, total double").groupBy("j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def center_columns(rows: DataFrame) -> DataFrame:
    """row_id, x less the mean signal."""
    means = column_sums(rows).select("j", (F.col("total") / F.col("n")).alias("mean"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "mean"))), lambda s: s["mean"]).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).select("row_id", F.zip_with("x", "mean", lambda v, c: v - c).alias("x"))


def gram(rows: DataFrame, fourier: bool = False, by: list[str] | None = None, basis: np.ndarray | None = None) -> DataFrame:
    """(by,) k, l, re, im, n: the sum over rows of conj(u_k) * u_l, u being the signal, its transform, or its product with ``basis`` (m * m, complex). One pass, m * m numbers from each task and group."""
    by = by or []
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    kinds = [rows.schema[b] for b in by]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "n long, m int, re array<double>, im array<double>"])

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * part.num_rows
                x = _matrix(part.column(len(by)))
                if shared.value is not None:
                    u = x @ shared.value
                else:
                    u = np.fft.fft(x, axis=1) / np.sqrt(max(1, x.shape[1])) if fourier else x
                for key in dict.fromkeys(keys):
                    mine = u if not by else u[[k == key for k in keys]]
                    g = mine.conj().T @ mine
                    if key in sums:
                        sums[key][0] += len(mine)
                        sums[key][1] += g
                    else:
                        sums[key] = [len(mine), g]
        for key, (n, g) in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(key, arrow, strict=True)], pa.array([n], pa.int64()), pa.array([len(g)], pa.int32()), pa.array([g.real.ravel()], pa.list_(pa.float64())), pa.array([g.imag.ravel()], pa.list_(pa.float64()))], [*by, "n", "m", "re", "im"])

    arrow = [to_arrow_type(f.dataType) for f in kinds]
    parts = rows.select(*by, "x").mapInArrow(partial, schema)
    flat = parts.select(*by, "n", "m", F.posexplode(F.arrays_zip("re", "im")).alias("at", "c"))
    place = [F.floor(F.col("at") / F.col("m")).cast("int").alias("k"), (F.col("at") % F.col("m")).cast("int").alias("l")]
    return flat.select(*by, *place, "n", "c.re", "c.im").groupBy(*by, "k", "l").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n"))


HELD_BYTES = 64 << 20  # of a task's co-moments before they are sent on


def _merged(a: list, b: list) -> list:
    """Co-moments [n, mean, products of deviations] of two disjoint sets of signals, of their union."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return [n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart.conj(), apart) * (a[0] * b[0] / n)]


def co_moments(rows: DataFrame, fourier: bool = False, by: list[str] | None = None, basis: np.ndarray | None = None) -> DataFrame:
    """(by,) k, n, re, im: row k of the summed products of deviations from the mean, conj(u_k - mean_k) * (u_l - mean_l), with u as in ``gram``; re and im hold all l.

    One pass. A task centres each batch and merges batches pairwise (Chan, Golub and
    LeVeque), so a common offset costs no digits; it sends m rows of 2m numbers for each group, sooner
    when it holds more than 64 MB. Rows k of all tasks are merged the same way, in two
    steps, so that no task gets a row from more than the square root of all tasks.
    """
    by = by or []
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    kinds = [rows.schema[b] for b in by]
    arrow = [to_arrow_type(f.dataType) for f in kinds]
    heads = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds)
    schema = f"{heads}k int, part int, n long, mean_k_re double, mean_k_im double, mean_re array<double>, mean_im array<double>, re array<double>, im array<double>"
    names = [*by, "k", "part", "n", "mean_k_re", "mean_k_im", "mean_re", "mean_im", "re", "im"]
    lists = pa.list_(pa.float64())
    types = [*arrow, pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), lists, lists, lists, lists]

    def sent(key: tuple, part: int, n: int, mean: np.ndarray, products: np.ndarray) -> Iterator[pa.RecordBatch]:
        m, means = len(mean), [pa.array([mean.real] * len(mean), lists), pa.array([mean.imag] * len(mean), lists)]
        ends = pa.array(np.arange(0, m * m + 1, max(1, m), dtype=np.int32))
        cells = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).ravel())) for v in (products.real, products.imag)]
        scalars = [np.arange(m, dtype=np.int32), np.full(m, part, np.int32), np.full(m, n, np.int64), mean.real.astype(float), np.array(mean.imag, float)]
        yield pa.RecordBatch.from_arrays([*[pa.array([v] * m, t) for v, t in zip(key, arrow, strict=True)], *map(pa.array, scalars), *means, *cells], names)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        part = TaskContext.get().partitionId()
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                piece = batch.slice(lo, BATCH)
                keys = list(zip(*(piece.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * piece.num_rows
                x = _matrix(piece.column(len(by)))
                if shared.value is not None:
                    u = x @ shared.value
                else:
                    u = np.fft.fft(x, axis=1) / np.sqrt(max(1, x.shape[1])) if fourier else x
                for key in dict.fromkeys(keys):
                    mine = u if not by else u[[k == key for k in keys]]
                    mean = mine.mean(axis=0)
                    off = mine - mean
                    found = [len(mine), mean, off.conj().T @ off]
                    sums[key] = _merged(sums[key], found) if key in sums else found
                if len(sums) * u.shape[1] ** 2 * 16 > HELD_BYTES and len(sums) > 1:
                    for key, found in sums.items():
                        yield from sent(key, part, *found)
                    sums = {}
        for key, found in sums.items():
            yield from sent(key, part, *found)

    def rows_merged(table: pa.Table) -> pa.Table:
        total = None
        for row in (r for batch in table.to_batches(max_chunksize=64) for r in batch.to_pylist()):
            one = [row["n"], np.array(row["mean_re"]) + 1j * np.array(row["mean_im"]), np.array(row["re"]) + 1j * np.array(row["im"]), row["mean_k_re"] + 1j * row["mean_k_im"]]
            if total is None:
                total, first = one, row
                continue
            n = total[0] + one[0]
            apart, apart_k = one[1] - total[1], one[3] - total[3]
            products = total[2] + one[2] + np.conj(apart_k) * apart * (total[0] * one[0] / n)
            total = [n, total[1] + apart * (one[0] / n), products, total[3] + apart_k * (one[0] / n)]
        n, mean, products, own = total
        made = {c: first[c] for c in [*by, "k", "part"]} | {"n": n, "mean_k_re": own.real, "mean_k_im": own.imag, "mean_re": mean.real.tolist(), "mean_im": mean.imag.tolist(), "re": products.real.tolist(), "im": products.imag.tolist()}
        return pa.Table.from_pylist([made], pa.schema(list(zip(names, types, strict=True))))

    parts = rows.select(*by, "x").mapInArrow(partial, schema)
    bucket = F.floor(F.sqrt(F.col("part"))).cast("int")
    merged = parts.withColumn("part", bucket).groupBy(*by, "k", "part").applyInArrow(rows_merged, schema).groupBy(*by, "k").applyInArrow(rows_merged, schema)
    return merged.select(*by, "k", "n", "re", "im")


def spread_moments(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by,) k, l, re, im, n of ``co_moments``: a row for each cell, as ``gram`` has them."""
    by = by or []
    return moments.select(*by, "k", "n", F.posexplode(F.arrays_zip("re", "im")).alias("l", "c")).select(*by, "k", "l", "c.re", "c.im", "n")


def covariance(rows: DataFrame) -> DataFrame:
    """a, b, c: the sample covariance (ddof 1) of columns, in one pass."""
    g = spread_moments(co_moments(rows))
    return g.select(F.col("k").alias("a"), F.col("l").alias("b"), divide(F.col("re"), (F.col("n") - 1).cast("double")).alias("c"))


def matrix_rows(long: DataFrame, row: str = "a", column: str = "b", value: str = "c") -> DataFrame:
    """A matrix in long form as signals, one for each row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(column, value))), lambda s: s[value])
    return long.groupBy(F.col(row).cast("long").alias("row_id")).agg(ordered.alias("x"))


def column_norms(rows: DataFrame) -> DataFrame:
    """k, norm: the Euclidean norm of each Fourier column over all rows."""
    return power_sums(rows).select("k", F.sqrt("total").alias("norm"))


def power_sums(rows: DataFrame) -> DataFrame:
    """k, m, total: the summed squared modulus of each bin; a task sends m numbers."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(0)[lo : lo + BATCH])
                if x.size:
                    p = (np.abs(np.fft.fft(x, axis=1)) ** 2).sum(axis=0) / x.shape[1]
                    total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), len(total)), pa.int32()), pa.array(total)], ["k", "m", "total"])

    return rows.select("x").mapInArrow(partial, "k int, m int, total double").groupBy("k", "m").agg(F.sum("total").alias("total"))


def eigenspectrum(rows: DataFrame, fs: float, negative: bool = True) -> DataFrame:
    """k, freq, power: the eigenspectrum of a signal matrix in transform order; without ``negative`` only bins with 2k < m."""
    if not fs:
        raise ValueError("fs must not be 0")
    found = power_sums(rows)
    found = found if negative else found.where("2 * k < m")
    return found.select("k", frequency(F.col("k"), F.col("m"), fs).alias("freq"), (F.col("total") / F.col("m")).alias("power"))


def covariance_eigenspectrum(cov: DataFrame, m: int, fs: float) -> DataFrame:
    """k, freq, power for 2k < m: the covariance summed by circular lag, then a cosine transform of the m lags."""
    if not fs:
        raise ValueError("fs must not be 0")
    lags = cov.groupBy(F.pmod(F.col("a") - F.col("b"), F.lit(m)).alias("lag")).agg(F.sum("c").alias("c"))
    bins = cov.sparkSession.range((m + 1) // 2).select(F.col("id").cast("int").alias("k"))
    angle = F.pmod(F.col("k") * F.col("lag"), F.lit(m)) * F.lit(2 * np.pi / m)
    power = lags.crossJoin(F.broadcast(bins)).groupBy("k").agg((F.sum(F.col("c") * F.cos(angle)) / m).alias("power"))
    return power.select("k", frequency(F.col("k"), m, fs).alias("freq"), "power")


def normalized_spectrum(spectrum: DataFrame) -> DataFrame:
    """The powers divided by their mean."""
    mean = spectrum.agg(F.avg("power").alias("mean_power"))
    return spectrum.crossJoin(F.broadcast(mean)).select("k", "freq", divide(F.col("power"), F.col("mean_power")).alias("power"))


def mean_psd(rows: DataFrame, fs: float) -> DataFrame:
    """k, freq, power for 1 <= k < m / 2: the mean over rows of the squared modulus of each z-scored row's transform; constant rows are left out."""
    from signalframe.functions import has_nan, z_score

    scored = rows.select("row_id", z_score(F.col("x")).alias("x")).where(~has_nan(F.col("x")))
    n = scored.agg(F.count(F.lit(1)).alias("n"))
    found = power_sums(scored).where("k >= 1 and 2 * k < m").crossJoin(F.broadcast(n))
    return found.select("k", frequency(F.col("k"), F.col("m"), fs).alias("freq"), (F.col("total") * F.col("m") / F.col("n")).alias("power"))


def welch_psd(rows: DataFrame, fs: float, segment: int) -> DataFrame:
    """row_id, k, freq, power: the mean one-sided periodogram of half-overlapping segments with a periodic Hann window, each less its mean."""
    if segment < 2:
        raise ValueError("segment must be at least 2")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    scale = fs * float((window**2).sum())

    def spectra(x: np.ndarray) -> np.ndarray:
        """The mean periodograms of signals of one length, a few of them at a time."""
        out = np.zeros((len(x), segment // 2 + 1))
        step = max(1, (1 << 21) // x.shape[1])
        for lo in range(0, len(x), step):
            parts = np.lib.stride_tricks.sliding_window_view(x[lo : lo + step].astype(float), segment, axis=1)[:, :: segment // 2]
            p = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * window, axis=2)) ** 2 / scale
            p[:, :, 1 : (segment + 1) // 2] *= 2
            out[lo : lo + step] = p.mean(axis=1)
        return out

    @F.pandas_udf("array<double>")
    def periodogram(x: pd.Series) -> pd.Series:
        return pd.Series(_transformed(list(x), spectra), dtype=object)

    found = rows.where(F.size("x") >= segment).select("row_id", F.posexplode(periodogram("x")).alias("k", "power"))
    return found.select("row_id", "k", (F.col("k") * F.lit(fs / segment)).alias("freq"), "power")


def fourier_eig(cov: DataFrame, m: int, conjugate: bool = True, basis: np.ndarray | None = None) -> DataFrame:
    """k, l, re, im: V^H C V (``conjugate``), or the two-dimensional transform V C V, for an m * m matrix (a, b, c); V is the unitary Fourier basis or ``basis``. Cells that ``cov`` doesn't have are 0; without any cell there is no row.

    The rows are transformed, then the columns of what that gives: m * m rows twice.
    """
    shared = cov.sparkSession.sparkContext.broadcast(basis)

    def apply(v: np.ndarray, conjugated: bool) -> np.ndarray:
        if shared.value is not None:
            return v @ (shared.value.conj() if conjugated else shared.value)
        return np.fft.ifft(v, axis=1) * np.sqrt(m) if conjugated else np.fft.fft(v, axis=1) / np.sqrt(m)

    def filled(at: pd.Series, re: pd.Series, im: pd.Series | None) -> np.ndarray:
        out = np.zeros((len(at), m), complex)
        for n, places in enumerate(at):
            if len(places) and not 0 <= min(places) <= max(places) < m:
                raise ValueError(f"the matrix has cells beyond {m} * {m}")
            np.add.at(out[n], places, re.iloc[n] if im is None else re.iloc[n] + 1j * im.iloc[n])
        return out

    @F.pandas_udf("re array<double>, im array<double>")
    def along(at: pd.Series, re: pd.Series) -> pd.DataFrame:
        u = apply(filled(at, re, None), False)
        return pd.DataFrame({"re": list(u.real), "im": list(u.imag)})

    @F.pandas_udf("re array<double>, im array<double>")
    def down(at: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        u = apply(filled(at, re, im), conjugate)
        return pd.DataFrame({"re": list(u.real), "im": list(u.imag)})

    cells = lambda *names: F.collect_list(F.struct(*names)).alias("s")
    rows = cov.groupBy(F.col("a").cast("int").alias("a")).agg(cells(F.col("b").cast("int").alias("b"), F.col("c").cast("double").alias("c"))).withColumn("u", along("s.b", "s.c"))
    long = rows.select("a", F.posexplode(F.arrays_zip("u.re", "u.im")).alias("l", "c")).select("a", "l", "c.re", "c.im")
    columns = long.groupBy("l").agg(cells("a", "re", "im")).withColumn("u", down("s.a", "s.re", "s.im"))
    return columns.select(F.posexplode(F.arrays_zip("u.re", "u.im")).alias("k", "c"), "l").select("k", "l", "c.re", "c.im")


def kappa(spectral: DataFrame, part: str = "modulus", by: list[str] | None = None) -> DataFrame:
    """kappa of a spectral matrix (k, l, re, im): the mean diagonal over the sum of the mean diagonal and the mean off it, of moduli or of absolute real parts; NaN where it is 0 / 0."""
    by = by or []
    size = F.abs("re") if part == "real" else F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    same = F.col("k") == F.col("l")
    sums = spectral.groupBy(*by).agg(F.sum(F.when(same, size).otherwise(0.0)).alias("d"), F.sum(F.when(same, 0.0).otherwise(size)).alias("o"), F.count_if(same).cast("double").alias("m"))
    diagonal, off = divide(F.col("d"), F.col("m")), divide(F.col("o"), F.col("m") * F.col("m") - F.col("m"))
    return sums.select(*by, divide(diagonal, diagonal + off).alias("kappa"))


def kappa_of_signals(rows: DataFrame, method: str = "svd", normalize: bool = True, basis: np.ndarray | None = None) -> DataFrame:
    """How near the covariance of signals is to a circulant matrix, from 0.5 to 1; with another ``basis``, how near it is to diagonal in that."""
    if method not in ("svd", "eig"):
        raise ValueError(f"method must be 'svd' or 'eig', not {method!r}")
    products = (lambda **how: spread_moments(co_moments(rows, **how))) if normalize else (lambda **how: gram(rows, **how))
    if method == "svd" or basis is not None:
        return kappa(products(fourier=True, basis=basis))
    some = rows.select(F.size("x").alias("m")).first()
    m = some["m"] if some else 0
    return kappa(fourier_eig(products().select(F.col("k").alias("a"), F.col("l").alias("b"), F.col("re").alias("c")), m))


def epsilon(spectral: DataFrame) -> DataFrame:
    """The summed squared modulus off the diagonal of a spectral matrix, over its size."""
    off = F.when(F.col("k") != F.col("l"), F.col("re") * F.col("re") + F.col("im") * F.col("im")).otherwise(0.0)
    return spectral.agg((F.sum(off) / F.count_if(F.col("k") == F.col("l"))).alias("epsilon"))


def log_sizes(low: int, high: int, n: int) -> list[int]:
    """``n`` sizes from ``low`` to ``high`` in equal ratios, cut to whole numbers; the same one only once."""
    return sorted({int(s) for s in np.round(np.logspace(np.log10(low), np.log10(high), n), 9)})


def sampled(rows: DataFrame, sizes: list[int], repeats: int, nested: bool = False) -> DataFrame:
    """size, rep, row_id, x: for each size and repetition that many rows without replacement, those with the least digests of 'size:rep:row_id'; ``nested`` takes 'rep:row_id' instead, so smaller draws are parts of larger ones. Row ids must be unique.

    The digest of a draw's last row is found from the ids alone: tasks keep those under
    a bound that the number of rows gives (twice as high as long as some draw lacks
    rows), and ranges of digests are counted before places are numbered within them. One scan of the
    signals then takes what lies under these digests, for all sizes and repetitions.
    """
    spark, n = rows.sparkSession, rows.count()
    draws = spark.createDataFrame([(s, r) for s in sizes for r in range(repeats)], "size int, rep int")
    names = (["rep"] if nested else ["size", "rep"])

    def digest(row: Column) -> Column:
        return F.md5(F.concat_ws(":", *[F.col(c) for c in names], row))

    keyed = draws.groupBy(*names).agg(F.collect_set("size").alias("sizes"), F.max("size").alias("most"))
    width = 2.0
    while True:
        # hex digits as a share of all: the first 12 are 48 bits
        share = F.conv(F.substring("digest", 1, 12), 16, 10).cast("double") / float(1 << 48)
        bound = F.lit(width) * (F.col("most") + 8 * F.sqrt(F.col("most")) + 8) / float(max(n, 1))
        ids = rows.select("row_id").crossJoin(F.broadcast(keyed)).withColumn("digest", digest(F.col("row_id"))).where(share <= bound)
        ids = materialise(ids.select(*names, "sizes", "digest"))
        short = keyed.join(ids.groupBy(*names).agg(F.count(F.lit(1)).alias("found")), names, "left").where(F.coalesce("found", F.lit(0)) < F.least("most", F.lit(n)))
        if width * 8 > n or short.isEmpty():
            break
        width *= 2
    ranges = ids.withColumn("range", F.substring("digest", 1, 4))
    counts = ranges.groupBy(*names, "range").agg(F.count(F.lit(1)).alias("held"))  # 65,536 ranges of each draw at most
    ahead = counts.withColumn("ahead", F.sum("held").over(Window.partitionBy(*names).orderBy("range")) - F.col("held")).drop("held")
    placed = ranges.withColumn("within", F.row_number().over(Window.partitionBy(*names, "range").orderBy("digest"))).join(ahead, [*names, "range"])
    place = F.col("within") + F.col("ahead")
    wanted = placed.select(*names, "digest", place.alias("place"), F.explode("sizes").alias("last")).where("place <= last")
    last = wanted.groupBy(*names, F.col("last").alias("drawn")).agg(F.max("digest").alias("limit"))  # a row for each draw
    limits = materialise(last.select(*([] if nested else ["size"]), "rep", "drawn", "limit"))
    met = rows.select("row_id", "x").crossJoin(F.broadcast(limits)).where(digest(F.col("row_id")) <= F.col("limit"))
    return met.select(F.col("drawn").alias("size"), "rep", "row_id", "x")


def covariance_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by,) row_id, x: the rows of each group's sample covariance (ddof 1)."""
    scale = (F.col("n") - 1).cast("double")
    return co_moments(rows, by=by).select(*by, F.col("k").cast("long").alias("row_id"), F.transform("re", lambda v: divide(v, scale)).alias("x"))


def kappa_convergence(rows: DataFrame, sizes: list[int], repeats: int, nested: bool = False) -> DataFrame:
    """size, ratio (size to the signals' length), kappa: the mean over repetitions of the kappa of the covariance of random subsets. The signals are read once; then all is about m rows of each draw."""
    by = ["size", "rep"]
    cov = covariance_rows(sampled(rows, sizes, repeats, nested), by)
    found = kappa(spread_moments(co_moments(cov.withColumn("length", F.size("x")), fourier=True, by=[*by, "length"]), [*by, "length"]), by=[*by, "length"])
    means = found.groupBy("size", "length").agg(F.avg("kappa").alias("kappa"))
    return means.select("size", (F.col("size") / F.col("length")).alias("ratio"), "kappa")


def spectrum_inversion(rows: DataFrame, m: int) -> DataFrame:
    """row_id, j, v: every Fourier column of the signals scaled to unit norm and coloured with the covariance's eigenspectrum, transformed back; empty columns stay 0. Of one signal, which has no covariance, all values are NaN."""
    number = column_sums(rows).agg(F.max("n").alias("n"))

    @F.pandas_udf("array<double>")
    def recolour(x: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series(_transformed(list(x), lambda v: np.fft.ifft(np.fft.fft(v, axis=1) * np.asarray(s.iloc[0])).real), dtype=object)

    centred = power_sums(center_columns(rows)).select("k", F.col("total").alias("lam"))
    scale = power_sums(rows).join(centred, "k").crossJoin(F.broadcast(number))
    unit = F.sqrt(divide(F.col("lam"), (F.col("n") - 1).cast("double")))
    scale = scale.select("k", F.coalesce(F.try_divide(unit, F.sqrt("total")), F.lit(0.0)).alias("s"))
    packed = scale.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda s: s["s"]).alias("s"))
    made = rows.crossJoin(F.broadcast(packed)).select("row_id", F.posexplode(recolour("x", "s")).alias("j", "v"))
    return made.withColumn("v", F.coalesce("v", F.lit(NAN)))  # NaN leaves Python as null
