"""Running spectra over streams of signals.

Power sums are additive, so a stream's spectrum is the batch operator's partial sums
kept as a streaming aggregation: each micro-batch sends m numbers from each task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.functions import frequency
from signalframe.operators.fourier import _transformed


def running_power(stream: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by,) k, n, total: signals so far and their summed power in each bin of the unitary transform; ``stream`` has ``x``.

    For an output mode of 'complete' or 'update'. With a watermark and a window among
    ``by`` the groups close and 'append' works as well.
    """

    @F.pandas_udf("array<double>")
    def power(x: pd.Series) -> pd.Series:
        return pd.Series(_transformed(list(x), lambda v: np.abs(np.fft.fft(v.astype(float), axis=1)) ** 2 / v.shape[1]), dtype=object)

    by = by or []
    bins = stream.select(*by, F.size("x").alias("m"), F.posexplode(power("x")).alias("k", "p"))
    return bins.groupBy(*by, "m", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


def windowed_power(stream: DataFrame, time: str, duration: str, late: str) -> DataFrame:
    """``running_power`` for each window of event time, closed when the watermark passes it."""
    marked = stream.withWatermark(time, late).withColumn("window", F.window(time, duration))
    return running_power(marked, ["window"])


def spectrum_of(power: DataFrame, fs: float) -> DataFrame:
    """k, freq, power of the table that ``running_power`` has made so far."""
    return power.select("k", frequency(F.col("k"), F.col("m"), fs).alias("freq"), (F.col("total") / F.col("m")).alias("power"))
