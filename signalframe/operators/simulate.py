"""Signal generators and the array forms of shifting, tiling, padding and mixing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.functions import cyclic_shift


def circulant(rows: DataFrame) -> DataFrame:
    """row_id, shift, x: every cyclic shift of every signal, to the right by 0, 1, ..."""
    return rows.select("row_id", F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("shift"), "x").select("row_id", "shift", cyclic_shift(F.col("x"), F.col("shift")).alias("x"))


def tile(rows: DataFrame, times: int) -> DataFrame:
    """row_id, copy, x."""
    return rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"), "x")


def pad(x: Column, before: int, behind: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), before), x, F.array_repeat(F.lit(0.0), behind))


def mix(a: DataFrame, b: DataFrame) -> DataFrame:
    """row_id, x: the sums of signals with the same id."""
    return a.join(b.withColumnRenamed("x", "y"), "row_id").select("row_id", F.zip_with("x", "y", lambda p, q: p + q).alias("x"))


def random_rows(spark: SparkSession, n: int, m: int, kind: str, seed: int) -> DataFrame:
    """row_id, x: 'normal', 'uniform' or 'exponential' values, the same for the same seed and row."""

    @F.pandas_udf("array<double>")
    def draw(ids: pd.Series) -> pd.Series:
        pick = {"normal": lambda g: g.standard_normal(m), "uniform": lambda g: g.random(m), "exponential": lambda g: g.exponential(size=m)}[kind]
        return pd.Series([pick(np.random.default_rng([seed, int(i)])) for i in ids])

    return spark.range(n).select(F.col("id").alias("row_id"), draw("id").alias("x"))


def power_law(spark: SparkSession, n: int, m: int, exponent: float, seed: int) -> DataFrame:
    """row_id, x: noise whose power falls as frequency ** exponent (Timmer and Koenig 1995), with mean 0 and variance 1."""

    @F.pandas_udf("array<double>")
    def draw(ids: pd.Series) -> pd.Series:
        k = np.arange(m // 2 + 1)
        gain = np.concatenate([[0.0], k[1:] ** (exponent / 2)])
        out = []
        for i in ids:
            g = np.random.default_rng([seed, int(i)])
            x = np.fft.irfft((g.standard_normal(len(k)) + 1j * g.standard_normal(len(k))) * gain, m)
            out.append((x - x.mean()) / x.std())
        return pd.Series(out)

    return spark.range(n).select(F.col("id").alias("row_id"), draw("id").alias("x"))


def sine(t: Column, freq: float, rdsym: float = 0.5) -> Column:
    """A sine of time; with ``rdsym`` other than 0.5 the share of a cycle that rises."""
    phase = t * freq - F.floor(t * freq)
    rise, fall = rdsym / 2, 1 - rdsym / 2
    bent = F.when(phase < rise, phase / (4 * rise)).when(phase < fall, 0.25 + (phase - rise) / (2 * (fall - rise))).otherwise(0.75 + (phase - fall) / (4 * (1 - fall)))
    return F.sin(2 * F.pi() * bent)
