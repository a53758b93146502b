"""Readers that turn tables into the engine's row and long forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MICROS = 1704067200000000  # 2024-01-01, UTC
BIN_MICROS = 21600000000  # six hours


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def within(df: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    """The rows whose named columns lie between two limits, both included; an infinite limit filters nothing, not even nulls. Plain comparisons, which reach the scan."""
    for name, (low, high) in limits.items():
        if low != -math.inf:
            df = df.where(F.col(name) >= low)
        if high != math.inf:
            df = df.where(F.col(name) <= high)
    return df


def first_rows(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first row in ``order`` of each group, or of all; an aggregation, so nothing is sorted. Later columns break ties."""
    by = by or []
    rest = [c for c in df.columns if c not in (*by, *order)]
    least = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("__row")).where("__row IS NOT NULL")
    return least.select(*by, "__row.*").select(*df.columns)


def signal_rows(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Row form: row_id and x, an array of doubles."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(array_col).cast("array<double>").alias("x"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_rows(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def binned_events(spark: SparkSession, sf_dir: str, bin_micros: int = BIN_MICROS) -> DataFrame:
    """Long form: a series for each event type, the summed values of six-hour bins, 0 where none is."""
    events = read_table(spark, sf_dir, "events")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_MICROS) / bin_micros).cast("long")
    summed = events.select(F.col("event_type").alias("signal_id"), t.alias("t"), "value").groupBy("signal_id", "t").agg(F.round(F.sum("value"), 6).alias("x"))
    grid = summed.groupBy("signal_id").agg(F.lit(0).alias("z")).crossJoin(F.broadcast(summed.agg(F.max("t").alias("last")))).select("signal_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("t"))
    return grid.join(summed, ["signal_id", "t"], "left").select("signal_id", "t", F.coalesce("x", F.lit(0.0)).alias("x"))


def to_long(rows: DataFrame, value: str = "x") -> DataFrame:
    """Row form to long form: row_id, j, v."""
    return rows.select("row_id", F.posexplode(value).alias("j", "v"))


def to_rows(long: DataFrame, key: str = "row_id", place: str = "j", value: str = "v") -> DataFrame:
    """Long form to row form, values in order of their place."""
    ordered = F.array_sort(F.collect_list(F.struct(place, value)))
    return long.groupBy(key).agg(F.transform(ordered, lambda s: s[value]).alias("x"))


def validate_signals(rows: DataFrame) -> int:
    """The common length of all signals; raises if they differ or hold nulls or values that aren't finite."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    low, high, broken = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count_if(bad)).first()
    if low != high or broken:
        raise ValueError(f"signals must have one length and finite values; lengths {low} to {high}, {broken} broken")
    return low or 0
