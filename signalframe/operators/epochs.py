"""Event-aligned epochs: nearest-time joins, row selection and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.tables import materialise, shuffle_partitions


def nearest_join(wanted: DataFrame, samples: DataFrame, value: str, by: list[str] | None = None, time: str = "time", parts: int | None = None) -> DataFrame:
    """``wanted`` (by, time, ...) with found_time and ``value`` of the nearest sample (by, time, value), the later one of two as near; of samples of one time the greatest value.

    No join on a range and no group of a key: the union of both sides is cut into
    ``parts`` ranges of (by, time), by sampled borders, so that a key of any length is
    many tasks. Each range hands its first and its last sample of each key to its
    neighbours: carried along the ranges, they enter the next pass as rows, where every
    row takes the last sample before and the first one behind it. Keys may be null (nulls are one key);
    a row whose time is null or NaN finds nothing, and such samples are left out.
    """
    by, spark = by or [], wanted.sparkSession
    parts = parts or shuffle_partitions(spark)
    kinds = dict(samples.dtypes)
    broken = lambda df: F.col(time).isNull() | (F.isnan(time) if dict(df.dtypes)[time] in ("double", "float") else F.lit(False))
    rest = [c for c in wanted.columns if c not in (*by, time)]
    rows = F.struct(*[F.col(c) for c in rest], F.lit(0).alias("__none"))
    left = wanted.select(*by, time, rows.alias("__rows"), F.lit(None).cast(kinds[value]).alias("__v"))
    no_rows = F.lit(None).cast(left.schema["__rows"].dataType).alias("__rows")
    right = samples.where(~broken(samples)).groupBy(*by, time).agg(F.max(value).alias("__v")).select(*by, time, no_rows, "__v")
    both = left.unionByName(right).withColumn("__tie", F.monotonically_increasing_id())  # rows of one time may go to several ranges
    dealt = materialise(both.repartitionByRange(parts, *by, time, "__tie").drop("__tie").withColumn("__part", F.spark_partition_id()))
    sample = F.struct(F.col(time).alias("t"), F.col("__v").alias("v"))
    ends = dealt.where("__rows IS NULL").groupBy(*by, "__part").agg(F.min(sample).alias("__first"), F.max(sample).alias("__last"))
    keys = dealt.select(*by, "__part").distinct()  # at most a row for each range and key in it
    ends = keys.join(ends, [keys[c].eqNullSafe(ends[c]) for c in [*by, "__part"]], "left").select(*[keys[c] for c in [*by, "__part"]], "__first", "__last")
    up, down = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__part", F.desc("__part")))
    carried = ends.withColumn("__ahead", F.last("__last", True).over(up)).withColumn("__behind", F.last("__first", True).over(down))
    carried = carried.select(*by, "__part", F.explode(F.array("__ahead", "__behind")).alias("__s")).where("__s IS NOT NULL")
    carried = carried.select(*by, F.col("__s.t").alias(time), no_rows, F.col("__s.v").alias("__v"), "__part")
    # both frames grow from their start, the second one over falling times: Spark adds each row to a frame once
    here, back = (Window.partitionBy("__part", *by).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (time, F.desc(time)))
    found = dealt.unionByName(carried).repartitionById(parts, F.col("__part").cast("int")).withColumn("__s", F.when(F.col("__rows").isNull(), sample))
    found = found.withColumn("__before", F.last("__s", True).over(here)).withColumn("__after", F.last("__s", True).over(back))
    later = F.col("__before").isNull() | (F.col("__after.t") - F.col(time) <= F.col(time) - F.col("__before.t"))
    best = F.when(broken(wanted), None).when(F.col("__after").isNotNull() & later, F.col("__after")).otherwise(F.col("__before"))
    found = found.where("__rows IS NOT NULL").withColumn("__best", best)
    return found.select(*by, time, *[F.col("__rows")[c].alias(c) for c in rest], F.col("__best.t").alias("found_time"), F.col("__best.v").alias(value))


def offsets(events: DataFrame, low: int, high: int, time: str = "time") -> DataFrame:
    """A row for each event and whole shift from ``low`` to ``high``: time is moved by it."""
    return events.withColumn("shift", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(time, F.col(time) + F.col("shift"))


def epoch_rows(found: DataFrame, key: str, value: str) -> DataFrame:
    """key, x: the values of each epoch in order of their shift."""
    ordered = F.array_sort(F.collect_list(F.struct("shift", value)))
    return found.groupBy(key).agg(F.transform(ordered, lambda s: s[value]).alias("x"))


def sample_rows(rows: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement: those with the least digests of 'seed:key'."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def shuffled(rows: DataFrame, seed: int | list[int], key: str = "row_id") -> DataFrame:
    """Rows with a place from 0 in a seeded order, the order of the digests of 'seed:key'; several seeds are stacked, each row with its ``seed``.

    Places are numbered within the 4096 ranges of digests with the same first digits,
    and moved by what the ranges before have, so no task orders all rows.
    """
    seeds = [seed] if isinstance(seed, int) else seed
    stacked = rows.withColumn("seed", F.explode(F.lit(seeds)) if not isinstance(seed, int) else F.lit(seed))
    digest = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col(key).cast("string")))
    dealt = stacked.withColumn("__digest", digest).withColumn("__range", F.substring("__digest", 1, 3))
    counts = dealt.groupBy("seed", "__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = counts.withColumn("__ahead", F.sum("__n").over(Window.partitionBy("seed").orderBy("__range")) - F.col("__n")).drop("__n")
    within = F.row_number().over(Window.partitionBy("seed", "__range").orderBy("__digest", key)) - 1
    placed = dealt.withColumn("__within", within).join(F.broadcast(ahead), ["seed", "__range"])  # 4096 rows for each seed
    columns = [*rows.columns, *([] if isinstance(seed, int) else ["seed"])]
    return placed.select(*columns, (F.col("__within") + F.col("__ahead")).alias("place"))


def unlisted(rows: DataFrame, skipped: DataFrame, name: str = "name") -> DataFrame:
    """The rows whose name isn't among those of ``skipped``; rows without a name stay."""
    return rows.join(skipped.select(name).distinct(), name, "left_anti").select(*rows.columns)


def label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
