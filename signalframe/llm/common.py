"""What the operators share: reading tables, shared scratch tables, words."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.tables import materialise, shared_dir, shuffle_partitions  # noqa: F401

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: What makes Python workers give memory back as soon as they free it, which costs time: a fifth of op6's.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship_package(spark: SparkSession, thrifty: bool = True) -> None:
    """Lets Python workers import this package where it isn't installed (PYTHONPATH of the workers) and keeps what they and Arrow hold small: batches of 8 MB where the session has Spark's default of 64, and (``thrifty``) workers that give memory back at once."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    for name, value in WORKER_MEMORY.items():
        if thrifty:
            environment.setdefault(name, value)
        elif environment.get(name) == value:
            del environment[name]
    if spark.conf.get(BATCH_BYTES).lower().strip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, "8m")


def return_heap(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect garbage and give the heap that is then free back, for the Python workers beside them: one short task for each core, which Spark deals over all executors. Else a JVM keeps what the work before has touched."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


_cache: list = [None, None]


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called by tasks: a worker that served another operator before drops that one's cache. ``clear`` drops the owner's."""
    if _cache[0] != owner:
        if _cache[1] is not None:
            _cache[1]()
        _cache[:] = owner, clear


def release() -> None:
    """Called by tasks at their end: drops the worker's caches and gives freed memory back, where the C library can (glibc)."""
    claim("")
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, the same in every worker; forgets all beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
