"""Low-rank algebra on signal matrices of N rows and m columns, N large.

Singular values and vectors come from a QR factorisation made in a tree: a task reduces
its signals to a triangle of m rows at most, triangles are stacked and reduced again. That
keeps small singular values, which X'X would lose below 1e-8 of the greatest. Where m is
too large for m * m numbers in a task, randomised subspace iteration (Halko, Martinsson
and Tropp 2011) needs m * rank of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.operators.fourier import BATCH, _matrix, center_columns, column_sums
from signalframe.tables import materialise, shuffle_partitions

WIDE = 4096  # signals longer than this have few singular vectors made, by ``subspace``
LISTS = pa.list_(pa.float64())


def as_lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows, float).ravel()))


def _times(x: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    return x if right is None else x @ right


def r_factor(rows: DataFrame, right: np.ndarray | None = None) -> np.ndarray:
    """R of a QR factorisation of the signals, or of their products with ``right``: m rows at most. Triangles are merged eight at a time, or as near to it as the number of partitions allows."""
    shared = rows.sparkSession.sparkContext.broadcast(right)

    def sent(part: int, r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None and len(r):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), part, np.int32)), as_lists(r)], ["part", "r"])

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                x = _times(_matrix(batch.column(0)[lo : lo + BATCH]), shared.value)
                if x.size:
                    r = np.linalg.qr(x if r is None else np.vstack([r, x]), "r")
        yield from sent(TaskContext.get().partitionId(), r)

    def merged(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(_matrix(table.column("r").combine_chunks()), "r")
        return pa.Table.from_batches(list(sent(table.column("part")[0].as_py(), r)), pa.schema([("part", pa.int32()), ("r", LISTS)]))

    found = rows.select("x").mapInArrow(partial, "part int, r array<double>")
    groups = shuffle_partitions(rows.sparkSession)
    while groups > 1:
        groups = -(-groups // 8)
        found = found.withColumn("part", F.pmod("part", F.lit(groups)).cast("int")).groupBy("part").applyInArrow(merged, "part int, r array<double>")
    got = found.select("r").toArrow().column("r").combine_chunks()
    return np.linalg.qr(_matrix(got), "r") if len(got) else np.zeros((0, 0 if right is None else right.shape[1]))


def signed(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]) if v.size else v


def subspace(rows: DataFrame, rank: int, spare: int = 10, rounds: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` greatest singular values and their right vectors in columns, by randomised subspace iteration: ``rounds`` + 1 passes, m * (rank + spare) numbers in a task and in the driver."""
    spark = rows.sparkSession
    first = rows.select(F.size("x").alias("m")).first()
    m = first["m"] if first else 0
    few, width = min(rank + spare, m), 256

    def multiplied(q: np.ndarray) -> np.ndarray:
        """X'(X q)."""
        shared = spark.sparkContext.broadcast(q)

        def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((m, few))
            for batch in it:
                for lo in range(0, batch.num_rows, BATCH):
                    x = _matrix(batch.column(0)[lo : lo + BATCH])
                    if x.size:
                        total += x.T @ (x @ shared.value)
            for block in range(0, m, width):
                yield pa.RecordBatch.from_arrays([pa.array([block // width], pa.int32()), pa.array([total[block : block + width].ravel()], LISTS)], ["block", "z"])

        def summed(table: pa.Table) -> pa.Table:
            total = sum(np.asarray(z.values) for z in table.column("z"))
            return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "z": pa.array([total], LISTS)})

        parts = rows.select("x").mapInArrow(partial, "block int, z array<double>").groupBy("block").applyInArrow(summed, "block int, z array<double>")
        got = parts.toArrow().sort_by("block").column("z").combine_chunks()
        shared.unpersist()
        return got.flatten().to_numpy().reshape(m, few)

    if not few:
        return np.zeros(0), np.zeros((m, 0))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, few)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(multiplied(q))[0]
    _, sigma, wt = np.linalg.svd(r_factor(rows, q), full_matrices=False)
    return sigma[:rank], signed(q @ wt[:rank].T)


def right_vectors(rows: DataFrame, rank: int | None = None, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and the right singular vectors in columns, each with its largest entry positive: all of them (m, zeros where there are fewer signals), or the first ``rank``. Signals of more than ``wide`` values, of which ``rank`` are wanted, go through ``subspace``."""
    length = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if rank is not None and length > wide:
        return subspace(rows, rank)
    r = r_factor(rows)
    if not length or not r.size:
        return np.zeros(0), np.zeros((0, 0))
    _, sigma, vt = np.linalg.svd(r, full_matrices=True)
    sigma = np.append(sigma, np.zeros(length - len(sigma)))
    return sigma[:rank], signed(vt[:rank].T)


def singular_values(rows: DataFrame, rank: int | None = None) -> DataFrame:
    """component, sigma: all, or the first ``rank``."""
    sigma, _ = right_vectors(rows, rank)
    return rows.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "component int, sigma double")


def projected(rows: DataFrame, right: np.ndarray, name: str) -> DataFrame:
    """row_id and ``name``: each signal's product with ``right``."""
    shared = rows.sparkSession.sparkContext.broadcast(right)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        m = _matrix(x)
        return as_lists(m @ shared.value) if len(m) else pa.array([], LISTS)

    return rows.select("row_id", project("x").alias(name))


def svd(rows: DataFrame, tolerance: float = 1e-14) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The thin factorisation X = U diag(s) V': U as rows (row_id, u), s, and V in columns, of the rank that values above ``tolerance`` of the greatest give.

    U is X V / s, which loses its orthogonality where s is small, written and factorised
    once more (the refinement step of Benson, Gleich and Demmel 2013).
    """
    sigma, v = right_vectors(rows)
    rank = int((sigma > tolerance * sigma[:1].sum()).sum())
    if not rank:
        return rows.select("row_id", F.array().cast("array<double>").alias("u")), sigma[:0], v[:, :0]
    rough = v[:, :rank] / sigma[:rank]
    q = materialise(projected(rows, rough, "x"))  # made once: made anew, its last digits, which X / s magnifies, might differ
    again = r_factor(q)
    # X = (X rough) diag(sigma) V', and X rough = Q again with an orthogonal Q
    left, s, wt = np.linalg.svd(again * sigma[:rank], full_matrices=False)
    right = v[:, :rank] @ wt.T
    turn = np.sign(right[np.abs(right).argmax(axis=0), np.arange(rank)])
    return projected(q, np.linalg.solve(again, left) * turn, "u"), s, right * turn


def low_rank(rows: DataFrame, rank: int) -> DataFrame:
    """row_id, x: the best approximation of that rank."""
    _, v = right_vectors(rows, rank)
    shared = rows.sparkSession.sparkContext.broadcast(v)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        m = _matrix(x)
        return as_lists(m @ shared.value @ shared.value.T) if len(m) else pa.array([], LISTS)

    return rows.select("row_id", project("x").alias("x"))


def pca(rows: DataFrame, components: int) -> DataFrame:
    """component, j, loading, variance of the leading principal components of the columns."""
    number = column_sums(rows).agg(F.max("n")).first()[0] or 0
    sigma, v = right_vectors(center_columns(rows), components)
    variance = sigma**2 / (number - 1) if number > 1 else np.full(len(sigma), np.nan)
    out = [(c, j, float(v[j, c]), float(variance[c])) for c in range(min(components, v.shape[1])) for j in range(len(v))]
    return rows.sparkSession.createDataFrame(out, "component int, j int, loading double, variance double")


SIDE, DEPTH = 512, 16  # of a block; blocks along the inner dimension that one task takes


def matrix_multiply(a: DataFrame, b: DataFrame, side: int = SIDE, depth: int = DEPTH) -> DataFrame:
    """i, j, v of the product of matrices in long form (i, j, v); cells that aren't there are 0, and cells of the product without any term aren't there.

    Cells are sent to a grid of blocks of ``side`` * ``side``: a block of ``a`` to each
    block column of ``b`` that there is, a block of ``b`` to each block row of ``a``.
    A task multiplies dense blocks, ``depth`` of them along the inner dimension, which
    bounds its memory; their sums are added.
    """
    block = lambda c: F.floor(F.col(c) / side)
    left = a.select("i", F.col("j").alias("k"), F.col("v").cast("double").alias("v"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").cast("double").alias("v"))
    rows, columns = (df.select(block(c).alias(name)).distinct().agg(F.collect_set(name).alias(name)) for df, c, name in ((left, "i", "bi"), (right, "j", "bj")))
    group = F.floor(F.col("k") / (side * depth))
    left = left.crossJoin(F.broadcast(columns)).select("i", "k", "v", block("i").alias("bi"), F.explode("bj").alias("bj"), group.alias("bk"))
    right = right.crossJoin(F.broadcast(rows)).select("k", "j", "v", F.explode("bi").alias("bi"), block("j").alias("bj"), group.alias("bk"))

    def multiplied(x: pa.Table, y: pa.Table) -> pa.Table:
        schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64())])
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        (i, xk, xv), (yk, j, yv) = ([t.column(c).to_numpy() for c in names] for t, names in ((x, ("i", "k", "v")), (y, ("k", "j", "v"))))
        low_i, low_j = i.min(), j.min()
        total = np.zeros((i.max() - low_i + 1, j.max() - low_j + 1))
        terms = np.zeros(total.shape, np.float32)
        for k in np.intersect1d(xk // side, yk // side):
            p, q = np.zeros((2, len(total), side)), np.zeros((2, side, total.shape[1]))
            own, other = xk // side == k, yk // side == k
            for dense, at, values in ((p, (i[own] - low_i, xk[own] - k * side), xv[own]), (q, (yk[other] - k * side, j[other] - low_j), yv[other])):
                np.add.at(dense[0], at, values)
                dense[1][at] = 1
            total += p[0] @ q[0]
            terms += (p[1].astype(np.float32) @ q[1].astype(np.float32)) > 0
        at = np.nonzero(terms)
        return pa.Table.from_arrays([pa.array(at[0] + low_i, pa.int64()), pa.array(at[1] + low_j, pa.int64()), pa.array(total[at])], schema=schema)

    keys = ["bi", "bj", "bk"]
    kinds = (a.schema["i"].dataType.simpleString(), b.schema["j"].dataType.simpleString())
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiplied, "i long, j long, v double")
    summed = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return summed.select(F.col("i").cast(kinds[0]).alias("i"), F.col("j").cast(kinds[1]).alias("j"), "v")


def matrix_trace(a: DataFrame) -> DataFrame:
    """trace of a matrix in long form."""
    return a.where("i = j").agg(F.sum("v").alias("trace"))
