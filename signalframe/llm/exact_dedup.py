"""Exact dedup by Grace hashing.

Texts are equal when identical after each run of ASCII white space became one
space; null counts as empty. The hash of the normalised text deals records out
over Spark's shuffle partitions (the first Grace partitioning). In a partition an
open-addressing table with a byte budget compares complete contents; contents
that no longer fit go to spill files by further hash bits, and each file is then
treated the same way, one level deeper. Before the shuffle every input partition
is reduced with the same table, so however many copies a text has, no more than
one record of it for each input partition (or filling of the table) is shuffled.

Spill files live in the task's own temporary folder and end with the task, like
Spark's own spill: a retried task starts anew from its shuffle input.

Defined cases: of equal texts the smallest id stays, null ids come last; rows that
repeat an id and its text are one document (``keep_rows`` leaves one of them,
``report`` lists each); an empty table gives an empty result; columns of any other
name pass through ``keep_rows``.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from signalframe.llm.common import claim, fresh, release, shuffle_partitions

SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
FANOUT_BITS = 4
TABLE_BYTES = 48 << 20


def normalised(text: str | None) -> bytes:
    """``text`` in UTF-8 with every run of ASCII white space as one space."""
    out = (text or "").encode().translate(SPACES)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


class OpenTable:
    """Open addressing with linear probing; a hit needs the same hash and the same complete content."""

    def __init__(self, budget: int, slots: int = 1 << 10) -> None:
        self.budget, self.bytes = budget, 0
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []

    def find(self, h: int, content: bytes) -> int:
        """The entry with this content, or -1 - the free slot for it."""
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return -1 - at

    def fits(self, content: bytes) -> bool:
        return not self.contents or self.bytes + len(content) <= self.budget

    def put(self, slot: int, h: int, content: bytes, value: list) -> None:
        self.slots[-1 - slot] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for entry, old in enumerate(self.hashes):
                at = old & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = entry


def merged(value: list, other: list) -> None:
    """Values are [id, count, payload]: adds the counts, keeps id and payload of the smaller id."""
    value[1] += other[1]
    if other[0] is not None and (value[0] is None or other[0] < value[0]):
        value[0], value[2] = other[0], other[2]


def grace(records: Iterator[tuple[int, bytes, list]], budget: int, level: int = 0) -> Iterator[tuple[int, bytes, list]]:
    """(hash, content, value) -> the same with one record for each content; contents beyond ``budget`` bytes are spilled by hash bits and done one level deeper."""
    table = OpenTable(budget)
    shift = 60 - FANOUT_BITS * level
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files: dict[int, object] = {}
        for h, content, value in records:
            at = table.find(h, content)
            if at >= 0:
                merged(table.values[at], value)
            elif table.fits(content) or shift < 0:  # with no bits left all hashes are the same: the table takes the rest
                table.put(at, h, content, value)
            else:
                bucket = (h >> shift) & ((1 << FANOUT_BITS) - 1)
                if bucket not in files:
                    files[bucket] = open(os.path.join(folder, str(bucket)), "wb")  # noqa: SIM115
                pickle.dump((h, content, value), files[bucket], pickle.HIGHEST_PROTOCOL)
        yield from zip(table.hashes, table.contents, table.values, strict=True)
        del table
        for bucket, file in files.items():
            file.close()
            yield from grace(spilled(os.path.join(folder, str(bucket))), budget, level + 1)
            os.remove(os.path.join(folder, str(bucket)))


def spilled(path: str) -> Iterator[tuple[int, bytes, list]]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def flushed(records: Iterator[tuple[int, bytes, list]], budget: int) -> Iterator[tuple[int, bytes, list]]:
    """Merges equal contents as long as the table has room; a full table is handed on and emptied."""
    table = OpenTable(budget)
    for h, content, value in records:
        at = table.find(h, content)
        if at >= 0:
            merged(table.values[at], value)
            continue
        if not table.fits(content):
            yield from zip(table.hashes, table.contents, table.values, strict=True)
            table = OpenTable(budget)
            at = table.find(h, content)
        table.put(at, h, content, value)
    yield from zip(table.hashes, table.contents, table.values, strict=True)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def batches(rows: Iterator[dict], schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``rows`` in record batches of about ``most`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, str | bytes))
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _groups(df: DataFrame, id_col: str, text_col: str, payload: bool, budget: int) -> tuple[DataFrame, dict[str, str]]:
    """A row for each content: hash, smallest id, count, and (payload) the row that stays as it came or else the normalised text's digest."""
    columns = df.columns
    names = {n: fresh(f"__{n}", columns) for n in ("hash", "content", "id", "count")}
    own = [f for f in df.schema.fields] if payload else []
    head = [T.StructField(names["hash"], T.LongType()), T.StructField(names["id"], df.schema[id_col].dataType), T.StructField(names["count"], T.LongType())]
    inner = T.StructType([*head, *([] if payload else [T.StructField(names["content"], T.BinaryType())]), *own])
    outer = T.StructType([*head, *own] if payload else [*head, T.StructField("text_sha256", T.StringType())])
    inner_arrow, outer_arrow = to_arrow_schema(inner), to_arrow_schema(outer)

    def reduce_locally(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            claim("exact dedup")
            for batch in it:
                for row in chain.from_iterable(batch.slice(lo, 256).to_pylist() for lo in range(0, batch.num_rows, 256)):
                    content = normalised(row[text_col])
                    yield xxhash.xxh3_64_intdigest(content), content, [row[id_col], 1, row if payload else None]

        def rows():
            for h, content, (key, count, row) in flushed(records(), budget):
                yield {names["hash"]: signed(h), names["id"]: key, names["count"]: count} | (row if payload else {names["content"]: content})

        yield from batches(rows(), inner_arrow)
        release()

    def resolve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            claim("exact dedup")
            for batch in it:
                for row in chain.from_iterable(batch.slice(lo, 256).to_pylist() for lo in range(0, batch.num_rows, 256)):
                    content = normalised(row[text_col]) if payload else row[names["content"]]
                    yield row[names["hash"]] % (1 << 64), content, [row[names["id"]], row[names["count"]], row if payload else None]

        def rows():
            for h, content, (key, count, row) in grace(records(), budget):
                yield (row or {}) | {names["hash"]: signed(h), names["id"]: key, names["count"]: count} | ({} if payload else {"text_sha256": hashlib.sha256(content).hexdigest()})

        yield from batches(rows(), outer_arrow)
        release()

    taken = df if payload else df.select(id_col, text_col)
    dealt = taken.mapInArrow(reduce_locally, inner).repartition(shuffle_partitions(df.sparkSession), names["hash"])
    return dealt.mapInArrow(resolve, outer), names


def keep_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``df``, all columns, with one row (the smallest id) for each text."""
    groups, names = _groups(df, id_col, text_col, True, table_bytes)
    return groups.select(*[F.col(f"`{c}`") for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row for each row of ``df``: id, keep_id, group_size, kept, text_sha256.

    The groups come from the Grace tables. Members find theirs by the digest of
    the normalised text in an equi-join that AQE splits where one text holds a
    large share of the rows.
    """
    groups, names = _groups(df, id_col, text_col, False, table_bytes)
    groups = groups.select("text_sha256", F.col(names["id"]).alias("keep_id"), F.col(names["count"]).alias("group_size"))
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    members = df.select(F.col(id_col), F.sha2(plain.cast("binary"), 256).alias("text_sha256"))
    return members.join(groups, "text_sha256").select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
