"""Substring dedup on a compacted de Bruijn graph of word k-mers.

The edges are the k-mers, windows of ``WINDOW`` consecutive words; an edge that also
starts in a document with a smaller id is a repeat. Edges are dealt over the tasks
by their minimizer (the least hash of ``ANCHOR`` consecutive words in the window),
so that equal edges meet, and the stretches of neighbouring edges with one
minimizer travel as one packed row with the hashes of the nodes at its ends, the
(k-1)-mers. In a bucket, neighbouring repeats whose first sources are neighbours too
are a path, as in BCALM. Nodes where paths of different buckets meet become rows: a
node's degrees are its distinct incoming and outgoing edges, and where both are 1 the
paths on both sides are one nonbranching path. Joins that double the reach of every
step (pointer jumping) give each path its chain and its place there
(``compacted``); in documents, the paths of a chain whose places, coordinates and source
coordinates run in step are a span. Copies may begin or end inside a path of others,
and such paths stay apart in the graph; what overlaps or touches in a document is one span
in the end, whatever the graph says, and the spans go to their documents by an
equi-join. Edges are compared by hashes: inside a task by the 64 bits of the whole
window's, between tasks by the 64-bit minimizer and 48 bits of the window's; words are
not compared again.

Before the shuffle each task merges the equal edges of the documents it holds: only
those of the smallest id go on. Minimizers that stand in a large share of the
documents (common lines with ever other neighbours) are found in a first pass, and
their edges are dealt by the whole edge instead.

Defined cases: texts with fewer words than a window, and null ones, keep all their
words; rows that repeat an id are documents of the same id, neither removes words of
the other; rows without an id neither lose words nor take any; an empty table gives
an empty result; other columns are not read; ids are whole numbers of any size, and
others raise a TypeError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalframe.llm.common import WordHashes, materialise, mixed, shuffle_partitions

WINDOW = 50
ANCHOR = 16
CHUNK_WORDS = 600_000
HASH_BYTES = 6
STEP = 0xD1342543DE82EF95
INVERSE = pow(STEP, -1, 1 << 64)

_words = WordHashes()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for at, base in enumerate((STEP, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def sums_of(words: list[bytes]) -> np.ndarray:
    """Prefix sums from which the hash of any stretch follows."""
    h = _words.of(words) * powers(len(words))[1]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])


def stretch_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on."""
    many = max(0, len(sums) - size)
    return mixed((sums[size:] - sums[:many]) * powers(many)[0]) if many else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """min(x[i : i + size]) for each i."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :])


def edges_of(text: bytes | None, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer and hash of each window of a text, and the hashes of the nodes between them, one more at the end."""
    words = (text or b"").split()
    if len(words) < window:
        return (np.zeros(0, np.uint64),) * 3
    sums = sums_of(words)
    return sliding_min(stretch_hashes(sums, anchor), window - anchor + 1), stretch_hashes(sums, window), stretch_hashes(sums, window - 1)


def documents_in_chunks(it: Iterator[pa.RecordBatch], window: int, anchor: int, chunk_words: int):
    """(doc, row, minimizers, edges, nodes) lists of the documents with edges, about ``chunk_words`` edges at a time."""
    held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in it:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for doc, row, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                least, edge, node = edges_of(text, window, anchor)
                if len(edge):
                    held.append((doc, row, least, edge, node))
                    size += len(edge)
                    if size >= chunk_words:
                        yield held
                        held, size = [], 0
    if held:
        yield held


def borders(*columns: np.ndarray) -> np.ndarray:
    """Where a stretch of rows with equal values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def hot_anchors(docs: DataFrame, window: int, anchor: int, chunk_words: int, partitions: int) -> np.ndarray:
    """Minimizers with at least 1 / (4 * partitions) of all packed rows. A chunk reports those with half this share of its own, so the others can't reach it together; the result has at most 8 * partitions of them."""
    share = 1 / (4 * partitions)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in documents_in_chunks(it, window, anchor, chunk_words):
            least = np.concatenate([x[borders(x)] for _, _, x, *_ in held])
            value, many = np.unique(least, return_counts=True)
            use = many >= max(2.0, share / 2 * len(least))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value[use], 0).view(np.int64)), pa.array(np.append(many[use], 0)), pa.array(np.append(np.zeros(use.sum(), np.int64), len(least)))], ["anchor", "n", "total"])

    counted = docs.mapInArrow(count, "anchor long, n long, total long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counted = materialise(counted)
    total = counted.agg(F.sum("total")).first()[0] or 0
    found = counted.where(F.col("n") >= max(2.0, share / 2 * total)).select("anchor").collect()  # no more than 8 * partitions
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def repeat_paths(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_words: int = CHUNK_WORDS, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """The paths of repeated edges in ``docs`` (doc, row, text): doc, row, first and last (edge numbers), source (the smallest document with them) and source_first, the nodes at the ends where another bucket's path may go on (else null), and the hashes of the first and last edge. For edges merged in a task all but coordinates are null."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    hot = spark.sparkContext.broadcast(hot_anchors(docs, window, anchor, chunk_words, partitions))
    path_schema = "doc long, row long, first long, last long, source long, source_first long, start_node long, end_node long, first_edge long, last_edge long"
    path_names = [c.split()[0] for c in path_schema.split(", ")]

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "anchor", "doc", "row", "first", "edges", "start", "end"]
        for held in documents_in_chunks(it, window, anchor, chunk_words):
            sizes = np.array([len(x) for _, _, x, *_ in held])
            doc = np.repeat(np.array([d for d, *_ in held], np.int64), sizes)
            which = np.repeat(np.arange(len(held)), sizes)
            row = np.array([r for _, r, *_ in held], np.int64)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            least, edge, node = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            by = np.argsort(edge, kind="stable")
            first = np.flatnonzero(borders(edge[by]))
            smallest = np.minimum.reduceat(doc[by], first)
            repeated = np.zeros(len(doc), bool)
            repeated[by] = doc[by] > np.repeat(smallest, np.diff(np.append(first, len(by))))
            # the edges merged here: paths of their own
            at = np.flatnonzero(repeated)
            begin = np.flatnonzero(borders(which[at], at - np.arange(len(at))))
            low, high = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at
            ends = place[high].astype("<i8")
            n = len(low)
            route = mixed(np.arange(n, dtype=np.uint64) + edge[low]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.nulls(n, pa.int64()), pa.array(doc[low]), pa.array(row[which[low]]), pa.array(place[low]), pa.array([x.tobytes() for x in ends], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
            # the others go on, packed by minimizer, or one by one where it is hot
            at = np.flatnonzero(~repeated)
            common = np.isin(least[at], hot.value)
            begin = np.flatnonzero(borders(which[at], at - np.arange(len(at)), least[at]) | common)
            low, high = at[begin], np.append(begin[1:], len(at))
            packed = edge[at].view(np.uint8).reshape(-1, 8)[:, :hash_bytes].tobytes()
            route = np.where(common[begin], mixed(edge[low] ^ least[low]), least[low]).view(np.int64)
            final = at[high - 1] if len(at) else at
            nodes = [x.view(np.int64) for x in (node[low + which[low]], node[final + which[final] + 1])]
            for lo in range(0, len(low), 50_000):
                part = slice(lo, lo + 50_000)
                edges = [packed[a * hash_bytes : b * hash_bytes] for a, b in zip(begin[part].tolist(), high[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(route[part]), pa.array(least[low[part]].view(np.int64)), pa.array(doc[low[part]]), pa.array(row[which[low[part]]]), pa.array(place[low[part]]), pa.array(edges, pa.binary()), *[pa.array(x[part]) for x in nodes]], names)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paths(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, doc, row, first, start_node, end_node = (rows.column(i).to_numpy() for i in (1, 2, 3, 4, 6, 7))
            edges = rows.column(5).combine_chunks()
            size = pa.compute.binary_length(edges).to_numpy() // hash_bytes
            flat = np.zeros((int(size.sum()), 8), np.uint8)
            flat[:, :hash_bytes] = np.frombuffer(b"".join(edges.to_pylist()), np.uint8).reshape(-1, hash_bytes)
            which = np.repeat(np.arange(len(doc)), size)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            place = first[which] + inside
            edge = flat.view(np.uint64)[:, 0]
            docs_, least = doc[which], anchor[which]
            by = np.lexsort((docs_, edge, least))
            start = np.flatnonzero(borders(edge[by], least[by]))
            many = np.diff(np.append(start, len(by)))
            source, source_place = np.empty_like(docs_), np.empty_like(place)
            source[by] = np.repeat(docs_[by][start], many)
            source_place[by] = np.repeat(place[by][start], many)
            at = np.flatnonzero(docs_ > source)
            begin = np.flatnonzero(borders(which[at], place[at] - np.arange(len(at)), source[at], source_place[at] - np.arange(len(at))))
            low, high = at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at
            ends = [pa.array(start_node[which[low]], mask=inside[low] > 0), pa.array(end_node[which[high]], mask=inside[high] + 1 < size[which[high]])]
            edges_at = [pa.array(mixed(edge[x] ^ mixed(least[x].view(np.uint64))).view(np.int64)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (docs_[low], row[which[low]], place[low], place[high], source[low], source_place[low])], *ends, *edges_at], path_names)

        left = None
        for batch in it:
            route, given = batch.column(0).to_numpy(), pa.Table.from_batches([batch])
            local = batch.column(1).is_null()
            ready = given.filter(local)
            if ready.num_rows:
                last = np.frombuffer(b"".join(ready.column(5).to_pylist()), "<i8")
                n = ready.num_rows
                yield pa.RecordBatch.from_arrays([*(ready.column(i).combine_chunks() for i in (2, 3, 4)), pa.array(last), *[pa.nulls(n, pa.int64())] * 6], path_names)
            given = given.filter(pa.compute.invert(local))
            given = pa.concat_tables([left, given]) if left is not None else given
            if not given.num_rows:
                continue
            route = given.column(0).to_numpy()
            over = int(np.searchsorted(route, route[-1], "left"))  # rows are sorted by route: the last one may go on
            if over:
                yield from paths(given.slice(0, over))
            left = given.slice(over).combine_chunks()
        if left is not None and left.num_rows:
            yield from paths(left)

    packed = docs.mapInArrow(pack, "route long, anchor long, doc long, row long, first long, edges binary, start long, end long")
    return packed.repartition(partitions, "route").sortWithinPartitions("route").mapInArrow(meet, path_schema)


def _with_row(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row (a hash of the text, which tells rows that share an id apart) and text in UTF-8."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).cast("binary").alias("text"))


def compacted(paths: DataFrame) -> DataFrame:
    """first_edge, last_edge, n (edges), chain and offset of each distinct path: paths in a row at nodes of one edge in and one out are one chain, offset edges from its first path on.

    Each round joins every path with the one its pointer leads to, so reaches double; it
    ends when no path finds more, with the paths of cycles, which have no first one, as
    chains of their own.
    """
    distinct = paths.where("source IS NOT NULL").withColumn("n", F.col("last") - F.col("first") + 1).groupBy("first_edge", "last_edge", "n")
    units = materialise(distinct.agg(F.max("start_node").alias("start_node"), F.max("end_node").alias("end_node")).withColumn("unit", F.xxhash64("first_edge", "last_edge", "n")))
    ends = units.select(F.col("end_node").alias("node"), F.col("last_edge").alias("into"), F.lit(None).cast("long").alias("out"), F.struct("n", "unit").alias("before"))
    starts = units.select(F.col("start_node").alias("node"), F.lit(None).cast("long").alias("into"), F.col("first_edge").alias("out"), F.lit(None).cast("struct<n: bigint, unit: bigint>").alias("before"))
    # distinct edges on either side are one where the least and the greatest hash are the same
    degrees = ends.unionByName(starts).where("node IS NOT NULL").groupBy("node").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("into", "out")], F.max("before").alias("before"))
    single = degrees.where("min_into = max_into AND min_out = max_out").select(F.col("node").alias("start_node"), "before")
    known = units.join(single, "start_node", "left").where("before IS NULL OR before.unit <> unit")
    state = materialise(known.select("unit", F.coalesce("before.unit", "unit").alias("to"), F.coalesce("before.n", F.lit(0)).alias("offset"), F.col("before").isNull().alias("done")))
    left = None
    while (open_ := state.where("NOT done").count()) and open_ != left:
        left = open_
        ahead = state.select(F.col("unit").alias("to"), F.col("to").alias("next"), F.col("offset").alias("more"), F.col("done").alias("ends"))
        state = materialise(state.join(ahead, "to", "left").select("unit", F.coalesce("next", "to").alias("to"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), (F.col("done") | F.coalesce("ends", F.lit(True))).alias("done")))
    of = F.when(F.col("done"), F.col("to")), F.when(F.col("done"), F.col("offset"))
    found = units.join(state, "unit", "left")
    return found.select("first_edge", "last_edge", "n", F.coalesce(of[0], "unit").alias("chain"), F.coalesce(of[1], F.lit(0)).alias("offset"))


def spans_of_chains(paths: DataFrame) -> DataFrame:
    """doc, row, first and last of the spans that ``paths`` make along their chains: what runs in step with the chain and with the source, edge after edge."""
    known, local = paths.where("source IS NOT NULL"), paths.where("source IS NULL")  # the latter have no edge to join by
    placed = known.withColumn("n", F.col("last") - F.col("first") + 1).join(compacted(paths), ["first_edge", "last_edge", "n"], "left")
    placed = placed.withColumn("shift", F.col("first") - F.col("offset")).withColumn("source_shift", F.col("source_first") - F.col("first"))
    step = Window.partitionBy("doc", "row", "chain", "shift", "source", "source_shift").orderBy("first")
    new = F.coalesce(F.col("first") > F.lag("last").over(step) + 1, F.lit(True)).cast("int")
    numbered = placed.withColumn("new", new).withColumn("island", F.sum("new").over(step.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["doc", "row", "chain", "shift", "source", "source_shift", "island"]
    spans = numbered.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.select("doc", "row", "first", "last").unionByName(local.select("doc", "row", "first", "last"))


def repeated_spans(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc, row and spans (first word, end word excluded) of what repeats; spans are joined where one begins no later than behind another's last word."""
    known = rows.where("doc is not null")
    paths = spans_of_chains(materialise(repeat_paths(known, window, anchor, chunk_words)))
    paths = paths.select("doc", "row", F.col("first").alias("start"), (F.col("last") + window).alias("end")).distinct()
    along = Window.partitionBy("doc", "row").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    numbered = paths.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc", "row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _applied(docs: DataFrame, id_col: str, text_col: str, window: int, per_text, schema: str, kinds: list[pa.DataType], chunk_words: int) -> DataFrame:
    rows = _with_row(docs, id_col, text_col)
    met = rows.join(repeated_spans(rows, window, min(ANCHOR, window), chunk_words), ["doc", "row"], "left").select("doc", "text", "spans")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words, kept, at = (text or b"").split(), [], 0
                    for span in spans or []:
                        kept += words[at : span["start"]]
                        at = span["end"]
                    kept += words[at:]
                    out.append(per_text(len(words), b" ".join(kept), len(kept)))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc", *[f"c{n}" for n in range(len(kinds))]])

    return met.mapInArrow(work, f"doc long, {schema}")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """A row for each document: id, n_words, n_removed and kept_sha256, the digest of its kept words joined by blanks."""
    found = _applied(docs, id_col, text_col, window, lambda n, kept, k: (n, n - k, hashlib.sha256(kept).hexdigest()), "c0 long, c1 long, c2 string", [pa.int64(), pa.int64(), pa.string()], chunk_words)
    return found.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("c0").alias("n_words"), F.col("c1").alias("n_removed"), F.col("c2").alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """id and the text that is left: the kept words joined by blanks."""
    found = _applied(docs, id_col, text_col, window, lambda n, kept, k: (kept.decode("utf-8", "replace"),), "c0 string", [pa.string()], chunk_words)
    return found.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), F.col("c0").alias(text_col))
