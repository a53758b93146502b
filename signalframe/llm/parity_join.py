"""N-gram Jaccard join with parity sketches: the components of near-equal documents.

A document's set holds the 64-bit hashes of its distinct word shingles. A sketch of
P parts of 64 bits takes each element to one part and flips one bit of it, so
sketches differ in no more bits than the sets differ in elements. Two sets that
link differ in at most D elements, D following from the sizes of a band; with
P = D + 1 + R parts at least 1 + R parts agree wholly (pigeonhole), and documents
that share a part of the same band meet in its bucket. Sizes in a link differ by
less than the ratio of neighbouring bands, so a document stands in its own and in
the next band. Parts of fewer than two set bits say little: a document that has at
most R of those leaves them out, which still leaves one agreeing part of every link.

Equal sets are one node from the start. Elements
that only one node has can't be in an intersection: they are counted (u) and left
out of sketches, which makes R greater by u and D less by u for each of two nodes.
Nodes that have too many of them link with nothing and are left out; the sets of all
others are written once.

Buckets are never expanded into all pairs. Each has a pivot, the member with the
least share of elements of its own; members are compared with it, by short
sketches first, which have four bits and more for each element in which linked sets may differ, then by their sets, and links make components. Buckets whose members
are still in several components go on. Those of at most ``SMALL`` members compare
the sketches of members of different components inside the task, and emit only near
pairs. A larger one is dealt anew by how its members differ from what most of them have: two
members that link share one of the first D + 1 elements of their differences, or
differ so little that the one with the least difference links with both
(``difference_entries``), so (pivot, element) are the buckets of the next round. The
pivot is in none of these, so buckets shrink until none is large. No link between
components can be missed.

Defined cases: a document with fewer words than a shingle has them all as its only
element; without words or text its set is empty, it links with nothing and is its
own component; a row without id has no component; rows that repeat an id count
each; an empty table gives an empty result; other columns, whatever their names, are
not read, and ``representatives`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import LOWER, WordHashes, claim, materialise, mixed, release, shuffle_partitions

SHINGLE = 3
THRESHOLD = (90, 100)
SPARE = 2  # R
CHUNK_ROWS = 600_000
BROADCAST_BYTES = 16_000_000
SMALL = 1000
FEW_LINKS = 500_000  # 8 MB
BITS = 4  # of a short sketch for each element in which its set may differ from one that it links with

_words = WordHashes()


def shingle_hashes(text: bytes | None, k: int, seed: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text's lower-cased words."""
    words = (text or b"").translate(LOWER).split()
    h = mixed(_words.of(words) + np.uint64(seed))
    if not words:
        return h
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - n + 1 + i])
    return np.unique(out)


@lru_cache
def band_limits(threshold: tuple[int, int], most: int) -> np.ndarray:
    """The least size of each band; a set links with none that is two bands below."""
    num, den = threshold
    limits = [1]
    while limits[-1] <= most:
        limits.append(max(limits[-1] + 1, -(-limits[-1] * den // num)))
    return np.array(limits)


@lru_cache(maxsize=100_000)
def part_borders(parts: int) -> np.ndarray:
    """The least element of each part but the first, and then the end: parts are ranges of the upper 32 bits."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)], np.uint64)


def bucket_keys(elements: np.ndarray, threshold: tuple[int, int], own: int = 0, spare: int = SPARE) -> np.ndarray:
    """The buckets in which a set stands that has ``own`` elements more, which no other has: hashes of band, part and the part's parity bits."""
    num, den = threshold
    size = len(elements) + own
    limits = band_limits(threshold, 1 << max(10, size.bit_length() + 1))
    at = int(np.searchsorted(limits, size, "right")) - 1
    flips = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << (elements & np.uint64(63)))])
    out = []
    for band in (at, at + 1):
        differ = 2 * (int(limits[band + 1]) - 1) * (den - num) // (den + num)
        if differ < max(1, own):  # only equal sets link, or none
            continue
        parts = differ + 1 + spare
        ends = np.concatenate([[0], np.searchsorted(elements, part_borders(parts)), [len(elements)]])
        sketch = flips[ends[1:]] ^ flips[ends[:-1]]
        weak = (sketch & (sketch - np.uint64(1))) == 0
        keys = mixed(sketch ^ mixed(np.uint64(band << 32) + np.arange(parts, dtype=np.uint64)))
        out.append(keys[~weak] if weak.sum() <= spare + own else keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(elements: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes(), seed)).astype(np.int64))


def sketch_words(n: int, threshold: tuple[int, int]) -> int:
    """64-bit words of the short sketch of a set of ``n``, a power of 2: so many that bits rarely meet while sets may still link."""
    num, den = threshold
    differ = 2 * n * (den - num) // (den + num)
    return max(4, 1 << (BITS * differ // 64).bit_length())


def short_sketch(elements: np.ndarray, words: int = 4) -> np.ndarray:
    """The parity bits of a whole set in ``words`` words, a power of 2."""
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (elements >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (elements & np.uint64(63)))
    return out


def same_width(sketches: list[bytes]) -> np.ndarray:
    """Short sketches as rows of the least width among them; wider ones are folded, which keeps the bound."""
    words = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(as_array(s).reshape(-1, words), axis=0) for s in sketches])


def as_array(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint64)


def set_rows(docs: DataFrame, id_col: str, text_col: str, k: int, seed: int, with_elements: bool) -> DataFrame:
    """id, n (set size), node, and a second hash of the set or its elements; all but n null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    last, last_kind = (np.ndarray.tobytes, "binary") if with_elements else (lambda s: node_of(s, seed + 1), "long")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it):
            sets = [shingle_hashes(t, k, seed) for t in part.column(1).to_pylist()]
            columns = [pa.array([f(s) if len(s) else None for s in sets], t) for f, t in ((lambda s: node_of(s, seed), pa.int64()), (last, pa.binary() if with_elements else pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *columns], ["id", "n", "node", "last"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("__text")).mapInArrow(work, f"id {kind}, n long, node long, last {last_kind}")


def slices(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    claim("shingles", _words.clear)
    for batch in it:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release()


def starred(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, and how many nodes the key has."""
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    sizes = np.diff(np.append(starts, len(key)))
    return key, node, np.repeat(sizes, sizes)


def packed(place: np.ndarray, value: np.ndarray, node: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (value, node, flag) as one row for each place: its values, its distinct nodes, and for each value the node's number and the flag."""
    if not len(place):
        return
    by = np.argsort(place, kind="stable")
    place, value, node, flag = place[by], value[by], node[by], flag[by]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    out = []
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(place)).tolist(), strict=True):
        nodes, number = np.unique(node[a:b], return_inverse=True)
        out.append((int(place[a]), value[a:b].tobytes(), nodes.tobytes(), (number << 1 | flag[a:b]).astype("<u2").tobytes()))
        if len(out) == 256:
            yield _packed_batch(out)
            out = []
    if out:
        yield _packed_batch(out)


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["place", "value", "node", "number"])


def opened(value: bytes, node: bytes, number: bytes, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    number = np.frombuffer(number, "<u2")
    return np.frombuffer(value, kind), np.frombuffer(node, np.int64)[number >> 1], (number & 1).astype(bool)


PACKED = "place int, value binary, node binary, number binary"


def shared_elements(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], whole: bool) -> DataFrame:
    """Rows (node, g, elements): g elements of a node that others have too, and (``whole``) which. ``sets_of`` gives the nodes and sets of a batch of ``rows``.

    A task that holds several nodes with an element knows it is shared, and sends it
    on once, so an element that all documents have is no large group anywhere. Without
    ``whole`` half of an element's bits beside its place stand for it; g is then at
    least the true number, as it is where a node comes twice.
    """
    places = shuffle_partitions(rows.sparkSession)
    kind = np.uint64 if whole else np.uint32

    def by_node(node: np.ndarray, element: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(node, kind="stable")
        node, element = node[by], np.ascontiguousarray(element[by])
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
        ends = np.append(starts, len(node)).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * 8), pa.py_buffer(element)])
        return pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(np.diff(ends).astype(np.int64)), lists], ["node", "g", "elements"])

    def sent(element: np.ndarray) -> np.ndarray:
        return element if whole else (element >> np.uint64(32)).astype(np.uint32)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            element, node, many = starred(np.concatenate([s for _, s in held]), np.repeat(np.array([n for n, _ in held], np.int64), [len(s) for _, s in held]))
            first = np.append(True, element[1:] != element[:-1])
            yield from packed((element[first] % np.uint64(places)).astype(np.int64), sent(element[first]), np.where(many[first] > 1, 0, node[first]), many[first] > 1)
            known = many > 1  # these need no meeting
            spread_over = mixed(node[known].view(np.uint64)) % np.uint64(places)
            yield from packed(-1 - spread_over.astype(np.int64), sent(element[known]), node[known], known[known])

        for part in slices(it, 256):
            for node, elements in sets_of(part):
                held.append((node, elements))
                size += len(elements)
                if size >= CHUNK_ROWS or len(held) >= 30_000:  # fewer nodes than 15 bits count
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def met(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        element, node, many = (np.concatenate(x) for x in zip(*found, strict=True))
        shared = np.unique(element[many])
        alone = ~many
        element, node, several = starred(element[alone], node[alone])
        use = (several > 1) | np.isin(element, shared)
        return by_place(node[use], element[use])

    def by_place(node: np.ndarray, element: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Nodes, how many elements each has, and the elements, as one row for each place of nodes."""
        place = (mixed(node.view(np.uint64)) % np.uint64(places)).astype(np.int32)
        by = np.lexsort((node, place))
        place, node, element = place[by], node[by], element[by]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
        counts = np.diff(np.append(starts, len(node)))
        for p in np.unique(place).tolist():
            a, b = np.searchsorted(place, (p, p + 1))
            own = slice(*np.searchsorted(starts, (a, b)))
            columns = [[p], [node[starts[own]].tobytes()], [counts[own].tobytes()], [element[a:b].tobytes() if whole else None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["place", "node", "g", "elements"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at = None
        for batch in it:
            for place, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    element, node, _ = opened(*row, kind)
                    yield from by_place(node, element)
                    continue
                if place != at and held:
                    yield from met(held)
                    held = []
                at = place
                held.append(opened(*row, kind))
        if held:
            yield from met(held)

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, ...]] = []
        at = None

        def gathered() -> pa.RecordBatch:
            node, g = (np.frombuffer(b"".join(x), np.int64) for x in list(zip(*held, strict=True))[:2])
            if whole:
                return by_node(np.repeat(node, g), as_array(b"".join(row[2] for row in held)))
            found, number = np.unique(node, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(number, g, len(found)).astype(np.int64)), pa.nulls(len(found), pa.binary())], ["node", "g", "elements"])

        for batch in it:
            for place, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at and held:
                    yield gathered()
                    held = []
                at = place
                held.append(tuple(row))
        if held:
            yield gathered()

    def dealt(packed_rows: DataFrame) -> DataFrame:
        return packed_rows.repartition(places, "place").sortWithinPartitions("place")

    tallies = dealt(rows.mapInArrow(spread, PACKED)).mapInArrow(count, "place int, node binary, g binary, elements binary")
    return dealt(tallies).mapInArrow(total, "node long, g long, elements binary")


def limited(df: DataFrame) -> DataFrame:
    """``df``, a written table of few columns, marked for broadcast if its values take few bytes."""
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(8)))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def linkable(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, k: int, seed: int, threshold: tuple[int, int]) -> DataFrame:
    """Of the distinct sets those that can link: node, n, u (elements of its own), the other elements and their short sketch. ``known`` has node, n and the id of a document that has the set."""
    num, den = threshold

    def of_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for text in batch.column(0).to_pylist():
            if len(s := shingle_hashes(text, k, seed)):
                yield node_of(s, seed), s

    def of_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        return zip(batch.column(0).to_pylist(), map(as_array, batch.column(1).to_pylist()), strict=True)

    def documents_of(ids: DataFrame) -> DataFrame:
        ids = materialise(ids.select(F.col("id").alias(id_col)).distinct())
        return docs.join(limited(ids), id_col, "left_semi")

    counted = shared_elements(documents_of(known).select(F.col(text_col).cast("binary").alias("__text")), of_texts, False)
    able = materialise(counted.join(known, "node").where(den * F.col("g") >= num * F.col("n")).select("node", "id", "n"))
    sets = set_rows(documents_of(able), id_col, text_col, k, seed, True).where("node is not null")
    sets = materialise(sets.select("node", F.col("last").alias("elements")).join(limited(materialise(able.select("node"))), "node", "left_semi"))
    found = shared_elements(sets, of_sets, True).join(able, "node")

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it):
            elements = [np.unique(as_array(x)) for x in part.column(2).to_pylist()]
            own = part.column(1).to_numpy() - np.array([len(s) for s in elements])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(own), pa.array([s.tobytes() for s in elements], pa.binary()), pa.array([short_sketch(s, sketch_words(n, threshold)).tobytes() for n, s in zip(part.column(1).to_pylist(), elements, strict=True)], pa.binary())], ["node", "n", "u", "elements", "sketch"])

    live = found.select("node", "n", "elements").mapInArrow(gather, "node long, n long, u long, elements binary, sketch binary")
    return materialise(live.where(den * (F.col("n") - F.col("u")) >= num * F.col("n")))


def bucket_entries(live: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, node) for the buckets of each node."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(it, 256):
            keys = [bucket_keys(as_array(s), threshold, u) for u, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            node = np.repeat(part.column(0).to_numpy(), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node)], ["key", "node"])

    return live.select("node", "u", "elements").mapInArrow(work, "key long, node long")


def buckets(entries: DataFrame, live: DataFrame) -> DataFrame:
    """key, node, and each key's size and pivot, for ``entries`` (key, node, perhaps lead: only keys with a leading entry count) that share a key."""
    rank = F.struct((F.col("u") / F.col("n")).alias("rank"), F.xxhash64("node").alias("hash"), "node")
    lead = F.max("lead") if "lead" in entries.columns else F.lit(True)
    entries = materialise(entries.join(limited(materialise(live.select("node", "n", "u"))), "node"))
    sizes = entries.groupBy("key").agg(F.count("node").alias("size"), F.min(rank)["node"].alias("pivot"), lead.alias("led")).where("size > 1 and led")
    return materialise(entries.select("key", "node").join(sizes.drop("led"), "key"))


def verified(pairs: DataFrame, live: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets link: by sizes and short sketches first, then by the elements."""
    num, den = threshold

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            n, m, u, v = (batch.column(i).to_numpy() for i in range(2, 6))
            both = map(same_width, zip(*(batch.column(i).to_pylist() for i in (6, 7)), strict=True))
            apart = np.array([np.bitwise_count(x ^ y).sum(dtype=np.int64) for x, y in both], np.int64)
            yield batch.select([0, 1]).filter(pa.array(apart + u + v <= (n + m) * (den - num) // (den + num)))

    def end(x: str, *columns: str) -> DataFrame:
        return live.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    met = pairs.join(end("a", "n", "u", "sketch"), "a").join(end("b", "n", "u", "sketch"), "b").select("a", "b", "n_a", "n_b", "u_a", "u_b", "sketch_a", "sketch_b")
    close = materialise(met.mapInArrow(near, "a long, b long"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 128):
            both = np.array([len(np.intersect1d(as_array(x), as_array(y), assume_unique=True)) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            union = batch.column(2).to_numpy() + batch.column(3).to_numpy() - both
            yield batch.select([0, 1]).filter(pa.array(den * both >= num * union))

    met = close.join(end("a", "n", "elements"), "a").join(end("b", "n", "elements"), "b").select("a", "b", "n_a", "n_b", "elements_a", "elements_b")
    return materialise(met.mapInArrow(compare, "a long, b long"))


def joined(links: DataFrame) -> DataFrame:
    """``components`` of a bounded number of links, in one task."""

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in it:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

    return links.coalesce(1).mapInArrow(join, "node long, component long")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, component): the smallest node that links lead to, for the nodes of ``links`` (a, b), by alternating large and small stars; ``few`` links are joined in one task."""
    links = materialise(links.where("a <> b"))
    if links.count() <= few:
        return materialise(joined(links))
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialise(stars.union(edges.select("v", "v")).distinct())


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only the components that these join are resolved anew."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    nodes = labels.union(moved.select("component", "component").toDF("node", "component")).distinct()
    return materialise(nodes.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component")))


def spanning(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that have several."""
    now = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return materialise(now.join(several, "key"))


def near_within(members: DataFrame, live: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of members of small buckets, in different components, that sizes and short sketches don't rule out."""
    num, den = threshold
    row = F.struct("node", "component", "n", "u", "sketch")
    groups = members.select("key", "node", "component").join(live.select("node", "n", "u", "sketch"), "node").groupBy("key").agg(F.collect_list(row).alias("rows"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 256):
            rows = batch.column(0).flatten()
            ends = np.cumsum(np.append(0, batch.column(0).value_lengths().to_numpy()))
            node, component, n, u = (rows.field(i).to_numpy() for i in range(4))
            sketches = rows.field(4).to_pylist()
            out = [np.zeros((0, 2), np.int64)]
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                sketch = same_width(sketches[lo:hi])
                for i in range(lo, hi - 1):
                    most = (n[i] + n[i + 1 : hi]) * (den - num) // (den + num) - u[i] - u[i + 1 : hi]
                    near = np.flatnonzero((component[i] != component[i + 1 : hi]) & (most > 0))
                    if len(near):
                        near = near[np.bitwise_count(sketch[i - lo] ^ sketch[i - lo + 1 + near]).sum(axis=1, dtype=np.int64) <= most[near]]
                        out.append(np.stack([np.minimum(node[i], node[i + 1 + near]), np.maximum(node[i], node[i + 1 + near])], axis=1))
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return materialise(groups.select("rows").mapInArrow(compare, "a long, b long").distinct())


def centres(stars: DataFrame, live: DataFrame, sample: int = 64) -> DataFrame:
    """pivot and centre: the elements that most of about ``sample`` of the pivot's nodes have. Any set would do; one near all of them leaves small differences."""

    def most(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 64):
            out = []
            for sets in batch.column(1).to_pylist():
                elements, count = np.unique(as_array(b"".join(sets)), return_counts=True)
                out.append(elements[2 * count > len(sets)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["pivot", "centre"])

    sizes = stars.groupBy("pivot").agg(F.count("node").alias("size"))
    some = stars.join(sizes, "pivot").where(F.pmod(F.xxhash64("pivot", "node"), F.lit(1 << 30)) * F.col("size") < sample << 30)
    return some.join(live.select("node", "elements"), "node").groupBy("pivot").agg(F.collect_list("elements").alias("sets")).mapInArrow(most, "pivot long, centre binary")


def difference_entries(stars: DataFrame, live: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, node, lead, w) for ``stars`` (pivot, node): keys are the pivot and each of the first elements in which a node differs from it.

    Let d(x) be the elements of x's own, then those that the pivot's centre lacks, then
    those of the centre that x lacks. Linked x and y differ in at most D elements, so d(x)
    and d(y) have (|d(x)| + |d(y)| - D) / 2 in common at least. If that is over 0, one of
    the first D / 2 + 1 elements of the smaller (its leading entries) is among the first
    D + 1 of the larger. Else |d(x)| + |d(y)| <= D, which makes x and y link; as D is a
    share of both sizes, whoever has such a partner has one in the node of the least
    w = |d| - share * size. Rows with w (times den + num) are for that.
    """
    num, den = threshold

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 256):
            keys, nodes, leads, weights = [], [], [], []
            for pivot, node, n, u, centre, elements in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                most = (n + n * den // num) * (den - num) // (den + num)
                x, p = as_array(elements), as_array(centre or b"")
                new, gone = np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)
                first = np.append(np.concatenate([new, gone])[: max(0, most + 1 - u)], np.uint64(0))
                keys.append(mixed(first ^ mixed(np.array([pivot], np.int64).view(np.uint64))))
                nodes.append(np.full(len(first), node, np.int64))
                leads.append(np.arange(u, u + len(first)) <= most // 2)
                weights += [None] * (len(first) - 1) + [(u + len(new) + len(gone)) * (den + num) - n * (den - num)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(leads)), pa.array(weights, pa.int64())], ["key", "node", "lead", "w"])

    met = stars.join(live.select("node", "n", "u", "elements"), "node").join(centres(stars, live), "pivot", "left")
    return materialise(met.select("pivot", "node", "n", "u", "centre", "elements").mapInArrow(work, "key long, node long, lead boolean, w long"))


def resolved(members: DataFrame, live: DataFrame, threshold: tuple[int, int], small: int = SMALL) -> DataFrame:
    """(node, component) of linked nodes, from ``members`` (key, node, size, pivot) of the buckets."""

    def stars(rows: DataFrame) -> DataFrame:
        return materialise(rows.where("pivot <> node").select("pivot", "node").distinct())

    labels, every = None, stars(members)
    while True:
        links = verified(every.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), live, threshold)
        labels = relabelled(labels, links) if labels is not None else components(links)
        members = spanning(members, labels)
        pairs = near_within(members.where(F.col("size") <= small), live, threshold)
        labels = relabelled(labels, verified(pairs, live, threshold))
        members = spanning(members.where(F.col("size") > small).drop("component"), labels)
        if members.isEmpty():
            return labels
        entries = difference_entries(stars(members), live, threshold)
        members = buckets(entries.where("w is null").drop("w"), live)
        close = entries.where("w is not null")
        least = close.groupBy("key").agg(F.min(F.struct("w", "node")).alias("least"))
        close = close.join(least, "key").where("w + least.w <= 0").select(F.col("least.node").alias("pivot"), "node")
        every = stars(members.select("pivot", "node").union(close))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, small: int = SMALL) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles and component_id, the smallest id that links (Jaccard at least threshold[0] / threshold[1]) lead to."""
    seed = 0
    while True:
        nodes = materialise(set_rows(docs, id_col, text_col, k, seed, False))
        known = nodes.where("id is not null and node is not null")
        of_node = materialise(known.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.min("last").alias("low"), F.max("last").alias("high")))
        if of_node.where("low <> high").isEmpty():
            break
        seed += 2  # two sets had one hash: with another seed they don't
    live = linkable(docs, of_node.select("node", "id", "n"), id_col, text_col, k, seed, threshold)
    labels = resolved(buckets(bucket_entries(live, threshold), live), live, threshold, small)
    named = of_node.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = materialise(named.groupBy("component").agg(F.min("id").alias("component_id")))
    found = materialise(named.join(smallest, "component").select("node", "component_id"))
    out = nodes.select("id", "n", "node").join(found, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component."""
    found = similar_components(docs, id_col, text_col, k, threshold)
    first = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_or(F.col(id_col) == F.col("component_id")).alias("first"))
    gone = materialise(first.where(~F.col("first")).select(id_col))
    return docs.join(limited(gone), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
