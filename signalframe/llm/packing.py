"""Best-fit packing by linear grouping.

Documents become token ids, longer ones pieces of at most ``capacity`` tokens.
Packing only needs how many pieces there are of each length, a table of at most
``capacity`` rows whatever the corpus, so this histogram alone goes to the driver.
There large lengths are rounded up within groups of equal cardinality,
configurations of the few rounded sizes are optimised (fullest fill of what is
left, used as often as it can be), the actual lengths are put in the places of
the rounded ones, and small lengths are best-fitted into what is left of each
sequence. The plan is a table of runs: pieces number a to b of one length go to
sequences s, s+1, ... Its size follows ``capacity`` and ``groups``, not the
corpus, so it is broadcast, and Spark numbers the pieces of each length and looks
their places up.

Numbering deals a length over about sqrt(count) salts, so that no length, however
common, is numbered in one task.

Defined cases: null text is an empty document (its only token is the end token);
an empty table gives an empty result; rows that repeat an id are packed each; other
columns are not read by ``pack_documents``, and ``pack`` returns those it is given,
which must not be called sequence_id or offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import claim, fresh, materialise, release

CAPACITY = 4096
END_ID = 1
LARGE = 8  # lengths over capacity / LARGE are large
GROUPS = 256
CACHED_WORDS = 800_000
MARKS = (",", ".")
SLICE = 2048
THRIFTY_WORDS, THRIFTY_SLICE = 200_000, 512


def cut_mark(part: str) -> str:
    """The stop or comma that ends ``part`` behind an ASCII digit or a Latin letter, else nothing. Composing and lower-casing leave such a letter a letter, so that the library cuts there too."""
    if part[-1:] in MARKS and (c := part[-2:-1]) < "\u0180" and (c.isascii() and c.isdigit() or c.isalpha() and len(c.lower()) == 1):
        return part[-1]
    return ""


class WordIds:
    """The library's ids of white-space separated parts of texts, each distinct part encoded once; forgets all beyond ``limit`` parts.

    The tokenizer maps white space to nothing and no token spans it, so the ids of
    a text are those of its parts, one after another. Parts that differ in their
    capitals A-Z or by a last stop or comma share one encoding.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.length = np.zeros(1 << 12, np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0
        self._encode(["", *MARKS])

    def _encode(self, parts: list[str]) -> None:
        """Adds parts that aren't known by asking the library."""
        if not parts:
            return
        encoded = self.library.encode(" ".join(parts), add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts])
        owner = np.searchsorted(ends, np.fromiter((start for start, _ in encoded.offsets), np.int64, len(ids)), "right")
        lengths = np.bincount(owner, minlength=len(parts))
        self._append(ids)
        self._add(parts, self.used - len(ids) + np.cumsum(lengths) - lengths, lengths)

    def _append(self, ids: np.ndarray) -> None:
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _add(self, parts: list[str], starts: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.index)
        self.index.update(zip(parts, range(first, first + len(parts)), strict=True))
        while len(self.length) < len(self.index):
            self.length, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start))
        self.length[first : first + len(parts)] = lengths
        self.start[first : first + len(parts)] = starts

    def _gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after another, and how many each has."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[codes] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def learn(self, parts: list[str]) -> None:
        """Adds the distinct ``parts``: bodies in lower case first, then those that are one of them in other letters or with a mark."""
        index = self.index
        new = [p for p in parts if p not in index]
        if len(index) + 2 * len(new) > self.limit and len(index) > 3:
            self.clear()
            index = self.index
            new = [p for p in parts if p not in index]
        marks = list(map(cut_mark, new))
        bodies = [p[:-1] if m else p for p, m in zip(new, marks, strict=True)]
        bodies = [b.lower() if b.isascii() and "<" not in b else b for b in bodies]
        self._encode(list(dict.fromkeys([b for b in bodies if b not in index])))
        others: dict[str, tuple[list[str], list[str]]] = {mark: ([], []) for mark in ("", *MARKS)}
        for p, b, m in zip(new, bodies, marks, strict=True):
            if p not in index:
                mine = others[m]
                mine[0].append(p)
                mine[1].append(b)
        for mark, (mine, mine_bodies) in others.items():
            if not mine:
                continue
            codes = np.fromiter(map(index.__getitem__, mine_bodies), np.int64, len(mine))
            starts, lengths = self.start[codes], self.length[codes]
            if mark:
                ids, _ = self._gathered(np.stack([codes, np.full(len(codes), index[mark])], axis=1).ravel())
                lengths = lengths + self.length[index[mark]]
                self._append(ids)
                starts = self.used - len(ids) + np.cumsum(lengths) - lengths
            self._add(mine, starts, lengths)

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Arrow splits the texts and numbers their distinct parts; only these become Python strings."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        parts = split.flatten().dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()  # ten times as fast as to_pylist
        self.learn(words)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))[parts.indices.to_numpy()]
        ids, lengths = self._gathered(codes)
        ends = np.append(0, np.cumsum(lengths))[split.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))


_encoders: dict[str, WordIds] = {}


def encoder(path: str, limit: int = CACHED_WORDS) -> WordIds:
    claim("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    _encoders[path].limit = limit
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, thrifty: bool = False) -> DataFrame:
    """A row for each piece of a document: id, piece, start, length, ids_crc32 and, asked for, the ids. ``thrifty`` tasks know fewer words at a time, take fewer texts at once and give the tokenizer and its words back at their end, which costs time: half as much again."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path or tokenizer_path(), THRIFTY_WORDS if thrifty else CACHED_WORDS)
        size = THRIFTY_SLICE if thrifty else SLICE
        for batch in it:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(texts), size):
                rows, out = [], []
                for row, ids in enumerate(words.encode_all(texts[lo : lo + size]), lo):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append(row)
                        out.append((piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *columns], [id_col, "piece", "start", "length", "ids_crc32", "ids"][: 1 + len(columns)])
        if thrifty:
            del words
            release()

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How often each size is used: the largest that is left, then the fullest fill of the rest with what is left."""
    use = [0] * len(sizes)
    first = next(i for i, n in enumerate(left) if n)
    use[first] = 1
    room = capacity - sizes[first]
    reach, steps, every = 1, [], (1 << (room + 1)) - 1  # bit s: a sum of s can be made
    for i in range(first, len(sizes)):
        for _ in range(min(left[i] - use[i], room // sizes[i])):
            wider = reach | (reach << sizes[i]) & every
            if wider == reach:
                break
            steps.append((i, reach))
            reach = wider
    total = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> total & 1:
            use[i] += 1
            total -= sizes[i]
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, count, first sequence, pieces of the run in a sequence, offset) that pack ``histogram[length]`` pieces of each length."""
    big = sorted(((n, c) for n, c in histogram.items() if c and n * large > capacity), reverse=True)
    small = sorted(((n, c) for n, c in histogram.items() if c and n * large <= capacity), reverse=True)
    # groups of equal cardinality, each a queue of (length, count) runs, rounded up to its largest length
    each = max(1, -(-sum(c for _, c in big) // groups))
    queues: list[list[list[int]]] = []
    room = 0
    for n, c in big:
        while c:
            if not room:
                queues.append([])
                room = each
            taken = min(c, room)
            queues[-1].append([n, taken])
            c, room = c - taken, room - taken
    sizes, left = [], []
    merged_queues: list[list[list[int]]] = []
    for q in queues:  # groups that round to the same size are one size
        if sizes and sizes[-1] == q[0][0]:
            merged_queues[-1] += q
            left[-1] += sum(c for _, c in q)
        else:
            sizes.append(q[0][0])
            merged_queues.append(q)
            left.append(sum(c for _, c in q))
    numbers: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
    next_sequence = 0

    def place(n: int, sequences: int, first: int, per: int, offset: int, count: int) -> None:
        runs.append((n, numbers.get(n, 0), count, first, per, offset))
        numbers[n] = numbers.get(n, 0) + count

    while any(left):
        use = fullest(sizes, left, capacity)
        times = min(left[i] // u for i, u in enumerate(use) if u)
        places = [i for i, u in enumerate(use) for _ in range(u)]
        for i in places:
            left[i] -= times
        while times:  # a stretch of sequences in which every place has one actual length
            need: dict[int, int] = {}
            for i in places:
                need[i] = need.get(i, 0) + 1
            stretch = times
            for i, u in need.items():
                if merged_queues[i][0][1] >= u:
                    stretch = min(stretch, merged_queues[i][0][1] // u)
                else:
                    stretch = 1
            offset = 0
            for i in places:
                run = merged_queues[i][0]
                if run[1] < stretch:  # only where stretch is 1
                    raise AssertionError("a run is shorter than its stretch")
                place(run[0], stretch, next_sequence, 1, offset, stretch)
                offset += run[0]
                run[1] -= stretch
                if not run[1]:
                    merged_queues[i].pop(0)
            open_by_room.setdefault(capacity - offset, []).append((next_sequence, stretch))
            next_sequence += stretch
            times -= stretch
    rooms = sorted(open_by_room)
    for n, c in small:
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                per = capacity // n
                full, rest = divmod(c, per)
                for count, k in ((full, per), (1 if rest else 0, rest)):
                    if count:
                        place(n, count, next_sequence, k, 0, count * k)
                        if capacity - k * n not in open_by_room:
                            insort(rooms, capacity - k * n)
                        open_by_room.setdefault(capacity - k * n, []).append((next_sequence, count))
                        next_sequence += count
                break
            room = rooms[at]
            first, count = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(at)
            per = room // n
            full = min(count, c // per)
            parts = [(first, full, per)]
            if full < count:
                rest = c - full * per
                parts += [(first + full, 1, min(rest, per)), (first + full + 1, count - full - 1, 0)]
            for start, many, k in parts:
                if not many:
                    continue
                if k:
                    place(n, many, start, k, capacity - room, many * k)
                    c -= many * k
                if room - k * n not in open_by_room:
                    insort(rooms, room - k * n)
                open_by_room.setdefault(room - k * n, []).append((start, many))
    return runs


def pack(parts: DataFrame, order: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``parts`` (any table with a ``length`` of 1 to ``capacity``, read more than once) with sequence_id and offset; ``order`` numbers the pieces of a length."""
    spark = parts.sparkSession
    if taken := {"sequence_id", "offset"} & {c.lower() for c in parts.columns}:
        raise ValueError(f"columns of this name are added: {sorted(taken)}")
    salt, many, ahead, base, inside, number, place = (fresh(x, parts.columns) for x in ("__salt", "__salts", "__n", "__base", "__within", "__number", "__place"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan(histogram, capacity, groups))
    bits = 44
    table = np.array([[n << bits | first, first, seq, per, offset] for n, first, _, seq, per, offset in runs], np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    # from Arrow, as a list of rows would go through Python workers of another pool, which then stay for a minute
    salts = spark.createDataFrame(pa.table({"length": pa.array(list(histogram), pa.int64()), many: pa.array([int(c**0.5) + 1 for c in histogram.values()], pa.int32())}))
    salted = parts.join(F.broadcast(salts), "length").withColumn(salt, F.pmod(F.xxhash64(*order), F.col(many)).cast("int"))
    bases = (
        salted.groupBy("length", salt)
        .agg(F.count(F.lit(1)).alias(ahead))
        .withColumn(base, F.sum(ahead).over(Window.partitionBy("length").orderBy(salt)) - F.col(ahead))
        .drop(ahead)
    )
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1
    numbered = salted.withColumn(inside, within).join(bases, ["length", salt]).withColumn(number, (F.col(base) + F.col(inside)).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def places(length, number):
        import pandas as pd

        t = shared.value
        n, k = length.to_numpy(np.int64), number.to_numpy(np.int64)
        run = t[np.searchsorted(t[:, 0], n << bits | k, "right") - 1]
        sequence, place = np.divmod(k - run[:, 1], run[:, 3])
        return pd.DataFrame({"sequence_id": run[:, 2] + sequence, "offset": run[:, 4] + place * n})

    placed = numbered.withColumn(place, places("length", number))
    return placed.select(*[F.col(f"`{c}`") for c in parts.columns], f"{place}.sequence_id", f"{place}.offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, with_ids: bool = False, thrifty: bool = False) -> DataFrame:
    """Cuts and packs ``docs``: the rows of ``pieces`` with sequence_id and offset."""
    parts = materialise(pieces(docs, id_col, text_col, path, capacity, end_id, with_ids, thrifty))
    return pack(parts, [id_col, "piece", "ids_crc32"], capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``with_ids``): sequence_id and its token ids in order of offset."""
    inner = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inner, lambda s: s["ids"])).alias("ids"))
