"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are a mask, a bit for each filter. Parts (sources) count their
documents by mask, 2^k rows each at most however many documents there are; only these
counts go on. Each part's counts become a decision diagram: a level for each filter, at
each node a low edge (passes) and a high edge (fails), equal nodes shared, and below the
last level the counts of one mask. A node's weight is the sum of what lies below it. The
orders are visited by adjacent transpositions, each one a swap of two neighbouring levels
that changes the nodes of these levels only. In each order the all-pass path gives the
steps: what leaves it by the high edge is removed there, what goes on is kept.

A filter is a condition on one text (``Filter``), or the one on the whole table: the same
text as a row with a smaller id. That one comes from the least id of each digest,
an aggregation that tasks begin before the shuffle; a row fails if it isn't that id, which
is found by a join on ids, so copies of a text don't meet in one task.

Defined cases: a null text is empty; a null or empty part is the part ''; a null id is
greater than all others, and rows without id (or with the same id) aren't smaller than
each other; rows that repeat an id count each; of several labels of an id each counts if
any row has the value 1; labels without id, or of ids that no row has, are left out; an
empty table gives an empty result; other columns, whatever their names, aren't read.
Texts are identical if their 128-bit digests are; they aren't compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import claim, materialise

MARKS = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(65, 91))
CONTINUED = bytes(range(0x80, 0xC0))  # of UTF-8: no code point begins with these


@dataclass(frozen=True)
class Filter:
    """A letter and what documents fail: a function of the text (UTF-8) and its words."""

    letter: str
    fails: Callable[[bytes, list[bytes]], bool]


FILTERS = [
    Filter("A", lambda text, words: len(words) < 200),
    Filter("B", lambda text, words: 100 * len(set(words)) < 50 * len(words)),
    Filter("C", lambda text, words: 100 * (len(text) - len(text.translate(None, UPPER))) > 2 * len(text.translate(None, CONTINUED))),
    Filter("D", lambda text, words: MARKS.search(text) is not None),
]
DUPLICATE = "E"


def text_masks(docs: DataFrame, filters: list[Filter], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask (bit n: fails filter n) and digest of each row; a text goes to a worker once."""
    arrow = pa.struct([("mask", pa.int32()), ("digest", pa.binary())])

    @F.arrow_udf("struct<mask: int, digest: binary>")
    def judged(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("filter audit")
        for texts in it:
            rows = []
            for lo in range(0, len(texts), 256):
                for text in texts[lo : lo + 256].to_pylist():
                    words = (text := text or b"").split()
                    rows.append({"mask": sum(f.fails(text, words) << n for n, f in enumerate(filters)), "digest": blake2b(text, digest_size=16).digest()})
            yield pa.array(rows, arrow)

    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), judged(F.col(f"`{text_col}`").cast("binary")).alias("__found"))
    return made.select("id", "part", "__found.mask", "__found.digest")


def mask_counts(docs: DataFrame, labels: DataFrame, filters: list[Filter] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the documents of a part with the same failures, and how many of them are labelled so; the highest bit is the duplicates'."""
    rows = materialise(text_masks(docs, filters, id_col, text_col, part_col))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"))
    own = firsts.where("first IS NOT NULL").select(F.col("first").alias("id"), F.col("digest").alias("__digest"))
    # an id may be the first of several texts if rows repeat it; then each of them is a row here
    repeated = 1 << len(filters)
    known = rows.where("id IS NOT NULL").join(own, (rows["id"] == own["id"]) & (rows["digest"] == own["__digest"]), "left").select(rows["id"], "part", (F.col("mask") + F.when(F.col("__digest").isNull(), repeated).otherwise(0)).alias("mask"))
    nameless = firsts.where("first IS NULL").select("digest", F.lit(True).alias("alone"))
    unknown = rows.where("id IS NULL").join(nameless, "digest", "left").select("id", "part", (F.col("mask") + F.when(F.col("alone"), 0).otherwise(repeated)).alias("mask"))
    graded = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__label")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rated = known.join(graded, F.col("id") == F.col("__label"), "left").select("part", "mask", "good", "toxic")
    rated = rated.unionByName(unknown.select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rated.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


Counts = tuple[int, ...]


class Diagram:
    """A decision diagram over ``k`` variables with counts below its last level.

    A node is a place in ``low``, ``high`` and ``weight``; ``tables`` finds the node of a
    level by its children. Below the last level a node is a leaf for one value of counts.
    """

    def __init__(self, k: int, counts: dict[int, Counts], width: int) -> None:
        self.order = list(range(k))
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[Counts] = []
        self.tables: list[dict] = [{} for _ in range(k + 1)]
        zero = (0,) * width
        nodes = [self._leaf(counts.get(mask, zero)) for mask in sorted(range(1 << k), key=lambda m: f"{m:0{k}b}"[::-1])]
        for level in reversed(range(k)):
            nodes = [self._node(level, a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
        self.root = nodes[0]

    def _add(self, low: int, high: int, weight: Counts) -> int:
        self.low.append(low)
        self.high.append(high)
        self.weight.append(weight)
        return len(self.low) - 1

    def _leaf(self, counts: Counts) -> int:
        table = self.tables[-1]
        if counts not in table:
            table[counts] = self._add(-1, -1, counts)
        return table[counts]

    def _node(self, level: int, low: int, high: int) -> int:
        table = self.tables[level]
        if (low, high) not in table:
            table[low, high] = self._add(low, high, tuple(map(sum, zip(self.weight[low], self.weight[high], strict=True))))
        return table[low, high]

    def swap(self, level: int) -> None:
        """Exchanges the variables of a level and the next one. Nodes of the level stay the nodes they are, so nothing above changes; those of the next level are made anew."""
        upper = list(self.tables[level].values())
        old = {n: (self.low[n], self.high[n]) for n in self.tables[level + 1].values()}
        self.tables[level], self.tables[level + 1] = {}, {}
        for n in upper:
            (a, b), (c, d) = old[self.low[n]], old[self.high[n]]
            self.low[n], self.high[n] = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.tables[level][self.low[n], self.high[n]] = n
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> list[tuple[int, Counts, Counts]]:
        """Variable, removed and kept counts of each step along the all-pass path."""
        out, node = [], self.root
        for variable in self.order:
            out.append((variable, self.weight[self.high[node]], self.weight[self.low[node]]))
            node = self.low[node]
        return out

    def at(self, mask: int) -> Counts:
        """The counts of a mask, along its path."""
        node = self.root
        for variable in self.order:
            node = self.high[node] if mask >> variable & 1 else self.low[node]
        return self.weight[node]


def transpositions(k: int) -> Iterator[int]:
    """The levels to swap with the next ones, one after another, to visit every order of ``k`` variables once (plain changes)."""
    if k < 2:
        return
    inner, down = transpositions(k - 1), True
    while True:
        yield from reversed(range(k - 1)) if down else range(k - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


def steps_of(counts: dict[int, Counts], letters: str) -> Iterator[dict]:
    """All steps of all orders; counts are (n, good, toxic) by mask."""
    k = len(letters)
    diagram = Diagram(k, counts, 3)
    failing = [sum(c[0] for mask, c in counts.items() if mask >> v & 1) for v in range(k)]
    alone = [diagram.at(1 << v)[0] for v in range(k)]
    orders = [(list(diagram.order), diagram.all_pass())]
    for level in transpositions(k):
        diagram.swap(level)
        orders.append((list(diagram.order), diagram.all_pass()))
    shares = [0] * k
    for _, path in orders:
        for variable, removed, _ in path:
            shares[variable] += removed[0]
    for order, path in orders:
        for n, (v, removed, kept) in enumerate(path, 1):
            yield {"filter_order": "".join(letters[x] for x in order), "step": n, "kept": kept[0], "removed": removed[0], "redundant": failing[v] - removed[0], "unique_fails": alone[v], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shares[v]}


def audit(docs: DataFrame, labels: DataFrame, filters: list[Filter] = FILTERS, duplicate: str = DUPLICATE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step."""
    letters = "".join(f.letter for f in filters) + duplicate
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(n, pa.int64()) for n in names]])
    counts = mask_counts(docs, labels, filters, id_col, text_col, part_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 2^k of them at most

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in (r for lo in range(0, batch.num_rows, 64) for r in batch.slice(lo, 64).to_pylist()):
                found = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in row["masks"]}
                yield pa.RecordBatch.from_pylist([{"part": row["part"]} | step for step in steps_of(found, letters)], schema)

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
