"""Benchmark decontamination with an FM-index for each training shard.

A shard is what one task reads, indexed in chunks of a bounded number of words.
Test phrases (windows of consecutive benchmark words) are searched backwards in
the shard's Burrows-Wheeler transform through the ranks of a wavelet matrix, all
phrases at once; occurrences are located by walking back to sampled suffix
positions, and overlapping ones are merged into removal spans.

Words that no phrase has can't be part of an occurrence, and neither can a run of
phrase words that is shorter than the shortest phrase. The index holds the
remaining runs, with a separator between them, so that its size follows what could
match; nothing that could match is left out.

The benchmark is read in blocks of bounded size, each a broadcast phrase table. With
one block (4 MB of text) documents aren't shuffled; with more, every block is a pass
of its own over the documents, and what the passes find is joined by row, so that
tasks never hold more than one block.

Defined cases: a text that is null or has no words has n_words = 0 and no hits; an
item without words has no phrase; items that repeat each other are reported each;
rows that repeat an id, or have none, are judged each;
with an empty benchmark nothing is hit; an empty table gives an empty result;
columns of any name pass through ``annotate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import claim, fresh, materialise, release

WINDOW = 13
SHARE = 20  # contaminated: at least one word in so many is hit
CHUNK_WORDS = 1_500_000
BLOCK_BYTES = 4 << 20
SAMPLED = 8
#: A-Z become lower case; ASCII that is neither letter nor digit becomes a blank; all other bytes are parts of words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Phrases:
    """The distinct windows of a block of items as rows of word numbers (from 2), and whose they are."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items = [str(key) for key, _ in items]
        for n, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for start in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[start : start + window]), set()).add(n)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.shortest = int(self.lengths.min()) if owners else 0
        self.words = np.zeros((len(owners), window), np.int64)
        for row, p in enumerate(owners):
            self.words[row, : len(p)] = p
        self.owner_ends = np.cumsum([len(o) for o in owners.values()], dtype=np.int64)
        self.owners = np.array([n for o in owners.values() for n in sorted(o)], np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling over what is still tied; ``text`` ends with its only 0."""
    n = len(text)
    bits = int(text.max()).bit_length()
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = key << bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    tied = ~(first & np.concatenate([first[1:], [True]]))
    left, k = order[tied], packed
    while len(left):
        old = rank[left]
        key = old * (n + 2) + rank[np.minimum(left + k, n)] + 1
        by = np.argsort(key, kind="stable")
        left, key, old = left[by], key[by], old[by]
        at = np.arange(len(left))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        place = old + at - group
        first = np.concatenate([[True], key[1:] != key[:-1]])
        order[place] = left
        rank[left] = place[np.maximum.accumulate(np.where(first, at, 0))]
        tied = ~(first & np.concatenate([first[1:], [True]]))
        left, k = left[tied], 2 * k
    return order


class FMIndex:
    """Over symbols from 1; adds the end symbol 0 itself."""

    def __init__(self, symbols: np.ndarray) -> None:
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        most = int(text.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.levels: list[tuple[int, np.ndarray]] = []  # of the wavelet matrix: zeros, ranks of ones
        for level in reversed(range(max(1, most.bit_length()))):
            ones = (bwt >> level & 1).astype(bool)
            self.levels.append((int(self.n - ones.sum()), np.concatenate([[0], np.cumsum(ones, dtype=np.int32)])))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.start = self._mapped(np.arange(most + 1), np.zeros(most + 1, np.int64))
        kept = order % SAMPLED == 0
        self.kept = kept
        self.kept_rank = np.cumsum(kept, dtype=np.int32) - 1
        self.samples = order[kept]

    def _mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (zeros, ones) in zip(reversed(range(len(self.levels))), self.levels, strict=True):
            one = ones[at]
            at = np.where(symbol >> level & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before ``at``."""
        return self._mapped(symbol, at) - self.start[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that begin one symbol earlier."""
        symbol, at = np.zeros(len(row), np.int64), row
        for zeros, ones in self.levels:
            one = ones[at]
            bit = ones[at + 1] > one
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + one, at - one)
        return self.before[symbol] + at - self.start[symbol]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, and the rows [low, high) of the suffixes that begin with each."""
        alive = np.arange(len(lengths))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 1
        while len(alive):
            symbol = words[alive, lengths[alive] - step]
            known = symbol < len(self.start)
            alive, low, high, symbol = alive[known], low[known], high[known], symbol[known]
            low, high = (self.before[symbol] + self.rank(symbol, x) for x in (low, high))
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
            over = lengths[alive] == step
            done.append((alive[over], low[over], high[over]))
            alive, low, high = alive[~over], low[~over], high[~over]
            step += 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows, 0
        while len(left):
            here = self.kept[at]
            out[left[here]] = self.samples[self.kept_rank[at[here]]] + steps
            left, at = left[~here], self.back(at[~here])
            steps += 1
        return out


def runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of numbers over 0 that are long enough, each with a separator 1 behind it, and where each symbol came from."""
    inside = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    sizes = ends - starts + 1
    total = np.cumsum(sizes)
    origin = np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
    symbols = np.ones(len(origin), np.int64)
    within = np.ones(len(origin), bool)
    within[total - 1] = False
    symbols[within] = ids[origin[within]]
    return symbols, origin


def spans_of(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence in ``ids`` (0: no phrase's word): phrase, start, end."""
    symbols, origin = runs(ids, phrases.shortest)
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(symbols)
    found, low, high = index.search(phrases.words, phrases.lengths)
    many = high - low
    ends = np.cumsum(many)
    rows = np.repeat(low - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
    phrase = np.repeat(found, many)
    start = origin[index.locate(rows)]
    return phrase, start, start + phrases.lengths[phrase]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans as spans that don't touch within themselves."""
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by]) if len(by) else end
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(by) else np.zeros(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(by) else new
    return start[new], end[last]


def judged(texts: list[bytes | None], block: Phrases | None) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: the number of words, the merged spans of hit words and the items that occur."""
    sizes = np.zeros(len(texts), np.int64)
    items: list[list[str]] = [[] for _ in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if block is None or not block.shortest:
        return [(len(words_of(t)), [], []) for t in texts]
    get, parts = block.vocabulary.get, [np.zeros(0, np.int64)]
    for n, t in enumerate(texts):
        words = words_of(t)
        sizes[n] = len(words)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))  # no occurrence spans two texts
    firsts = np.cumsum(sizes + 1) - sizes - 1
    phrase, start, end = spans_of(np.concatenate(parts), block)
    doc = np.searchsorted(firsts, start, "right") - 1
    pairs = np.unique(doc * len(block.lengths) + phrase)
    doc, phrase = np.divmod(pairs, len(block.lengths))
    lows = np.concatenate([[0], block.owner_ends])
    seen: dict[int, set[int]] = {}
    for d, p in zip(doc.tolist(), phrase.tolist(), strict=True):
        seen.setdefault(d, set()).update(block.owners[lows[p] : lows[p + 1]].tolist())
    for d, found in seen.items():
        items[d] += [block.items[i] for i in found]
    start, end = merge_spans(start, end)
    doc = np.searchsorted(firsts, start, "right") - 1
    for d, a, b in zip(doc.tolist(), (start - firsts[doc]).tolist(), (end - firsts[doc]).tolist(), strict=True):
        spans[d].append((a, b))
    return list(zip(sizes.tolist(), spans, items, strict=True))


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Iterator]:
    """How many blocks there are, and the benchmark as broadcast phrase tables, each of about ``block_bytes`` of text and made when it is asked for; None if the benchmark has no text."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64(F.col("item"), F.col("text")), F.lit(n))
    made = (Phrases([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in rows.where(block == i).collect()], window) if size else None for i in range(n))
    return n, (sc.broadcast(x) for x in made)


def annotate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, chunk_words: int = CHUNK_WORDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all) of ``docs`` and a struct column, whose name is the second value: n_words, n_hit, n_items, items_sha256, contaminated and the removal spans (word numbers, the end excluded)."""
    keep = docs.columns if keep is None else keep
    name, text, row = (fresh(x, docs.columns) for x in ("decontamination", "__text", "__row"))
    n, blocks = phrase_blocks(benchmark, item_col, item_text, window, block_bytes)
    kind = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, spans: array<struct<start: bigint, end: bigint>>>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(span))])
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias(text))

    def result(n_words: int, spans: list[tuple[int, int]], items: list[str]) -> dict:
        n_hit = sum(b - a for a, b in spans)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        return {"n_words": n_words, "n_hit": n_hit, "n_items": len(items), "items_sha256": digest, "contaminated": n_hit > 0 and share * n_hit >= n_words, "spans": [{"start": a, "end": b} for a, b in spans]}

    def chunks(it: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        """Slices whose texts (column ``at``) have about ``chunk_words`` words, a word taking two bytes at least with what follows it."""
        claim("decontamination")
        for batch in it:
            lo = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            limits = np.cumsum(sizes) // (2 * chunk_words)
            while lo < batch.num_rows:
                hi = int(np.searchsorted(limits, limits[lo], "right"))
                yield batch.slice(lo, hi - lo)
                lo = hi

    if n == 1:
        shared = next(blocks)

        @F.arrow_udf(kind)
        def search(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in it:
                batch = pa.RecordBatch.from_arrays([texts], [text])
                yield pa.array([result(*x) for part in chunks([batch], 0) for x in judged(part.column(0).to_pylist(), shared.value)], arrow)
            release()

        return docs.select(*[F.col(f"`{c}`") for c in keep], search(F.col(f"`{text_col}`").cast("binary")).alias(name)), name

    # a pass for each block, so that one is in memory at a time; what the passes find is joined by row
    numbered = materialise(given.withColumn(row, F.monotonically_increasing_id()))
    passes = []
    for shared in blocks:
        first = not passes

        def hits(it: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for part in chunks(it, 1):
                found = [(k, *x) for k, x in zip(part.column(0).to_pylist(), judged(part.column(1).to_pylist(), shared.value), strict=True)]
                rows = [{"row": k, "n_words": words, "spans": [{"start": a, "end": b} for a, b in spans], "items": items} for k, words, spans, items in found if first or spans]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]))
            release()

        passes.append(materialise(numbered.select(row, text).mapInArrow(hits, "row long, n_words long, spans array<struct<start: bigint, end: bigint>>, items array<string>")))
        shared.destroy()
    every = passes[0]
    for found in passes[1:]:
        every = every.unionByName(found)
    every = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for words, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                start, end = merge_spans(*(np.array([s[x] for s in spans], np.int64) for x in ("start", "end")))
                found.append(result(words, list(zip(start.tolist(), end.tolist(), strict=True)), items))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], [row, name])

    judgements = every.mapInArrow(merged, f"`{row}` long, `{name}` {kind}")
    return numbered.join(judgements, row).select(*[F.col(f"`{c}`") for c in keep], name), name


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, name = annotate(docs, benchmark, [id_col], **options)
    return found.select(id_col, *[f"{name}.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    found, name = annotate(docs, benchmark, **options)
    return found.where(~F.col(f"{name}.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])
