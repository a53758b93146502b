"""Language-model scoring by the likelihood of subword lattices.

A word's probability sums over all its segmentations into pieces of an existing
vocabulary: a forward recursion in log space over the lattice of pieces gives it.
The vocabulary's own order gives first piece scores (a piece's probability falls
with its rank); ``STEPS`` expectation steps over all distinct training words, by the
same forward recursion and its backward counterpart, fit them to the corpus. Each
distinct word counts once there, since new words are what the pieces must explain.
The lattice also has an arc for each word that the training documents have, with the
word's discounted share of their tokens, and the discounts' mass goes to the
pieces. So the model is

    P(w) = max(c(w) - d, 0) / N  +  (d V / N) * sum over segmentations of prod p(piece)

which sums to 1 over all words and the end, the end being a token that only has its
own arc and a fixed share of the pieces' mass.

Jobs: count the words of every document (a task merges what it holds, Spark the
rest), fit the pieces, score every distinct word once. Then documents are scored in
one pass: the ``FREQUENT`` most frequent words, a bounded number, are broadcast;
all other words go, counted by document, through a join with the scored words.

Defined cases: null text is empty and its only token is the end; a null id counts as
the empty string in the split; rows that repeat an id count each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import LOWER, materialise, mixed

FREQUENT = 200_000
SHORT = 64  # bytes of a word that may be broadcast; longer ones are joined
MERGED_WORDS = 300_000
DISCOUNT = 0.6
STEPS = 2
FOLDS, HELD_OUT = 5, 1
LONG_WORD = 40  # words of so many bytes take the same recursions one by one
GROUP = 4096
STEP = 0x9E3779B97F4A7C15
INVERSE = pow(STEP, -1, 1 << 64)


class Pieces:
    """An existing vocabulary with a log probability for each piece. Words are written behind a blank, so that a piece begins a word or continues one."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        by_size: dict[int, list[int]] = {}
        for n, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(n)
        self.by_size = {}
        for size, numbers in by_size.items():
            h = np.array([_hash(pieces[n]) for n in numbers], np.uint64)
            order = np.argsort(h)
            self.by_size[size] = (h[order], np.array(numbers)[order])
        self.longest = max(by_size)
        self.number = {p: n for n, p in enumerate(pieces)}

    def with_logp(self, logp: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__, logp=logp)
        return out

    def arcs(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers (-1: none) of the bytes [start, end) of words that are the rows of a matrix."""
        n, size = words.shape
        up, down = _steps(size + 1)
        sums = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum((words.astype(np.uint64) + np.uint64(1)) * down[:size], axis=1, dtype=np.uint64)], axis=1)
        found = {}
        for length, (hashes, numbers) in self.by_size.items():
            for start in range(size - length + 1):
                h = mixed((sums[:, start + length] - sums[:, start]) * up[start])
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                if hit.any():
                    found[start, start + length] = np.where(hit, numbers[at], -1)
        return found

    def forward(self, words: np.ndarray, arcs: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """Log of the summed probability of all ways to the place i of each word, for every i."""
        n, size = words.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for (start, end), number in sorted(arcs.items(), key=lambda x: x[0][1]):
            hit = number >= 0
            alpha[hit, end] = np.logaddexp(alpha[hit, end], alpha[hit, start] + self.logp[number[hit]])
        return alpha

    def expected(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` of these words."""
        arcs = self.arcs(words)
        alpha = self.forward(words, arcs)
        n, size = words.shape
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        out = np.zeros(len(self.pieces))
        for (start, end), number in sorted(arcs.items(), key=lambda x: -x[0][0]):
            hit = number >= 0
            arc = self.logp[number[hit]]
            beta[hit, start] = np.logaddexp(beta[hit, start], arc + beta[hit, end])
        total = alpha[:, size]
        for (start, end), number in arcs.items():
            hit = (number >= 0) & np.isfinite(total)
            weight = counts[hit] * np.exp(np.minimum(0, alpha[hit, start] + self.logp[number[hit]] + beta[hit, end] - total[hit]))
            out += np.bincount(number[hit], weight, minlength=len(out))
        return out

    def forward_long(self, word: bytes) -> list[float]:
        """``forward`` for one long word."""
        sizes = sorted(self.by_size)
        alpha = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            ways = []
            for size in sizes:
                if size > end:
                    break
                if alpha[end - size] > -math.inf and (n := self.number.get(word[end - size : end])) is not None:
                    ways.append(alpha[end - size] + self.logp[n])
            if ways:
                top = max(ways)
                alpha[end] = top + math.log(sum(math.exp(w - top) for w in ways))
        return alpha

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """The natural log of the summed probability of all segmentations of each word."""
        out = np.empty(len(words))
        for at, matrix in _by_length(words):
            out[at] = self.forward(matrix, self.arcs(matrix))[:, -1]
        for n, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[n] = self.forward_long(b" " + w)[-1]
        return out

    def expected_long(self, word: bytes, out: np.ndarray, count: float = 1.0) -> None:
        """Adds what ``expected`` gives for one long word to ``out``."""
        alpha, sizes = self.forward_long(word), sorted(self.by_size)
        n, total = len(word), alpha[-1]
        if total == -math.inf:
            return
        beta = [-math.inf] * n + [0.0]
        for start in range(n - 1, -1, -1):
            ways = []
            for size in sizes:
                end = start + size
                if end > n:
                    break
                if beta[end] > -math.inf and (k := self.number.get(word[start:end])) is not None:
                    ways.append(self.logp[k] + beta[end])
                    if alpha[start] > -math.inf:
                        out[k] += count * math.exp(min(0.0, alpha[start] + ways[-1] - total))
            if ways:
                top = max(ways)
                beta[start] = top + math.log(sum(math.exp(w - top) for w in ways))

    def expected_counts(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected, by all segmentations of each word."""
        out = np.zeros(len(self.pieces))
        for at, matrix in _by_length(words):
            out += self.expected(matrix, counts[at])
        for n, w in enumerate(words):
            if len(w) >= LONG_WORD:
                self.expected_long(b" " + w, out, counts[n])
        return out


def _hash(piece: bytes) -> int:
    total, step = 0, 1
    for b in piece:
        total, step = (total + (b + 1) * step) % (1 << 64), step * INVERSE % (1 << 64)
    return int(mixed(np.array([total], np.uint64))[0])


@lru_cache
def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (STEP, INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words shorter than ``LONG_WORD`` as matrices of equal length, each word behind a blank, and where they stood."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes[sizes < LONG_WORD]).tolist():
        where = np.flatnonzero(sizes == size)
        for lo in range(0, len(where), GROUP):
            at = where[lo : lo + GROUP]
            letters = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(len(at), size)
            yield at, np.concatenate([np.full((len(at), 1), 32, np.uint8), letters], axis=1)


def vocabulary(path: str | None = None) -> Pieces:
    """The pieces of an existing byte-level vocabulary (a file of ranks) in lower case that can begin or continue a word, with probabilities falling with the rank."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    best: dict[bytes, int] = {}
    with open(path, "rb") as file:
        for line in file:
            if line.split():
                raw, rank = line.split()
                piece = base64.b64decode(raw)
                if piece == piece.translate(LOWER) and not any(b in b"\t\n\x0b\x0c\r " for b in piece[1:]) and piece[:1] not in b"\t\n\x0b\x0c\r":
                    best[piece] = int(rank)
    pieces = sorted(best, key=best.get)
    weight = 1 / (np.arange(len(pieces)) + 10.0)
    return Pieces(pieces, np.log(weight / weight.sum()))


_vocabularies: dict[str | None, Pieces] = {}


def pieces_at(path: str | None) -> Pieces:
    if path not in _vocabularies:
        _vocabularies[path] = vocabulary(path)
    return _vocabularies[path]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c, its count in training documents (0 for words of held-out ones only); ``docs`` has id and text."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter[bytes] = Counter()
        others: set[bytes] = set()

        def flush():
            words = [*trained, *(others - trained.keys())]
            numbers = [*trained.values()]
            numbers += [0] * (len(words) - len(numbers))
            for lo in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.binary()), pa.array(numbers[lo : lo + 50_000], pa.int64())], ["word", "c"])
            trained.clear()
            others.clear()

        for batch in it:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (others.update if held_out(key) else trained.update)(words_of(text))
                if len(trained) + len(others) > MERGED_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fitted_pieces(counts: DataFrame, path: str | None, steps: int = STEPS) -> np.ndarray:
    """Log probabilities of the pieces after ``steps`` expectation steps over all distinct training words."""
    logp = pieces_at(path).logp
    size = len(logp)
    for _ in range(steps):
        shared = counts.sparkSession.sparkContext.broadcast(logp)

        def expect(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, total = pieces_at(path).with_logp(shared.value), np.zeros(size)
            for batch in it:
                for lo in range(0, batch.num_rows, 50_000):
                    words = batch.column(0)[lo : lo + 50_000].to_pylist()
                    total += model.expected_counts(words, np.ones(len(words)))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

        found = counts.where("c > 0").select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # as many rows as pieces
        total = np.full(size, 0.01)
        total[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        logp = np.log(total / total.sum())
    return logp


def scored_words(counts: DataFrame, logp: np.ndarray, path: str | None, words: int, types: int, ends: int) -> DataFrame:
    """word, c and lp, the model's log10 probability of the word."""
    shared = counts.sparkSession.sparkContext.broadcast(logp)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_at(path).with_logp(shared.value)
        for batch in it:
            for lo in range(0, batch.num_rows, 50_000):
                part = batch.slice(lo, 50_000)
                c = part.column(1).to_numpy()
                lp = word_log10(model.log_probabilities(part.column(0).to_pylist()), c, words, types, ends)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lp)], ["word", "c", "lp"])

    return counts.mapInArrow(score, "word binary, c long, lp double")


def end_share(words: int, ends: int) -> float:
    """The end's part of the pieces' mass."""
    return (ends + 1) / (words + ends + 2)


def word_log10(lattice: np.ndarray, c: np.ndarray, words: int, types: int, ends: int) -> np.ndarray:
    """log10 P of words from their lattice's log probability and training counts; in training: word tokens, distinct words, documents."""
    n, v = words + ends, types + (ends > 0)
    rest = DISCOUNT * v / n if n else 1.0
    pieces = lattice + math.log(rest * (1 - end_share(words, ends)))
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(c - DISCOUNT, 0) / max(1, n))
    return np.logaddexp(pieces, own) / math.log(10)


def end_log10(words: int, types: int, ends: int) -> float:
    n, v = words + ends, types + (ends > 0)
    rest = DISCOUNT * v / n if n else 1.0
    return math.log10((max(ends - DISCOUNT, 0) / n if n else 0) + rest * end_share(words, ends))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word unigrams) and score (log10 probability under the model)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = materialise(word_counts(rows))
    words, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    fold = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    ends = rows.where(fold != HELD_OUT).count()
    n, v = words + ends, types + (ends > 0)
    scored = materialise(scored_words(counts, fitted_pieces(counts, path), path, words, types, ends))
    top = scored.where(F.octet_length("word") <= SHORT).orderBy(F.desc("c"), "word").limit(frequent).toArrow()  # a bounded number of bytes
    index = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    shared = spark.sparkContext.broadcast((index, np.append(top.column("c").to_numpy(), 0), np.append(top.column("lp").to_numpy(), 0.0)))
    del top, index
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    end_base, end_score, end_known = float(base_of(ends)), end_log10(words, types, ends), int(ends > 0)

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, c, lp = shared.value
        get, known, base = index.get, (c > 0).astype(np.int64), base_of(c)
        row = TaskContext.get().partitionId() << 36
        kinds = pa.schema([("row", pa.int64()), ("id", batch_id), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = words_of(text)
                    at = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                    here = at[at >= 0]
                    rare = Counter([tokens[i] for i in np.flatnonzero(at < 0).tolist()])
                    row += 1
                    out.append((row, key, held_out(key), len(tokens) + 1, int(known[here].sum()) + end_known, float(base[here].sum()) + end_base, float(lp[here].sum()) + end_score, [{"word": w, "n": k} for w, k in rare.items()]))
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    batch_id = to_arrow_type(id_type)
    schema = f"row long, id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<struct<word: binary, n: bigint>>"
    parts = rows.mapInArrow(partial, schema)
    # a row for each word that isn't frequent; the first of a document's rows, with a key no word equals, has its own figures
    own = F.struct(F.concat(F.lit(b"\x20"), F.col("row").cast("string").cast("binary")).alias("word"), F.lit(0).cast("long").alias("n"))
    head = F.col("word").startswith(F.lit(b"\x20"))
    flat = parts.select("row", "id", "held_out", "n_tokens", "n_known", "base", "score", F.explode(F.concat(F.array(own), "words")).alias("w"))
    flat = flat.select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"), *[F.when(F.col("w.n") == 0, F.col(x)).alias(x) for x in ("id", "held_out", "n_tokens", "n_known", "base", "score")])
    met = flat.join(scored, "word", "left")
    known = F.when(F.col("n") == 0, F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("n")).otherwise(0))
    base = F.when(F.col("n") == 0, F.col("base")).otherwise(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1))))
    score = F.when(F.col("n") == 0, F.col("score")).otherwise(F.col("n") * F.col("lp"))
    summed = met.groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(base).alias("base_score"), F.sum(score).alias("score"))
    return summed.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
