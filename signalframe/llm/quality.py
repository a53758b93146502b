"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered (here 0: toxic, 1: poor, 2: good). One weight vector over hashed
text features scores a document, s = w.x, and ordered thresholds cut the score:
P(grade <= j) = sigmoid(t_j - s). That gives the expected grade and the tail
probabilities P(grade >= j), by which documents are selected.

Features are the distinct words of the whole text and coarse shares of it (upper
case, symbols, repeated words and others), hashed into one space of ``BUCKETS``
weights. Only buckets that go with some grade get a weight (``SHIFT``, ``CHI2``):
else the many words that say nothing would add up in long texts.

The model is fitted on a bounded sample of labelled documents, ``SAMPLE`` of them
with the least hashes of their ids, gathered by a broadcast join; every document
is then scored in one pass without a shuffle.

Defined cases: null text has no words; several labels of a document count as its
worst; labels without a value, and those of missing documents, are left out;
without any labelled document every weight is 0 and all documents are kept; rows
that repeat an id are scored each; an empty table gives an empty result; columns of any
other name pass through ``good_documents`` as they are and aren't read by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import claim, fresh, release
from signalframe.llm.decontamination import words_of

BUCKETS = 1 << 21
SAMPLE = 10_000
LEAST_DOCS = 4  # features of fewer sampled documents get no weight
SHIFT, CHI2 = 0.3, 20.0  # how far a grade's share must differ where a feature is, and the least test value
STEPS, RATE, PENALTY = 200, 0.1, 3e-5
GOOD = 2
SURE = 0.5
CACHED_WORDS = 400_000
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#$%&*@^~<>={}[]\\|_+"
CALLS = b"!?"


def shares(text: bytes, words: list[bytes]) -> list[bytes]:
    """Coarse shares of a text as features that no word can equal."""
    size = max(1, len(text))
    tokens = text.split()
    part = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    found = {
        b"upper": part(UPPER),
        b"digits": part(DIGITS),
        b"symbols": part(SYMBOLS),
        b"calls": part(CALLS),
        b"same": sum(map(eq, tokens, tokens[1:])) / max(1, len(tokens)),
        b"new": len(set(words)) / max(1, len(words)),
        b"bars": tokens.count(b"|") / max(1, len(tokens)),
    }
    # a step for each doubling from 1 in 512 up, each step counting the lower ones too
    out = []
    for name, value in found.items():
        out += [b"\0%s %d" % (name, step) for step in range(10) if value * 512 >= 1 << step]
    return out


def features(text: bytes | None) -> set[bytes]:
    text = text or b""
    words = words_of(text)
    return {*words, *shares(text, words)}


def bucket(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (BUCKETS - 1)


@dataclass
class Model:
    """Weights by bucket, 0 where there is none, and the thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def telling(column: np.ndarray, grade: np.ndarray, shares: np.ndarray, least_shift: float, least_chi2: float) -> np.ndarray:
    """The buckets that shift a grade's share by ``least_shift`` at least, with a test value of ``least_chi2`` at least."""
    seen = [np.bincount(column[grade == g], minlength=BUCKETS).astype(np.float32) for g in range(len(shares))]
    total = sum(seen)
    expected = [np.maximum(total * np.float32(s), np.float32(1e-9)) for s in shares]
    chi2 = sum((o - e) ** 2 / e for o, e in zip(seen, expected, strict=True))
    shift = np.max([np.abs(o - e) for o, e in zip(seen, expected, strict=True)], axis=0) / np.maximum(total, 1)
    return (total >= LEAST_DOCS) & (shift >= least_shift) & (chi2 >= least_chi2)


def fit(sizes: np.ndarray, column: np.ndarray, grades: np.ndarray, n_grades: int = 3, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, shift: float = SHIFT, chi2: float = CHI2) -> Model:
    """Maximum likelihood by full-batch Adam; ``column`` has the buckets of each document, one document after another, ``sizes`` of them."""
    model = Model({}, np.linspace(-4, -2, n_grades - 1))
    if not len(sizes):
        return model
    useful = telling(column, np.repeat(grades.astype(np.int8), sizes), np.bincount(grades, minlength=n_grades) / len(grades), shift, chi2)[column]
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[useful]
    used, column = np.unique(column[useful], return_inverse=True)
    n = len(sizes)
    w = np.zeros(len(used))
    free = np.concatenate([[-3.0], np.zeros(n_grades - 2)])  # the first threshold and the logs of the gaps
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, steps + 1):
        cut = np.concatenate([[-np.inf], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), [np.inf]])
        score = np.bincount(doc, w[column], minlength=n)
        high, low = (1 / (1 + np.exp(np.clip(score - cut[grades + up], -500, 500))) for up in (1, 0))
        p = np.maximum(high - low, 1e-12)
        pull = high + low - 1  # of the log-likelihood by the score
        grad_w = -np.bincount(column, pull[doc], minlength=len(w)) / n + penalty * w
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades + 1, high * (1 - high) / p)
        np.add.at(by_cut, grades, -low * (1 - low) / p)
        by_cut = by_cut[1:-1] / n
        grad_free = -np.concatenate([[by_cut.sum()], [by_cut[j:].sum() * np.exp(free[j]) for j in range(1, n_grades - 1)]])
        for value, grad, first, second in ((w, grad_w, *moments[:2]), (free, grad_free, *moments[2:])):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    model.weights = dict(zip(used.tolist(), w.tolist(), strict=True))
    model.thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
    return model


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and grade: 0 toxic, 1 poor, 2 good; the worst of several."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(id_col).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_grades: int = 3) -> Model:
    """Fits on at most ``sample`` rated documents (``ratings``: id, grade), those with the least hashes; of rows that repeat an id the one with the least text hash."""
    chosen = ratings.orderBy(F.xxhash64(id_col), id_col).limit(sample).cache()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in it:
            found = [sorted({bucket(f) for f in features(t)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "columns"])
        release()

    joined = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text")).join(F.broadcast(chosen), id_col)
    joined = joined.groupBy(id_col).agg(F.min("grade").cast("int").alias("grade"), F.min_by("__text", F.xxhash64("__text")).alias("__text")).select("grade", "__text")
    got = joined.mapInArrow(rows, "grade int, columns array<int>").toArrow()
    chosen.unpersist()
    columns = got.column("columns").combine_chunks()
    return fit(columns.value_lengths().to_numpy(), columns.flatten().to_numpy(), got.column("grade").to_numpy(), n_grades)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", good: int = GOOD, sure: float = SURE) -> tuple[DataFrame, str]:
    """The columns ``keep`` and a struct column, named by the second value: expected_grade, tails (P(grade >= 1), ...) and kept (P(grade >= ``good``) at least ``sure``). Only texts go to the Python workers."""
    name = fresh("quality", docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.struct([("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64())), ("kept", pa.bool_())])

    @F.arrow_udf("struct<expected_grade: double, tails: array<double>, kept: boolean>")
    def judge(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        claim("quality")
        model, known = shared.value, {}

        def weight(feature: bytes) -> float:
            found = known.get(feature)
            if found is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                found = known[feature] = model.weights.get(bucket(feature), 0.0)
            return found

        for texts in it:
            rows = []
            for lo in range(0, len(texts), 512):
                scores = np.array([sum(map(weight, sorted(features(t)))) for t in texts[lo : lo + 512].to_pylist()])
                rows += [{"expected_grade": float(t.sum()), "tails": t.tolist(), "kept": bool(t[good - 1] >= sure)} for t in model.tails(scores)]
            yield pa.array(rows, arrow)
        known.clear()
        release()

    return docs.select(*[F.col(f"`{c}`") for c in keep], judge(F.col(f"`{text_col}`").cast("binary")).alias(name)), name


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: id, expected_grade, p_not_toxic, p_good, kept."""
    model = train(docs, graded(labels, id_col), id_col, text_col, **options)
    found, name = score(docs, model, [id_col], text_col)
    tails = F.col(f"{name}.tails")
    return found.select(id_col, f"{name}.expected_grade", tails[0].alias("p_not_toxic"), tails[1].alias("p_good"), f"{name}.kept")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    model = train(docs, graded(labels, id_col), id_col, text_col, **options)
    found, name = score(docs, model, docs.columns, text_col)
    return found.where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
