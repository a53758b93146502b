import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from signalframe.llm import lattice_lm as m

PIECES = m.Pieces([b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", b"bb"], np.log(np.array([0.2, 0.1, 0.1, 0.2, 0.15, 0.05, 0.15, 0.05])))


def every_way(word):
    word = b" " + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        if all(p in PIECES.number for p in parts):
            total += math.exp(sum(PIECES.logp[PIECES.number[p]] for p in parts))
    return total


def test_forward_sums_all_segmentations(monkeypatch):
    words = [bytes(w) for n in range(1, 7) for w in itertools.product(b"ab", repeat=n)]
    got = np.exp(PIECES.log_probabilities(words))
    assert np.allclose(got, [every_way(w) for w in words])
    monkeypatch.setattr(m, "LONG_WORD", 3)
    assert np.allclose(np.exp(PIECES.log_probabilities(words)), got)


def test_expected_counts_are_posteriors():
    words, counts = [b"ab", b"abab", b"b"], np.array([3.0, 1.0, 2.0])
    got = PIECES.expected_counts(words, counts)
    letters = sum(c * (len(w) + 1) for w, c in zip(words, counts, strict=True))
    assert math.isclose(sum(n * len(p) for n, p in zip(got, PIECES.pieces, strict=True)), letters)


def test_probabilities_sum_to_one():
    counts = {b"a": 5, b"bb": 1}
    words = [bytes(w) for n in range(1, 13) for w in itertools.product(b"ab", repeat=n)]
    c = np.array([counts.get(w, 0) for w in words])
    start = np.array([0.2, 0.15, 0.25])  # begin a word
    p = m.Pieces([b" a", b" ab", b" b", b"a", b"b", b"ab"], np.log(np.concatenate([start, [0.2, 0.1, 0.1]])))
    total = (10 ** m.word_log10(p.log_probabilities(words), c, 6, 2, 3)).sum() + 10 ** m.end_log10(6, 2, 3)
    assert 0.97 < total <= 1 + 1e-9


@pytest.mark.parametrize("frequent", [5, 1000])
def test_scores_against_plain_code(spark, frequent):
    rng = random.Random(0)
    words = ["the", "The", "cat", "sat", "naïve", "x" * 60, "12,", "zq"]
    docs = [(n, " ".join(rng.choice(words[: 4 + n % 5]) for _ in range(rng.randint(0, 30)))) for n in range(60)] + [(90, None), (91, ""), (3, "the\tcat")]
    got = m.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), frequent=frequent)
    split = lambda t: m.words_of((t or "").encode())
    train = [t for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = {}
    for t in train:
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = sorted((k, zlib.crc32(str(k).encode()) % 5 == 1, len(split(t)) + 1, sum(w in counts for w in split(t)) + 1, n, round(sum(base(counts.get(w, 0)) for w in split(t)) + base(len(train)), 6)) for k, t in docs)
    rows = got.collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(-math.inf < r["score"] < 0 for r in rows)
    with_rare = {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows}
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in m.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), frequent=3).collect()}
    assert all(math.isclose(with_rare[k], again[k], rel_tol=1e-9) for k in again)


def test_empty_table(spark):
    assert m.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def segmentations(model, word):
    """Every way to spell a word, as lists of piece numbers."""
    if not word:
        yield []
    for end in range(1, len(word) + 1):
        if (n := model.number.get(word[:end])) is not None:
            for rest in segmentations(model, word[end:]):
                yield [n, *rest]


def test_long_words_count_all_segmentations(monkeypatch):
    model = m.pieces_at(None)
    words = [b"internationalisation", b"abcabcabc" * 5, "\u65e5\u672c".encode() * 8, b"x" * 60]
    one_by_one = [model.expected_counts([w], np.ones(1)) for w in words]
    whole = [model.log_probabilities([w])[0] for w in words]
    monkeypatch.setattr(m, "LONG_WORD", 1)
    for w, counts, logp in zip(words, one_by_one, whole, strict=True):
        assert np.allclose(model.expected_counts([w], np.ones(1)), counts) and np.isclose(model.log_probabilities([w])[0], logp)
        assert np.isclose(sum(n * len(p) for n, p in zip(counts, model.pieces, strict=True)), len(w) + 1)
    monkeypatch.setattr(m, "LONG_WORD", 1000)
    for w, counts in zip(words, one_by_one, strict=True):
        assert np.allclose(model.expected_counts([w], np.ones(1)), counts)


def test_document_scores_by_enumeration(spark):
    docs = [(n, t) for n, t in enumerate(["The cat sat", "a cat is a cat", "hats at", None, "", "sat hat zq", "The the THE", "is it a hat", "cat zzq", "new words"])]
    docs.append((None, "a hat"))
    train = [m.words_of((t or "").encode()) for i, t in docs if not m.held_out(i)]
    c = Counter(w for d in train for w in d)
    model = m.pieces_at(None)
    logp = model.logp
    for _ in range(m.STEPS):
        total = np.full(len(logp), 0.01)
        for w in c:
            ways = [(sum(logp[k] for k in way), way) for way in segmentations(model, b" " + w)]
            every = sum(math.exp(x) for x, _ in ways)
            for x, way in ways:
                for k in way:
                    total[k] += math.exp(x) / every
        logp = np.log(total / total.sum())
    words, ends = sum(c.values()), len(train)
    n, v = words + ends, len(c) + 1
    rest, share = m.DISCOUNT * v / n, (ends + 1) / (words + ends + 2)

    def probability(w):
        lattice = sum(math.exp(sum(logp[k] for k in way)) for way in segmentations(model, b" " + w))
        return max(c[w] - m.DISCOUNT, 0) / n + rest * (1 - share) * lattice

    end = (ends - m.DISCOUNT) / n + rest * share
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, word string, score double")
    got = {r["doc_id"]: r for r in m.score_documents(df).collect()}
    for i, t in docs:
        expected = math.log10(end) + sum(math.log10(probability(w)) for w in m.words_of((t or "").encode()))
        assert math.isclose(got[i]["score"], expected, rel_tol=1e-9), (i, t)
        assert got[i]["train_tokens"] == n
