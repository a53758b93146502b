import random

import numpy as np
import pytest

from signalframe.llm import parity_join as p


def brute(docs, k=3, num=90, den=100):
    sets = []
    for _, text in docs:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (key, _) in enumerate(docs):
        smallest[root(i)] = min(key, smallest.get(root(i), key))
    return sorted((key, len(sets[i]), smallest[root(i)]) for i, (key, _) in enumerate(docs))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed, groups=6):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 4, 25, 60, 130, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3]))))
        chain = base * 3
        for _ in range(6):  # links that only chain
            chain = edited(rng, chain, max(1, len(chain) // 90))
            docs.append("  ".join(chain))
    docs += ["", None, "a", "A", "a b", "b a", "the same words again " * 50, "The same words again " * 50]
    rng.shuffle(docs)
    return [(n * 3 + 1, t) for n, t in enumerate(docs)]


@pytest.mark.parametrize("seed, small", [(0, p.SMALL), (1, p.SMALL), (1, 3)])
def test_components_against_brute_force(spark, seed, small):
    docs = corpus(seed)
    got = p.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), small=small)
    assert sorted(map(tuple, got.collect())) == brute(docs)


@pytest.mark.parametrize("k, threshold, small, copies", [(3, (90, 100), p.SMALL, 3000), (5, (80, 100), 100, 700)])
def test_many_different_near_copies(spark, k, threshold, small, copies):
    """Different copies of one text that share buckets, of which few link, against the links of all pairs."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for n in range(copies):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            at = rng.randrange(len(copy))
            copy[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)]
        docs.append((n, " ".join(copy)))
    sets = [p.shingle_hashes(t.encode(), k, 0) for _, t in docs]
    every, number = np.unique(np.concatenate(sets), return_inverse=True)
    table = np.zeros((len(docs), len(every)), np.float32)
    table[np.repeat(np.arange(len(docs)), [len(s) for s in sets]), number] = 1
    size = np.array([len(s) for s in sets])
    both = (table @ table.T).astype(np.int64)
    linked = threshold[1] * both >= threshold[0] * (size[:, None] + size - both)
    least = np.arange(len(docs))
    while (now := np.where(linked, least, len(docs)).min(axis=1)).tolist() != least.tolist():
        least = now
    got = p.similar_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=k, threshold=threshold, small=small)
    assert sorted(map(tuple, got.collect())) == [(n, int(size[n]), int(least[n])) for n in range(len(docs))]
    assert 1 < len(set(least.tolist())) < len(docs) - 100


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 500))), (3, " ".join(edited(rng, words, 9_000)))]
    rows = spark.createDataFrame([(*d, 7, "x", 1, "y") for d in docs], "doc_id long, text string, node int, id string, row int, __text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in p.similar_components(rows).collect()) == [(1, 1), (2, 1), (3, 3)]
    kept = p.representatives(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_every_link_shares_a_bucket():
    rng = np.random.default_rng(3)
    for size in [10, 15, 19, 20, 37, 100, 333, 900]:
        for _ in range(30):
            whole = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            differ = int(rng.integers(0, 2 * size // 19 + 1))
            gone = int(rng.integers(0, differ + 1))
            other = np.unique(np.concatenate([rng.permutation(whole)[gone:], rng.integers(0, 1 << 64, differ - gone, dtype=np.uint64)]))
            both = len(np.intersect1d(whole, other))
            if 100 * both >= 90 * (len(whole) + len(other) - both) and both < max(len(whole), len(other)):
                assert set(p.bucket_keys(whole, (90, 100)).tolist()) & set(p.bucket_keys(other, (90, 100)).tolist())


def test_elements_of_ones_own_leave_a_bucket():
    rng = np.random.default_rng(8)
    for _ in range(200):
        size = int(rng.integers(20, 400))
        common = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        u, v = (int(x) for x in rng.integers(0, size // 20 + 1, 2))
        if 100 * size >= 90 * (size + u + v):
            shared = set(p.bucket_keys(common, (90, 100), u).tolist()) & set(p.bucket_keys(common, (90, 100), v).tolist())
            assert shared


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 300, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert np.bitwise_count(p.short_sketch(x) ^ p.short_sketch(y)).sum() <= len(np.setxor1d(x, y))
        for words, other in ((16, 16), (8, 32)):
            a, b = p.same_width([p.short_sketch(x, words).tobytes(), p.short_sketch(y, other).tobytes()])
            assert np.array_equal(a, p.short_sketch(x, min(words, other))) and np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (101, 90)]
    for few in (0, 1000):
        got = p.components(spark.createDataFrame(edges, "a long, b long"), few)
        assert {(r["node"], r["component"]) for r in got.collect()} == {(i, 0) for i in range(61)} | {(100, 90), (101, 90), (90, 90)}
        assert p.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert p.similar_components(empty).count() == 0
    assert p.representatives(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (4, "x", 4), (6, None, 5), (7, "", 6)], "doc_id long, text string, node int")
    got = sorted((tuple(r) for r in p.similar_components(rows).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (4, 1, 4), (6, 0, 6), (7, 0, 7)], key=str)
    kept = p.representatives(rows)
    assert kept.columns == rows.columns
    assert sorted(r["node"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
