import hashlib
import random

import pytest

from signalframe.llm import substring_dedup as s


def brute(docs, window):
    first = {}
    split = [(key, [] if text is None else text.encode().split()) for key, text in docs]
    for key, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(key, first.get(w, key))
    out = []
    for key, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(200)}" for _ in range(rng.choice([10, 20, 25, 60]))] for _ in range(5)]
    common = [f"c{i}" for i in range(18)]
    docs = []
    for n in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice([*passages, common, [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]])
        if rng.random() < 0.3 and docs:
            words = (rng.choice(docs)[1] or "").split() + words[:3]
        docs.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(words)))
    return [*docs, (7, None), (8, ""), (9, "x " * 300), (10, "x " * 200), (docs[0][0], docs[0][1])]


@pytest.mark.parametrize(("seed", "chunk_words"), [(0, 10**6), (1, 300), (2, 60)])
def test_report_against_brute_force(spark, seed, chunk_words):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, s.report(df, window=20, chunk_words=chunk_words).collect())) == brute(docs, 20)


def test_production_window(spark):
    rng = random.Random(9)
    line = [f"w{rng.randrange(90)}" for _ in range(120)]
    docs = [(n, " ".join([f"a{n}_{i}" for i in range(rng.randrange(60))] + line[rng.randrange(40) : 60 + rng.randrange(60)] + [f"b{n}_{i}" for i in range(20)])) for n in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, s.report(df).collect())) == brute(docs, 50)


def test_edge_cases(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, text, 1), (2, text, 2), (1, text, 3)], "doc_id long, text string, spans int")
    assert {(r["doc_id"], r["n_removed"]) for r in s.report(df).collect()} == {(None, 0), (2, 60), (1, 0)}
    assert {r["doc_id"]: r["text"] for r in s.without_repeats(df).collect()} == {None: text, 2: "", 1: text}
    assert s.report(df.limit(0)).count() == 0


def edge_paths(spark, rows):
    """Paths (doc, first, last, source, source_first, start node, end node, first edge, last edge)."""
    full = [(d, 0, *rest) for d, *rest in rows]
    return spark.createDataFrame(full, "doc long, row long, first long, last long, source long, source_first long, start_node long, end_node long, first_edge long, last_edge long")


def test_nonbranching_paths_are_chains(spark):
    # 10 -> 20 -> 30 in a row; 30 ends at a node with two ways on; 60 -> 70 -> 60 is a cycle; 80 meets itself
    found = s.compacted(edge_paths(spark, [
        (5, 0, 2, 1, 0, None, 100, 10, 12), (5, 3, 6, 1, 3, 100, 200, 20, 23), (5, 7, 7, 1, 7, 200, 300, 30, 30),
        (5, 8, 9, 1, 8, 300, None, 40, 41), (6, 8, 9, 1, 8, 300, None, 50, 51),
        (6, 20, 21, 1, 20, 600, 700, 60, 61), (6, 22, 23, 1, 22, 700, 600, 70, 71),
        (7, 0, 0, 1, 0, 800, 800, 80, 80), (7, 3, 5, 1, 3, None, None, 20, 23), (8, 1, 2, None, None, None, None, None, None),
    ])).collect()
    chains = {(r["first_edge"], r["n"]): (r["chain"], r["offset"]) for r in found}
    head = chains[10, 3][0]
    assert [chains[k] for k in ((10, 3), (20, 4), (30, 1))] == [(head, 0), (head, 3), (head, 7)]
    others = [chains[k] for k in ((40, 2), (50, 2), (60, 2), (70, 2), (80, 1))]
    assert len({c for c, _ in others} | {head}) == 6 and all(o == 0 for _, o in others)


def test_a_gap_in_a_chain_parts_its_span(spark):
    paths = edge_paths(spark, [
        (5, 0, 2, 1, 0, None, 100, 10, 12), (5, 3, 6, 1, 3, 100, 200, 20, 23), (5, 7, 7, 1, 7, 200, None, 30, 30),
        (6, 40, 42, 1, 0, None, 100, 10, 12), (6, 47, 47, 1, 7, 200, None, 30, 30), (7, 1, 2, None, None, None, None, None, None),
    ])
    assert sorted((r["doc"], r["first"], r["last"]) for r in s.spans_of_chains(paths).collect()) == [(5, 0, 7), (6, 40, 42), (6, 47, 47), (7, 1, 2)]


def test_ids_of_other_kinds(spark):
    text = " ".join(map(str, range(60)))
    with pytest.raises(TypeError):
        s.report(spark.createDataFrame([("a", text)], "doc_id string, text string"))
    found = s.report(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"))
    assert dict(found.dtypes)["doc_id"] == "int" and {r["doc_id"]: r["n_removed"] for r in found.collect()} == {1: 0, 2: 60}


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:50_000] + ["own"] + words[50_000:])), (3, " ".join(words[100:160]))]
    found = s.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {1: 0, 2: 60_000, 3: 60}
