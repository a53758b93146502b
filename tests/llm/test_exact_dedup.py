import hashlib
import random
import re

import pytest

from signalframe.llm import exact_dedup as e


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for key, text in docs:
        groups.setdefault(norm(text), []).append(key)
    return sorted((key, min(groups[norm(t)]), len(groups[norm(t)]), key == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for key, t in docs)


@pytest.mark.parametrize("table_bytes", [1 << 20, 600])
def test_report_against_brute_force(spark, table_bytes):
    rng = random.Random(1)
    texts = ["", None, " ", "a\t b", "a b", "a\n\nb ", "é\x0b", "é ", "x" * 5000, *(f"text {i} " + "z" * rng.randrange(40) for i in range(30))]
    docs = [(n, rng.choice(texts)) for n in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, e.report(df, table_bytes=table_bytes).collect())) == brute(docs)
    kept = {r["doc_id"] for r in e.keep_rows(df, table_bytes=table_bytes).collect()}
    assert kept == {r[0] for r in brute(docs) if r[3]}


def test_grace_recursion_with_colliding_hashes():
    records = [(5, f"content {i % 50}".encode(), [i, 1, None]) for i in range(400)]
    got = {c: (v[0], v[1]) for _, c, v in e.grace(iter(records), budget=300)}
    assert got == {f"content {i}".encode(): (i, 8) for i in range(50)}


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (None, "a", "q"), (None, "b", "r")], "doc_id long, text string, __hash string")
    assert sorted(map(tuple, e.keep_rows(df).collect()), key=str) == sorted([(1, "a", "p"), (None, "b", "r")], key=str)
    assert e.report(df.limit(0)).count() == 0 and e.keep_rows(df.limit(0)).count() == 0
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in e.report(df.where("text = 'a' and doc_id is not null")).collect()) == [(1, 1, 2, True), (1, 1, 2, True)]


def test_very_long_texts(spark):
    text = "long words " * 300_000
    df = spark.createDataFrame([(3, text), (2, text.replace(" ", "\n")), (1, text + "end")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in e.report(df, table_bytes=1 << 20).collect()} == {1: 1, 2: 2, 3: 2}
