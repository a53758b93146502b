import hashlib
import random
import re

import numpy as np
import pytest

from signalframe.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    out = []
    split = [(key, WORD.findall(lower(text))) for key, text in items]
    for key, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for item, iw in split:
            for s in range(max(1, len(iw) - window + 1) if iw else 0):
                p = iw[s : s + window]
                for at in range(len(words) - len(p) + 1):
                    if words[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        found.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_index(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 200)
    if seed == 5:
        text = np.full(50, 2)
    order = d.suffix_array(np.append(text, 0))
    t = [*text.tolist(), 0]
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    index = d.FMIndex(text)
    words = np.array([[2, 2, 3], [3, 1, 0], [1, 0, 0], [9, 9, 9]])
    found, low, high = index.search(words, np.array([3, 2, 1, 3]))
    for f, a, b in zip(found, low, high, strict=True):
        p = [x for x in words[f].tolist() if x]
        expected = [i for i in range(len(text)) if t[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c9", "é", "dd"])
    items = [(n, " ".join(word() for _ in range(rng.choice([0, 1, 5, 14, 20])))) for n in range(12)]
    items[0] = (0, "...")
    items += [(50, None), (51, items[3][1]), (1, "zz yy")]
    items = [(k, t) for k, t in items if t is None or len(t.split()) != 1]
    docs = [(n, ", ".join(word() for _ in range(rng.randint(0, 60)))) for n in range(60)]
    docs += [(60, None), (61, ""), (62, items[3][1]), (63, "x " * 900 + (items[3][1] or "")), (62, items[3][1])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    got = d.report(docs_df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, chunk_words=200)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, decontamination string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.clean_documents(docs, none).collect() == docs.collect()
    assert d.report(docs.limit(0), none).count() == 0
    items = spark.createDataFrame([(7, "A b")], "item_id long, text string")
    assert d.clean_documents(docs, items).count() == 0


def test_a_very_long_text_and_repeated_ids(spark):
    phrase = " ".join(f"q{n}" for n in range(13))
    docs = spark.createDataFrame([(1, "a b c " * 300_000 + phrase + " a b c" * 1000), (2, phrase), (2, "none"), (None, phrase)], "doc_id long, text string")
    got = d.report(docs, spark.createDataFrame([(7, phrase)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"], r["contaminated"]) for r in got) == [("1", 13, False), ("2", 0, False), ("2", 13, True), ("None", 13, True)]
