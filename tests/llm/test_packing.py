import random
import zlib

import numpy as np
import pytest

from signalframe.llm import packing as k


def checked(histogram, capacity):
    total, use = {}, {}
    for n, first, count, seq, per, offset in k.plan(histogram, capacity):
        assert first == total.get(n, 0) and count % per == 0
        total[n] = first + count
        for j in range(count // per):
            use.setdefault(seq + j, []).append((offset, per * n))
    assert total == {n: c for n, c in histogram.items() if c}
    for places in use.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(use)


@pytest.mark.parametrize("seed", range(20))
def test_plans_are_gapless(seed):
    rng = random.Random(seed)
    checked({rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 25))}, 60)


def test_plans_are_nearly_full():
    rng = random.Random(1)
    histogram = {}
    for _ in range(50_000):
        n = min(4096, max(1, int(rng.lognormvariate(6.3, 1))))
        histogram[n] = histogram.get(n, 0) + 1
    least = -(-sum(n * c for n, c in histogram.items()) // 4096)
    assert checked(histogram, 4096) <= 1.01 * least
    assert checked({}, 4096) == 0 and checked({4096: 3, 1: 7}, 4096) == 4


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(k.tokenizer_path())
    rng = random.Random(2)
    words = ["the", "The,", "naïve", "x1", "<|endoftext|>", "don't", "日本", "a\u0301", "\x85", "..."]
    docs = [(n, rng.choice([" ", "\n", "\t", "  "]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 900])))) for n in range(80)] + [(100, None), (101, ""), (101, "")]
    got = k.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), capacity=128, with_ids=True).collect()
    by_doc = {}
    for r in got:
        assert len(r["ids"]) == r["length"] <= 128 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["start"] == 128 * r["piece"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["ids"]))
    for key, text in docs[:-1]:
        if key < 101:
            assert [i for _, ids in sorted(by_doc[key]) for i in ids] == [*library.encode(text or "", add_special_tokens=False).ids, 1]
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    assert k.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marks_behind_every_letter_equal_the_library():
    """Every letter and digit before a stop or comma, alone and behind another, among them those that the library takes apart."""
    import sys

    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(k.tokenizer_path()), k.WordIds(k.tokenizer_path(), limit=50_000)
    letters = [c for c in map(chr, range(sys.maxunicode)) if c.isalnum() and (ord(c) < 0x3400 or ord(c) > 0xF900 and ord(c) < 0x10000)]
    for lo in range(0, len(letters), 2000):
        part = letters[lo : lo + 2000]
        text = " ".join([f"{c}{m}" for c in part for m in ".,"] + [f"x{c}." for c in part] + [f"{c}'s." for c in part])
        assert words.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_library():
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(k.tokenizer_path()), k.WordIds(k.tokenizer_path(), limit=300)
    rng = random.Random(4)
    alphabet = [*"aAzZ09.,'<|>- \n\t\u0130\u0958\u09dc\ufb2a\u0301\u0307éÉßſŉµª²½İıΣς日가ᄀ", "<|endoftext|>", "'s", "don't", " The", ".\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    import pyarrow as pa

    for text, ids in zip(texts, words.encode_all(pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_pack_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(n, 3 + n % 2, "s", 1, 2, 3) for n in range(20)], "id long, length long, __salt string, __within int, __number int, __place int")
    got = k.pack(rows, ["id"], capacity=10)
    assert got.columns == [*rows.columns, "sequence_id", "offset"] and got.count() == 20
    with pytest.raises(ValueError):
        k.pack(rows.withColumnRenamed("__salt", "Offset"), ["id"], capacity=10)
    assert k.pack_documents(spark.createDataFrame([], "doc_id long, text string, length int")).count() == 0
