import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from signalframe.llm import token_counts as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abc  \n\t'sre<|> é日\x1c\x85\xa0\u3000🎉12%", "<|endoftext|>", "'ll", " the", "ing", "\r\n", "  ", "Hello", " world"]


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_the_library(seed):
    library, counter = Tokenizer.from_file(PATH), t.PrefixCounter(PATH, limit=50)
    for text in texts(seed):
        ids = library.encode(text, add_special_tokens=False).ids
        assert counter.counts(text) == len(ids)
        prefixes = counter.prefix_counts(text)
        assert len(prefixes) == len(text) + 1 and prefixes[-1] == len(ids) and prefixes[0] == 0
    every = [*texts(seed + 10, 2000), None, ""]
    expected = [len(library.encode(x or "", add_special_tokens=False).ids) for x in every]
    assert counter.counts_of(pa.array(every, pa.string())).tolist() == expected


def test_words_equal_the_library():
    """Plain texts of words that share beginnings, with a cache that is emptied between."""
    rng = random.Random(9)
    library, counter = Tokenizer.from_file(PATH), t.PrefixCounter(PATH, limit=400)
    for _ in range(20):
        words = ["".join(rng.choice("aeinrstlthe'.,éß日9") for _ in range(rng.randint(1, 14))) for _ in range(300)]
        every = [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(20)]
        assert counter.counts_of(pa.array(every, pa.string())).tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in every]


def test_tokens_that_go_together():
    counter = t.PrefixCounter(PATH)
    rng = random.Random(3)
    vocab = sorted(v for v in counter.vocab if len(v) < 9 and counter.by_itself(v))
    for _ in range(5000):
        a, b = rng.choice(vocab), rng.choice(vocab)
        assert counter.together(a, b) == (counter.encoded(a + b) == [a, b])


def test_a_very_long_pre_token():
    counter, text = t.PrefixCounter(PATH), "abcdefgh" * 4000
    assert counter.counts(text) == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)


def test_prefix_counts_of_words_equal_the_library():
    library, counter = Tokenizer.from_file(PATH), t.PrefixCounter(PATH)
    for text in [" internationalisation", "abcdefghij" * 4, "Donaudampfschiff", " 1234567"]:
        counts = counter.prefix_counts(text)
        assert counts.tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_queries(spark):
    docs = [(1, "Hello world"), (2, None), (3, ""), (4, "é " * 2000), (4, "x"), (None, "a")]
    df = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id long, text string, n_bytes int")
    library = Tokenizer.from_file(PATH)
    n = lambda s: len(library.encode(s or "", add_special_tokens=False).ids)
    got = sorted((tuple(r) for r in t.token_counts(df).collect()), key=str)
    assert got == sorted(((a, len((b or "").encode()), n(b), n(b) > 1024) for a, b in docs), key=str)
    cut = {r["doc_id"]: r["n_chars_within"] for r in t.truncation(t.prefix_counts(df.where("doc_id < 4")), 1).collect()}
    assert cut == {1: 5, 2: 0, 3: 0}
    assert t.token_counts(df.limit(0)).count() == 0
