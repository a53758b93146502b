"""Exact token counts of every prefix of a text, by dynamic programming.

In byte-pair encoding the last token of a prefix's encoding is the only suffix of
it that is a token and that goes with the last token of the encoding of what is
before it: two tokens go together when encoding their joined bytes gives them
back. So last[i] and count[i] follow from the same of shorter prefixes, no prefix
is encoded anew, and count[i] = count[i - len(last[i])] + 1 holds for each. Tokens
never cross the tokenizer's own pre-token borders, so counts before a pre-token
add up, and a part's counts (white space and the text behind it, the largest unit
that no neighbour influences) are kept for its next occurrence.

``counts`` gives a text's token count; ``prefix_counts`` the counts of all its
prefixes at once, from which ``truncation`` reads how many characters fit a
budget. A character counts from the byte that completes it.

The counts are of the prefix's tokens within the text's own pre-tokens. Cutting a
text anew can move a pre-token border only in white space at the cut's end and in
contractions; ``prefix_counts`` counts the former as the library does for the cut
text, and truncation points are the same for both.

Defined cases: null text is an empty one, with 0 tokens and the one prefix 0; rows that
repeat an id are counted each, and a null id is kept; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import claim

CACHED_PARTS = 500_000
#: The byte-level pre-tokenizer's pattern, as published with the vocabulary.
PRE_TOKENS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space and what follows it. Only blanks and line feeds separate parts, in texts with other white space too: a part that has any is cut by the pattern with its neighbours.
PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
OTHER_SPACES = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # the same characters, for Arrow
SLICE = 512


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible Latin-1 as it is, the rest from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str, limit: int = CACHED_PARTS) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.vocab = {raw(s) for s in spec["model"]["vocab"] if all(c in alphabet for c in s)}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        self.longest = max(map(len, self.vocab))
        self.limit = limit
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.alone: dict[bytes, bool] = {}
        self.merged: dict[bytes, tuple[int, bytes, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.parts: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def encoded(self, data: bytes, until: int = 1) -> list[bytes]:
        """Byte-pair encoding as defined: the lowest merge first, the leftmost of equals; ends at ``until`` tokens."""
        tokens = [data[i : i + 1] for i in range(len(data))]
        while len(tokens) > until:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)))
            if rank == 1 << 60:
                break
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
        return tokens

    def made(self, token: bytes) -> tuple[int, bytes, bytes]:
        """The rank of the merge that makes a token, and what it merges; -1 for a byte."""
        known = self.merged.get(token)
        if known is None:
            known = (-1, token, token)
            if len(token) > 1:
                left, right = self.encoded(token, 2)
                known = (self.ranks[left, right], left, right)
            self.merged[token] = known
        return known

    def together(self, a: bytes, b: bytes) -> bool:
        """Whether no merge crosses the border of two tokens. From their last state back in time: the one that was made last is taken apart, and a merge across the border would have come before that if its rank is lower (or equal, where it is further left)."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            x, y, goes = a, b, (a, b) not in self.ranks
            while goes:
                (r, _, right), (s, left, _) = self.made(x), self.made(y)
                if r < 0 and s < 0:
                    break
                if r > s:
                    x = right
                    goes = self.ranks.get((x, y), 1 << 60) >= r
                else:
                    y = left
                    goes = self.ranks.get((x, y), 1 << 60) > s
            known = self.pairs[a, b] = goes
        return known

    def by_itself(self, token: bytes) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.encoded(token) == [token]
        return known

    def along(self, data: bytes, last: list[bytes] | None = None, count: list[int] | None = None) -> list[int]:
        """count[i] for every prefix of a pre-token's bytes; ``last`` and ``count`` of a prefix, where given, are gone on with."""
        n, vocab, longest, pairs = len(data), self.vocab, self.longest, self.pairs
        if last is None or count is None:
            last, count = [b""], [0]
        for i in range(len(last), n + 1):
            for start in range(max(0, i - longest), i):
                token = data[start:i]
                if token not in vocab:
                    continue
                if start:
                    known = pairs.get((last[start], token))
                    goes = self.together(last[start], token) if known is None else known
                else:
                    goes = self.by_itself(token)
                if goes:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count

    def learn(self, words: list[str]) -> None:
        """The counts of new words, in the order of their bytes: one that begins like the one before goes on from their common prefix's counts."""
        found = [PRE_TOKENS.findall(w if w[:1] == "\n" else " " + w) for w in words]
        totals: dict[str, int] = {}
        before, last, count = b"", [b""], [0]
        for data, token in sorted((t.encode(), t) for t in {t for tokens in found for t in tokens}):
            most, same = min(len(before), len(data)), 0
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            totals[token] = self.along(data, last, count)[-1]
            before = data
        if len(self.words) + len(words) > self.limit:
            self.words.clear()
        self.words.update((w, sum(map(totals.__getitem__, tokens))) for w, tokens in zip(words, found, strict=True))

    def piece(self, token: str) -> list[int]:
        """count[i] for the prefixes of i bytes of a pre-token."""
        known = self.pieces.get(token)
        if known is None:
            if len(self.pieces) >= self.limit // 4:
                self.pieces.clear()
            known = self.pieces[token] = self.along(token.encode())
        return known

    def part(self, text: str) -> int:
        known = self.parts.get(text)
        if known is None:
            if len(self.parts) >= self.limit:
                self.parts.clear()
            known = self.parts[text] = sum(self.piece(p)[-1] for p in PRE_TOKENS.findall(text))
        return known

    def stretches(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and these, which the library makes one token each."""
        at = 0
        if self.special_at and any(s in text for s in self.special):
            for m in self.special_at.finditer(text):
                yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        yield text[at:], False

    def counts(self, text: str | None) -> int:
        total = 0
        for stretch, special in self.stretches(text or ""):
            if special:
                total += 1
            elif OTHER_SPACE.search(stretch):
                total += sum(self.piece(p)[-1] for p in PRE_TOKENS.findall(stretch))
            else:
                parts = PARTS.findall(stretch)
                try:
                    total += sum(map(self.parts.__getitem__, parts))
                except KeyError:
                    total += sum(map(self.part, parts))
        return total

    def counts_of(self, texts: pa.Array) -> np.ndarray:
        """``counts`` of many texts. Where all that separates words is one blank or line feed, Arrow splits the texts and numbers their distinct words; only these become Python strings."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"^[ \n]|[ \n]$|[ \n][ \n]|{OTHER_SPACES}")
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = pc.or_(odd, pc.equal(texts, ""))
        out = np.zeros(len(texts), np.int64)
        rest = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        out[rest] = [self.counts(t) for t in texts.take(pa.array(rest)).to_pylist()]
        plain = texts.filter(pc.invert(odd))
        if len(plain):
            split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
            words = split.flatten().dictionary_encode()
            starts, distinct = split.offsets.to_numpy(), words.dictionary.to_pylist()
            if new := [w for w in distinct if w not in self.words]:
                self.learn(distinct if len(self.words) + len(new) > self.limit else new)
            counts = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
            firsts = words.indices.to_numpy()[starts[:-1]]
            counts[starts[:-1]] = [self.part(distinct[i]) for i in firsts.tolist()]  # no blank before these
            out[~odd.to_numpy(zero_copy_only=False)] = np.diff(np.append(0, np.cumsum(counts))[starts])
        return out

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """The token count of each prefix of 0, 1, ... characters."""
        out, base = [np.zeros(1, np.int64)], 0
        for stretch, special in self.stretches(text or ""):
            if special:
                out.append(np.full(len(stretch), base + 1))
                base += 1
                continue
            for p in PRE_TOKENS.findall(stretch):
                count = np.array(self.piece(p), np.int64)
                ends = np.cumsum([len(c.encode()) for c in p])
                out.append(base + count[ends])
                base += int(count[-1])
        return np.concatenate(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str | None) -> PrefixCounter:
    claim("token counts", _counters.clear)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    """``columns(texts)`` behind the id; texts go through in small slices."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                out = columns(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *out], [id_col, *[f"c{n}" for n in range(len(out))]])

    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {schema}")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every text."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        return [pc.binary_length(pc.fill_null(texts, "")).cast(pa.int64()), pa.array(counter(path).counts_of(texts))]

    found = _mapped(df, id_col, text_col, "c0 long, c1 long", columns)
    return found.select(id_col, F.col("c0").alias("n_bytes"), F.col("c1").alias("n_tokens"), (F.col("c1") > limit).alias("over_limit"))


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and prefix_counts, whose element i (from 0) is the token count of the first i characters."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([counter(path).prefix_counts(t) for t in texts.to_pylist()], pa.list_(pa.int64()))]

    found = _mapped(df, id_col, text_col, "c0 array<long>", columns)
    return found.select(id_col, F.col("c0").alias("prefix_counts"))


def truncation(prefix_counts: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """id and the largest number of characters whose prefix has at most ``budget`` tokens, read from the stored counts."""
    fits = F.expr(f"aggregate(prefix_counts, struct(-1 AS at, -1 AS best), (a, c) -> struct(a.at + 1 AS at, IF(c <= {int(budget)}, a.at + 1, a.best) AS best), a -> a.best)")
    return prefix_counts.select(id_col, fits.alias("n_chars_within"))
