"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed URL is a host and the beginning of a path with a verdict; it fits the host
and all subdomains where the path begins with its own, and the longest one wins. A
page's candidates are the ends of its host at label borders, each with the
beginnings of its path that are as long as some listed one. The Bloom filter (blocks
of eight 64-bit words, one bit in each) has at most ``MAX_BLOCKS`` blocks whatever
the list's size, so it is broadcast; candidates it passes go to the hash join with
the list, which takes away the false positives. All of it is DataFrame functions.

Defined cases: a null url, or one without ``://``, has an empty host and path; like
any url without a fitting rule it gets the default verdict and a null rule; equal
rules with different verdicts block; rows that repeat an id are judged each; an
empty list or table is no special case; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 15  # of 64 bytes: 2 MB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.col(url_col)
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": path})


def bloom_bits(key: Column) -> list[Column]:
    """The bit of each word of a block that a key sets."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: block, w0 to w7."""
    bits = bloom_bits(F.col("key"))
    rows = keys.select(bloom_block(F.col("key"), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each page: id, host, path, rule and verdict; ``rules`` has host, path and verdict ('allow' or 'block')."""
    listed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("listed"))
    sizes = rules.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("path"))), F.max(F.size(F.split("host", r"\.")))).first()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 64 * WORDS < sizes[0] * BITS_PER_URL:
        blocks *= 2
    bloom = F.broadcast(blocked_bloom(listed, blocks))
    labels = F.split("host", r"\.")
    most = F.least(F.size(labels), F.lit(sizes[2] or 1))
    hosts = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in sizes[1]]).cast("array<int>"), lambda n: F.length("path") >= n)
    begins = F.transform(fits, lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(begins, lambda p: F.concat(h, p))))
    pages = with_host_and_path(pages.select(id_col, url_col), url_col).withColumn("row", F.monotonically_increasing_id())
    candidates = pages.select("row", id_col, "host", "path", F.explode_outer(keys).alias("key"))
    tested = candidates.withColumn("block", bloom_block(F.col("key"), blocks)).join(bloom, "block", "left")
    passes = F.lit(True)
    for i, bit in enumerate(bloom_bits(F.col("key"))):
        passes &= F.col(f"w{i}").bitwiseAND(bit) != 0
    # a page without hits keeps a key of its own, which no rule has: nulls would meet in one partition
    own = F.concat(F.lit("\0"), F.col("row").cast("string"))
    passed = tested.select("row", id_col, "host", "path", F.when(passes, F.col("key")).otherwise(own).alias("key"))
    judged = passed.join(listed, "key", "left").withColumn("found", F.when(F.col("listed").isNotNull(), F.struct(F.length("key").alias("size"), F.col("key").alias("rule"), F.col("listed").alias("verdict"))))
    best = judged.groupBy("row", id_col, "host", "path").agg(F.max("found").alias("found"))
    return best.select(id_col, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
