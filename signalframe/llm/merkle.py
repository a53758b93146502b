"""Merkle dataset manifest: a tree for each source, a tree over sources, a proof for each document.

Leaves of a source ascend by id. Their places come from bitmaps, not from a sort: every
task sets the bits of its ids in blocks of 1,024 ids (16 words of 64 bits, only blocks
that have an id), blocks of one source and range merge by OR, and a popcount directory
gives each block what lies before it: words within the block, blocks within their group
of 2^18, groups within theirs, so no sum runs over more than 2^18 rows. The rank of an id
is the directory's number for its block and word plus the bits below its own.

Rank div 16 is a leaf's run and rank mod 16 its slot. A run is one row of 16 keyed slots,
each filled by whatever task has it; its hash is a slot of the next level. Levels are
written as tables (level k has one row for each 16^k leaves), and paths go down again by
a join of each level with the one above.

A leaf is H (lowercase hex sha256) of the chosen columns, each ``-`` if null, else its
UTF-8 byte count, a colon and its value. A run's hash is H of its digests' hex text. A
tree of one leaf is that leaf. Subroots are ordered by source, null first, then bytewise.

Defined cases: a null id is the least one; a null source is a source of its own; rows that
repeat a source and an id are one leaf, the least digest of theirs, and a row with another
digest is not verified; ids must be integers, others raise TypeError; an empty table gives
an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import materialise

FANOUT = 16
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK_BITS, GROUP_BITS = 10, 18
WORDS = 1 << (BLOCK_BITS - 6)
BEFORE_ALL = -(1 << (63 - BLOCK_BITS)) - 1  # the block of null ids: less than that of any 64-bit id


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(columns: list[Column]) -> Column:
    return digest(F.concat(*map(encoded, columns)))


def lowered(text: Column) -> Column:
    """A-Z in lower case; ``lower`` where there is nothing but ASCII, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def leaves(docs: DataFrame, id_col: str, source_col: str, columns: list[str], text_col: str, tampered: Column) -> DataFrame:
    """source, id, leaf and forged (the leaf of a tampered row, whose text is lower-cased; else null)."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    plain = {c: F.col(f"`{c}`") for c in columns}
    forged = [lowered(c) if name == text_col else c for name, c in plain.items()]
    return docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf_of(list(plain.values())).alias("leaf"), F.when(tampered, leaf_of(forged)).alias("forged"))


def with_block(rows: DataFrame) -> DataFrame:
    """``rows`` (id) with block, word and bit of their ids."""
    low = F.col("id").bitwiseAND((1 << BLOCK_BITS) - 1)
    return rows.withColumn("block", F.coalesce(F.shiftright("id", BLOCK_BITS), F.lit(BEFORE_ALL))).withColumn("word", F.coalesce(F.shiftright(low, 6).cast("int"), F.lit(0))).withColumn("bit", F.coalesce(low.bitwiseAND(63).cast("int"), F.lit(0)))


def bitmaps(rows: DataFrame) -> DataFrame:
    """source, block, words: the merged bitmap of each block of a source that has ids."""
    mask = F.expr("shiftleft(1L, bit)")
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, mask)), F.lit(0)).alias(f"w{w}") for w in range(WORDS)]
    return with_block(rows.select("source", "id")).groupBy("source", "block").agg(*words).select("source", "block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("words"))


def directory(blocks: DataFrame) -> DataFrame:
    """``blocks`` with starts, the rank of the first id of each word: popcounts summed within blocks, groups of blocks and groups of these."""
    null_safe = lambda a, b, on: a.join(b, [a["source"].eqNullSafe(b["__s"]), *[a[c] == b[f"__{c}"] for c in on]])
    counted = blocks.withColumn("n", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)))
    counted = counted.withColumn("g1", F.shiftright("block", GROUP_BITS)).withColumn("g2", F.shiftright("block", 2 * GROUP_BITS))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy("source", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counted.groupBy("source", "g1", "g2").agg(F.sum("n").alias("n"))
    tops = groups.groupBy("source", "g2").agg(F.sum("n").alias("n")).withColumn("before2", before([], "g2"))
    tops = tops.select(F.col("source").alias("__s"), F.col("g2").alias("__g2"), "before2")
    groups = null_safe(groups.withColumn("before1", before(["g2"], "g1")), tops, ["g2"]).select(F.col("source").alias("__s"), F.col("g1").alias("__g1"), (F.col("before1") + F.col("before2")).alias("ahead"))
    placed = null_safe(counted.withColumn("before0", before(["g1"], "block")), groups, ["g1"])
    start = F.col("before0") + F.col("ahead")
    starts = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.aggregate(F.slice("words", F.lit(1), k), F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)))
    return placed.select("source", "block", "words", F.transform(starts, lambda s: s + start).alias("starts"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (source, id, ...) with run and slot: the rank of the id among its source's ids, div and mod 16."""
    found = directory(bitmaps(rows)).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "words", "starts")
    met = with_block(rows)
    met = met.join(found, met["source"].eqNullSafe(found["__s"]) & (met["block"] == found["__b"]))
    below = F.bit_count(F.get("words", F.col("word")).bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    rank = F.get("starts", F.col("word")) + below
    return met.withColumn("rank", rank).select(*rows.columns, F.shiftright("rank", 4).alias("run"), F.col("rank").bitwiseAND(FANOUT - 1).cast("int").alias("slot"))


def runs(nodes: DataFrame) -> DataFrame:
    """tree, run, slots, node: the digests of up to 16 neighbours by slot, and their hash; ``nodes`` has tree, run, slot, digest. Of several digests for a slot the least counts."""
    keyed = [F.min(F.when(F.col("slot") == k, F.unhex("digest"))).alias(f"s{k}") for k in range(FANOUT)]
    slots = F.transform(F.array_compact(F.array(*[f"s{k}" for k in range(FANOUT)])), lambda d: F.lower(F.hex(d)))
    made = nodes.groupBy("tree", "run").agg(*keyed).select("tree", "run", slots.alias("slots"))
    return made.withColumn("node", digest(F.array_join("slots", "")))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The runs of each level, the leaves' first, until every tree has one; trees that have one node at a level aren't in the next."""
    out = [materialise(runs(nodes))]
    while not out[-1].where("run > 0").isEmpty():
        last = out[-1]
        several = last.where("run = 1").select(F.col("tree").alias("__t"))  # these have a run 0 too; others are done
        going = last.join(several, last["tree"].eqNullSafe(several["__t"]), "left_semi")
        out.append(materialise(runs(going.select("tree", F.shiftright("run", 4).alias("run"), F.col("run").bitwiseAND(FANOUT - 1).cast("int").alias("slot"), F.col("node").alias("digest")))))
    return out


def finished(levels: list[DataFrame], k: int) -> DataFrame:
    """The runs of level ``k`` that are the one run of their tree there."""
    done = levels[k].where("run = 0")
    if k + 1 == len(levels):
        return done
    higher = levels[k + 1].select(F.col("tree").alias("__t")).distinct()
    return done.join(higher, done["tree"].eqNullSafe(higher["__t"]), "left_anti")


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree, top: the one node that remains of each tree; of a tree of one leaf the leaf itself."""
    out = None
    for k in range(len(levels)):
        top = F.when(F.size("slots") == 1, F.col("slots")[0]).otherwise(F.col("node")) if k == 0 else F.col("node")
        done = finished(levels, k).select("tree", top.alias("top"))
        out = done if out is None else out.unionByName(done)
    return out


def paths(levels: list[DataFrame], starts: DataFrame) -> DataFrame:
    """tree, run, slots, steps and what else ``starts`` has, of the leaves' runs.

    ``starts`` has tree and steps, the path from the tree's top to whatever is above.
    steps has (slots, slot) of each run above a run, from the next one on, then these.
    """
    rest = [c for c in starts.columns if c != "tree"]
    own = starts.withColumnRenamed("tree", "__t")
    above = None
    for k in reversed(range(len(levels))):
        done = finished(levels, k)
        here = done.join(own, done["tree"].eqNullSafe(own["__t"])).select("tree", "run", "slots", *rest)
        if above is not None:
            child = above.select(F.col("tree").alias("__t"), F.col("run").alias("__r"), F.col("slots").alias("__slots"), *rest, F.posexplode("slots").alias("__slot", "__digest"))
            step = F.array(F.struct(F.col("__slots").alias("slots"), F.col("__slot").alias("slot")))
            child = child.withColumn("__r", F.col("__r") * FANOUT + F.col("__slot")).withColumn("steps", F.concat(step, "steps")).drop("__slots", "__slot", "__digest")
            level = levels[k].select("tree", "run", "slots")
            under = level.join(child, level["tree"].eqNullSafe(child["__t"]) & (level["run"] == child["__r"])).select("tree", "run", "slots", *rest)
            here = here.unionByName(under)
        above = here
    return above


def own_step(lone: Column) -> Column:
    """The path from a node up: the step of its own run first, unless the node is a whole tree of one leaf."""
    return F.when(lone, F.col("steps")).otherwise(F.concat(F.array(F.struct("slots", "slot")), "steps"))


def siblings(slots: Column, slot: Column) -> Column:
    return F.array_join(F.filter(slots, lambda _, k: k != slot), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path; a run of one leaf that is a whole tree isn't hashed, so it isn't in a path."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.array_join(F.transform(step["slots"], lambda d, k: F.when(k == step["slot"], node).otherwise(d)), "")))


def source_places(sources: DataFrame) -> DataFrame:
    """``sources`` (source, top) with run and slot of the source among all: ranges are sorted by tasks, and moved by what the ranges before them have."""
    ordered = sources.repartitionByRange("source").sortWithinPartitions("source").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered)
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    rank = F.col("within") + F.col("ahead")
    return ordered.withColumn("within", within).join(F.broadcast(ahead), "part").select("source", "top", F.shiftright(rank, 4).cast("long").alias("run"), rank.bitwiseAND(FANOUT - 1).cast("int").alias("slot"))


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: list[str] | None = None, text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: its id, leaf, subroot, root, proof_sha256 (H of all siblings from leaf to root), folded_root and verified.

    ``folded_root`` is made anew from the row's leaf, or its forged one where ``tampered``
    holds (the text lower-cased), and the siblings of the manifest.
    """
    made = leaves(docs, id_col, source_col, columns or COLUMNS, text_col, F.lit(False) if tampered is None else tampered)
    placed = materialise(ranked(materialise(made)))
    ground = levels(placed.select(F.col("source").alias("tree"), "run", "slot", F.col("leaf").alias("digest")))
    subroots = materialise(tops(ground).withColumnRenamed("tree", "source"))
    places = materialise(source_places(subroots))
    upper = levels(places.select(F.lit(0).alias("tree"), "run", "slot", F.col("top").alias("digest")))
    root = tops(upper).select(F.col("top").alias("root"))  # one row, or none of an empty table
    none = F.array().cast("array<struct<slots: array<string>, slot: int>>")
    start = docs.sparkSession.range(1).select(F.lit(0).alias("tree"), none.alias("steps"))
    above = paths(upper, start).select(F.col("run").alias("__run"), "slots", "steps")
    above = places.join(above, F.col("run") == F.col("__run")).crossJoin(F.broadcast(root))
    own = own_step((F.size("steps") == 0) & (F.size("slots") == 1))
    starts = materialise(above.select(F.col("source").alias("tree"), F.col("top").alias("subroot"), "root", F.size(own).alias("height"), own.alias("steps")))
    down = paths(ground, starts).withColumn("tail", F.array_join(F.transform("steps", lambda s: siblings(s["slots"], s["slot"])), ""))
    down = down.withColumnRenamed("tree", "__tree").withColumnRenamed("run", "__run")
    met = placed.join(down, placed["source"].eqNullSafe(down["__tree"]) & (placed["run"] == down["__run"]))
    steps = own_step((F.size("steps") == F.col("height")) & (F.size("slots") == 1))
    proof = digest(F.concat(siblings(F.col("slots"), F.col("slot")), F.col("tail")))
    out = met.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("forged", "leaf"), steps).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``manifest`` of ``documents``, where the text of every id whose crc32 5 divides is tampered with."""
    return manifest(docs, id_col, tampered=F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0)
