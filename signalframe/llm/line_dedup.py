"""Line dedup: repeated lines leave all documents but one, by keep bitmaps instead of text.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys
of at least ``least_chars`` code points that ``least_docs`` documents or more hold lose
their lines everywhere but in the document with the largest id.

Keys travel as two 64-bit hashes beside id and position; texts don't. Hashes are spread
evenly, so their ranges are cut by arithmetic instead of by sampling: a range is a
partition, which one sort orders by hash, then id (falling), then position. Streaming
over it in that order, the first row of a hash is the document that keeps its lines, and
a row whose id differs from the last one's is the first occurrence in another document.
A hash that holds more lines than a quarter of a partition's share, as a sample of lines
says, is dealt over all ranges by id; each gives its number of documents and its largest
id, one row each, and their sum and greatest are the verdict. There are at most eight such
hashes for each partition, and the result doesn't depend on which they are.

What comes out is a row for each document that loses lines: a compressed bitmap, the
64-bit words of 64 lines each that have a dropped line, bits of kept lines set; a word
that isn't listed keeps all its lines. Everything is DataFrame functions.

Defined cases: null and empty text is one empty line; rows that repeat an id are one
document when lines are counted, and each row is filtered by its own bitmap; a null id is
one document with the least id; a key that a document repeats counts once there, and the
document that keeps it keeps every occurrence; an empty table gives an empty result; other
columns, whatever their names, aren't read, and ``without_repeated_lines`` returns them as
they are. Keys are the same when both hashes are; words aren't compared.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.functions import let
from signalframe.llm.common import fresh, materialise, shuffle_partitions

LEAST_CHARS, LEAST_DOCS = 40, 5
SPACE = " \t\n\x0b\x0c\r"
WORD = 64


def line_key(line: Column) -> Column:
    """The line stripped, A-Z lower-cased: ``lower`` where there is nothing but ASCII, which is faster."""
    return let(F.btrim(line, F.lit(SPACE)), lambda k: F.when(F.octet_length(k) == F.char_length(k), F.lower(k)).otherwise(F.translate(k, string.ascii_uppercase, string.ascii_lowercase)))


def version(text: Column) -> Column:
    """Tells rows of the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """h1, h2, id, version, pos of every line whose key is long enough."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), version(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    long = lines.where(F.char_length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "version", "pos")


def frequent(lines: DataFrame, parts: int) -> DataFrame:
    """h1 of the hashes that hold more lines than a quarter of a partition's share, by a hashed sample of about 400 lines for each partition; ``8 * parts`` rows at most. It only decides where lines go."""
    n, sample = lines.count(), 400 * parts
    share = F.pmod(F.xxhash64("h1", "h2", "id", "version", "pos"), F.lit(1 << 30)) * F.lit(n) < F.lit(sample << 30)
    return lines.where(share).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(n, sample) // (8 * parts)).select("h1")


def repeated_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """h1, h2, id, version, pos, keeper, docs of the lines of keys that so many documents hold."""
    parts = shuffle_partitions(lines.sparkSession)
    hot = F.broadcast(frequent(lines, parts).withColumn("hot", F.lit(True)))  # 8 * parts rows at most
    met = lines.join(hot, "h1", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    at = F.shiftright(F.shiftrightunsigned("h1", 33) * parts, 31)  # the range of a hash, as an unsigned number
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(F.lit(0))
    dealt = met.withColumn("range", F.pmod(at + spread, F.lit(parts)).cast("int")).repartitionById(parts, "range")
    stream = Window.partitionBy("range", "h1", "h2").orderBy(F.desc_nulls_last("id"), "version", "pos")
    first = F.row_number().over(stream) == 1
    seen = dealt.withColumn("head", first).withColumn("new", first | ~F.lag("id").over(stream).eqNullSafe(F.col("id")))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = seen.withColumn("docs", F.count_if("new").over(whole)).withColumn("keeper", F.first("id").over(whole))
    kept = materialise(counted.where(F.col("hot") | (F.col("docs") >= least_docs)).drop("range", "new"))
    sums = kept.where(F.col("hot") & F.col("head")).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("keeper").alias("last"))
    found = kept.join(F.broadcast(sums), ["h1", "h2"], "left")  # hot hashes only
    found = found.withColumn("docs", F.coalesce("all_docs", "docs")).withColumn("keeper", F.coalesce("last", "keeper"))
    return found.where(F.col("docs") >= least_docs).select("h1", "h2", "id", "version", "pos", "keeper", "docs")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """id, version, n_dropped and keep of each document that loses lines; keep lists (word, bits) of the words of 64 lines that lose some."""
    lines = materialise(line_rows(docs, id_col, text_col, least_chars))
    gone = repeated_lines(lines, least_docs).where(~F.col("id").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = gone.groupBy("id", "version", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    word = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("id", "version").agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.sort_array(F.collect_list(word)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` whose bit is set, joined again."""

    def of_word(lines: Column, word: Column) -> Column:
        some = F.slice(lines, word * WORD + 1, F.lit(WORD))
        bits = F.get(F.filter(keep, lambda w: w["word"] == word), F.lit(0))["bits"]
        return let(F.struct(some.alias("lines"), bits.alias("bits")), lambda s: F.when(s["bits"].isNull(), s["lines"]).otherwise(F.filter(s["lines"], lambda _, n: F.getbit(s["bits"], n) == 1)))

    def filtered(lines: Column) -> Column:
        words = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / WORD).cast("int"))
        return F.array_join(F.flatten(F.transform(words, lambda w: of_word(lines, w))), "\n")

    return F.when(keep.isNull(), text).otherwise(let(F.split(text, "\n"), filtered))


def _met(docs: DataFrame, id_col: str, text_col: str, columns: list[str], **options) -> tuple[DataFrame, str, str]:
    """``columns`` of ``docs``, the text (coalesced) and its bitmap, by a join on id and version."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **options)
    names = {n: fresh(f"__{n}", docs.columns) for n in ("id", "version", "n_dropped", "keep", "own")}
    bitmaps = bitmaps.select(*[F.col(c).alias(names[c]) for c in bitmaps.columns])
    own = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(names["own"], version(F.col(f"`{text_col}`")))
    met = own.join(bitmaps.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"])) & (F.col(names["own"]) == F.col(names["version"])), "left")
    return met, names["keep"], names["n_dropped"]


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, texts without the lines that go; a null text stays null."""
    met, keep, _ = _met(docs, id_col, text_col, docs.columns, **options)
    return met.select(*[kept_text(F.col(f"`{c}`"), F.col(keep)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of ``docs``: id, n_lines, n_dropped, kept_sha256."""
    met, keep, dropped = _met(docs, id_col, text_col, [id_col, text_col], **options)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return met.select(F.col(f"`{id_col}`"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept_text(text, F.col(keep)).cast("binary"), 256).alias("kept_sha256"))
