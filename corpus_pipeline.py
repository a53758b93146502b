"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage gets what its predecessor kept, read from Parquet, and returns the rows
that stay, with the columns of documents; the last returns packed pieces. SQL can't
express the classifier and the tokenizer, so ORACLE_SQL is None and the stages are
tested against plain code.

Defined cases: a null text is empty; a row without id goes where a row with one has an
equal text, and else passes the stages that compare documents; rows that repeat an id are judged each, but the parity join keeps all rows of
an id or none; columns of any other name pass through all stages but the last; an
empty table gives an empty result of each stage's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalframe.llm import decontamination, exact_dedup, packing, parity_join, quality
from signalframe.llm.common import materialise, read, return_heap, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepare(spark: SparkSession) -> None:
    """What each stage begins with: the package for the workers, and executors without the heap that the stages before have touched."""
    ship_package(spark)
    return_heap(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal classifier doesn't think good; ratings come from ``labels``."""
    prepare(spark)
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    prepare(spark)
    return exact_dedup.keep_rows(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal texts (five-word shingles, Jaccard 0.8) the one with the smallest id stays."""
    prepare(spark)
    return parity_join.representatives(docs, k=5, threshold=(80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which the benchmark's windows hit one word in twenty at least."""
    prepare(spark)
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, thrifty=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
