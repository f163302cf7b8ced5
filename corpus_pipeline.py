"""A corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Defined cases of the stages: a null or empty text fails the quality rules; later stages keep such a row, which is
like no other, and packing gives it one piece with the end id. Rows of equal id and equal text are one document to
the near-duplicate stage; equal ids with other texts are documents of their own everywhere. A null id is never a
near-duplicate. Very long texts are read whole. Empty tables give empty tables, and columns of any name are kept
up to packing, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coverloom.llm import _digests, decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from coverloom.llm._spark import load, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out; documents left without a word go."""
    return suffix_dedup.cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048."""
    return packing.pack(docs, of_pieces=_digests.with_ids_crc32)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
