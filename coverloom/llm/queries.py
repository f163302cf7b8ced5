"""The queries opN_<name> over the documents table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _digests, decontaminate, license_scan, lm_scoring, near_dedup, oracles, packing, quality_rules, sharding, suffix_dedup, token_counts, token_files
from ._spark import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_passages(load(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start", "end", (spans["end"] - spans["start"]).alias("n_words"), "later")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_metrics(load(spark, sf_dir, "documents"))


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 16)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), of_pieces=_digests.with_ids_crc32)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.token_file_path(spark)
    token_files.write_token_files(load(spark, sf_dir, "documents"), path)
    return _digests.with_ids_crc32(token_files.read_token_files(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("version")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": oracles.LICENSE_SCAN,
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op3_near_dedup": oracles.NEAR_DEDUP,
    "op4_quality_rules": oracles.QUALITY_RULES,
    "op9_decontamination": oracles.DECONTAMINATION,
}
