"""Differences of two corpora, and routing to owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(element_id, change, tests, docs, ...) of elements that came, went or changed their counts."""
    b = base.select(F.col("element_id").alias("b_id"), F.col("tests").alias("base_tests"), F.col("docs").alias("base_docs"))
    h = head.select(F.col("element_id").alias("h_id"), F.col("tests").alias("head_tests"), F.col("docs").alias("head_docs"))
    full = b.join(h, F.col("b_id") == F.col("h_id"), "full_outer")
    change = F.when(F.col("b_id").isNull(), "added").when(F.col("h_id").isNull(), "removed").when((F.col("base_tests") != F.col("head_tests")) | (F.col("base_docs") != F.col("head_docs")), "changed")
    return full.select(F.coalesce("h_id", "b_id").alias("element_id"), change.alias("change"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("base_tests", "head_tests", "base_docs", "head_docs"))).where("change is not null")


def removed(base: DataFrame, head: DataFrame) -> DataFrame:
    return base.select("element_id").join(head.select("element_id"), "element_id", "left_anti")


def affected_findings(findings: DataFrame, delta: DataFrame) -> DataFrame:
    return findings.join(delta.select(F.col("element_id").alias("subject")), "subject", "left_semi")


def routed(affected: DataFrame, ownership: DataFrame) -> DataFrame:
    """Owners and subscribers by category; an owner with a scope sees that library only."""
    at = (affected["category"] == ownership["category"]) & (ownership["scope"].isNull() | (ownership["scope"] == "") | (ownership["scope"] == affected["library"]))
    met = affected.join(ownership, at).select(affected["category"], "owner", "subscribe")
    return met.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set(F.when(~F.col("subscribe"), F.col("owner")))), ",").alias("owners"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("subscribe"), F.col("owner")))), ",").alias("subscribers"))


def summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("head_tests") - F.col("base_tests")).alias("tests_gained"), F.sum(F.col("head_docs") - F.col("base_docs")).alias("docs_gained"))
