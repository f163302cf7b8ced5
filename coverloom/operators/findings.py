"""Findings: rules over profiles, path suppression, order, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.globs import matches_any

KIND_RANK = {"DOCUMENTED_UNTESTED": 1, "TESTED_UNDOCUMENTED": 2, "MISSING_IN_CATEGORY": 3, "THIN_REFERENCE": 4, "EXTERNAL_MENTION_ONLY": 5, "COVERAGE_DELTA": 6, "STALE_DOC": 7}
SEVERITY_RANK = {"INFO": 1, "WARNING": 2, "ERROR": 3}
MENTION_KINDS = ("METHOD", "FLAG", "SUBCOMMAND")


def ranked(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(column == name, F.lit(rank)).otherwise(out)
    return out.cast("int")


def finding(rows: DataFrame, analyzer: str, kind: str, severity: str = "WARNING", detail: str | None = None) -> DataFrame:
    """Findings on element_id; `detail` is a column that tells several findings of one element apart."""
    subject = F.col("element_id")
    key = F.concat_ws(":", F.lit(analyzer), F.lit(kind), subject, *((F.col(detail),) if detail else ()))
    return rows.select(key.alias("id"), F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(severity).alias("severity"), F.lit(analyzer).alias("analyzer"))


def documented_untested(profiles: DataFrame, kinds: Sequence[str] = ("METHOD",)) -> DataFrame:
    return finding(profiles.where(F.col("kind").isin(*kinds) & F.col("has_substantive_doc") & (F.col("tests") == 0)), "documented-untested", "DOCUMENTED_UNTESTED")


def tested_undocumented(profiles: DataFrame, kinds: Sequence[str] = MENTION_KINDS) -> DataFrame:
    return finding(profiles.where(F.col("kind").isin(*kinds) & (F.col("tests") > 0) & ~F.col("has_any_doc")), "tested-undocumented", "TESTED_UNDOCUMENTED")


def missing_in_category(profiles: DataFrame, evidence: DataFrame, places: Sequence[tuple[str, str]]) -> DataFrame:
    """Elements without evidence in each (surface, bucket) to alert for."""
    wanted = profiles.select("element_id", F.explode(F.array(*(F.struct(F.lit(s).alias("surface"), F.lit(b).alias("bucket")) for s, b in places))).alias("w")).select("element_id", "w.surface", "w.bucket")
    gone = wanted.join(evidence.select("element_id", "surface", "bucket"), ["element_id", "surface", "bucket"], "left_anti")
    return finding(gone.withColumn("place", F.concat_ws(".", "surface", "bucket")), "missing-in-category", "MISSING_IN_CATEGORY", detail="place")


def thin_reference(evidence: DataFrame) -> DataFrame:
    """Elements whose first reference below PARTIAL is signature only or less: fidldoc, clidoc, dockerdoc, then by name."""
    refs = evidence.where(F.col("bucket").startswith("reference.") & (F.col("rank") > 0) & (F.col("rank") <= 2))
    adapter = F.substring_index("bucket", ".", -1)
    order = F.when(adapter == "fidldoc", 0).when(adapter == "clidoc", 1).when(adapter == "dockerdoc", 2).otherwise(3)
    first = refs.groupBy("element_id").agg(F.min(F.struct(order.alias("o"), adapter.alias("adapter"), "path", "line")).alias("first"))
    return finding(first, "thin-reference", "THIN_REFERENCE")


def external_mention_only(profiles: DataFrame, evidence: DataFrame, kinds: Sequence[str] = MENTION_KINDS) -> DataFrame:
    weak = evidence.where((F.col("surface") == "docs") & F.col("bucket").isin("concept", "tutorial") & (F.col("rank") < 3)).select("element_id").distinct()
    rows = profiles.where(F.col("kind").isin(*kinds) & ~F.col("has_substantive_doc")).join(weak, "element_id", "left_semi")
    return finding(rows, "external-mention-only", "EXTERNAL_MENTION_ONLY")


def stale_doc(elements: DataFrame, evidence: DataFrame, times: DataFrame, max_lag_days: int = 90) -> DataFrame:
    """Elements whose first reference lies in another file, last changed max_lag_days or more before the element's."""
    refs = evidence.where(F.col("bucket").startswith("reference."))
    first = refs.groupBy("element_id").agg(F.min(F.struct("bucket", "path", "line")).alias("first")).select("element_id", F.col("first.path").alias("doc_path"))
    rows = elements.select(F.col("id").alias("element_id"), F.col("path").alias("code_path")).join(first, "element_id").where("doc_path <> code_path")
    rows = rows.join(times.select(F.col("path").alias("doc_path"), F.col("ts").alias("doc_ts")), "doc_path").join(times.select(F.col("path").alias("code_path"), F.col("ts").alias("code_ts")), "code_path")
    days = F.expr("(code_ts - doc_ts) div 86400")
    return finding(rows.where(days >= max_lag_days), "stale-doc", "STALE_DOC")


@dataclass
class Corpus:
    """What analyzers read: elements (id, path), profiles, evidence rows, and when files last changed (path, ts)."""

    elements: DataFrame
    profiles: DataFrame
    evidence: DataFrame
    times: DataFrame | None = None


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "documented-untested": lambda c, **o: documented_untested(c.profiles, **o),
    "tested-undocumented": lambda c, **o: tested_undocumented(c.profiles, **o),
    "missing-in-category": lambda c, **o: missing_in_category(c.profiles, c.evidence, **o),
    "thin-reference": lambda c, **o: thin_reference(c.evidence, **o),
    "external-mention-only": lambda c, **o: external_mention_only(c.profiles, c.evidence, **o),
    "stale-doc": lambda c, **o: stale_doc(c.elements, c.evidence, c.times, **o),
}


def found(corpus: Corpus, config: dict[str, dict]) -> list[DataFrame]:
    """The findings of each named analyzer; their options may hold a severity, which is WARNING else."""
    if unknown := sorted(set(config) - set(REGISTRY)):
        raise ValueError(f"unknown analyzers: {', '.join(unknown)}")
    parts = []
    for name, options in config.items():
        own = REGISTRY[name](corpus, **{k: v for k, v in options.items() if k != "severity"})
        parts.append(own.withColumn("severity", F.lit(options.get("severity", "WARNING"))))
    return parts


def analyze(corpus: Corpus, config: dict[str, dict], suppress: Sequence[str] = ()) -> DataFrame:
    """All findings of the named analyzers, without elements in suppressed paths, in report order."""
    paths = corpus.elements.select(F.col("id").alias("element_id"), "path")
    return run_all(found(corpus, config), paths, suppress)


def run_all(parts: Sequence[DataFrame], paths: DataFrame | None = None, suppress: Sequence[str] = ()) -> DataFrame:
    """All findings, without subjects in suppressed paths, in report order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if paths is not None and suppress:
        hidden = paths.where(matches_any(F.col("path"), suppress)).select(F.col("element_id").alias("subject"))
        out = out.join(hidden, "subject", "left_anti").select(*parts[0].columns)
    return ordered(out)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("subject", ranked(F.col("kind"), KIND_RANK), ranked(F.col("severity"), SEVERITY_RANK).desc(), "id")


def selected(findings: DataFrame, kinds: Sequence[str] = (), min_severity: str = "INFO", max_items: int | None = None) -> DataFrame:
    out = findings.where(ranked(F.col("severity"), SEVERITY_RANK) >= SEVERITY_RANK[min_severity])
    out = out.where(F.col("kind").isin(*kinds)) if kinds else out
    return ordered(out).limit(max_items) if max_items else ordered(out)


def by_library(findings: DataFrame, libraries: DataFrame) -> DataFrame:
    """Findings with the longest library that begins their subject and ends at = / . or a space."""
    cuts = F.filter(F.sequence(F.lit(1), F.length("subject")), lambda i: F.substring(F.col("subject"), i, F.lit(1)).isin("=", "/", ".", " "))
    keys = F.concat(F.transform(cuts, lambda i: F.substring(F.col("subject"), F.lit(1), i - 1)), F.array("subject"))
    met = findings.withColumn("library", F.explode(F.array_distinct(keys))).join(libraries.select("library").distinct(), "library")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.length("library").desc()))
    return met.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
