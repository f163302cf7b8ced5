"""Outputs: CSV and JSON reports, one element, and the snapshot of a library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings


def coverage_csv(profiles: DataFrame, path: str) -> None:
    profiles.select("element_id", "tests", "docs", "examples", "missing").orderBy("element_id").write.mode("overwrite").option("header", "true").csv(path)


def profile_json(profiles: DataFrame) -> DataFrame:
    return profiles.select("element_id", F.to_json(F.struct(*profiles.columns)).alias("json"))


def findings_csv(found: DataFrame, path: str, min_severity: str = "INFO") -> None:
    findings.selected(found, (), min_severity).write.mode("overwrite").option("header", "true").csv(path)


def one(profiles: DataFrame, element_id: str) -> DataFrame:
    return profiles.where(F.col("element_id") == element_id)


def library_snapshot(elements: DataFrame, profiles: DataFrame, found: DataFrame, library: str) -> dict[str, DataFrame]:
    own = elements.where(F.col("library") == library)
    begins = F.col("subject") == library
    for mark in ("=", "/", ".", " "):
        begins = begins | F.col("subject").startswith(library + mark)
    return {"elements": own, "profiles": profiles.where(F.col("library") == library), "findings": found.where(begins)}


def delta_json(delta: DataFrame) -> DataFrame:
    """(change, element_id, json): one row for each changed element, so that no cell holds a whole kind."""
    return delta.select("change", "element_id", F.to_json(F.struct("element_id", "base_tests", "head_tests", "base_docs", "head_docs")).alias("json"))


#: Parts of a snapshot and the columns that are read back from it.
SNAPSHOT = {
    "elements": "id string, kind string, library string, path string, line int",
    "profiles": "element_id string, kind string, library string, tests bigint, examples bigint, docs_all bigint, docs bigint, docs_rendered bigint, docs_core bigint, best_substance int, missing string",
    "findings": "id string, kind string, subject string, severity string, analyzer string",
}
SCHEMA_VERSION = 1


def write_snapshot(parts: dict[str, DataFrame], folder: str) -> None:
    """Elements, profiles and findings as JSON lines, each row with the schema's version."""
    for name, df in parts.items():
        df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").json(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts of a snapshot by their fixed schemas; rows of another version or unreadable lines are an error when they are read."""
    out = {}
    for name, schema in SNAPSHOT.items():
        rows = spark.read.schema(f"{schema}, schema_version int").option("mode", "FAILFAST").json(f"{folder}/{name}")
        wrong = F.raise_error(F.concat(F.lit(f"{name}: snapshot version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing"))))
        first = rows.columns[0]
        checked = F.when(F.col("schema_version") == SCHEMA_VERSION, F.col(first)).otherwise(wrong.cast("string"))
        out[name] = rows.withColumn(first, checked).drop("schema_version")
    return out


def united(snapshots: Sequence[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Snapshots of several libraries as one: all rows of each part."""
    out = dict(snapshots[0])
    for s in snapshots[1:]:
        out = {name: df.unionByName(s[name], allowMissingColumns=True) for name, df in out.items()}
    return out
