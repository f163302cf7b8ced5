"""Union of sources with tier precedence, and gates for proposed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tier_rank(tier: Column) -> Column:
    """Deterministic rows come before proposed ones."""
    return F.when(tier == "LLM", 1).otherwise(0)


def union_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row a key: the deterministic one, then the first in the given total order. Rows without a key go."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(tier_rank(F.col("tier")), *order))
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def without_redundant(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed (owner, element_id) edges that no deterministic edge repeats."""
    return proposed.join(known.select("owner", "element_id"), ["owner", "element_id"], "left_anti")


def citation_gate(cited: DataFrame, lines: DataFrame, slack: int = 1) -> DataFrame:
    """(citation, line, distance, by_alias): the nearest line, at most `slack` away, that holds the cited name as a whole token.

    cited has (citation, path, cited_line, name) and may have aliases; lines has (path, line, text). At equal
    distance the earlier line wins, and on a line the name comes before its aliases, in their order.
    """
    near = F.array(*(F.col("cited_line") + d for d in range(-slack, slack + 1)))
    names = F.array("name")
    if "aliases" in cited.columns:
        names = F.concat(names, F.coalesce("aliases", F.array().cast("array<string>")))
    asked = cited.withColumn("names", F.filter(names, lambda n: n.isNotNull() & (n != ""))).withColumn("at", F.explode(near))
    met = asked.join(lines.select(F.col("path").alias("p"), "line", "text"), (F.col("path") == F.col("p")) & (F.col("at") == F.col("line")))
    held = F.transform("names", lambda n: F.regexp_like("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), n, F.lit(r"\E(?![A-Za-z0-9_])"))))
    found = met.withColumn("which", F.array_position(held, True)).where("which > 0").withColumn("distance", F.abs(F.col("line") - F.col("cited_line")))
    by_alias = F.col("name").isNull() | (F.element_at("names", F.col("which").cast("int")) != F.col("name"))
    rank = F.row_number().over(W.partitionBy("citation").orderBy("distance", "line"))
    return found.withColumn("_rank", rank).where("_rank = 1").select("citation", "line", "distance", by_alias.alias("by_alias"))


def surviving_workflows(steps: DataFrame, least: int = 2) -> DataFrame:
    """(workflow, refs): proposed workflows of which at least `least` different elements passed the gate, in the order of their steps.

    steps has (workflow, position, element_id). A single element belongs to itself and is no workflow.
    """
    first = steps.groupBy("workflow", "element_id").agg(F.min("position").alias("position"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("position", "element_id"))), lambda r: r["element_id"])
    return first.groupBy("workflow").agg(refs.alias("refs")).where(F.size("refs") >= least)
