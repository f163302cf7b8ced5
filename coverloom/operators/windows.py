"""Ordered logic: heading stacks, first uses, densities, enclosing rows, source order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def heading_stack(rows: DataFrame, doc: str, offset: str) -> DataFrame:
    """rows with `section`, the packed stack of headings H1 to H3 at each row; deeper ones fill the third slot.

    rows has level (null for other rows) and title. A shallower heading clears the deeper ones.
    """
    upto = W.partitionBy(doc).orderBy(offset).rowsBetween(W.unboundedPreceding, 0)
    slot = F.when(F.col("level").isNotNull(), F.least(F.col("level"), F.lit(3)))
    out = rows
    for k in (1, 2, 3):
        out = out.withColumn(f"_t{k}", F.last(F.when(slot == k, F.col("title")), ignorenulls=True).over(upto)).withColumn(f"_o{k}", F.last(F.when(slot == k, F.col(offset)), ignorenulls=True).over(upto))
    live2 = F.col("_o2") > F.coalesce("_o1", F.lit(-1))
    live3 = F.col("_o3") > F.greatest(F.coalesce("_o1", F.lit(-1)), F.coalesce("_o2", F.lit(-1)))
    section = F.array_compact(F.array("_t1", F.when(live2, F.col("_t2")), F.when(live3, F.col("_t3"))))
    return out.withColumn("section", section).select(*rows.columns, "section")


def first_uses(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("doc", "element_id").agg(F.min("offset").alias("offset"))


def density(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("density", F.count(F.lit(1)).over(W.partitionBy("doc", "section")))


def enclosing(cited: DataFrame, tests: DataFrame) -> DataFrame:
    """(citation, test_id): the last test of the file that begins at or before the cited line."""
    t = tests.select("path", F.col("line").alias("at"), F.lit(None).cast("string").alias("citation"), "test_id", F.lit(0).alias("kind"))
    c = cited.select("path", F.col("line").alias("at"), "citation", F.lit(None).cast("string").alias("test_id"), F.lit(1).alias("kind"))
    upto = W.partitionBy("path").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    return t.unionByName(c).withColumn("test_id", F.last("test_id", ignorenulls=True).over(upto)).where("kind = 1 and test_id is not null").select("citation", "test_id")


def rail_ranks(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.lower(name), name)))
