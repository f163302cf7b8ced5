"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop_table, table


def connected_components(links: DataFrame) -> DataFrame:
    """(u, root) for every node of links (a, b) that isn't itself its component's smallest node.

    Every round is a table in the shared folder. Rounds grow with the logarithm of a path's length.
    """
    edges = table(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select(F.col("u").alias("k"), "m")
        rest = large.join(own, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_edges = table(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = after_edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after_edges
        if after == before:
            out = edges.select("u", F.col("v").alias("root"))
            out._coverloom_path = edges._coverloom_path
            return out
        before = after
