"""Evidence panels: for each element and surface, the first places with the lines that stand there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_SURFACE = 3
#: Lines of an excerpt by the file's extension; 12 for others. Fixed values.
LINES = {".proto": 12, ".fidl": 12, ".rs": 16, ".go": 16, ".py": 16, ".ts": 16, ".js": 16}


def excerpt_lines(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    out = F.lit(12)
    for ext, n in LINES.items():
        out = F.when(extension == ext, n).otherwise(out)
    return out


def cards(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(element_id, surface, place, path, line, excerpt, extra): the first PER_SURFACE places, with the number of further ones.

    rows has (element_id, surface, path, line), files (path, text). Places of unknown files have no excerpt.
    """
    at = W.partitionBy("element_id", "surface").orderBy("path", "line")
    distinct = rows.select("element_id", "surface", "path", "line").distinct()
    first = distinct.withColumn("place", F.row_number().over(at)).where(F.col("place") <= PER_SURFACE)
    further = distinct.groupBy("element_id", "surface").agg((F.count(F.lit(1)) - PER_SURFACE).alias("extra"))
    shown = first.join(files.select("path", F.split("text", "\n").alias("lines")), "path", "left")
    start = F.greatest(F.col("line"), F.lit(1))
    excerpt = F.when(F.col("lines").isNotNull(), F.array_join(F.slice("lines", start, excerpt_lines(F.col("path"))), "\n"))
    shown = shown.select("element_id", "surface", "place", "path", "line", F.rtrim(excerpt).alias("excerpt"))
    return shown.join(further.withColumn("extra", F.greatest("extra", F.lit(0))), ["element_id", "surface"])


def panels(elements: DataFrame, shown: DataFrame, surfaces: tuple[str, ...] = ("docs", "workflows", "tests", "examples")) -> DataFrame:
    """(element_id, present, absent, inline): surfaces with cards; docs that all stand at the contract's own line are inline."""
    own = elements.select(F.col("id").alias("element_id"), F.col("path").alias("own_path"), F.col("line").alias("own_line"))
    same = (F.col("path") == F.col("own_path")) & (F.col("line") == F.col("own_line"))
    found = own.join(shown, "element_id", "left").groupBy("element_id").agg(
        F.array_sort(F.collect_set("surface")).alias("present"),
        F.coalesce(F.bool_and(F.when(F.col("surface") == "docs", F.coalesce(same, F.lit(False)))), F.lit(False)).alias("inline"),
    )
    return found.select("element_id", "present", F.array_except(F.array(*(F.lit(s) for s in surfaces)), "present").alias("absent"), "inline")
