"""Checks of a corpus against itself, against samples, and against given counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.globs import CONTAMINATED

#: Percent at or below which a share is suspicious.
DENOMINATOR_SHARE = 15


def smearing(refs: DataFrame, min_refs: int = 8, max_files: int = 2) -> DataFrame:
    """Elements whose many references come from very few files."""
    return refs.groupBy("element_id").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("path").alias("files")).where((F.col("refs") >= min_refs) & (F.col("files") <= max_files))


def contamination(refs: DataFrame) -> DataFrame:
    """References by directory where the path runs through vendored or generated directories."""
    return refs.where(F.col("path").rlike(CONTAMINATED)).groupBy(F.regexp_extract("path", CONTAMINATED, 2).alias("segment")).agg(F.count(F.lit(1)).alias("refs"))


def name_collisions(elements: DataFrame) -> DataFrame:
    return elements.groupBy(F.lower("id").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def denominator_effect(rows: DataFrame, share: int = DENOMINATOR_SHARE) -> DataFrame:
    """By surface, in whole percent: whether the pooled share is low only because the modifier tier dilutes the primary one.

    rows has (surface, tier, covered); surfaces without rows of both tiers show no effect.
    """
    of = lambda tier: F.col("tier") == tier
    got = lambda where, name: T.percent(F.count_if(F.col("covered") & where), F.count_if(where)).alias(name)
    own = rows.groupBy("surface").agg(
        got(F.lit(True), "pooled"), got(of("primary"), "primary"), got(of("modifier"), "modifier"),
        (F.bool_or(of("primary")) & F.bool_or(of("modifier"))).alias("both"),
    )
    low = (F.col("pooled") <= share) & (F.col("primary") >= 2 * share) & (F.col("primary") - F.col("pooled") >= share)
    return own.withColumn("effect", F.col("both") & low).drop("both")


def metrics(rows: DataFrame, reported: DataFrame, share: int = DENOMINATOR_SHARE) -> DataFrame:
    """Each reported percentage against its own numerator and denominator, within one percent.

    rows has (tier, surface, covered), reported (tier, surface, percent). A figure that isn't reproduced is an
    error; one of exactly 0 or of `share` and less is a warning.
    """
    counted = rows.groupBy("tier", "surface").agg(F.count_if("covered").alias("numerator"), F.count(F.lit(1)).alias("denominator"))
    out = counted.join(reported, ["tier", "surface"]).withColumn("expected", T.percent(F.col("numerator"), F.col("denominator")))
    off = F.abs(F.col("expected") - F.col("percent")) > 1
    finding = F.when(off, "reconcile").when(F.col("percent") == 0, "zero_surface").when(F.col("percent") <= share, "low_coverage")
    severity = F.when(off, "ERROR").when(F.col("percent") <= share, "WARNING")
    return out.select("tier", "surface", "numerator", "denominator", "percent", "expected", (~off).alias("reproduced"), finding.alias("finding"), severity.alias("severity"))


def ground_truth(counted: Column, expected: Column) -> Column:
    """clean within 1 or 1 %, error beyond 5 and 10 %, warning between."""
    off, n = F.abs(counted - expected), expected
    return F.when(off <= F.greatest(F.lit(1), F.floor(n / 100)), "clean").when(off > F.greatest(F.lit(5), F.floor(n / 10)), "error").otherwise("warning")


def recount(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """Surfaces whose recount differs from the report. rows: (element_id, surface); reported: (surface, n)."""
    own = rows.groupBy("surface").agg(F.count_distinct("element_id").alias("counted"))
    return own.join(reported, "surface", "full_outer").select("surface", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("n", F.lit(0)).alias("reported")).where("counted <> reported")


def precision(rows: DataFrame, by: str) -> DataFrame:
    """Verdicts by group with tp / (tp + fp), null where none is decided. rows has verdict TP, FP or null."""
    tp, fp = F.count_if(F.col("verdict") == "TP"), F.count_if(F.col("verdict") == "FP")
    return rows.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), F.count_if(F.col("verdict").isNull()).alias("unverified"), F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("precision"))


def verdict(checks: DataFrame) -> DataFrame:
    errors, warnings = F.count_if(F.col("severity") == "ERROR"), F.count_if(F.col("severity") == "WARNING")
    return checks.agg(F.when(errors > 0, "broken").when(warnings > 0, "review").otherwise("trustworthy").alias("verdict"), errors.alias("errors"), warnings.alias("warnings"))


def capped_sample(rows: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each group in a given order: a sampling operator."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def missed_tests(terms: DataFrame, lines: DataFrame, attributed: DataFrame, per_element: int = 5) -> DataFrame:
    """Files whose lines hold an element's distinctive term and that aren't attributed to it; per_element at most.

    terms has (element_id, term), lines (path, line, text); a line's identifiers are joined with the terms.
    """
    words = lines.where(~F.col("path").rlike(CONTAMINATED) & F.lower("path").rlike("test")).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term"))
    hits = words.join(terms, "term").groupBy("element_id", "path").agg(F.min("line").alias("line"))
    return capped_sample(hits.join(attributed.select("element_id", "path"), ["element_id", "path"], "left_anti"), "element_id", per_element, "path")
