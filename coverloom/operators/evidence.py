"""The long evidence table (element_id, surface, bucket, ...), its buckets, counts and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any

SECTION_EXCLUDED = "_section_excluded"
TEST_BUCKETS = ("unit", "integration", "e2e", "ctf", "performance", "fuzz", "golden")
DOC_PREFIXES = {
    "docs.tutorial": "tutorial",
    "docs.concept": "concept",
    "docs.guide.migration": "guide.migration",
    "docs.guide.troubleshooting": "guide.troubleshooting",
    "docs.guide.cookbook": "guide.cookbook",
    "docs.proposal.rfc": "proposal.rfc",
    "docs.proposal.design": "proposal.design",
    "docs.release_notes": "release_notes",
    "docs.faq": "faq",
}
GAP_DOC_BUCKETS = ("concept", "tutorial", "guide.migration", "guide.troubleshooting", "guide.cookbook")
ALL_DOC_BUCKETS = (*GAP_DOC_BUCKETS, "release_notes", "faq", "proposal.rfc", "proposal.design")


def categories(path: Column, sections: Column, rules: Sequence[dict]) -> Column:
    """Sorted categories of a path; the sentinel alone where only section filters ruled some out.

    A rule has dotted_path, paths, and optionally exclude_paths, section_excludes and section_includes.
    Section texts compare without case, as substrings; claims without sections pass.
    """
    hits, blocked = [], []
    for rule in rules:
        at = matches_any(path, rule["paths"]) & ~matches_any(path, rule.get("exclude_paths", ()))
        said = lambda words: F.exists(sections, lambda s: F.lower(s).rlike("|".join("\\Q" + w.lower() + "\\E" for w in words)))
        ok = F.lit(True)
        if rule.get("section_excludes"):
            ok = ok & ~said(rule["section_excludes"])
        if rule.get("section_includes"):
            ok = ok & said(rule["section_includes"])
        ok = (F.size(sections) <= 0) | ok
        hits.append(F.when(at & ok, F.lit(rule["dotted_path"])))
        blocked.append(at & ~ok)
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    excluded = F.lit(False)
    for b in blocked:
        excluded = excluded | b
    return F.when((F.size(found) == 0) & excluded, F.array(F.lit(SECTION_EXCLUDED))).otherwise(found)


def doc_bucket(kind: Column, adapter: Column, category: Column, tier: Column) -> Column:
    """surface/bucket of a documentation claim; null where it enters no profile."""
    prose = F.lit("docs/concept")
    for prefix, bucket in reversed(DOC_PREFIXES.items()):
        prose = F.when(category.startswith(prefix), F.lit(f"docs/{bucket}")).otherwise(prose)
    return (
        F.when(kind == "REFERENCE", F.concat(F.lit("docs/reference."), F.when(adapter == "fidl", F.lit("fidldoc")).otherwise(adapter)))
        .when((kind.isin("EXAMPLE", "WORKFLOW")) & (tier == "LLM"), F.lit(None).cast("string"))
        .when(kind == "EXAMPLE", F.lit("examples/in_docs"))
        .when(kind == "WORKFLOW", F.lit("docs/reference.workflows"))
        .when(category == SECTION_EXCLUDED, F.lit(None).cast("string"))
        .otherwise(prose)
    )


def test_bucket(category: Column, tier: Column) -> Column:
    """surface/bucket of a test: by category, unit otherwise; proposed ones stand apart."""
    out = F.lit("tests/unit")
    for bucket in TEST_BUCKETS:
        out = F.when(category.startswith(f"tests.{bucket}"), F.lit(f"tests/{bucket}")).otherwise(out)
    return F.when(tier == "LLM", F.lit("tests/llm_inferred")).otherwise(out)


def evidence(doc_rows: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Both inputs have (element_id, place, path, line, rank); place is surface/bucket."""
    rows = doc_rows.unionByName(test_rows).where(F.col("place").isNotNull())
    return rows.withColumn("surface", F.substring_index("place", "/", 1)).withColumn("bucket", F.substring_index("place", "/", -1)).drop("place")


def _in(surface: str, buckets: Sequence[str] = (), reference: Sequence[str] | None = ()) -> Column:
    """Rows of a surface in some buckets; reference: adapters that count, None for all."""
    at = F.col("bucket").isin(*buckets) if buckets else F.lit(False)
    if reference is None:
        at = at | F.col("bucket").startswith("reference.")
    elif reference:
        at = at | F.col("bucket").isin(*(f"reference.{a}" for a in reference))
    return (F.col("surface") == surface) & at




def counts() -> dict[str, Column]:
    """The count variants; each has its own set of buckets."""
    test, example = _in("tests", TEST_BUCKETS), F.col("surface") == "examples"
    return {
        "tests": F.count_if(test),
        "examples": F.count_if(example),
        "docs_all": F.count_if(_in("docs", ALL_DOC_BUCKETS, None)),
        "docs": F.count_if(_in("docs", (*GAP_DOC_BUCKETS, "release_notes", "faq"), None)),
        "docs_rendered": F.count_if(_in("docs", (*GAP_DOC_BUCKETS, "release_notes", "faq"), ("fidldoc", "clidoc"))),
        "docs_core": F.count_if(_in("docs", ("concept", "tutorial"), None)),
        "has_gap_doc": F.coalesce(F.bool_or(_in("docs", GAP_DOC_BUCKETS, None)), F.lit(False)),
        "has_any_doc": F.coalesce(F.bool_or(_in("docs", ALL_DOC_BUCKETS, None)), F.lit(False)),
        "has_substantive_doc": F.coalesce(F.bool_or(_in("docs", ("tutorial", "concept"), ("fidldoc", "clidoc")) & (F.col("rank") >= 3)), F.lit(False)),
        "thin_reference": F.coalesce(F.bool_or(_in("docs", (), None) & (F.col("rank") == 2)), F.lit(False)),
        "best_substance": F.coalesce(F.max(F.when(F.col("surface") == "docs", F.when(F.col("rank") == 0, 2).otherwise(F.col("rank")))), F.lit(0)).cast("int"),
    }


def profiles(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each element with its counts, flags and missing surfaces."""
    own = rows.groupBy("element_id").agg(*(c.alias(n) for n, c in counts().items()))
    out = elements.select(F.col("id").alias("element_id"), "kind", "library").join(own, "element_id", "left")
    out = out.fillna(0).fillna(False)
    missing = F.array_compact(F.array(F.when(~F.col("has_gap_doc"), F.lit("docs.reference")), F.when(F.col("examples") == 0, F.lit("examples")), F.when(F.col("tests") == 0, F.lit("tests"))))
    return out.withColumn("missing", F.array_join(missing, "|"))


def csv_rows(profile: DataFrame) -> DataFrame:
    """The coverage report: one row an element, by id."""
    return profile.select("element_id", "tests", "docs", "examples", "missing").orderBy("element_id")
