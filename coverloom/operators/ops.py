"""Questions on a corpus, each a DataFrame: contracts, gaps, examples, libraries, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import findings as _findings
from . import search

#: Profile columns of a part of the coverage tree.
SUBTREES = {"tests": ("tests",), "docs": ("docs_all", "docs", "docs_rendered", "docs_core", "best_substance"), "examples": ("examples",), "gaps": ("missing",)}


def query_contract(elements: DataFrame, profiles: DataFrame, ids: DataFrame, subtree: str | None = None) -> DataFrame:
    """The elements of `ids` (element_id) with their profiles, or one part of them; ids that don't exist give no row."""
    columns = SUBTREES.get(subtree or "", tuple(c for c in profiles.columns if c not in ("element_id", "kind", "library")))
    own = elements.select(F.col("id").alias("element_id"), "kind", "library")
    return own.join(ids.select("element_id").distinct(), "element_id", "left_semi").join(profiles.select("element_id", *columns), "element_id", "left")


def find_coverage_gaps(found: DataFrame, library: str = "", kinds: Sequence[str] = (), max_items: int | None = None) -> DataFrame:
    """Findings on what lies below a library, of some kinds, in report order."""
    own = found.where(F.col("subject").startswith(f"{library}/") | F.col("subject").startswith(f"{library}.")) if library else found
    return _findings.selected(own, [k.upper() for k in kinds], max_items=max_items)


def find_examples(elements: DataFrame, query: str, max_items: int = 10) -> DataFrame:
    """The elements whose ids share most tokens with the query."""
    return search.by_tokens(elements, query, "id", "id", max_items)


def list_libraries(elements: DataFrame, profiles: DataFrame, found: DataFrame) -> DataFrame:
    """(library, elements, profiles, findings); elements without a library are `(unspecified)`."""
    name = F.when((F.col("library") == "") | F.col("library").isNull(), "(unspecified)").otherwise(F.col("library"))
    known = profiles.select(F.col("element_id").alias("id"), F.lit(1).alias("known")).distinct()
    own = elements.join(known, "id", "left").groupBy(name.alias("library")).agg(F.count(F.lit(1)).alias("elements"), F.count("known").alias("profiles"))
    counted = _findings.by_library(found, elements.select("library")).groupBy("library").agg(F.count(F.lit(1)).alias("findings"))
    return own.join(counted, "library", "left").fillna(0, ["findings"])


def corpus_statistics(**relations: DataFrame) -> DataFrame:
    """(relation, tier, n): rows of each relation, by tier where it has one."""
    parts = []
    for name, df in relations.items():
        tier = F.coalesce("tier", F.lit("UNSPECIFIED")) if "tier" in df.columns else F.lit("DETERMINISTIC")
        parts.append(df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "tier", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CLAIM_ORDER = ("line", "column", "kind", "adapter", "refs", "raw_text")


def claim_places(claims: DataFrame) -> DataFrame:
    """claims with their place in their file: by line, column, kind, adapter, references and text."""
    return claims.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy(*CLAIM_ORDER)))
