"""Ecosystem views: which kinds are containers, primary details or modifiers. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: view -> kind -> (tier, whether the tier shows in the header)
VIEWS: dict[str, dict[str, tuple[str, bool]]] = {
    "cli": {"SUBCOMMAND": ("primary", True), "FLAG": ("modifier", True), "SWITCH": ("modifier", True), "POSITIONAL": ("modifier", True)},
    "cpp": {"CPP_CLASS": ("container", True), "METHOD": ("primary", True), "CPP_FREE_FUNCTION": ("primary", True), "CPP_MACRO": ("modifier", True), "TYPE": ("other", False)},
    "crd": {"TYPE": ("container", True), "CONFIG_KNOB": ("primary", True)},
    "fidl": {"PROTOCOL": ("container", True), "METHOD": ("primary", True), "TYPE": ("other", False)},
    "helm": {"CONFIG_KNOB": ("primary", True)},
    "manifest": {"TYPE": ("container", True), "CONFIG_KNOB": ("primary", True)},
    "openapi": {"PROTOCOL": ("container", True), "METHOD": ("primary", True)},
    "proto": {"PROTOCOL": ("container", True), "METHOD": ("primary", True), "TYPE": ("other", False)},
    "proto-config": {"PROTOCOL": ("container", False), "TYPE": ("primary", True), "METHOD": ("other", False)},
}

#: Surfaces that a view shows; absent: all.
SURFACES: dict[str, tuple[str, ...]] = {
    "crd": ("contract", "docs"),
    "helm": ("contract", "docs"),
    "manifest": ("contract", "docs"),
    "openapi": ("contract", "docs", "tests", "examples"),
}

#: Views with their own version symbols; unknown views share them.
VERSION_SCHEME = {"fidl": "fidl"}

ALIASES = {"docs.concepts": "concept", "docs.concept": "concept", "docs": "concept", "tests.unit": "test", "tests": "test", "test": "test", "concept": "concept", "examples": "example", "example": "example", "docs.reference": "reference", "workflow": "workflow"}


def tiers(spark: SparkSession) -> DataFrame:
    """(ecosystem, kind, tier): a table of fixed size."""
    rows = [(e, k, t) for e, kinds in VIEWS.items() for k, (t, _) in kinds.items()]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(e).alias("ecosystem"), F.lit(k).alias("kind"), F.lit(t).alias("tier")) for e, k, t in rows))))


def tier_of(ecosystem: Column, kind: Column) -> Column:
    """Container, then primary, then modifier; `none` for kinds or ecosystems without a tier."""
    out = F.lit("none")
    for e, kinds in VIEWS.items():
        for k, (tier, _) in kinds.items():
            out = F.when((ecosystem == e) & (kind == k), F.lit(tier)).otherwise(out)
    return out


def required_surfaces(names: list[str]) -> list[str]:
    """Canonical, sorted surface names of a list that may use their other spellings."""
    return sorted({ALIASES[n] if n in ALIASES else ALIASES.get(n.split(".")[0], n) for n in names})


def allows(ecosystem: Column, surface: str) -> Column:
    out = F.lit(True)
    for e, surfaces in SURFACES.items():
        out = F.when(ecosystem == e, F.lit(surface in surfaces)).otherwise(out)
    return out
