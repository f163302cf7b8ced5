"""Rollups of profiles: tiers, overlap, worklists, libraries, workflows, lag, deprecation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import percent
from .graph import cut
from .matching import shuffled

#: Surfaces that elements of a kind can have; reference is never counted by row. Fixed values.
KIND_SURFACES: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("METHOD", "TYPE", "PROTOCOL", "SYSCALL"), ("concept", "example", "impl")),
    **dict.fromkeys(("FLAG", "SWITCH", "CONFIG_KNOB", "SUBCOMMAND", "POSITIONAL", "CONFIG_FACET"), ("concept", "example", "test")),
    **dict.fromkeys(("CPP_CLASS", "RUST_TYPE"), ("test",)),
    "LIBRARY": ("concept", "example"),
}
INTERFACE_KINDS = ("METHOD", "TYPE", "PROTOCOL", "SYSCALL")


def effective_surfaces(kind: str, required: Sequence[str] = ()) -> tuple[str, ...]:
    """Those of a kind that are required, all of them where nothing is; an unknown kind has the required ones, else three."""
    own = KIND_SURFACES.get(kind)
    if own is None:
        return tuple(required) or ("concept", "test", "example")
    return tuple(s for s in own if s in required) if required else own


def bridged(kind: Column, required: Sequence[str] = ()) -> Column:
    """All effective surfaces of the kind have evidence; none effective is true."""

    def all_of(names: Sequence[str]) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col(n)
        return out

    out = all_of(effective_surfaces("", required))
    for k in KIND_SURFACES:
        out = F.when(kind == k, all_of(effective_surfaces(k, required))).otherwise(out)
    return out


def needs_test(kind: Column) -> Column:
    return ~kind.isin(*INTERFACE_KINDS) & ~F.col("test")


def tier_rollup(rows: DataFrame) -> DataFrame:
    """Counts and percents for each tier and for all (tier null); rows has tier and boolean surfaces."""
    flags = ("concept", "test", "example", "impl", "bridged", "workflow")
    live = rows.where(~F.col("removed"))
    summed = live.rollup("tier").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(f)).alias(f"{f}_n") for f in flags))
    return summed.select(F.coalesce("tier", F.lit("all")).alias("tier"), "total", *(f"{f}_n" for f in flags), *(percent(F.col(f"{f}_n"), F.col("total")).alias(f"{f}_percent") for f in flags))


def overlap_cube(rows: DataFrame, example_required: bool = True) -> DataFrame:
    """All eight combinations of concept, test and example with counts, percents and bar lengths."""
    spark = rows.sparkSession
    live = rows.where(~F.col("removed"))
    own = live if example_required else live.withColumn("example", F.lit(True))
    seen = own.groupBy("concept", "test", "example").agg(F.count(F.lit(1)).alias("n"))
    corners = spark.range(8).select(((F.col("id") % 2) == 1).alias("c"), ((F.floor(F.col("id") / 2) % 2) == 1).alias("t"), (F.col("id") >= 4).alias("e"))
    full = corners.join(seen, (F.col("c") == F.col("concept")) & (F.col("t") == F.col("test")) & (F.col("e") == F.col("example")), "left").select(F.col("c").alias("concept"), F.col("t").alias("test"), F.col("e").alias("example"), F.coalesce("n", F.lit(0)).alias("n"))
    eight = W.partitionBy()  # the eight rows
    return full.select("concept", "test", "example", "n", percent(F.col("n"), F.sum("n").over(eight)).alias("percent"), percent(F.col("n"), F.max("n").over(eight)).alias("bar"))


def worklist(rows: DataFrame, workflows: bool = False) -> DataFrame:
    """The first reason to work on each element: (element_id, reason); bridged ones without drift have none."""
    reason = (
        F.when(F.col("removed"), "removed")
        .when(F.col("bridged") & F.col("drift").isNull(), F.lit(None).cast("string"))
        .when(F.col("deprecated"), "deprecated")
        .when(F.col("drift") == "time", "time")
        .when(F.col("drift") == "domain", "domain")
        .when(~F.col("concept") & ~F.col("test") & ~F.col("example"), "orphan")
        .when(needs_test(F.col("kind")), "untested")
        .when(~F.col("example"), "noexample")
    )
    whole = F.col("concept") & F.col("test") & F.col("example")
    reason = reason.when(whole & ~F.col("workflow"), "noworkflow") if workflows else reason
    return rows.select("element_id", reason.alias("reason")).where("reason is not null")


def drift(findings: DataFrame) -> DataFrame:
    """(element_id, drift): time where documentation is stale, else domain where coverage is lopsided."""
    return findings.groupBy(F.col("subject").alias("element_id")).agg(F.when(F.bool_or(F.col("kind") == "STALE_DOC"), "time").when(F.bool_or(F.col("kind").isin("TESTED_UNDOCUMENTED", "EXTERNAL_MENTION_ONLY")), "domain").alias("drift")).where("drift is not null")


def hero(rows: DataFrame) -> DataFrame:
    """One row: drift counts, and only where both are 0 those of unbridged rows that need a test, else an example."""
    open_, needs = ~F.col("bridged") & F.col("drift").isNull(), needs_test(F.col("kind"))
    sums = rows.agg(
        F.count_if(F.col("drift") == "domain").alias("domain_drift"),
        F.count_if(F.col("drift") == "time").alias("time_drift"),
        F.count_if(open_ & needs).alias("untested"),
        F.count_if(open_ & ~needs & ~F.col("example")).alias("no_example"),
        F.count_if(F.col("drift").isNull()).alias("drift_free"),
    )
    quiet = (F.col("domain_drift") == 0) & (F.col("time_drift") == 0)
    return sums.withColumns({c: F.when(quiet, F.col(c)) for c in ("untested", "no_example")})


def completeness(rows: DataFrame) -> DataFrame:
    """Elements of each library by how many of docs, tests and examples they have; removed ones don't count."""
    score = F.col("concept").cast("int") + F.col("test").cast("int") + F.col("example").cast("int")
    return rows.where(~F.col("removed")).groupBy("library", score.alias("score")).agg(F.count(F.lit(1)).alias("n"))


def deprecation(rows: DataFrame) -> DataFrame:
    """Libraries counted as deprecated when half of their elements are."""
    return rows.groupBy("library").agg(F.count(F.lit(1)).alias("n"), F.count_if("deprecated").alias("deprecated_n")).withColumn("deprecated", F.col("deprecated_n") * 2 >= F.col("n"))


def libraries(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """Elements and findings of each library; no name is `(unspecified)`."""
    name = F.when((F.col("library") == "") | F.col("library").isNull(), "(unspecified)").otherwise(F.col("library"))
    own = elements.groupBy(name.alias("library")).agg(F.count(F.lit(1)).alias("elements"))
    found = findings.groupBy(name.alias("library")).agg(F.count(F.lit(1)).alias("findings"))
    return own.join(found, "library", "left").fillna(0)


def workflow_stats(refs: DataFrame) -> DataFrame:
    """Workflows by their number of distinct elements: 2, 3, 4, 5 and 6+. refs has (path, element_id)."""
    sized = refs.groupBy("path").agg(F.count_distinct("element_id").alias("n"))
    label = F.when(F.col("n") >= 6, "6+").otherwise(F.col("n").cast("string"))
    return sized.groupBy(label.alias("size")).agg(F.count(F.lit(1)).alias("workflows"), F.sum("n").alias("elements"))


def usage(rows: DataFrame) -> DataFrame:
    """Elements that an example or a workflow uses, each once."""
    return rows.agg(F.count_if(F.col("example") | F.col("workflow")).alias("used"), F.count(F.lit(1)).alias("total"))


def lag_days(code_ts: Column, doc_ts: Column) -> Column:
    """Whole days by which code is newer than its text, 0 at least; epoch seconds, 0 is unknown."""
    return F.when((code_ts > 0) & (doc_ts > 0), F.floor(F.greatest(code_ts - doc_ts, F.lit(0)) / 86400).cast("long"))


def lag_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "UNKNOWN").when(days <= 0, "FRESH").when(days <= 30, "RECENT").when(days <= 180, "AGING").otherwise("STALE")


def lag_summary(rows: DataFrame, by: str) -> DataFrame:
    """Buckets, p50 and p90 (interpolated, halves up) of each element's largest lag. rows has (by, element_id, days)."""
    most = rows.groupBy(by, "element_id").agg(F.max("days").alias("days"))
    rounded = lambda q: F.floor(F.percentile("days", q) + 0.5).cast("long")
    bucket = lag_bucket(F.col("days"))
    return most.groupBy(by).agg(*(F.count_if(bucket == b).alias(b.lower()) for b in ("FRESH", "RECENT", "AGING", "STALE", "UNKNOWN")), rounded(0.5).alias("p50"), rounded(0.9).alias("p90"))


def lag_pairs(elements: DataFrame, refs: DataFrame, times: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(element_id, path, line, inline, days) of every reference in documentation; days is null where a time is unknown.

    elements has (id, path, line), refs (element_id, path, line), times (path, line, ts), where line 0 is the whole
    file and stands in for lines without a time. tracked (path) limits times to files under version control.
    """
    known = times.where("ts > 0 AND line >= 0").groupBy("path", "line").agg(F.max("ts").alias("ts"))
    known = known if tracked is None else known.join(shuffled(tracked.select("path").distinct()), "path", "left_semi")
    # four joins read the times, so they are written once and the plan doesn't hold what they come from four times
    known = cut(known)
    by_line = known.where("line > 0").select("path", "line", F.col("ts").alias("line_ts"))
    by_file = known.where("line = 0").select("path", F.col("ts").alias("file_ts"))

    def timed(rows: DataFrame, name: str) -> DataFrame:
        out = rows.join(shuffled(by_line), ["path", "line"], "left").join(shuffled(by_file), "path", "left")
        return out.withColumn(name, F.coalesce("line_ts", "file_ts")).drop("line_ts", "file_ts")

    code = timed(elements.select(F.col("id").alias("element_id"), "path", "line").where("path <> ''"), "code_ts")
    code = code.select("element_id", F.col("path").alias("code_path"), "code_ts")
    pairs = timed(refs.select("element_id", "path", "line"), "doc_ts").join(shuffled(code), "element_id")
    inline = F.col("path") == F.col("code_path")
    days = F.when(~inline, lag_days(F.coalesce("code_ts", F.lit(0)), F.coalesce("doc_ts", F.lit(0))))
    return pairs.select("element_id", "path", "line", inline.alias("inline"), days.alias("days"))


def lag_run(pairs: DataFrame) -> DataFrame:
    """One row for all pairs: buckets, p50, p90, and how many are inline or unknown and so not counted."""
    counted, bucket = ~F.col("inline") & F.col("days").isNotNull(), lag_bucket(F.col("days"))
    rounded = lambda q: F.coalesce(F.floor(F.percentile(F.when(counted, F.col("days")), q) + 0.5), F.lit(0)).cast("long")
    return pairs.agg(
        F.count_if(counted).alias("pairs"),
        F.count_if("inline").alias("inline"),
        F.count_if(~F.col("inline") & F.col("days").isNull()).alias("unknown"),
        *(F.count_if(counted & (bucket == b)).alias(b.lower()) for b in ("FRESH", "RECENT", "AGING", "STALE")),
        rounded(0.5).alias("p50"),
        rounded(0.9).alias("p90"),
    )


def monorepo(rows: DataFrame, by: str = "library") -> DataFrame:
    """Sums and median percents of members by group. rows has (by, member, total, tests, docs, examples)."""
    surfaces = ("docs", "tests", "examples")
    own = rows.select(by, "total", *surfaces, *(percent(F.col(s), F.col("total")).alias(f"{s}_p") for s in surfaces))
    median = lambda c: F.floor(F.percentile(c, 0.5) + 0.5).cast("long")
    out = own.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sum("total").alias("total"), *(F.sum(s).alias(s) for s in surfaces), *(median(f"{s}_p").alias(f"{s}_median") for s in surfaces))
    mean = F.floor((F.col("docs_median") + F.col("tests_median") + F.col("examples_median")) / 3 + 0.5).cast("long")
    least = F.least("docs_median", "tests_median", "examples_median")
    weakest = F.when(F.col("docs_median") == least, "docs").when(F.col("tests_median") == least, "tests").otherwise("examples")
    return out.withColumn("cover", mean).withColumn("weakest", weakest)


def anomalies(findings: DataFrame, confidence: Column) -> DataFrame:
    """Findings by cause with their least and greatest confidence, largest group first; of equal ones that seen first in report order."""
    own = findings.withColumn("_c", confidence)
    place = F.min(F.struct("subject", "kind", "id")).alias("_first")
    out = own.groupBy(F.col("kind").alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.min("_c").alias("low"), F.max("_c").alias("high"), place)
    return out.orderBy(F.desc("n"), "_first").drop("_first")


def concept_verdicts(mentions: DataFrame, elements: DataFrame) -> DataFrame:
    """clear, ambiguous or silent: by the least number of elements that share a site with the element."""
    site = mentions.groupBy("doc", "line", "token").agg(F.count_distinct("element_id").alias("degree"))
    least = mentions.join(site, ["doc", "line", "token"]).groupBy("element_id").agg(F.min("degree").alias("degree"))
    verdict = F.when(F.col("degree").isNull(), "silent").when(F.col("degree") == 1, "clear").otherwise("ambiguous")
    return elements.join(least, "element_id", "left").select(*elements.columns, verdict.alias("verdict"))


def region_tally(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    return verdicts.groupBy("verdict", *by).agg(F.count(F.lit(1)).alias("n")).orderBy("verdict", F.desc("n"), *by)


def hardening(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by tier, and symbols that only proposed rows name: no deterministic row has their local name."""
    local = F.substring_index(F.regexp_replace("element_id", "^[^/]*/", ""), "::", -1)
    named = rows.select("tier", "element_id", local.alias("local"))
    tiers = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tier")
    sure = named.where("tier <> 'LLM'").select("local").distinct()
    return tiers, named.where("tier = 'LLM'").join(sure, "local", "left_anti").select("element_id").distinct()


#: What replaces proposed rows: formats with a schema and grammars of workflows, with their rungs (1 schema, 2 cheap, 3 extension, 4 irreducible). Fixed values.
SCHEMA_ADAPTERS = ("proto", "fidl", "clap", "cml")
TRANSFORM_RUNGS = {"workflow-cli-grammar": 2, "workflow-yaml-grammar": 1, "workflow-prose": 4}


def hardening_backlog(detected: DataFrame, workflows: DataFrame) -> DataFrame:
    """(rung, entry, rows, dominant): deterministic replacements by the rows that they would pin, then by rung.

    detected has (adapter, files); workflows has proposed workflows (transform, text). The dominant key is the
    command that leads most texts of the command grammar, or the package that most names of the yaml grammar
    begin with; the least of equal ones.
    """
    schemas = detected.where(F.col("adapter").isin(*SCHEMA_ADAPTERS) & (F.col("files") > 0))
    schemas = schemas.select(F.lit(1).alias("rung"), F.concat(F.lit("schema:"), "adapter").alias("entry"), F.col("files").cast("long").alias("rows"), F.lit(None).cast("string").alias("dominant"))
    command = F.substring_index(F.regexp_extract("text", r"^\s*(?:[$>] )?\s*(\S+)", 1), "/", -1)
    package = F.regexp_extract("text", r"([A-Za-z_]\w*)\.[A-Za-z_]\w*", 1)
    key = F.when(F.col("transform") == "workflow-cli-grammar", command).when(F.col("transform") == "workflow-yaml-grammar", package)
    rung = F.lit(None).cast("int")
    for name, level in TRANSFORM_RUNGS.items():
        rung = F.when(F.col("transform") == name, level).otherwise(rung)
    counted = workflows.withColumn("rung", rung).where("rung is not null").groupBy("rung", "transform", F.nullif(key, F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("key").isNotNull(), F.struct((-F.col("n")).alias("n"), "key")))["key"]
    entries = counted.groupBy("rung", "transform").agg(F.sum("n").alias("rows"), best.alias("dominant"))
    return schemas.unionByName(entries.select("rung", F.col("transform").alias("entry"), "rows", "dominant")).orderBy(F.desc("rows"), "rung", "entry")


def grounding(rows: DataFrame) -> DataFrame:
    """Counts and best state by element: grounded over guessing over ungrounded. rows has (element_id, state)."""
    rank = F.when(F.col("state") == "GROUNDED", 3).when(F.col("state") == "GUESSING", 2).otherwise(1)
    out = rows.groupBy("element_id").agg(*(F.count_if(F.col("state") == s).alias(s.lower()) for s in ("GROUNDED", "GUESSING", "UNGROUNDED")), F.max(rank).alias("best"))
    return out.withColumn("best_state", F.when(F.col("best") == 3, "GROUNDED").when(F.col("best") == 2, "GUESSING").otherwise("UNGROUNDED")).withColumn("forces_a_guess", F.col("guessing") + F.col("ungrounded")).drop("best")


def confidence_chip(surface: Column, n: Column, total: Column, in_module_n: Column, examples: Column, implements: Column, ecosystem: Column) -> Column:
    """How far a tier's share of a surface can be trusted; null where no chip shows. Chips are for C++ only.

    `n` of `total` elements have evidence, `in_module_n` of them within their module; `examples` counts the
    corpus' examples, `implements` says whether it has implementations at all.
    """
    p, inside = percent(n, total), percent(in_module_n, total)
    concept = F.when(p >= 100, "Verified").when(p == 0, "Needs tuning").otherwise("Lower bound")
    test = F.when((n > in_module_n) & (p > inside), "Needs tuning").when(inside >= 80, "Verified").otherwise("Lower bound")
    share = F.when(p >= 80, "Verified").otherwise("Lower bound")
    chip = (
        F.when((surface == "example") & (examples == 0), "Not measured")
        .when((surface == "implementations") & ~implements, F.lit(None).cast("string"))
        .when((surface != "implementations") & (total == 0), F.lit(None).cast("string"))
        .when(surface == "concept", concept)
        .when(surface == "test", test)
        .otherwise(share)
    )
    return F.when(ecosystem == "cpp", chip)


def tier_sentence(p: Column) -> Column:
    return F.when(p >= 60, "high").when(p < 25, "low").otherwise("partial")
