"""Queries on scalar functions, deltas, search, checks, windows and lag, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import text as T
from ..operators import delta, graph, matching, merge, rollups, search, verify, windows
from . import corpus
from .corpus import load, relation, with_relations
from .coverage import FOLD, SQL_TESTS, tests

CAMEL = "concat(substr(upper(p_type), 1, 3), upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', 'X'), CAST(p_size AS STRING), p_brand)"
FROM_CAMEL = f"SELECT p_partkey, {CAMEL} AS s FROM part"
_SPLIT = "list_filter(string_split(lower(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([^a-z ])([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda x: x <> '')"


def camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr("p_partkey", f"{CAMEL} AS s")


def q_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return camel(spark, sf_dir).select("p_partkey", F.array_join(T.split_camel(F.col("s")), ",").alias("tokens"), F.array_join(T.split_camel_simple(F.col("s")), ",").alias("simple"))


def q_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.explode(T.search_tokens(F.col("text"))).alias("w")).distinct()
    return words.select("w", F.array_join(F.array_sort(T.stems(F.array("w"), F.array(F.lit("tions"), F.lit("ment")))), ",").alias("stems"))


def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = corpus.elements(spark, sf_dir)
    i = F.col("id")
    return els.select("id", T.library_of(i).alias("library"), T.method_of(i).alias("method"), T.protocol_of(i).alias("protocol"), T.last_segment(i).alias("last"), T.slug(F.col("owner")).alias("slug"), F.concat(T.slug(F.col("owner")), F.lit("-"), T.short_hash(F.col("owner"))).alias("slug_hash"), T.alnum_lower(F.col("owner")).alias("alnum"), T.source_url("https://example.org/{path}#L{line}", F.col("path"), F.col("line")).alias("url"))


def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return tests(spark, sf_dir).select("path").distinct().select("path", F.array_join(T.path_tokens(p), ",").alias("tokens"), T.basename(p).alias("base"), F.array_join(T.dir_chain(p), "/").alias("dirs"), globs.included(p, ["tests/**", "qa/*/F/*.go"], ["**/s1?_test.go"]).alias("included"), globs.not_contaminated(p).alias("clean"))


def q_substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))
    w = F.col("words") % FOLD
    return rows.select("doc_id", F.col("words").cast("long").alias("words"), T.substance_name(T.substance_rank(w)).alias("prose"), T.substance_name(T.substance_rank(w, cli=True)).alias("cli"))


def q_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = corpus.elements(spark, sf_dir)
    return els.select("id", *(T.removed_at(F.col("removed"), t).alias(f"at_{n}") for n, t in (("head", "HEAD"), ("next", "NEXT"), ("20", "20"))))


def q_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "git_times").select("library", F.col("id").alias("element_id"), rollups.lag_days(F.col("code_ts"), F.col("doc_ts")).alias("days"))
    return rollups.lag_summary(rows, "library")


def q_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") * 7 + F.length("text") % 5).cast("string").alias("element_id"))
    return rollups.workflow_stats(rows)


def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    mentions = line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("token"), F.col("l_partkey").alias("element_id"))
    els = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_type").alias("region"))
    return rollups.region_tally(rollups.concept_verdicts(mentions, els), ["region"])


def _corpus_of(spark: SparkSession, sf_dir: str, low: int) -> DataFrame:
    o = load(spark, sf_dir, "orders").where(f"year(o_orderdate) % 3 <> {low}")
    return o.groupBy((F.col("o_custkey") % 400).alias("c")).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("o_orderstatus") == "F").alias("docs")).where(f"c % 5 <> {low}").select(F.concat(F.lit("e"), F.col("c").cast("string")).alias("element_id"), "tests", "docs")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.coverage_delta(_corpus_of(spark, sf_dir, 0), _corpus_of(spark, sf_dir, 1))


def q_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    owners = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("lib"), F.col("n_nationkey").cast("string"))).alias("scope"), F.col("n_name").alias("owner"), (F.col("n_nationkey") % 2 == 0).alias("subscribe"))
    affected = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category"), F.concat(F.lit("lib"), (F.col("s_suppkey") % 9).cast("string")).alias("library")).distinct()
    return delta.routed(affected, owners)


def q_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("e"), (F.col("user_id") % 500).cast("string")).alias("subject"), F.col("event_type").alias("kind"))
    return delta.affected_findings(found, deltas(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERY_TEXT = "the this that with tion of and ment"


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_tokens(load(spark, sf_dir, "documents"), QUERY_TEXT, "doc_id", "text")


def q_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").first()["embedding"]
    return search.by_vector(rows, query, "vec_id", "embedding").select("id", F.round("score", 5).alias("score"))


ASKED = """SELECT DISTINCT CASE p_partkey % 60 WHEN 0 THEN concat('lib', CAST(p_size AS STRING), '/', p_type, '.M', CAST(p_partkey AS STRING)) WHEN 20 THEN concat('no-such ', p_brand, '!')
        ELSE concat('lib', CAST(p_size AS STRING), ' ', p_type, '.M', CAST(p_partkey % 100 AS STRING)) END AS invocation FROM {part} WHERE p_partkey % 20 = 0"""


def q_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.verify_invocation(corpus.elements(spark, sf_dir), spark.sql(ASKED, part=load(spark, sf_dir, "part")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element_id"), F.concat(F.when(F.col("l_suppkey") % 13 == 0, "third_party/x").when(F.col("l_suppkey") % 17 == 0, "a/vendor/b").otherwise("src"), F.lit("/f"), (F.col("l_suppkey") % 2 + F.col("l_partkey") % 3 * F.col("l_linenumber")).cast("string")).alias("path"))


def q_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 1, "TP").when(F.col("quality") == 0, "FP")
    return verify.precision(docs.select("doc_id", "source").join(labels, "doc_id", "left").select("source", verdict.alias("verdict")), "source").withColumn("precision", F.round("precision", 6))


#: Two surfaces of the parts: a fifth are primary, and one covered surface is rare outside them.
COVERED = """SELECT s.surface, CASE WHEN p_partkey % 5 = 0 THEN 'primary' ELSE 'modifier' END AS tier, CASE s.surface WHEN 'tests' THEN p_partkey % 10 = 0 ELSE p_size % 2 = 0 END AS covered
    FROM {part} CROSS JOIN (VALUES ('tests'), ('docs')) AS s(surface)"""
REPORTED = "SELECT * FROM (VALUES ('primary', 'tests', 50), ('modifier', 'tests', 0), ('primary', 'docs', 5), ('modifier', 'docs', 50)) AS r(tier, surface, percent)"


def q_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.denominator_effect(spark.sql(COVERED, part=load(spark, sf_dir, "part")))


def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.metrics(spark.sql(COVERED, part=load(spark, sf_dir, "part")), spark.sql(REPORTED))


def q_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "workflow-cli-grammar").when(F.col("user_id") % 3 == 1, "workflow-yaml-grammar").otherwise("workflow-prose")
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("$ bin/"), "event_type", F.lit(" run"))).otherwise(F.concat(F.lit("name: "), "event_type", F.lit(".v1.Thing")))
    detected = load(spark, sf_dir, "part").groupBy(F.expr("CASE p_size % 4 WHEN 0 THEN 'proto' WHEN 1 THEN 'cml' ELSE 'markdown' END").alias("adapter")).agg(F.count(F.lit(1)).alias("files"))
    return rollups.hardening_backlog(detected, events.select(kind.alias("transform"), text.alias("text")))


def q_surviving(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS workflow", "l_linenumber AS position", "CAST(l_suppkey % 4 AS STRING) AS element_id")
    return merge.surviving_workflows(steps).select("workflow", F.array_join("refs", ">").alias("refs"))


def q_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m"))
    expected = F.col("n") + F.col("m") % 14
    return n.select("o_custkey", verify.ground_truth(F.col("n"), expected).alias("verdict"))


def q_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("element_id"), F.col("event_type").alias("surface"))
    reported = events.groupBy(F.col("event_type").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    return verify.recount(rows, reported)


def q_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdict(load(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") > 50, "WARNING").otherwise("INFO").alias("severity")))


def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    cited = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("lang")).alias("citation"), F.col("doc_id").alias("path"), (F.col("doc_id") % 4).cast("int").alias("cited_line"), F.when(F.col("lang") == "en", "the").when(F.col("lang") == "fr", "le").otherwise("de").alias("name"))
    return merge.citation_gate(cited.withColumn("aliases", F.array(F.lit("of"), F.lit("la"))), lines)


def q_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("doc"), F.col("o_orderkey").alias("offset"), F.when(F.col("o_orderkey") % 5 < 4, F.col("o_orderkey") % 5 + 1).cast("int").alias("level"), F.col("o_orderstatus").alias("title"))
    return windows.heading_stack(o, "doc", "offset").select("doc", "offset", F.array_join("section", "/").alias("section"))


def q_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tests(spark, sf_dir).groupBy("path", "line").agg(F.min("test_id").alias("test_id"))
    cited = t.groupBy("path").agg(F.collect_set("line").alias("at")).select("path", F.explode(F.array(F.lit(50), F.lit(500), F.lit(1500))).alias("line"))
    return windows.enclosing(cited.withColumn("citation", F.concat_ws("#", "path", F.col("line").cast("string"))), t)


def q_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_mktsegment", F.concat(F.when(F.col("c_custkey") % 2 == 0, "Cust").otherwise("cust"), F.col("c_custkey").cast("string")).alias("name"))
    return windows.rail_ranks(rows, "c_mktsegment", "name").withColumn("rank", F.col("rank").cast("long"))


def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("section"), F.col("l_suppkey").alias("element_id"), F.col("l_partkey").alias("offset"))
    first = windows.first_uses(rows).groupBy("doc").agg(F.count(F.lit(1)).alias("owners"), F.sum("offset").alias("offsets"))
    dense = windows.density(rows).groupBy("doc").agg(F.max("density").alias("density"))
    return first.join(dense, "doc")


def q_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("element_id"), F.when(F.col("event_type") == "purchase", "GROUNDED").when(F.col("value") > 20, "GUESSING").otherwise("UNGROUNDED").alias("state"))
    return rollups.grounding(rows)


def q_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "GROUNDED").when(F.col("event_type") == "error", "GUESSING").otherwise("UNGROUNDED")
    severity = T.grounding_severity(state, F.col("user_id") % 5, F.col("event_id") % 8)
    return load(spark, sf_dir, "events").select("event_id", F.round(severity, 2).alias("severity"))


def q_hardening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "raw_tests").select("tier", F.col("ref").alias("element_id"))
    tiers, only = rollups.hardening(rows)
    return tiers.unionByName(only.select(F.lit("only proposed").alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n")))


def q_local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = load(spark, sf_dir, "part").selectExpr("concat(p_brand, '::', replace(p_name, ' ', '_'), '::', CAST(p_size AS STRING), p_type) AS id").distinct()
    refs = load(spark, sf_dir, "part").selectExpr("p_partkey AS owner", "CASE WHEN p_partkey % 4 = 0 THEN concat(p_brand, '::', replace(p_name, ' ', '_'), '::', CAST(p_size AS STRING), p_type) ELSE concat('x::', CAST(p_size AS STRING), p_type) END AS ref")
    return matching.unique_local_names(refs, els)


def q_implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("impl"), F.col("l_suppkey").cast("string")).alias("src_id"), F.lit("IMPLEMENTS").alias("kind"), F.col("l_partkey"))
    els = corpus.elements(spark, sf_dir)
    edges = edges.join(els.select("p_partkey", F.col("id").alias("target_id")), F.col("l_partkey") == F.col("p_partkey")).select("src_id", "kind", "target_id")
    return graph.implementors(els, edges).select("element_id", F.array_join("implementors", ",").alias("implementors"))


def q_facades(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    backends = part.selectExpr("concat('b', CAST(p_partkey AS STRING)) AS id", "p_type AS path", "p_brand AS module", "CAST(p_partkey % 50 AS STRING) AS local")
    facades = part.selectExpr("concat('f', CAST(p_partkey AS STRING)) AS id", "concat('lib', CAST(p_size % 5 AS STRING)) AS library", "CAST(p_partkey % 50 AS STRING) AS local")
    by_path = part.where("p_type < 'L'").selectExpr("p_type AS path", "concat('lib', CAST(length(p_type) % 5 AS STRING)) AS facade").distinct()
    by_module = part.selectExpr("p_brand AS module", "concat('lib', CAST(length(p_brand) % 5 AS STRING)) AS facade").distinct()
    return graph.facade_edges(backends, by_path, by_module, facades)


def q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def q_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    lines = docs.select(F.concat(F.lit("tests/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    terms = docs.where("doc_id % 20 = 0").select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("element_id"), F.regexp_extract("text", r"([\p{L}\p{N}_]{7,})", 1).alias("term")).where("term <> ''")
    known = docs.where("doc_id % 2 = 0").select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("element_id"), F.concat(F.lit("tests/"), F.col("doc_id").cast("string")).alias("path"))
    return verify.missed_tests(terms, lines, known).select("element_id", "path")


QUERIES = {
    "camel_tokens": q_camel,
    "stem_forms": q_stems,
    "element_names": q_names,
    "path_parts": q_paths,
    "substance": q_substance,
    "removed_levels": q_removed,
    "lag_summary": q_lag,
    "workflow_sizes": q_workflows,
    "concept_verdicts": q_verdicts,
    "coverage_delta": deltas,
    "delta_summary": lambda s, d: delta.summary(deltas(s, d)),
    "removed_elements": lambda s, d: delta.removed(_corpus_of(s, d, 0), _corpus_of(s, d, 1)),
    "routed_owners": q_routed,
    "affected_findings": q_affected,
    "token_search": q_tokens,
    "vector_search": q_vectors,
    "verify_invocation": q_invocations,
    "smearing": lambda s, d: verify.smearing(_links(s, d), 8, 2),
    "contamination": lambda s, d: verify.contamination(_links(s, d)),
    "name_collisions": lambda s, d: verify.name_collisions(load(s, d, "part").selectExpr("concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_type) AS id")),
    "denominator_effect": q_denominator,
    "metric_checks": q_metrics,
    "hardening_backlog": q_backlog,
    "surviving_workflows": q_surviving,
    "ground_truth": q_ground_truth,
    "precision_ledger": q_precision,
    "recount": q_recount,
    "verification_verdict": q_verdict,
    "capped_sample": lambda s, d: verify.capped_sample(tests(s, d).select("path", "test_id"), "path", 3, "test_id"),
    "citation_gate": q_citations,
    "heading_stack": q_headings,
    "enclosing_tests": q_enclosing,
    "rail_ranks": q_rails,
    "mention_windows": q_mentions,
    "grounding_rollup": q_grounding,
    "grounding_severity": q_severity,
    "hardening": q_hardening,
    "local_names": q_local_names,
    "implementors": q_implementors,
    "facade_edges": q_facades,
    "event_properties": q_events,
    "missed_tests": q_misses,
}

_DELTA = """WITH {0} full_ AS (SELECT coalesce(h.element_id, b.element_id) AS element_id, CASE WHEN b.element_id IS NULL THEN 'added' WHEN h.element_id IS NULL THEN 'removed' WHEN b.tests <> h.tests OR b.docs <> h.docs THEN 'changed' END AS change,
    coalesce(b.tests, 0) AS base_tests, coalesce(h.tests, 0) AS head_tests, coalesce(b.docs, 0) AS base_docs, coalesce(h.docs, 0) AS head_docs FROM base b FULL OUTER JOIN head h ON b.element_id = h.element_id), delta AS (SELECT * FROM full_ WHERE change IS NOT NULL) """
_SIDES = ", ".join(f"{n} AS (SELECT concat('e', CAST(o_custkey % 400 AS STRING)) AS element_id, count(*) AS tests, count(*) FILTER (o_orderstatus = 'F') AS docs FROM orders WHERE year(o_orderdate) % 3 <> {k} AND o_custkey % 400 % 5 <> {k} GROUP BY 1)" for n, k in (("base", 0), ("head", 1)))
_DELTAS = _DELTA.format(_SIDES + ",")
_STEM = "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%s' THEN CASE WHEN w NOT LIKE '%ss' AND length(w) >= 4 AND left(w, length(w) - 1) NOT IN ('tions', 'ment') THEN concat(left(w, length(w) - 1), ',', w) ELSE w END WHEN concat(w, 's') NOT IN ('tions', 'ment') THEN concat(w, ',', w, 's') ELSE w END"
_LINKS = "links AS (SELECT l_partkey AS element_id, concat(CASE WHEN l_suppkey % 13 = 0 THEN 'third_party/x' WHEN l_suppkey % 17 = 0 THEN 'a/vendor/b' ELSE 'src' END, '/f', CAST(l_suppkey % 2 + l_partkey % 3 * l_linenumber AS STRING)) AS path FROM lineitem)"
_LINES = "WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"
_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"

ORACLE_SQL = {
    "camel_tokens": f"SELECT p_partkey, array_to_string({_SPLIT}, ',') AS tokens, array_to_string(list_filter(string_split(lower(regexp_replace(s, '([a-z])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: x <> ''), ',') AS simple FROM ({FROM_CAMEL})",
    "stem_forms": f"SELECT w, {_STEM} AS stems FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[ _\\-./,:!?]+'), lambda x: x <> '')) AS w FROM documents)",
    "element_names": with_relations("elements") + """SELECT id, library, split_part(id, '.', 2) AS method, type AS protocol, split_part(id, '.', 2) AS last, regexp_replace(regexp_replace(lower(owner), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        concat(regexp_replace(regexp_replace(lower(owner), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '-', left(sha256(owner), 8)) AS slug_hash, regexp_replace(lower(owner), '[^a-z0-9]', '', 'g') AS alnum, concat('https://example.org/', path, '#L', CAST(line AS STRING)) AS url FROM elements""",
    "path_parts": with_relations("raw_tests") + """SELECT DISTINCT path, replace(replace(replace(path, '.go', ''), '/', ','), '_', ',') AS tokens, regexp_extract(path, '(s[0-9]+)_test', 1) AS base, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS dirs,
        (path LIKE 'tests/%' OR regexp_matches(path, '^qa/[^/]*/F/[^/]*\\.go$')) AND NOT regexp_matches(path, '/s1[0-9]_test\\.go$') AS included, TRUE AS clean FROM raw_tests""",
    "substance": f"""SELECT doc_id, words, CASE WHEN w = 0 THEN 'ABSENT' WHEN w <= 4 THEN 'SIGNATURE_ONLY' WHEN w <= 19 THEN 'PARTIAL' ELSE 'SUBSTANTIVE' END AS prose, CASE WHEN w = 0 THEN 'ABSENT' WHEN w <= 1 THEN 'SIGNATURE_ONLY' WHEN w <= 7 THEN 'PARTIAL' ELSE 'SUBSTANTIVE' END AS cli
        FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, words % {FOLD} AS w FROM documents)""",
    "removed_levels": with_relations("elements") + "SELECT id, removed NOT IN ('', 'NEXT') AS at_head, removed = 'NEXT' AS at_next, coalesce(try_cast(removed AS INT) <= 20, FALSE) AS at_20 FROM elements",
    "lag_summary": with_relations("git_times") + """, lags AS (SELECT library, id, max(greatest(code_ts - doc_ts, 0) // 86400) AS days FROM git_times GROUP BY library, id)
        SELECT library, count(*) FILTER (days <= 0) AS fresh, count(*) FILTER (days > 0 AND days <= 30) AS recent, count(*) FILTER (days > 30 AND days <= 180) AS aging, count(*) FILTER (days > 180) AS stale, count(*) FILTER (days IS NULL) AS unknown,
        CAST(floor(quantile_cont(days, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(days, 0.9) + 0.5) AS BIGINT) AS p90 FROM lags GROUP BY library""",
    "workflow_sizes": "SELECT CASE WHEN n >= 6 THEN '6+' ELSE CAST(n AS STRING) END AS size, count(*) AS workflows, CAST(sum(n) AS BIGINT) AS elements FROM (SELECT conv_id, count(DISTINCT turn * 7 + length(text) % 5) AS n FROM conversations GROUP BY conv_id) GROUP BY 1",
    "concept_verdicts": """WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_returnflag AS token, l_partkey AS e FROM lineitem), d AS (SELECT doc, line, token, count(DISTINCT e) AS degree FROM m GROUP BY ALL), least_ AS (SELECT e, min(degree) AS degree FROM m JOIN d USING (doc, line, token) GROUP BY e)
        SELECT CASE WHEN degree IS NULL THEN 'silent' WHEN degree = 1 THEN 'clear' ELSE 'ambiguous' END AS verdict, p_type AS region, count(*) AS n FROM part LEFT JOIN least_ ON e = p_partkey GROUP BY ALL""",
    "coverage_delta": _DELTAS + "SELECT * FROM delta",
    "delta_summary": _DELTAS + "SELECT change, count(*) AS n, CAST(sum(head_tests - base_tests) AS BIGINT) AS tests_gained, CAST(sum(head_docs - base_docs) AS BIGINT) AS docs_gained FROM delta GROUP BY change",
    "removed_elements": _DELTAS + "SELECT element_id FROM delta WHERE change = 'removed'",
    "routed_owners": """WITH owners AS (SELECT r_name AS category, CASE WHEN n_nationkey % 3 = 0 THEN concat('lib', CAST(n_nationkey AS STRING)) END AS scope, n_name AS owner, n_nationkey % 2 = 0 AS subscribe FROM nation JOIN region ON n_regionkey = r_regionkey),
        affected AS (SELECT DISTINCT r_name AS category, concat('lib', CAST(s_suppkey % 9 AS STRING)) AS library FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        met AS (SELECT DISTINCT a.category, owner, subscribe FROM affected a JOIN owners o ON a.category = o.category AND (o.scope IS NULL OR o.scope = a.library))
        SELECT category, coalesce(string_agg(owner, ',' ORDER BY owner) FILTER (NOT subscribe), '') AS owners, coalesce(string_agg(owner, ',' ORDER BY owner) FILTER (subscribe), '') AS subscribers FROM met GROUP BY category""",
    "affected_findings": _DELTAS + "SELECT event_type AS kind, count(*) AS n FROM events WHERE concat('e', CAST(user_id % 500 AS STRING)) IN (SELECT element_id FROM delta) GROUP BY event_type",
    "token_search": "SELECT doc_id AS id, CAST(len(list_filter(regexp_split_to_array(lower(text), '[ _\\-./,:!?]+'), lambda x: x IN ('the', 'this', 'that', 'with', 'tion', 'of', 'and', 'ment'))) AS INT) AS score FROM documents ORDER BY score DESC, id LIMIT 10",
    "vector_search": f"SELECT vec_id AS id, round({_COSINE}, 5) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 10",
    "verify_invocation": with_relations("elements") + ", asked AS (" + ASKED.format(part="part") + """), q AS (SELECT invocation, list_filter(regexp_split_to_array(lower(invocation), '[ _\\-./,:!?]+'), lambda x: x <> '') AS w FROM asked),
        t AS (SELECT id, unnest(regexp_split_to_array(lower(id), '[ _\\-./,:!?]+')) AS token FROM elements),
        scored AS (SELECT invocation, id, count(*) AS score FROM (SELECT DISTINCT invocation, unnest(w) AS token FROM q) JOIN t USING (token) GROUP BY ALL),
        best AS (SELECT invocation, id, score FROM (SELECT *, row_number() OVER (PARTITION BY invocation ORDER BY score DESC, id) AS k FROM scored) WHERE k = 1)
        SELECT q.invocation, e.id IS NOT NULL AS matched, coalesce(e.id, best.id) AS element_id, CASE WHEN e.id IS NOT NULL THEN 1.0 ELSE score / len(w) END AS confidence FROM q LEFT JOIN elements e ON e.id = q.invocation LEFT JOIN best ON best.invocation = q.invocation""",
    "smearing": f"WITH {_LINKS} SELECT element_id, count(*) AS refs, count(DISTINCT path) AS files FROM links GROUP BY element_id HAVING count(*) >= 8 AND count(DISTINCT path) <= 2",
    "contamination": f"WITH {_LINKS} SELECT regexp_extract(path, '(third_party|vendor)', 1) AS segment, count(*) AS refs FROM links WHERE path LIKE '%third_party%' OR path LIKE '%vendor%' GROUP BY 1",
    "name_collisions": "SELECT lower(concat(p_name, p_type)) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "denominator_effect": "WITH c AS (" + COVERED.format(part="part") + """), s AS (SELECT surface, CAST(floor(100.0 * count(*) FILTER (covered) / count(*) + 0.5) AS BIGINT) AS pooled,
        CAST(floor(100.0 * count(*) FILTER (covered AND tier = 'primary') / count(*) FILTER (tier = 'primary') + 0.5) AS BIGINT) AS primary, CAST(floor(100.0 * count(*) FILTER (covered AND tier = 'modifier') / count(*) FILTER (tier = 'modifier') + 0.5) AS BIGINT) AS modifier FROM c GROUP BY surface)
        SELECT *, pooled <= 15 AND "primary" >= 30 AND "primary" - pooled >= 15 AS effect FROM s""",
    "metric_checks": "WITH c AS (" + COVERED.format(part="part") + "), r AS (" + REPORTED + """), m AS (SELECT tier, surface, count(*) FILTER (covered) AS numerator, count(*) AS denominator FROM c GROUP BY ALL),
        e AS (SELECT m.*, percent, CAST(floor(100.0 * numerator / denominator + 0.5) AS BIGINT) AS expected FROM m JOIN r USING (tier, surface))
        SELECT *, abs(expected - percent) <= 1 AS reproduced, CASE WHEN abs(expected - percent) > 1 THEN 'reconcile' WHEN percent = 0 THEN 'zero_surface' WHEN percent <= 15 THEN 'low_coverage' END AS finding,
        CASE WHEN abs(expected - percent) > 1 THEN 'ERROR' WHEN percent <= 15 THEN 'WARNING' END AS severity FROM e""",
    "hardening_backlog": """WITH w AS (SELECT user_id % 3 AS k, event_type, count(*) AS n FROM events GROUP BY ALL)
        SELECT CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 4 END AS INT) AS rung, CASE k WHEN 0 THEN 'workflow-cli-grammar' WHEN 1 THEN 'workflow-yaml-grammar' ELSE 'workflow-prose' END AS entry, CAST(sum(n) AS BIGINT) AS rows,
            CASE WHEN k < 2 THEN (SELECT event_type FROM w v WHERE v.k = w.k ORDER BY n DESC, event_type LIMIT 1) END AS dominant FROM w GROUP BY k
        UNION ALL SELECT 1, CASE p_size % 4 WHEN 0 THEN 'schema:proto' ELSE 'schema:cml' END, count(*), NULL FROM part WHERE p_size % 4 < 2 GROUP BY p_size % 4""",
    "surviving_workflows": """WITH f AS (SELECT l_orderkey, l_suppkey % 4 AS e, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
        SELECT l_orderkey AS workflow, string_agg(CAST(e AS STRING), '>' ORDER BY place, CAST(e AS STRING)) AS refs FROM f GROUP BY l_orderkey HAVING count(*) >= 2""",
    "ground_truth": "SELECT o_custkey, CASE WHEN m % 14 <= greatest(1, (n + m % 14) // 100) THEN 'clean' WHEN m % 14 > greatest(5, (n + m % 14) // 10) THEN 'error' ELSE 'warning' END AS verdict FROM (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY o_custkey)",
    "precision_ledger": "SELECT source, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp, count(*) FILTER (quality IS NULL) AS unverified, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 6) AS precision FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "recount": "SELECT event_type AS surface, count(DISTINCT user_id) AS counted, count(*) AS reported FROM events GROUP BY event_type HAVING count(DISTINCT user_id) <> count(*)",
    "verification_verdict": "SELECT CASE WHEN e > 0 THEN 'broken' WHEN w > 0 THEN 'review' ELSE 'trustworthy' END AS verdict, e AS errors, w AS warnings FROM (SELECT count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type <> 'error' AND value > 50) AS w FROM events)",
    "capped_sample": with_relations("raw_tests") + ", " + SQL_TESTS + "SELECT path, test_id FROM (SELECT path, test_id, row_number() OVER (PARTITION BY path ORDER BY test_id) AS k FROM tests) WHERE k <= 3",
    "citation_gate": _LINES + """, cited AS (SELECT concat(CAST(doc_id AS STRING), '#', lang) AS citation, doc_id, doc_id % 4 AS here, unnest([CASE lang WHEN 'en' THEN 'the' WHEN 'fr' THEN 'le' ELSE 'de' END, 'of', 'la']) AS name, unnest([1, 2, 3]) AS which FROM documents),
        met AS (SELECT citation, line, abs(line - here) AS distance, which FROM cited c JOIN lines l ON l.doc_id = c.doc_id AND abs(line - here) <= 1 WHERE regexp_matches(text, concat('(^|[^A-Za-z0-9_])', name, '([^A-Za-z0-9_]|$)')))
        SELECT citation, CAST(line AS INT) AS line, CAST(distance AS INT) AS distance, which > 1 AS by_alias FROM (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY distance, line, which) AS k FROM met) WHERE k = 1""",
    "heading_stack": """WITH r AS (SELECT o_custkey % 97 AS doc, o_orderkey AS offset_, CASE WHEN o_orderkey % 5 < 4 THEN least(o_orderkey % 5 + 1, 3) END AS slot, o_orderstatus AS title FROM orders),
        o AS (SELECT doc, offset_, max(CASE WHEN slot = 1 THEN offset_ END) OVER w AS o1, max(CASE WHEN slot = 2 THEN offset_ END) OVER w AS o2, max(CASE WHEN slot = 3 THEN offset_ END) OVER w AS o3 FROM r WINDOW w AS (PARTITION BY doc ORDER BY offset_ ROWS UNBOUNDED PRECEDING))
        SELECT o.doc, offset_ AS "offset", concat_ws('/', a.o_orderstatus, CASE WHEN o2 > coalesce(o1, -1) THEN b.o_orderstatus END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN c.o_orderstatus END) AS section
        FROM o LEFT JOIN orders a ON a.o_orderkey = o1 LEFT JOIN orders b ON b.o_orderkey = o2 LEFT JOIN orders c ON c.o_orderkey = o3""",
    "enclosing_tests": with_relations("raw_tests") + ", " + SQL_TESTS + """, t AS (SELECT path, line, min(test_id) AS test_id FROM tests GROUP BY ALL), c AS (SELECT DISTINCT path, here FROM tests, (VALUES (50), (500), (1500)) v(here))
        SELECT concat(c.path, '#', CAST(here AS STRING)) AS citation, arg_max(test_id, line) AS test_id FROM c JOIN t ON t.path = c.path AND line <= here GROUP BY c.path, here""",
    "rail_ranks": "SELECT c_mktsegment, name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY lower(name), name) AS rank FROM (SELECT c_mktsegment, concat(CASE WHEN c_custkey % 2 = 0 THEN 'Cust' ELSE 'cust' END, CAST(c_custkey AS STRING)) AS name FROM customer)",
    "mention_windows": """WITH f AS (SELECT l_orderkey AS doc, l_suppkey, min(l_partkey) AS o FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey AS doc, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT doc, owners, offsets, density FROM (SELECT doc, count(*) AS owners, CAST(sum(o) AS BIGINT) AS offsets FROM f GROUP BY doc) JOIN (SELECT doc, max(n) AS density FROM d GROUP BY doc) USING (doc)""",
    "grounding_rollup": """WITH s AS (SELECT user_id AS element_id, CASE WHEN event_type = 'purchase' THEN 3 WHEN value > 20 THEN 2 ELSE 1 END AS k FROM events)
        SELECT element_id, count(*) FILTER (k = 3) AS grounded, count(*) FILTER (k = 2) AS guessing, count(*) FILTER (k = 1) AS ungrounded, CASE max(k) WHEN 3 THEN 'GROUNDED' WHEN 2 THEN 'GUESSING' ELSE 'UNGROUNDED' END AS best_state, count(*) FILTER (k < 3) AS forces_a_guess FROM s GROUP BY element_id""",
    "grounding_severity": """SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE round(least(1.0, CASE WHEN event_type = 'error' THEN 0.30 ELSE 0.60 END
        + CASE WHEN user_id % 5 > 1 THEN least(0.24, 0.12 * (user_id % 5 - 1)) ELSE 0 END + CASE WHEN event_id % 8 > 1 THEN least(0.16, 0.04 * (event_id % 8 - 1)) ELSE 0 END), 2) END AS DOUBLE) AS severity FROM events""",
    "hardening": with_relations("raw_tests") + """, n AS (SELECT tier, ref, split_part(regexp_replace(ref, '^[^/]*/', ''), '::', -1) AS own FROM raw_tests) SELECT tier, count(*) AS n FROM raw_tests GROUP BY tier
        UNION ALL SELECT 'only proposed', count(DISTINCT ref) FROM n WHERE tier = 'LLM' AND own NOT IN (SELECT own FROM n WHERE tier <> 'LLM' AND own IS NOT NULL) HAVING count(*) > 0""",
    "local_names": """WITH e AS (SELECT DISTINCT concat(p_brand, '::', replace(p_name, ' ', '_'), '::', CAST(p_size AS STRING), p_type) AS id, concat(CAST(p_size AS STRING), p_type) AS local FROM part), lone AS (SELECT local, min(id) AS id FROM e GROUP BY local HAVING count(*) = 1)
        SELECT * FROM (SELECT p_partkey AS owner, CASE WHEN p_partkey % 4 = 0 THEN own ELSE concat('x::', loc) END AS ref, CASE WHEN p_partkey % 4 = 0 THEN own ELSE lone.id END AS element_id FROM (SELECT p_partkey, concat(CAST(p_size AS STRING), p_type) AS loc, concat(p_brand, '::', replace(p_name, ' ', '_'), '::', CAST(p_size AS STRING), p_type) AS own FROM part) LEFT JOIN lone ON loc = local) WHERE element_id IS NOT NULL""",
    "implementors": with_relations("elements") + "SELECT id AS element_id, coalesce(string_agg(DISTINCT concat('impl', CAST(l_suppkey AS STRING)), ',' ORDER BY concat('impl', CAST(l_suppkey AS STRING))) FILTER (l_suppkey IS NOT NULL), '') AS implementors FROM elements LEFT JOIN lineitem ON l_partkey = p_partkey WHERE kind IN ('METHOD', 'TYPE') GROUP BY id",
    "facade_edges": """WITH b AS (SELECT concat('b', CAST(p_partkey AS STRING)) AS id, concat('lib', CAST(CASE WHEN p_type < 'L' THEN length(p_type) ELSE length(p_brand) END % 5 AS STRING)) AS library, p_partkey % 50 AS local FROM part)
        SELECT b.id AS src_id, concat('f', CAST(p_partkey AS STRING)) AS facade_id FROM b JOIN part f ON concat('lib', CAST(f.p_size % 5 AS STRING)) = library AND f.p_partkey % 50 = local""",
    "event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "missed_tests": """WITH terms AS (SELECT doc_id AS own, concat('e', CAST(doc_id AS STRING)) AS element_id, regexp_extract(text, '([\\p{L}\\p{N}_]{7,})', 1) AS term FROM documents WHERE doc_id % 20 = 0),
        words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([\\p{L}\\p{N}_]+)')) AS term FROM documents),
        hits AS (SELECT element_id, concat('tests/', CAST(doc_id AS STRING)) AS path FROM terms JOIN words USING (term) WHERE term <> '' AND NOT (own = doc_id AND own % 2 = 0))
        SELECT element_id, path FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY path) AS k FROM hits) WHERE k <= 5""",
}
