"""Queries on matching, evidence, profiles and findings, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ecosystems, evidence, findings, graph, matching, merge, rollups
from . import corpus
from .corpus import RULES, relation, with_relations

#: Word counts of the documents are folded so that all substance levels occur.
FOLD = 30
TEST_ORDER = ("path", "line", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")

SQL_TESTS = "tests AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY CASE tier WHEN 'LLM' THEN 1 ELSE 0 END, " + ", ".join(TEST_ORDER) + ") AS rn FROM raw_tests) WHERE rn = 1)"
SQL_ALIASED = "aliased AS (SELECT *, p_partkey % 5 IN (0, 3) AS has_alias FROM elements)"
SQL_DOC_MATCH = "doc_match AS (SELECT DISTINCT c.claim_id AS owner, e.id AS element_id FROM claims c JOIN aliased e ON c.ref = e.id OR ends_with(e.id, concat('/', c.ref)) OR ends_with(e.id, concat('.', c.ref)) OR (e.has_alias AND c.ref = e.alias))"
SQL_TEST_MATCH = "test_match AS (SELECT DISTINCT t.test_id AS owner, e.id AS element_id FROM tests t JOIN aliased e ON t.ref = e.id OR (e.has_alias AND t.ref = e.alias) OR (e.kind = 'METHOD' AND starts_with(t.ref, concat(e.library, '/*.')) AND ends_with(e.id, concat('.', substr(t.ref, length(e.library) + 4)))))"
SQL_CLAIMS = f"""graded AS (SELECT *, CASE WHEN adapter = 'clidoc' THEN CASE WHEN w <= 0 THEN 1 WHEN w <= 1 THEN 2 WHEN w <= 7 THEN 3 ELSE 4 END
    ELSE CASE WHEN w <= 0 THEN 1 WHEN w <= 4 THEN 2 WHEN w <= 19 THEN 3 ELSE 4 END END AS rank
    FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) % {FOLD} AS w FROM claims))"""
SQL_PLACES = """placed_claims AS (SELECT *, CASE WHEN kind = 'REFERENCE' THEN concat('docs/reference.', CASE adapter WHEN 'fidl' THEN 'fidldoc' ELSE adapter END)
        WHEN kind IN ('EXAMPLE', 'WORKFLOW') AND tier = 'LLM' THEN NULL WHEN kind = 'EXAMPLE' THEN 'examples/in_docs' WHEN kind = 'WORKFLOW' THEN 'docs/reference.workflows'
        WHEN regexp_matches(path, '^src[12]/') THEN 'docs/tutorial' WHEN regexp_matches(path, '^src3/') THEN 'docs/concept'
        WHEN regexp_matches(path, '^src4/') THEN 'docs/guide.cookbook' WHEN regexp_matches(path, '^src5/[^/]+/[^/]+\\.md$') THEN 'docs/proposal.rfc'
        WHEN regexp_matches(path, '^src[67]/') THEN 'docs/release_notes' ELSE 'docs/concept' END AS place FROM graded),
    placed_tests AS (SELECT *, CASE WHEN tier = 'LLM' THEN 'tests/llm_inferred' WHEN starts_with(path, 'tests/integration/') THEN 'tests/integration' WHEN starts_with(path, 'qa/') THEN 'tests/e2e' ELSE 'tests/unit' END AS place FROM tests)"""
SQL_EVIDENCE = """evidence AS (SELECT element_id, split_part(place, '/', 1) AS surface, split_part(place, '/', 2) AS bucket, path, line, rank
        FROM doc_match JOIN placed_claims ON owner = claim_id WHERE place IS NOT NULL
    UNION ALL SELECT element_id, split_part(place, '/', 1), split_part(place, '/', 2), path, line, 0 FROM test_match JOIN placed_tests ON owner = test_id)"""
SQL_COUNTS = """counted AS (SELECT element_id,
        count(*) FILTER (surface = 'tests' AND bucket IN ('unit', 'integration', 'e2e')) AS tests, count(*) FILTER (surface = 'examples') AS examples,
        count(*) FILTER (surface = 'docs') AS docs_all, count(*) FILTER (surface = 'docs' AND bucket NOT LIKE 'proposal%') AS docs,
        count(*) FILTER (surface = 'docs' AND bucket NOT LIKE 'proposal%' AND (bucket NOT LIKE 'reference.%' OR bucket IN ('reference.fidldoc', 'reference.clidoc'))) AS docs_rendered,
        count(*) FILTER (surface = 'docs' AND (bucket LIKE 'reference.%' OR bucket IN ('concept', 'tutorial'))) AS docs_core,
        count(*) FILTER (surface = 'docs' AND (bucket LIKE 'reference.%' OR bucket IN ('concept', 'tutorial') OR bucket LIKE 'guide.%')) > 0 AS has_gap_doc,
        count(*) FILTER (surface = 'docs') > 0 AS has_any_doc,
        count(*) FILTER (surface = 'docs' AND bucket IN ('tutorial', 'concept', 'reference.fidldoc', 'reference.clidoc') AND rank >= 3) > 0 AS has_substantive_doc,
        count(*) FILTER (surface = 'docs' AND bucket LIKE 'reference.%' AND rank = 2) > 0 AS thin_reference,
        coalesce(max(CASE WHEN surface = 'docs' THEN CASE rank WHEN 0 THEN 2 ELSE rank END END), 0) AS best_substance
        FROM evidence GROUP BY element_id)"""
SQL_PROFILES = """profiles AS (SELECT e.id AS element_id, e.kind, e.library, coalesce(tests, 0) AS tests, coalesce(examples, 0) AS examples, coalesce(docs_all, 0) AS docs_all,
        coalesce(docs, 0) AS docs, coalesce(docs_rendered, 0) AS docs_rendered, coalesce(docs_core, 0) AS docs_core, coalesce(has_gap_doc, FALSE) AS has_gap_doc,
        coalesce(has_any_doc, FALSE) AS has_any_doc, coalesce(has_substantive_doc, FALSE) AS has_substantive_doc, coalesce(thin_reference, FALSE) AS thin_reference, CAST(coalesce(best_substance, 0) AS INT) AS best_substance,
        concat_ws('|', CASE WHEN NOT coalesce(has_gap_doc, FALSE) THEN 'docs.reference' END, CASE WHEN coalesce(examples, 0) = 0 THEN 'examples' END, CASE WHEN coalesce(tests, 0) = 0 THEN 'tests' END) AS missing
        FROM elements e LEFT JOIN counted ON element_id = e.id)"""
BASE = with_relations("raw_tests", "claims", "file_times") + ", " + SQL_TESTS + ", " + SQL_ALIASED
MATCHED = BASE + ", " + SQL_DOC_MATCH + ", " + SQL_TEST_MATCH
EVIDENCE = MATCHED + ", " + SQL_CLAIMS + ", " + SQL_PLACES + ", " + SQL_EVIDENCE
PROFILES = EVIDENCE + ", " + SQL_COUNTS + ", " + SQL_PROFILES
SQL_FOUND = """stale AS (SELECT e.id AS element_id FROM elements e JOIN (SELECT element_id, path AS doc_path, row_number() OVER (PARTITION BY element_id ORDER BY bucket, path, line) AS k FROM evidence WHERE bucket LIKE 'reference.%') f ON f.element_id = e.id AND k = 1
        JOIN file_times d ON d.path = doc_path JOIN file_times c ON c.path = e.path WHERE doc_path <> e.path AND c.ts - d.ts >= 90 * 86400),
    found AS (SELECT concat('documented-untested:DOCUMENTED_UNTESTED:', element_id) AS id, 'DOCUMENTED_UNTESTED' AS kind, element_id AS subject, 'WARNING' AS severity, 'documented-untested' AS analyzer FROM profiles WHERE kind = 'METHOD' AND has_substantive_doc AND tests = 0
    UNION ALL SELECT concat('tested-undocumented:TESTED_UNDOCUMENTED:', element_id), 'TESTED_UNDOCUMENTED', element_id, 'WARNING', 'tested-undocumented' FROM profiles WHERE kind IN ('METHOD', 'FLAG', 'SUBCOMMAND') AND tests > 0 AND NOT has_any_doc
    UNION ALL SELECT DISTINCT concat('thin-reference:THIN_REFERENCE:', element_id), 'THIN_REFERENCE', element_id, 'INFO', 'thin-reference' FROM evidence WHERE bucket LIKE 'reference.%' AND rank > 0 AND rank <= 2
    UNION ALL SELECT concat('external-mention-only:EXTERNAL_MENTION_ONLY:', element_id), 'EXTERNAL_MENTION_ONLY', element_id, 'WARNING', 'external-mention-only' FROM profiles p WHERE kind IN ('METHOD', 'FLAG', 'SUBCOMMAND') AND NOT has_substantive_doc
        AND EXISTS (SELECT 1 FROM evidence v WHERE v.element_id = p.element_id AND surface = 'docs' AND bucket IN ('concept', 'tutorial') AND rank < 3)
    UNION ALL SELECT concat('missing-in-category:MISSING_IN_CATEGORY:', element_id, ':', s, '.', b), 'MISSING_IN_CATEGORY', element_id, 'WARNING', 'missing-in-category' FROM profiles p, (VALUES ('tests', 'e2e'), ('docs', 'tutorial')) w(s, b)
        WHERE NOT EXISTS (SELECT 1 FROM evidence v WHERE v.element_id = p.element_id AND v.surface = s AND v.bucket = b)
    UNION ALL SELECT concat('stale-doc:STALE_DOC:', element_id), 'STALE_DOC', element_id, 'WARNING', 'stale-doc' FROM stale)"""
SQL_FINDINGS = SQL_FOUND + """, findings AS (SELECT * FROM found WHERE subject NOT IN (SELECT id FROM elements WHERE starts_with(path, 'src/lib7/')))"""
SQL_DRIFT = """drift AS (SELECT subject AS element_id, CASE WHEN count(*) FILTER (kind = 'STALE_DOC') > 0 THEN 'time' ELSE 'domain' END AS drift FROM found
        WHERE kind IN ('STALE_DOC', 'TESTED_UNDOCUMENTED', 'EXTERNAL_MENTION_ONLY') GROUP BY subject)"""
SQL_ROWS = """report AS (SELECT p.element_id, p.library, e.ecosystem, has_gap_doc AS concept, tests > 0 AS test, examples > 0 AS example,
        e.removed NOT IN ('', 'NEXT') AS removed, e.deprecated AS deprecated, d.drift,
        EXISTS (SELECT 1 FROM evidence v WHERE v.element_id = p.element_id AND bucket = 'reference.workflows') AS workflow,
        CASE e.ecosystem WHEN 'fidl' THEN CASE p.kind WHEN 'METHOD' THEN 'primary' WHEN 'TYPE' THEN 'other' ELSE 'none' END
            WHEN 'cli' THEN CASE p.kind WHEN 'SUBCOMMAND' THEN 'primary' WHEN 'FLAG' THEN 'modifier' ELSE 'none' END
            WHEN 'cpp' THEN CASE p.kind WHEN 'CPP_CLASS' THEN 'container' WHEN 'METHOD' THEN 'primary' WHEN 'TYPE' THEN 'other' ELSE 'none' END
            ELSE CASE p.kind WHEN 'TYPE' THEN 'container' WHEN 'CONFIG_KNOB' THEN 'primary' ELSE 'none' END END AS tier,
        CASE p.kind WHEN 'CPP_CLASS' THEN tests > 0 WHEN 'METHOD' THEN has_gap_doc AND examples > 0 AND e.p_partkey % 2 = 0 WHEN 'TYPE' THEN has_gap_doc AND examples > 0 AND e.p_partkey % 2 = 0 ELSE has_gap_doc AND examples > 0 AND tests > 0 END AS bridged, e.p_partkey % 2 = 0 AS impl, p.kind
        FROM profiles p JOIN elements e ON e.id = p.element_id LEFT JOIN drift d ON d.element_id = p.element_id)"""
REPORT = PROFILES + ", " + SQL_FOUND + ", " + SQL_DRIFT + ", " + SQL_ROWS


def _percent(n: str, total: str) -> str:
    return f"CAST(CASE WHEN {total} = 0 THEN 0 ELSE least(100, ({n} * 100 + {total} // 2) // {total}) END AS BIGINT)"


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_first(relation(spark, sf_dir, "raw_tests"), "test_id", *TEST_ORDER)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "claims").withColumn("w", T.word_count(F.col("text")) % FOLD).drop("text")
    rank = F.when(F.col("adapter") == "clidoc", T.substance_rank(F.col("w"), cli=True)).otherwise(T.substance_rank(F.col("w")))
    return rows.withColumn("rank", rank)


def refs(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("owner"), "ref")


def evidence_rows(spark: SparkSession, sf_dir: str, surface: str | None = None) -> DataFrame:
    """All evidence, or that of one surface; a test's rows share their surface, so others go before one row is chosen."""
    els, docs, cases = corpus.elements(spark, sf_dir), claims(spark, sf_dir), relation(spark, sf_dir, "raw_tests")
    none = F.array().cast("array<string>")
    first = lambda path: F.coalesce(F.try_element_at(evidence.categories(path, none, RULES), F.lit(1)), F.lit(""))
    docs = docs.withColumn("place", evidence.doc_bucket(F.col("kind"), F.col("adapter"), first(F.col("path")), F.col("tier")))
    place = evidence.test_bucket(first(F.col("path")), F.col("tier"))
    if surface is not None:
        docs, cases = docs.where(F.col("place").startswith(surface + "/")), cases.where(place.startswith(surface + "/"))
    cases = merge.union_first(cases, "test_id", *TEST_ORDER).withColumn("place", place).withColumn("rank", F.lit(0))
    columns = ("ref", "place", "path", "line", "rank")
    doc_hits = matching.matched(docs.where(F.col("place").isNotNull()).select(*columns), matching.doc_keys(els)).drop("ref")
    test_hits = matching.matched(cases.select(*columns), matching.test_keys(els)).drop("ref")
    return evidence.evidence(doc_hits, test_hits.select(doc_hits.columns))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.profiles(corpus.elements(spark, sf_dir), evidence_rows(spark, sf_dir))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.csv_rows(profile_rows(spark, sf_dir))


def analyzed(spark: SparkSession, sf_dir: str) -> findings.Corpus:
    """What analyzers read; evidence and profiles have several readers, so they are written once."""
    els, rows = corpus.elements(spark, sf_dir), graph.cut(evidence_rows(spark, sf_dir))
    return findings.Corpus(els, graph.cut(evidence.profiles(els, rows)), rows, relation(spark, sf_dir, "file_times"))


ANALYZERS: dict[str, dict] = {
    "documented-untested": {},
    "tested-undocumented": {},
    "thin-reference": {"severity": "INFO"},
    "external-mention-only": {},
    "missing-in-category": {"places": [("tests", "e2e"), ("docs", "tutorial")]},
    "stale-doc": {"max_lag_days": 90},
}


def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.analyze(analyzed(spark, sf_dir), ANALYZERS, ["src/lib7/**"])


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an element with its flags, as all rollups use it."""
    known = analyzed(spark, sf_dir)
    els, own, rows = known.elements, known.profiles, known.evidence
    parts = findings.found(known, {n: ANALYZERS[n] for n in ("stale-doc", "tested-undocumented", "external-mention-only")})
    drift = rollups.drift(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    flows = rows.where("bucket = 'reference.workflows'").select("element_id").distinct().withColumn("workflow", F.lit(True))
    base = own.join(els.select(F.col("id").alias("element_id"), "ecosystem", T.removed_at(F.col("removed"), "HEAD").alias("removed"), "deprecated", (F.col("p_partkey") % 2 == 0).alias("impl")), "element_id")
    base = base.join(drift, "element_id", "left").join(flows, "element_id", "left").withColumn("workflow", F.coalesce("workflow", F.lit(False)))
    base = base.withColumn("concept", F.col("has_gap_doc")).withColumn("test", F.col("tests") > 0).withColumn("example", F.col("examples") > 0)
    return base.withColumn("tier", ecosystems.tier_of(F.col("ecosystem"), F.col("kind"))).withColumn("bridged", rollups.bridged(F.col("kind")))


def q_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = corpus.load(spark, sf_dir, "nation")
    a = nation.select(F.concat(F.lit("N/"), F.col("n_nationkey").cast("string")).alias("id"), "n_nationkey")
    pairs = graph.template_bridge(a, nation.select(F.col("n_name").alias("id")), F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")))
    supplier = corpus.load(spark, sf_dir, "supplier")
    customer = corpus.load(spark, sf_dir, "customer")
    rows = supplier.select(F.concat(F.lit("N/"), F.col("s_nationkey").cast("string")).alias("element_id"), F.lit("s").alias("source")).unionByName(customer.select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("element_id"), F.lit("c").alias("source")))
    return graph.bridge_evidence(rows, pairs).groupBy("element_id", "source").agg(F.count(F.lit(1)).alias("n"))


def q_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = relation(spark, sf_dir, "edges")
    nodes = edges.select(F.col("src").alias("protocol")).union(edges.select("dst")).distinct()
    methods = nodes.withColumn("method", F.explode(F.array(F.lit("Open"), F.concat(F.lit("Get"), F.substring("protocol", 1, 1)), F.concat(F.lit("Do"), F.length("protocol").cast("string")))))
    return graph.inherited_methods(methods.where("method <> 'Open' or protocol like 'A%'"), graph.closure(edges))




def q_alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.load(spark, sf_dir, "part")
    commands = part.select(F.concat(F.lit("cmd"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" sub")).otherwise(F.lit(""))).alias("id"), "p_partkey")
    target = F.expr("p_partkey * 2 + 1")
    aliases = F.array(F.concat(F.lit("cmd"), target.cast("string")), F.concat(F.lit("x"), F.col("p_partkey").cast("string")))
    return graph.alias_groups(commands.select("id", F.when(F.col("p_partkey") % 3 == 0, aliases).otherwise(F.array().cast("array<string>")).alias("aliases"))).select("id", F.array_join("aliases", ",").alias("aliases"))


KNOBS = """SELECT CASE p_partkey % 3 WHEN 0 THEN concat('argh:m', CAST(p_partkey AS STRING), ' --', replace(p_name, ' ', '-')) WHEN 1 THEN concat('cml:lib/k', CAST(p_partkey AS STRING), '/', replace(p_name, ' ', '__'))
        ELSE concat('lib.k', CAST(p_partkey AS STRING), '/', upper(substr(p_name, 1, 1)), substr(replace(p_name, ' ', 'X'), 2)) END AS id, concat(p_type, CAST(CAST(floor(p_partkey / 2000) AS BIGINT) AS STRING)) AS kind, p_brand AS type,
        CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size % 3 AS STRING) END AS max_size, CAST(p_partkey % 4 AS STRING) AS max_count, CAST(p_partkey % 7 AS STRING) AS default_value FROM {part}"""


def q_affordances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.affordances(spark.sql(KNOBS, part=corpus.load(spark, sf_dir, "part")))


def q_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report_rows(spark, sf_dir)
    n = lambda c: F.count_if(F.col(c)).alias(f"{c}_n")
    sums = rows.groupBy("ecosystem", "tier").agg(F.count(F.lit(1)).alias("total"), n("concept"), n("test"), n("example"), n("impl"), F.count_if(F.col("test") & F.col("impl")).alias("in_n"), F.sum("examples").alias("shown"))
    surfaces = {"concept": "concept_n", "test": "test_n", "example": "example_n", "implementations": "impl_n"}
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("surface"), F.col(c).alias("n")) for k, c in surfaces.items()))).alias("s")
    cells = sums.select("ecosystem", "tier", "total", "in_n", "shown", listed).select("*", "s.surface", "s.n")
    chip = rollups.confidence_chip(F.col("surface"), F.col("n"), F.col("total"), F.col("in_n"), F.col("shown"), F.lit(True), F.col("ecosystem"))
    return cells.select("ecosystem", "tier", "surface", "n", chip.alias("chip"))


def q_findings_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q_findings(spark, sf_dir)
    return findings.by_library(found, corpus.elements(spark, sf_dir).select("library")).groupBy("library", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.anomalies(q_findings(spark, sf_dir), T.severity_confidence(F.col("severity")))


def q_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.tier_rollup(report_rows(spark, sf_dir))


_FLAGS = ("concept", "test", "example", "impl", "bridged", "workflow")
_TIER_SELECT = "count(*) AS total, " + ", ".join(f"count(*) FILTER ({f}) AS {f}_n" for f in _FLAGS)
_TIER_PERCENT = ", ".join(f"{_percent(f'{f}_n', 'total')} AS {f}_percent" for f in _FLAGS)

QUERIES = {
    "coverage_report": coverage_report,
    "merge_tests": lambda s, d: tests(s, d).select("test_id", "path", "line", "tier", "ref"),
    "doc_matches": lambda s, d: matching.doc_matches(refs(claims(s, d), "claim_id"), corpus.elements(s, d)),
    "test_matches": lambda s, d: matching.test_matches(refs(tests(s, d), "test_id"), corpus.elements(s, d)),
    "evidence_buckets": lambda s, d: evidence_rows(s, d).groupBy("surface", "bucket", "rank").agg(F.count(F.lit(1)).alias("n")),
    "count_variants": lambda s, d: profile_rows(s, d),
    "findings": q_findings,
    "findings_filtered": lambda s, d: findings.selected(q_findings(s, d), ["THIN_REFERENCE", "EXTERNAL_MENTION_ONLY", "STALE_DOC"], "WARNING", 25),
    "findings_by_library": q_findings_by_library,
    "anomaly_groups": q_anomalies,
    "tier_rollup": q_tiers,
    "overlap_cube": lambda s, d: rollups.overlap_cube(report_rows(s, d)),
    "worklist": lambda s, d: rollups.worklist(report_rows(s, d), workflows=True),
    "drift_hero": lambda s, d: rollups.hero(report_rows(s, d)),
    "library_completeness": lambda s, d: rollups.completeness(report_rows(s, d)),
    "library_deprecation": lambda s, d: rollups.deprecation(report_rows(s, d)),
    "library_counts": lambda s, d: rollups.libraries(corpus.elements(s, d), findings.by_library(q_findings(s, d), corpus.elements(s, d).select("library"))),
    "usage": lambda s, d: rollups.usage(report_rows(s, d)),
    "monorepo": lambda s, d: rollups.monorepo(report_rows(s, d).groupBy(F.col("ecosystem").alias("library"), F.col("library").alias("member")).agg(F.count(F.lit(1)).alias("total"), F.count_if("concept").alias("docs"), F.count_if("test").alias("tests"), F.count_if("example").alias("examples"))),
    "same_as_bridge": q_same_as,
    "closure": lambda s, d: graph.closure(relation(s, d, "edges")),
    "inherited_methods": q_inherited,
    "alias_groups": q_alias_groups,
    "affordances": q_affordances,
    "confidence_chips": q_chips,
}

_CLOSURE = """RECURSIVE edges AS ({edges}), walk AS (SELECT src, dst, 1 AS depth FROM edges WHERE src <> dst
    UNION SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.dst = e.src WHERE w.src <> e.dst AND w.depth < 12)""".format(edges=corpus.RELATIONS["edges"])

ORACLE_SQL = {
    "coverage_report": PROFILES + "SELECT element_id, tests, docs, examples, missing FROM profiles",
    "merge_tests": BASE + "SELECT test_id, path, line, tier, ref FROM tests",
    "doc_matches": MATCHED + "SELECT * FROM doc_match",
    "test_matches": MATCHED + "SELECT * FROM test_match",
    "evidence_buckets": EVIDENCE + "SELECT surface, bucket, CAST(rank AS INT) AS rank, count(*) AS n FROM evidence GROUP BY ALL",
    "count_variants": PROFILES + "SELECT * FROM profiles",
    "findings": PROFILES + ", " + SQL_FINDINGS + "SELECT * FROM findings",
    "findings_filtered": PROFILES + ", " + SQL_FINDINGS + "SELECT * FROM findings WHERE kind IN ('THIN_REFERENCE', 'EXTERNAL_MENTION_ONLY', 'STALE_DOC') AND severity IN ('WARNING', 'ERROR') ORDER BY subject, CASE kind WHEN 'STALE_DOC' THEN 7 ELSE 5 END, id LIMIT 25",
    "findings_by_library": PROFILES + ", " + SQL_FINDINGS + "SELECT split_part(subject, '/', 1) AS library, kind, count(*) AS n FROM findings GROUP BY ALL",
    "anomaly_groups": PROFILES + ", " + SQL_FINDINGS + "SELECT kind AS cause, count(*) AS n, min(c) AS low, max(c) AS high FROM (SELECT kind, CAST(CASE severity WHEN 'ERROR' THEN 0.9 WHEN 'WARNING' THEN 0.7 WHEN 'INFO' THEN 0.55 ELSE 0.5 END AS DOUBLE) AS c FROM findings) GROUP BY kind",
    "tier_rollup": REPORT + f"SELECT tier, total, {', '.join(f'{f}_n' for f in _FLAGS)}, {_TIER_PERCENT} FROM (SELECT coalesce(tier, 'all') AS tier, {_TIER_SELECT} FROM report WHERE NOT removed GROUP BY ROLLUP (tier))",
    "overlap_cube": REPORT + f"SELECT c AS concept, t AS test, e AS example, n, {_percent('n', 'CAST(sum(n) OVER () AS BIGINT)')} AS percent, {_percent('n', 'max(n) OVER ()')} AS bar FROM (SELECT c, t, e, count(element_id) AS n FROM (VALUES (TRUE), (FALSE)) a(c), (VALUES (TRUE), (FALSE)) b(t), (VALUES (TRUE), (FALSE)) d(e) LEFT JOIN report ON concept = c AND test = t AND example = e AND NOT removed GROUP BY c, t, e)",
    "worklist": REPORT + """SELECT * FROM (SELECT element_id, CASE WHEN removed THEN 'removed' WHEN bridged AND drift IS NULL THEN NULL WHEN deprecated THEN 'deprecated' WHEN drift = 'time' THEN 'time' WHEN drift = 'domain' THEN 'domain'
        WHEN NOT concept AND NOT test AND NOT example THEN 'orphan' WHEN kind NOT IN ('METHOD', 'TYPE') AND NOT test THEN 'untested' WHEN NOT example THEN 'noexample' WHEN concept AND test AND NOT workflow THEN 'noworkflow' END AS reason FROM report) WHERE reason IS NOT NULL""",
    "drift_hero": REPORT + """, sums AS (SELECT count(*) FILTER (drift = 'domain') AS domain_drift, count(*) FILTER (drift = 'time') AS time_drift, count(*) FILTER (NOT bridged AND drift IS NULL AND kind NOT IN ('METHOD', 'TYPE') AND NOT test) AS untested,
        count(*) FILTER (NOT bridged AND drift IS NULL AND (kind IN ('METHOD', 'TYPE') OR test) AND NOT example) AS no_example, count(*) FILTER (drift IS NULL) AS drift_free FROM report)
        SELECT domain_drift, time_drift, CASE WHEN domain_drift + time_drift = 0 THEN untested END AS untested, CASE WHEN domain_drift + time_drift = 0 THEN no_example END AS no_example, drift_free FROM sums""",
    "library_completeness": REPORT + "SELECT library, CAST(concept AS INT) + CAST(test AS INT) + CAST(example AS INT) AS score, count(*) AS n FROM report WHERE NOT removed GROUP BY ALL",
    "library_deprecation": REPORT + "SELECT library, count(*) AS n, count(*) FILTER (deprecated) AS deprecated_n, count(*) FILTER (deprecated) * 2 >= count(*) AS deprecated FROM report GROUP BY library",
    "library_counts": PROFILES + ", " + SQL_FINDINGS + "SELECT library, count(*) AS elements, coalesce(max(n), 0) AS findings FROM elements LEFT JOIN (SELECT split_part(subject, '/', 1) AS lib, count(*) AS n FROM findings GROUP BY 1) ON lib = library GROUP BY library",
    "usage": REPORT + "SELECT count(*) FILTER (example OR workflow) AS used, count(*) AS total FROM report",
    "monorepo": REPORT + f""", members AS (SELECT ecosystem AS library, library AS member, count(*) AS total, count(*) FILTER (concept) AS docs, count(*) FILTER (test) AS tests, count(*) FILTER (example) AS examples FROM report GROUP BY 1, 2),
        shares AS (SELECT *, {_percent('docs', 'total')} AS dp, {_percent('tests', 'total')} AS tp, {_percent('examples', 'total')} AS ep FROM members),
        sums AS (SELECT library, count(*) AS members, CAST(sum(total) AS BIGINT) AS total, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tests) AS BIGINT) AS tests, CAST(sum(examples) AS BIGINT) AS examples,
            CAST(floor(quantile_cont(dp, 0.5) + 0.5) AS BIGINT) AS docs_median, CAST(floor(quantile_cont(tp, 0.5) + 0.5) AS BIGINT) AS tests_median, CAST(floor(quantile_cont(ep, 0.5) + 0.5) AS BIGINT) AS examples_median FROM shares GROUP BY library)
        SELECT *, CAST(floor((docs_median + tests_median + examples_median) / 3 + 0.5) AS BIGINT) AS cover,
            CASE least(docs_median, tests_median, examples_median) WHEN docs_median THEN 'docs' WHEN tests_median THEN 'tests' ELSE 'examples' END AS weakest FROM sums""",
    "same_as_bridge": """WITH rows_ AS (SELECT concat('N/', CAST(s_nationkey AS STRING)) AS element_id, 's' AS source FROM supplier UNION ALL SELECT concat('NATION_', CAST(c_nationkey AS STRING)), 'c' FROM customer),
        pairs AS (SELECT concat('N/', CAST(n_nationkey AS STRING)) AS a, n_name AS b FROM nation WHERE n_name = concat('NATION_', CAST(n_nationkey AS STRING)))
        SELECT element_id, source, count(*) AS n FROM (SELECT * FROM rows_ UNION ALL SELECT b, source FROM rows_ JOIN pairs ON a = element_id UNION ALL SELECT a, source FROM rows_ JOIN pairs ON b = element_id) GROUP BY ALL""",
    "closure": f"WITH {_CLOSURE} SELECT src, dst, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY src, dst",
    "inherited_methods": f"""WITH {_CLOSURE}, reach AS (SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst), nodes AS (SELECT src AS protocol FROM edges UNION SELECT dst FROM edges),
        methods AS (SELECT * FROM (SELECT protocol, unnest(['Open', concat('Get', substr(protocol, 1, 1)), concat('Do', CAST(length(protocol) AS STRING))]) AS method FROM nodes) WHERE method <> 'Open' OR protocol LIKE 'A%'),
        met AS (SELECT r.src, r.dst, m.method, row_number() OVER (PARTITION BY r.src, m.method ORDER BY depth, r.dst) AS k FROM reach r JOIN methods m ON m.protocol = r.dst)
        SELECT concat(src, '.', method) AS id, concat(dst, '.', method) AS parent_id FROM met WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM methods m WHERE m.protocol = met.src AND m.method = met.method)""",
    "alias_groups": """WITH RECURSIVE commands AS (SELECT concat('cmd', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN ' sub' ELSE '' END) AS id, p_partkey, p_partkey % 3 = 0 AS aliased, concat('cmd', CAST(p_partkey * 2 + 1 AS STRING)) AS alias FROM part),
        links AS (SELECT a.id AS a, b.id AS b FROM commands a JOIN commands b ON a.aliased AND a.alias = b.id), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT id AS node, id AS other FROM commands UNION SELECT r.node, e.b FROM reach r JOIN both_ e ON r.other = e.a),
        roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node), own AS (SELECT root, c.* FROM roots JOIN commands c ON c.id = node),
        heads AS (SELECT root, id AS head FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY len(string_split(id, ' ')) DESC, id) AS k FROM own) WHERE k = 1),
        names AS (SELECT root, id AS name FROM own UNION SELECT root, alias FROM own WHERE aliased UNION SELECT root, concat('x', CAST(p_partkey AS STRING)) FROM own WHERE aliased)
        SELECT head AS id, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM names n WHERE n.root = h.root AND name <> head), '') AS aliases FROM heads h""",
    "affordances": "WITH knobs AS (" + KNOBS.format(part="part") + """), named AS (SELECT *, regexp_replace(lower(regexp_replace(CASE WHEN contains(id, ' --') THEN split_part(id, ' --', 2) ELSE split_part(id, '/', -1) END, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[-_]+', '_', 'g') AS nm FROM knobs),
        sized AS (SELECT *, count(*) OVER (PARTITION BY kind, nm) AS n FROM named WHERE nm <> '')
        SELECT x.id AS a, y.id AS b, round(least(0.95, 0.70 + CASE WHEN x.type = y.type THEN 0.15 ELSE 0 END + CASE WHEN x.max_size = y.max_size AND x.max_size <> '' THEN 0.05 ELSE 0 END + CASE WHEN x.max_count = y.max_count THEN 0.05 ELSE 0 END + CASE WHEN x.default_value = y.default_value THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS score
        FROM sized x JOIN sized y ON x.kind = y.kind AND x.nm = y.nm AND x.id <> y.id WHERE x.n BETWEEN 2 AND 8""",
    "confidence_chips": REPORT + """, cells AS (SELECT ecosystem, tier, surface, count(*) AS total, count(*) FILTER (CASE surface WHEN 'concept' THEN concept WHEN 'test' THEN test WHEN 'example' THEN example ELSE impl END) AS n,
            count(*) FILTER (test AND impl) AS in_n, count(*) FILTER (example) AS shown FROM report, (VALUES ('concept'), ('test'), ('example'), ('implementations')) v(surface) GROUP BY ALL),
        shares AS (SELECT *, floor((n * 100 + total // 2) / total) AS p, floor((in_n * 100 + total // 2) / total) AS i FROM cells)
        SELECT ecosystem, tier, surface, n, CASE WHEN ecosystem <> 'cpp' THEN NULL WHEN surface = 'concept' THEN CASE WHEN p >= 100 THEN 'Verified' WHEN p = 0 THEN 'Needs tuning' ELSE 'Lower bound' END
            WHEN surface = 'test' THEN CASE WHEN n > in_n AND p > i THEN 'Needs tuning' WHEN i >= 80 THEN 'Verified' ELSE 'Lower bound' END WHEN surface = 'example' AND shown = 0 THEN 'Not measured' WHEN p >= 80 THEN 'Verified' ELSE 'Lower bound' END AS chip FROM shares""",
}
