"""Queries on lag, questions on the corpus, scopes and search terms, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings, graph, matching, ops, panels, rollups
from . import corpus
from .corpus import load, relation, with_relations
from .coverage import ANALYZERS, BASE, EVIDENCE, PROFILES, SQL_FINDINGS, analyzed, evidence_rows, profile_rows, q_findings, tests

#: A seventh of the documents have no time, a quarter have one for their line.
TIMES = """SELECT path, 0 AS line, CAST(788918400 + doc_id * 37 % 500 * 86400 AS BIGINT) AS ts FROM claims WHERE doc_id % 7 <> 0
    UNION ALL SELECT path, line, CAST(788918400 + doc_id * 41 % 600 * 86400 AS BIGINT) AS ts FROM claims WHERE doc_id % 4 = 0
    UNION ALL SELECT path, 0 AS line, ts FROM file_times WHERE path LIKE 'src/lib%'"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = corpus.elements(spark, sf_dir)
    inside = els.where("p_partkey % 9 = 0").select(F.col("id").alias("element_id"), "path", "line")
    refs = evidence_rows(spark, sf_dir, "docs").select("element_id", "path", "line").unionByName(inside)
    parts = {n: relation(spark, sf_dir, n) for n in ("claims", "file_times")}
    times = graph.cut(spark.sql(TIMES.replace("FROM claims", "FROM {claims}").replace("FROM file_times", "FROM {file_times}"), **parts))
    return rollups.lag_pairs(els, refs, times, tracked=times.select("path").where("path not like '%/fr/%'"))


def q_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    els = corpus.elements(spark, sf_dir)
    ids = els.where("p_partkey % 20 = 0").select(F.col("id").alias("element_id"))
    return ops.query_contract(els, profile_rows(spark, sf_dir), ids, "docs")


def q_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = analyzed(spark, sf_dir)
    return ops.list_libraries(known.elements, known.profiles, findings.analyze(known, ANALYZERS, ["src/lib7/**"]))


def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.corpus_statistics(elements=corpus.elements(spark, sf_dir), tests=tests(spark, sf_dir), claims=relation(spark, sf_dir, "claims"))


def q_claim_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").selectExpr("concat('d/', CAST(l_suppkey AS STRING), '.md') AS path", "CAST(l_partkey % 50 AS INT) AS line", "CAST(l_linenumber AS INT) AS column", "l_returnflag AS kind", "l_linestatus AS adapter", "array(CAST(l_orderkey AS STRING), l_returnflag) AS refs", "CAST(l_quantity AS STRING) AS raw_text")
    return ops.claim_places(rows).groupBy("path", F.col("line"), "kind").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


def q_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = load(spark, sf_dir, "part").selectExpr("concat('lib', CAST(p_size AS STRING)) AS library", "concat('P.', CASE WHEN p_partkey % 3 = 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, instr(p_name, ' ') - 2)) ELSE concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, instr(p_name, ' ') - 2), 'Up', substr(p_name, instr(p_name, ' ') + 1)) END) AS id")
    return matching.prefix_collisions(named).select("library", "token", F.array_join("siblings", ",").alias("siblings"))


TERMS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('lib/', replace(p_name, ' ', '.')) WHEN 1 THEN concat('tool run --', replace(p_name, ' ', '-')) WHEN 2 THEN 'tool --Config' WHEN 3 THEN 'lib/Plain' WHEN 4 THEN concat('gen/a::', replace(p_name, ' ', '_')) ELSE 'tool run' END AS id,
    CASE p_partkey % 6 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'FLAG' WHEN 2 THEN 'SWITCH' WHEN 3 THEN 'TYPE' WHEN 4 THEN 'CPP_CLASS' ELSE 'SUBCOMMAND' END AS kind,
    CASE p_partkey % 5 WHEN 0 THEN 'google.protobuf.x' WHEN 1 THEN 'www' WHEN 2 THEN 'gen.v1' WHEN 3 THEN concat('gen.v1.', p_brand) ELSE p_type END AS package FROM {part}"""


def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(TERMS, part=load(spark, sf_dir, "part"))
    scope = T.library_in_scope(F.col("package"), ["gen.*"], ["ECONOMY"], ["gen.v1"])
    return rows.select("p_partkey", T.search_term(F.col("id"), F.col("kind")).alias("term"), T.is_noise_package(F.col("package")).alias("noise"), scope.alias("in_scope"))


CARDS = """SELECT l_partkey AS element_id, CASE l_returnflag WHEN 'A' THEN 'docs' WHEN 'R' THEN 'tests' ELSE 'examples' END AS surface,
    concat('f', CAST(l_suppkey AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN '.go' ELSE '.md' END) AS path, CAST(l_linenumber * 5 AS INT) AS line FROM {lineitem}"""
CARD_FILES = """SELECT concat('f', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN '.go' ELSE '.md' END) AS path,
    array_join(transform(sequence(1, CAST(12 + s_suppkey % 9 AS INT)), i -> concat('x', CAST(i AS STRING))), '\n') AS text FROM {supplier}"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CARDS, lineitem=load(spark, sf_dir, "lineitem"))
    return panels.cards(rows, spark.sql(CARD_FILES, supplier=load(spark, sf_dir, "supplier")))


def q_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces present and absent; the element of every third part stands where a card of it may stand."""
    els = load(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'f1.md' AS path", "5 AS line")
    found = panels.panels(els, _cards(spark, sf_dir))
    return found.select("element_id", F.array_join("present", ",").alias("present"), F.array_join("absent", ",").alias("absent"), "inline")


QUERIES = {
    "evidence_cards": lambda s, d: _cards(s, d).withColumn("place", F.col("place").cast("int")),
    "evidence_panels": q_panels,
    "lag_run": lambda s, d: rollups.lag_run(_pairs(s, d)),
    "lag_pairs": lambda s, d: _pairs(s, d).groupBy("element_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if("inline").alias("inline"), F.max("days").alias("days")),
    "query_contract": q_contracts,
    "find_coverage_gaps": lambda s, d: ops.find_coverage_gaps(q_findings(s, d), "lib3", ["stale_doc", "missing_in_category"]),
    "find_examples": lambda s, d: ops.find_examples(corpus.elements(s, d), "show lib9 economy.m9"),
    "list_libraries": q_libraries,
    "corpus_statistics": q_statistics,
    "claim_places": q_claim_places,
    "prefix_collisions": q_collisions,
    "search_terms": q_terms,
}

_PAIRS = EVIDENCE + ", times AS (" + TIMES + """), known AS (SELECT * FROM times WHERE path NOT LIKE '%/fr/%'),
    refs AS (SELECT element_id, path, line FROM evidence WHERE surface = 'docs' UNION ALL SELECT id, path, line FROM elements WHERE p_partkey % 9 = 0),
    stamped AS (SELECT r.*, e.path AS code_path, coalesce((SELECT max(ts) FROM known k WHERE k.path = r.path AND k.line = r.line AND k.line > 0), (SELECT max(ts) FROM known k WHERE k.path = r.path AND k.line = 0)) AS doc_ts,
        (SELECT max(ts) FROM known k WHERE k.path = e.path AND k.line = 0) AS code_ts FROM refs r JOIN elements e ON e.id = r.element_id),
    pairs AS (SELECT element_id, path = code_path AS inline, CASE WHEN path <> code_path THEN greatest(code_ts - doc_ts, 0) // 86400 + CASE WHEN doc_ts IS NULL OR code_ts IS NULL THEN NULL ELSE 0 END END AS days FROM stamped) """

_CARDS = "WITH own AS (SELECT DISTINCT * FROM (" + CARDS.format(lineitem="lineitem") + """)), r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY element_id, surface) AS n FROM own WINDOW w AS (PARTITION BY element_id, surface ORDER BY path, line)),
    cards AS (SELECT element_id, surface, CAST(place AS INT) AS place, path, line, rtrim(array_to_string([concat('x', i) FOR i IN range(line, least(line + CASE WHEN path LIKE '%.go' THEN 16 ELSE 12 END, 13 + CAST(substr(split_part(path, '.', 1), 2) AS INT) % 9))], chr(10))) AS excerpt, greatest(n - 3, 0) AS extra FROM r WHERE place <= 3) """

ORACLE_SQL = {
    "evidence_cards": _CARDS + "SELECT * FROM cards",
    "evidence_panels": _CARDS + """, s AS (SELECT p_partkey, coalesce(list(DISTINCT surface) FILTER (surface IS NOT NULL), []) AS have, coalesce(bool_and(path = 'f1.md' AND line = 5) FILTER (surface = 'docs'), false) AS inline FROM part LEFT JOIN cards ON element_id = p_partkey GROUP BY p_partkey)
        SELECT p_partkey AS element_id, array_to_string(list_sort(have), ',') AS present, array_to_string([x FOR x IN ['docs', 'workflows', 'tests', 'examples'] IF NOT list_contains(have, x)], ',') AS absent, inline FROM s""",
    "lag_run": _PAIRS + """SELECT count(days) AS pairs, count(*) FILTER (inline) AS inline, count(*) FILTER (NOT inline AND days IS NULL) AS unknown, count(*) FILTER (days <= 0) AS fresh, count(*) FILTER (days > 0 AND days <= 30) AS recent,
        count(*) FILTER (days > 30 AND days <= 180) AS aging, count(*) FILTER (days > 180) AS stale, CAST(floor(quantile_cont(days, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(days, 0.9) + 0.5) AS BIGINT) AS p90 FROM pairs""",
    "lag_pairs": _PAIRS + "SELECT element_id, count(*) AS refs, count(*) FILTER (inline) AS inline, max(days) AS days FROM pairs GROUP BY element_id",
    "query_contract": PROFILES + "SELECT element_id, p.kind, p.library, docs_all, docs, docs_rendered, docs_core, best_substance FROM profiles p JOIN elements e ON e.id = element_id WHERE p_partkey % 20 = 0",
    "find_coverage_gaps": PROFILES + ", " + SQL_FINDINGS + "SELECT * FROM findings WHERE (starts_with(subject, 'lib3/') OR starts_with(subject, 'lib3.')) AND kind IN ('STALE_DOC', 'MISSING_IN_CATEGORY')",
    "find_examples": with_relations("elements") + """SELECT id, CAST(len(list_filter(regexp_split_to_array(lower(id), '[ _\\-./,:!?]+'), lambda x: x IN ('show', 'lib9', 'economy', 'm9'))) AS INT) AS score FROM elements ORDER BY score DESC, id LIMIT 10""",
    "list_libraries": PROFILES + ", " + SQL_FINDINGS + "SELECT library, count(*) AS elements, count(*) AS profiles, coalesce(max(n), 0) AS findings FROM elements LEFT JOIN (SELECT split_part(subject, '/', 1) AS lib, count(*) AS n FROM findings GROUP BY 1) ON lib = library GROUP BY library",
    "corpus_statistics": BASE + "SELECT 'elements' AS relation, 'DETERMINISTIC' AS tier, count(*) AS n FROM elements UNION ALL SELECT 'tests', tier, count(*) FROM tests GROUP BY tier UNION ALL SELECT 'claims', tier, count(*) FROM claims GROUP BY tier",
    "claim_places": """WITH r AS (SELECT concat('d/', CAST(l_suppkey AS STRING), '.md') AS path, CAST(l_partkey % 50 AS INT) AS line, l_returnflag AS kind, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey % 50, l_linenumber, l_returnflag, l_linestatus, CAST(l_orderkey AS STRING), CAST(l_quantity AS STRING)) AS place FROM lineitem)
        SELECT path, line, kind, count(*) AS n, CAST(min(place) AS INT) AS first, CAST(max(place) AS INT) AS last FROM r GROUP BY path, line, kind""",
    "prefix_collisions": """WITH n AS (SELECT concat('lib', CAST(p_size AS STRING)) AS library, split_part(p_name, ' ', 1) AS token, p_partkey % 3 = 0 AS single, concat(split_part(p_name, ' ', 1), ' up', split_part(p_name, ' ', 2)) AS sibling FROM part)
        SELECT library, token, string_agg(DISTINCT sibling, ',' ORDER BY sibling) AS siblings FROM n WHERE NOT single AND EXISTS (SELECT 1 FROM n o WHERE o.single AND o.library = n.library AND o.token = n.token) GROUP BY library, token""",
    "search_terms": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN concat('--', replace(p_name, ' ', '-')) WHEN 4 THEN concat('a::', replace(p_name, ' ', '_')) ELSE '' END AS term,
        p_partkey % 5 IN (0, 1) AS noise, p_partkey % 5 = 3 OR (p_partkey % 5 = 4 AND p_type = 'ECONOMY') AS in_scope FROM part""",
}
