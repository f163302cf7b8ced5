"""Queries on text scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, grounding
from .corpus import load


def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage as a mention, with the passage's item."""
    docs = load(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    lexicon = load(spark, sf_dir, "benchmark").select(F.col("text").alias("form"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("element_id"))
    return grounding.scan(docs, lexicon).join(lexicon, "form").select("path", "element_id").distinct()


PAGES_PER_TASK = 16384
#: A page for each part: names, links, headings, emphasis and bare nouns in turn, on one common element and on the parts' own.
PAGES = """SELECT concat('d', CAST(p_partkey AS STRING), '.md') AS path, CASE p_partkey % 8
    WHEN 0 THEN concat('# Intro\n\nUse part', CAST(p_partkey AS STRING), ' things.')
    WHEN 1 THEN '# Intro\n\nA node waits.'
    WHEN 2 THEN '# Keys\n\nThe key turns.'
    WHEN 3 THEN '# Intro\n\nThe `key` turns, a key turns.'
    WHEN 4 THEN '# Intro\n\nThe [key](x/y#Key) turns.'
    WHEN 5 THEN '# Intro\n\nThe key turns.\n\n## More\n\nThe *key*, a key.\n```\nkey\n```'
    WHEN 6 THEN '# Intro\n\nSo. Keys turn.'
    ELSE '# Intro\n\nThe key turns, a key fits.' END AS text FROM {part}"""
NAMES = """SELECT concat('lib', CAST(p_size AS STRING), '/Part', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 1 THEN 'Node' ELSE 'Thing' END) AS id FROM {part} UNION ALL SELECT 'lib0/Key' AS id"""


def _grounding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part")
    # a small compressed file is one task, but many pages and names
    part = part.repartition(-(-part.count() // PAGES_PER_TASK) or 1)
    forms = grounding.lexicon(spark.sql(NAMES, part=part))
    return forms, grounding.findings(spark.sql(PAGES, part=part), forms)


def grounding_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir)[1].select("path", "line", "token", "element_id", "competing", "state", "severity", "fix")


def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by best state, and the summary."""
    rows = grounding.report_json(*_grounding(spark, sf_dir)).where("part <> 'finding'")
    read = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.groupBy("part", read("state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.max(read("forces_a_guess").cast("long")).alias("forces_a_guess"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages")
    return rows.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(<h1[ >])"), F.lit(1))).cast("long").alias("h1"))


def detected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".rst")).alias("path"), "text")
    return files.detect(docs).select("adapter", "files", F.array_join("samples", ",").alias("samples"))


QUERIES = {"mention_scan": mention_scan, "grounding_findings": grounding_findings, "grounding_report": grounding_report, "page_titles": page_titles, "detected_sources": detected_sources}

_FOUND = """WITH names AS (""" + NAMES.format(part="part") + """), p AS (SELECT *, concat('d', CAST(p_partkey AS STRING), '.md') AS path, p_partkey % 8 AS k FROM part),
    nodes AS (SELECT min(id) AS id, count(*) AS n FROM names WHERE id LIKE '%Node'),
    found AS (SELECT path, 3 AS line, concat('part', CAST(p_partkey AS STRING), ' things') AS token, concat('lib', CAST(p_size AS STRING), '/Part', CAST(p_partkey AS STRING), 'Thing') AS element_id, 1 AS competing, 'GROUNDED' AS state, 0.0 AS severity FROM p WHERE k = 0 AND p_partkey % 5 <> 1
        UNION ALL SELECT path, 3, 'node', id, n, 'GUESSING', CASE n WHEN 1 THEN 0.3 WHEN 2 THEN 0.42 ELSE 0.54 END FROM p, nodes WHERE k = 1
        UNION ALL SELECT path, 3, 'key', 'lib0/Key', 1, 'GUESSING', 0.3 FROM p WHERE k = 2
        UNION ALL SELECT path, 3, 'key', 'lib0/Key', 1, 'GROUNDED', 0.0 FROM p, range(2) WHERE k = 3
        UNION ALL SELECT path, 3, unnest(['key', 'Key']), 'lib0/Key', 1, 'GROUNDED', 0.0 FROM p WHERE k = 4
        UNION ALL SELECT path, 3, 'key', 'lib0/Key', 1, 'UNGROUNDED', 0.6 FROM p WHERE k = 5
        UNION ALL SELECT path, 7, 'key', 'lib0/Key', 1, 'GROUNDED', 0.0 FROM p, range(2) WHERE k = 5
        UNION ALL SELECT path, 3, 'Keys', 'lib0/Key', 1, 'GUESSING', 0.3 FROM p WHERE k = 6
        UNION ALL SELECT path, 3, 'key', 'lib0/Key', 1, 'UNGROUNDED', 0.64 FROM p, range(2) WHERE k = 7) """

ORACLE_SQL = {
    "grounding_findings": _FOUND + "SELECT path, line, token, element_id, CAST(competing AS BIGINT) AS competing, state, CAST(severity AS DOUBLE) AS severity, CASE state WHEN 'GUESSING' THEN 'define_term' WHEN 'UNGROUNDED' THEN 'link_first_use' END AS fix FROM found",
    "grounding_report": _FOUND + """, best AS (SELECT id, CASE WHEN count(*) FILTER (state = 'GROUNDED') > 0 THEN 'GROUNDED' WHEN count(*) FILTER (state = 'GUESSING') > 0 THEN 'GUESSING' WHEN count(state) > 0 THEN 'UNGROUNDED' ELSE 'NOT_MENTIONED' END AS state FROM names LEFT JOIN found ON element_id = id GROUP BY id)
        SELECT 'element' AS part, state, count(*) AS n, CAST(NULL AS BIGINT) AS forces_a_guess FROM best GROUP BY state UNION ALL SELECT 'summary', NULL, 1, count(*) FILTER (state <> 'GROUNDED') FROM found""",
    "mention_scan": "SELECT DISTINCT concat('d', CAST(doc_id AS STRING)) AS path, concat('b', CAST(item_id AS STRING)) AS element_id FROM documents d JOIN benchmark b ON contains(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(b.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<h1[ >]')) AS BIGINT) AS h1 FROM pages",
    "detected_sources": """WITH p AS (SELECT concat(source, '/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.rst' END) AS path, CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'rst' END AS adapter FROM documents)
        SELECT adapter, count(*) AS files, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM p q WHERE q.adapter = p.adapter ORDER BY path LIMIT 5)) AS samples FROM p GROUP BY adapter""",
}
