"""Relations of a contract corpus derived from the driver's tables, in SQL that Spark and DuckDB both run.

`part` gives elements, `lineitem` tests, `documents` documentation claims, `orders` timestamps, and
`supplier`, `nation` and `region` composition edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import shuffled
from ..session import reachable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS: dict[str, str] = {
    "elements": """
        SELECT concat('lib', CAST(p_size AS STRING), '/', p_type, '.M', CAST(p_partkey AS STRING)) AS id,
               CASE p_partkey % 6 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'FLAG' WHEN 3 THEN 'SUBCOMMAND' WHEN 4 THEN 'CONFIG_KNOB' ELSE 'CPP_CLASS' END AS kind,
               CASE p_size % 4 WHEN 0 THEN 'fidl' WHEN 1 THEN 'cli' WHEN 2 THEN 'cpp' ELSE 'crd' END AS ecosystem,
               concat('lib', CAST(p_size AS STRING)) AS library, p_name AS name, p_type AS type, p_brand AS owner,
               CAST(p_partkey % 7 AS STRING) AS default_value,
               concat('src/lib', CAST(p_size AS STRING), '/', lower(p_type), '.fidl') AS path, CAST(p_partkey % 400 + 1 AS INT) AS line,
               concat('lib', CAST(p_size AS STRING), '.', p_type, '.M', CAST(p_partkey AS STRING)) AS alias,
               CASE WHEN p_partkey % 23 = 0 THEN 'HEAD' WHEN p_partkey % 29 = 0 THEN 'NEXT' WHEN p_partkey % 31 = 0 THEN CAST(p_size AS STRING) ELSE '' END AS removed,
               p_partkey % 17 = 0 OR p_size % 9 = 0 AS deprecated, p_partkey
        FROM part""",
    "raw_tests": """
        SELECT concat('t', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS test_id,
               concat(CASE l_returnflag WHEN 'A' THEN 'tests/unit/' WHEN 'N' THEN 'tests/integration/' ELSE 'qa/e2e/' END, l_linestatus, '/s', CAST(l_suppkey AS STRING), '_test.go') AS path,
               CAST(l_partkey AS INT) AS line, CASE WHEN l_linenumber = 7 THEN 'LLM' ELSE 'DETERMINISTIC' END AS tier,
               CASE WHEN l_partkey % 3 <> 0 THEN concat('unknown/', e.id) ELSE CASE l_partkey % 5 WHEN 0 THEN e.alias WHEN 1 THEN concat(e.library, '/*.M', CAST(l_partkey AS STRING)) ELSE e.id END END AS ref,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate
        FROM lineitem JOIN elements e ON l_partkey = e.p_partkey""",
    "claims": """
        SELECT CAST(doc_id AS STRING) AS claim_id, doc_id, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.md') AS path, CAST(doc_id % 100 AS INT) AS line,
               CASE doc_id % 4 WHEN 0 THEN 'REFERENCE' WHEN 1 THEN 'EXAMPLE' WHEN 2 THEN 'PROSE_MENTION' ELSE 'WORKFLOW' END AS kind,
               CASE doc_id % 3 WHEN 0 THEN 'fidl' WHEN 1 THEN 'clidoc' ELSE 'markdowncli' END AS adapter,
               CASE WHEN doc_id % 11 = 0 THEN 'LLM' ELSE 'DETERMINISTIC' END AS tier,
               CASE doc_id % 5 WHEN 1 THEN concat(p_type, '.M', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('M', CAST(p_partkey AS STRING))
                    WHEN 3 THEN e.alias ELSE e.id END AS ref,
               text
        FROM documents JOIN (SELECT p_partkey, type AS p_type, id, alias FROM elements) e ON doc_id = p_partkey""",
    "edges": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS src, n_name AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'AFRICA' AS src, 'NATION_0' AS dst""",
    "file_times": """
        SELECT DISTINCT path, CAST(788918400 + p_size * 53 % 700 * 86400 AS BIGINT) AS ts FROM elements JOIN (SELECT p_partkey AS k, p_size FROM part) p ON k = p_partkey
        UNION ALL SELECT path, CAST(788918400 + doc_id * 37 % 500 * 86400 AS BIGINT) AS ts FROM claims""",
    "git_times": """
        SELECT p_partkey, id, library, CAST(max(o_epoch) AS BIGINT) AS doc_ts, CAST(max(l_epoch) AS BIGINT) AS code_ts FROM (
            SELECT e.p_partkey, e.id, e.library, CAST(floor({o_epoch}) AS BIGINT) AS o_epoch, CAST(floor({l_epoch}) AS BIGINT) AS l_epoch
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN elements e ON l_partkey = e.p_partkey) x
        GROUP BY p_partkey, id, library""",
}
_NEEDS = {"raw_tests": ("elements",), "claims": ("elements",), "file_times": ("elements", "claims"), "git_times": ("elements",)}
_EPOCH = {"spark": "unix_timestamp({0})", "duckdb": "epoch({0})"}

RULES = [
    {"dotted_path": "tests.unit", "paths": ["tests/unit/**"]},
    {"dotted_path": "tests.integration", "paths": ["tests/integration/**"]},
    {"dotted_path": "tests.e2e", "paths": ["qa/**"]},
    {"dotted_path": "docs.tutorial", "paths": ["src1/**", "src2/**"]},
    {"dotted_path": "docs.concepts", "paths": ["src3/**"]},
    {"dotted_path": "docs.guide.cookbook", "paths": ["src4/**/*.md"]},
    {"dotted_path": "docs.proposal.rfc", "paths": ["src5/*/?*.md"]},
    {"dotted_path": "docs.release_notes", "paths": ["src[67]/**"]},
]


def relation_sql(name: str, dialect: str) -> str:
    own = {"o_epoch": _EPOCH[dialect].format("o_orderdate"), "l_epoch": _EPOCH[dialect].format("l_shipdate")}
    return RELATIONS[name].format(**own) if name == "git_times" else RELATIONS[name]


def with_relations(*names: str) -> str:
    """The WITH clause of DuckDB SQL over these relations."""
    needed: list[str] = []
    for n in names:
        needed += [x for x in (*_NEEDS.get(n, ()), n) if x not in needed]
    return "WITH " + ", ".join(f"{n} AS ({relation_sql(n, 'duckdb')})" for n in needed) + "\n"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    named: dict[str, DataFrame] = {}
    for n in (*_NEEDS.get(name, ()), name):
        sql = relation_sql(n, "spark")
        used = {t: load(spark, sf_dir, t) for t in TABLES if t in sql} | {k: shuffled(v) for k, v in named.items() if k in sql}
        for k, df in used.items():
            sql = _named(sql, k)
        named[n] = spark.sql(sql, **used)
    return named[name]


def _named(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with their aliases as an array; every fifth has a dotted one."""
    return relation(spark, sf_dir, "elements").selectExpr("*", "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 3 THEN array(alias) ELSE array() END AS aliases")
