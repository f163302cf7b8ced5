"""Each query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from coverloom.plans import analysis, corpus, coverage, generated, naming, operations, sources

SF = "/root/testdata/sf0.001"
QUERIES = {**coverage.QUERIES, **analysis.QUERIES, **sources.QUERIES, **generated.QUERIES, **naming.QUERIES, **operations.QUERIES}
SQL = {**coverage.ORACLE_SQL, **analysis.ORACLE_SQL, **sources.ORACLE_SQL, **generated.ORACLE_SQL, **naming.ORACLE_SQL, **operations.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in corpus.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
