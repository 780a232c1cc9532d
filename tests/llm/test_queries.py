"""The queries that SQL can express against DuckDB, and what their plans must hold to at scale."""

import duckdb
import pytest

from loomline.llm import queries

TABLES = "documents embeddings conversations pages labels benchmark".split()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect()) == expected
