"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from predio.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=key)
