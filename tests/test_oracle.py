"""Every registered query with SQL against DuckDB on the same tables; the others have plain loops in other tests."""

import math

import duckdb
import pytest

from predio.plans import registered

QUERIES, SQL = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Checked in test_plain_loops and test_functions.
PLAIN = {"j17_scored_duplicates", "j17_scored_greedy", "x39_title_similarity", "x42_same_agent", "x28_found_fields", "x29_price_candidates", "r15_question_answers", "r18_chat_search", "r19_briefing"}


def test_no_query_goes_unchecked():
    assert set(QUERIES) - set(SQL) == PLAIN


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = con.sql(SQL[name])
    assert columns == sorted(want.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in con.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())
