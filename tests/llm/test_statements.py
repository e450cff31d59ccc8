"""The operators that SQL can express, against their DuckDB statements."""

import duckdb
import pytest

from noteframe.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    rows = sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))
    assert rows and rows == sorted(tuple(map(str, r)) for r in got.fetchall())
