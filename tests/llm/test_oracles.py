"""The queries that SQL can express against their SQL, on whole tables."""

import duckdb
import pytest

from tidewatch.llm import queries as Q

TABLES = ("documents", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = Q.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]}) AS o").fetchall()
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(want)
