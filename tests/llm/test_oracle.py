"""The operators' queries against their DuckDB SQL on whole tables."""

import duckdb
import pytest

from quire.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got and got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
