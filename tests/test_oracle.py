"""Every engine query that has SQL gives DuckDB's rows."""

import duckdb
import pytest

from gradloom import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    got = duck.execute(engine.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)
