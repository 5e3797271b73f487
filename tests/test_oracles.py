"""Every query with SQL against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    want = sorted([plain(v) for v in row] for row in duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(ORACLES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
