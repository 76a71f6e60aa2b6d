"""Every query with SQL against DuckDB, and the others for rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quire import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return ""
        return str(v) if isinstance(v, str) else str(round(float(v), 6))

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ours = QUERIES[name](spark, DATA).toPandas()
    assert len(ours)
    if name not in SQL:
        return
    theirs = db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
