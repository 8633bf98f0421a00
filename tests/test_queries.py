"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from slantree import entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.7g}" if not math.isnan(float(v)) else "nan"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = entries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    r = db.execute(entries.SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
