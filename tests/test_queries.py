"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from fathomline.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.6g}"
    return "null" if x is None else str(float(x)) if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(float(x) if isinstance(x, int) and not isinstance(x, bool) else x) for x in row] for row in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted([plain(float(row[i]) if isinstance(row[i], int) and not isinstance(row[i], bool) else row[i]) for i in order] for row in found.fetchall())
    assert got == want
