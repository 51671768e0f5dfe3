"""Every query agrees with its SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

from skein.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert name in ORACLES, "a core query without SQL"
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted(([plain(r[names.index(c)]) for c in cols] for r in result.fetchall()), key=str)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
