"""Every query that has SQL against DuckDB on the smallest tables, and fixed vectors."""

import datetime
import decimal
import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return tuple(map(norm, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def names():
    from spinlattice.catalog_queries import SQL

    return sorted(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    from spinlattice.catalog_queries import QUERIES, SQL

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(SQL[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    want = sorted(repr(tuple(norm(r[heads.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want
