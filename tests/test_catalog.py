import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def names():
    from gridloom.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    import duckdb
    from gridloom.plans import catalog

    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name not in catalog.ORACLES:
        return
    con = duckdb.connect()
    for t in ("orders", "part", "lineitem", "events", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(norm(v) for v in r) for r in cur.fetchall()]
    got = [tuple(norm(r[c]) for c in cols) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
