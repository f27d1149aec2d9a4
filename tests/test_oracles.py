"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import catalog

SF = os.environ.get("QUARRY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(catalog.ORACLES[name])
    assert sorted(d[0] for d in want.description) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    rows = lambda x: sorted((tuple(same(v) for v in r) for r in x), key=repr)
    assert rows([tuple(r[n] for n in names) for r in df.collect()]) == rows([tuple(r[i] for i in at) for r in want.fetchall()])


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
