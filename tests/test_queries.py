"""Every core query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from idforge.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if v != v else f"{v + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in registry.SQL:
        return
    want = duck.execute(registry.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert got == sorted(tuple(norm(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
