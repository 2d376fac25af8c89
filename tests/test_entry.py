"""The registered queries agree with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as e

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
NAMES = [n for n in e.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        return "-" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = e.queries()[name](spark, DIR)
    want = duck.execute(e.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), names)


def test_entry_has_rows(spark):
    assert e.entry(spark).take(1)
