"""Every registered query with SQL equals DuckDB's answer on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from recordwell.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return ("", v)
    if isinstance(v, int | decimal.Decimal):
        return ("n", format(decimal.Decimal(v).normalize(), "f") if v else "0")
    if isinstance(v, float):
        return ("f", round(v, 6))
    if isinstance(v, datetime.date):
        return ("d", v.isoformat()[:19])
    return ("s", v)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in all_sql():
        found = duck.sql(all_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)
    else:
        assert columns
