"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from scholarframe import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns, at = sorted(got.columns), {c: i for i, c in enumerate(want.columns)}
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)
