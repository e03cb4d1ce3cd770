"""Differences of populations: a lost, an added and a repeated row, and incomplete members."""

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import populations as pop


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet("/root/testdata/sf0.01/orders.parquet")


@pytest.mark.parametrize("few", [1 << 20, 50])
def test_one_row_of_each_kind(spark, orders, monkeypatch, few):
    """In a whole table, whether rows are compared after the first round or drilled into."""
    monkeypatch.setattr(pop, "FEW_ROWS", few)
    key = F.col("o_orderkey")
    keys = [r[0] for r in orders.select("o_orderkey").orderBy("o_orderkey").limit(4).collect()]
    other = orders.where(key != keys[0])  # lost
    other = other.unionAll(orders.where(key == keys[1]))  # repeated
    other = other.unionAll(orders.where(key == keys[2]).withColumn("o_orderkey", F.lit(-1).cast("long")))  # added
    other = other.withColumn("o_orderstatus", F.when(key == keys[3], None).otherwise(F.col("o_orderstatus")))  # changed
    got = sorted((r["o_orderkey"], r["only_in"], r["surplus"]) for r in pop.row_differences(orders, other.repartition(9)).collect())
    assert got == sorted([(keys[0], "left", 1), (keys[1], "right", 1), (-1, "right", 1), (keys[3], "left", 1), (keys[3], "right", 1)])
    assert pop.row_differences(orders, orders.repartition(5)).collect() == []


def test_nulls_and_places(spark):
    a = spark.createDataFrame([(None, "x"), ("x", None), (None, None), (None, None)], "a string, b string")
    b = spark.createDataFrame([("x", None), ("x", None), (None, None)], "a string, b string")
    got = sorted(map(tuple, pop.row_differences(a, b).collect()), key=str)
    assert got == sorted([(None, "x", "left", 1), ("x", None, "right", 1), (None, None, "left", 1)], key=str)
    assert pop.row_differences(a.limit(0), b.limit(0)).collect() == []
    assert pop.row_differences(a.limit(0), b).agg(F.sum("surplus")).first()[0] == 3


def test_incomplete_members(spark):
    members, peers = spark.createDataFrame([(m,) for m in (1, 2, 3, 4)], "m int"), spark.createDataFrame([(p,) for p in ("a", "b", "c", "a", None)], "p string")
    seen = [(1, p) for p in "abcabc"] + [(2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "z"), (9, "a"), (None, "a"), (1, None)]
    got = sorted(map(tuple, pop.incomplete_members(members, "m", peers, "p", spark.createDataFrame(seen, "m int, p string")).collect()))
    assert got == [(2, "c", "left"), (3, "c", "left"), (3, "z", "right"), (4, "a", "left"), (4, "b", "left"), (4, "c", "left"), (9, "a", "right")]
