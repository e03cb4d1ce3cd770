"""Polygons over the antimeridian."""

import pytest
from pyspark.sql import functions as F

from scholarframe.functions import geo

SCHEMA = "id int, polygon array<array<array<double>>>"


def box(west, south, east, north):
    return [[west, south], [east, south], [east, north], [west, north], [west, south]]


def pieces(spark, *polygons):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(polygons)], SCHEMA)
    return [r["p"] for r in df.select("id", geo.split_polygon(F.col("polygon")).alias("p")).orderBy("id").collect()]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2


def bounds(ring):
    return min(p[0] for p in ring), max(p[0] for p in ring)


def test_split(spark):
    over, whole, reversed_ = [box(170, 0, -170, 10)], [box(10, 0, 20, 10)], [box(170, 0, -170, 10)[::-1]]
    a, b, c = pieces(spark, [[[float(x) for x in p] for p in r] for r in over], [[[float(x) for x in p] for p in r] for r in whole], [[[float(x) for x in p] for p in r] for r in reversed_])
    assert sorted((bounds(p[0]), area(p[0])) for p in a) == sorted((bounds(p[0]), area(p[0])) for p in c) == [((-180.0, -170.0), 100.0), ((170.0, 180.0), 100.0)]
    assert all(p[0][0] == p[0][-1] and len(p) == 1 for p in a)
    assert b == [[[[float(x) for x in p] for p in whole[0]]]]


def test_slanted_edges_meet(spark):
    """A triangle over the line is cut where its edges cross; the parts add up."""
    (parts,) = pieces(spark, [[[170.0, 0.0], [-170.0, 0.0], [-170.0, 20.0], [170.0, 0.0]]])
    assert sorted(area(p[0]) for p in parts) == pytest.approx([50.0, 150.0])
    assert {tuple(q) for p in parts for q in p[0] if abs(q[0]) == 180} == {(180.0, 0.0), (180.0, 10.0), (-180.0, 0.0), (-180.0, 10.0)}


def test_holes_go_with_their_piece(spark):
    shell, east, west = box(160.0, -10.0, -160.0, 10.0), box(-178.0, -1.0, -170.0, 1.0), box(170.0, -1.0, 178.0, 1.0)
    over = box(179.0, 5.0, -179.0, 6.0)
    (parts,) = pieces(spark, [shell, east, west, over])
    got = sorted((bounds(p[0]), sorted((bounds(h), area(h)) for h in p[1:])) for p in parts)
    assert got == [((-180.0, -160.0), [((-180.0, -179.0), 1.0), ((-178.0, -170.0), 16.0)]), ((160.0, 180.0), [((170.0, 178.0), 16.0), ((179.0, 180.0), 1.0)])]


def test_edges(spark):
    touching = box(170.0, 0.0, 180.0, 1.0)
    got = pieces(spark, [touching], None, [], [box(178.0, 0.0, -178.0, 1.0), box(0.0, 0.0, 1.0, 1.0)])
    assert got[0] == [[touching]] and got[1] is None and got[2] is None and len(got[3]) == 2


def test_gathered(spark):
    far = [[box(-179.0, 60.0, -178.0, 61.0)], [box(30.0, 50.0, 170.0, 70.0)], [box(175.0, 1.0, 176.0, 2.0)]]
    df = spark.createDataFrame([(far,)], "p array<array<array<array<double>>>>")
    got = df.select(geo.gathered(F.col("p")).alias("p")).first()["p"]
    assert [bounds(p[0]) for p in got] == [(181.0, 182.0), (30.0, 170.0), (175.0, 176.0)]
