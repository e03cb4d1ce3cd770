"""Exact sums against ``math.fsum``, bit for bit."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import exact


def any_double(rng):
    while True:
        x = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        if math.isfinite(x) and abs(x) < 1e300:
            return x


def groups():
    rng = random.Random(1)
    out = {
        "cancel": [1e20, 1.0, -1e20],
        "tiny": [1e-300] * 10 + [1e-19] * 10,
        "subnormal": [5e-324, 5e-324, -1e-310, 2.2e-308],
        "tenths": [0.1] * 1000,
        "powers": [2.0**k for k in range(-1074, 1020)],
        "below powers": [math.nextafter(2.0**k, 0) for k in range(-1022, 1020, 7)],
        "half to even": [1.0, 2.0**-53],
        "over half": [1.0, 2.0**-53, 2.0**-1074],
        "zero": [-0.0, 0.0],
        "to zero": [1e300, 3.0, -3.0, -1e300],
        "nulls too": [None, 1.5, None],
        "null": [None, None],
    }
    for k in range(30):
        out[f"any {k}"] = [any_double(rng) for _ in range(60)]
        out[f"spread {k}"] = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-25, 25) for _ in range(100)]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_to_fsum(spark, parts):
    own = groups()
    rows = [(g, v) for g, vs in own.items() for v in vs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r["g"]: (r["s"], r["minus"]) for r in exact.exact_sums(df, ["g"], s=F.col("v"), minus=-F.col("v")).collect()}
    for g, vs in own.items():
        want = math.fsum(v for v in vs if v is not None) if any(v is not None for v in vs) else None
        assert got[g][0] == want, g
        assert got[g][1] == (None if want is None else -want), g


def test_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", inf), ("a", 1.0), ("b", -inf), ("c", inf), ("c", -inf), ("d", nan), ("d", 2.0), ("e", 1.7e308), ("e", 1.7e308), ("f", 1.7e308), ("f", 1.7e308), ("f", -1.7e308)]
    got = {r["g"]: r["s"] for r in exact.exact_sums(spark.createDataFrame(rows, "g string, v double"), ["g"], s=F.col("v")).collect()}
    assert math.isnan(got.pop("c")) and math.isnan(got.pop("d"))
    assert got == {"a": inf, "b": -inf, "e": inf, "f": 1.7e308}


def test_merge(spark):
    """Sums of batches, merged in any order, are those of all rows."""
    own = groups()
    df = spark.createDataFrame([(g, i % 5, v) for g, vs in own.items() for i, v in enumerate(vs)], "g string, batch int, v double")
    batches = [exact.accumulated(df.where(F.col("batch") == b), ["g"], s=F.col("v")) for b in (3, 0, 4, 2, 1)]
    every = batches[0]
    for b in batches[1:]:
        every = exact.merged(every.unionByName(b), ["g"])
    want = {r["g"]: r["s"] for r in exact.exact_sums(df, ["g"], s=F.col("v")).collect()}
    assert {r["g"]: r["s"] for r in exact.totals(every, ["g"], ["s"]).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact.exact_sums(df, ["g"], s=F.col("v")).collect() == []
    assert exact.exact_sums(spark.createDataFrame([(1, 2)], "g int, v int"), ["g"], s=F.col("v")).first()["s"] == 2.0


def test_digest_of_many_rows(spark, monkeypatch):
    """The same digest from any partitioning, in one round or in several, and another one for any change."""
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), F.sha1(F.col("id").cast("string")).alias("v"))
    for most in (1 << 16, 100, 3):
        monkeypatch.setattr(exact, "DIGEST_ROWS", most)
        own = {tuple(exact.table_digest(df.repartition(n)).first()) for n in (1, 5)}
        assert len(own) == 1 and min(own)[0] == 3000
        others = {exact.table_digest(d).first()["digest"] for d in (df.where("k > 0"), df.unionAll(df.limit(1)), df.withColumn("v", F.when(F.col("k") == 3, "x").otherwise(F.col("v"))))}
        assert len(others | {min(own)[1]}) == 4
