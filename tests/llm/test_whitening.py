"""Whitening against exact sums and an eigendecomposition of the covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarframe.llm import registry, whitening
from scholarframe.llm.whitening import jacobi, whiten

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=4):
    """Row values from whole-number sums, components from a covariance that is exact until it is rounded once."""
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    away = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    cov = np.array([[float(Fraction(sum(a[p] * a[q] for a in away), n**3)) for q in range(len(sums))] for p in range(len(sums))])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        w = np.array(d) / n @ vectors / np.sqrt(values)
        out += [(i, j + 1, n, sum(c * c for c in d), w[j], values[j] / np.trace(cov)) for j in range(k)]
    return out


def same(got, want, close=1e-8):
    got, want = sorted(got, key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[3], abs(r[4]))), sorted(want, key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[3], abs(r[4])))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in {r[1] for r in want}:
        a, b = np.array([r[4] for r in got if r[1] == j]), np.array([r[4] for r in want if r[1] == j])
        assert np.allclose(np.abs(a), np.abs(b), atol=close)
        assert abs(abs(a @ b) - b @ b) <= close * (1 + b @ b)  # one sign for all rows
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] <= 1e-4 for r in got)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = registry.QUERIES["op13_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same([tuple(r) for r in got.collect()], brute(rows))


def test_hard_cases(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(40, 6)) * [5, 3, 2, 1, 0.5, 0.2] + 100).tolist()
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(0, good[1]), (0, good[1]), (None, good[2]), (50, [0.0] * 6), (51, [-0.0] * 6), (52, None), (53, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (54, [float("nan")] + [1.0] * 5)]
    rows += [(55, [float("inf")] + [1.0] * 5), (56, [float("-inf")] + [1.0] * 5), *((100 + i, good[7]) for i in range(300))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for parts in (1, 5, 40):  # 40 factors take two rounds
        odd = df.repartition(parts).select("*", *(F.lit("z").alias(c) for c in ("id", "x", "n", "component", "part", "r")))
        same([tuple(r) for r in whiten(odd).collect()], want)
    ragged = df.unionByName(spark.createDataFrame([(900, []), (901, [1.0]), (902, [1.0] * 7)], SCHEMA))
    same([tuple(r) for r in whiten(ragged).collect()], want)


def test_fewer_components(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    got = [tuple(r) for r in whiten(spark.createDataFrame(line, SCHEMA)).collect()]
    assert {r[1] for r in got} == {1}
    same(got, brute(line, 1))


def test_large_values(spark):
    rows = [(i, [2.0**i, 1e3 * i, -5.0]) for i in range(20)]
    got = [tuple(r) for r in whiten(spark.createDataFrame(rows, SCHEMA), components=2).collect()]
    same(got, brute(rows, 2))
    huge = [(0, [1e12]), (1, [-1e12]), (2, [3.0])]
    assert [r["deviation"] for r in whiten(spark.createDataFrame(huge, SCHEMA)).orderBy("vec_id").collect()][:2] == [None, None]


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_small_deviations(d):
    """Graded columns: the smallest lengths keep their digits, which a covariance loses."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    scale = 10.0 ** -np.linspace(0, 12, d)
    lengths, v = jacobi(q * scale)
    assert np.allclose(lengths, scale, rtol=1e-13)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)


def test_factor_is_of_rows(spark):
    """R has the inner products of the centred rows, from whatever partitioning."""
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(500, 5))
    n, sums = len(x), x.sum(axis=0).astype(object)
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(70)
    r = whitening.triangular_factor(df, 5, n, sums)
    c = x - x.mean(axis=0)
    assert r.shape == (5, 5) and np.allclose(r.T @ r, c.T @ c, rtol=1e-12)
