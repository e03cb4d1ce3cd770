"""Ranks and quantiles by counting in ranges against plain ones."""

import random

import numpy as np
import pytest

from scholarframe.operators import ranks


def rows():
    rng = random.Random(2)
    out = [("wide", rng.gauss(0, 1)) for _ in range(900)] + [("heavy", float(rng.choice([0, 0, 0, 1, 2, 1e9]))) for _ in range(500)]
    out += [("skew", rng.paretovariate(0.3)) for _ in range(400)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 5.0), (None, 7.0), ("none", None), ("wide", None)]
    out += [("far", x) for x in (-1e308, 1e-300, 0.0, 1e308, 5.0)]
    return out


@pytest.mark.parametrize("most", [None, 100, 7])
def test_equal_to_plain(spark, most):
    data = rows()
    df = spark.createDataFrame(data, "c string, v double").repartition(5)
    groups = {}
    for c, v in data:
        if v is not None:
            groups.setdefault(c, []).append(v)
    got = {(r["c"], r["v"]): (r["ties"], r["below"], r["cohort_size"]) for r in ranks.cumulative(df, "v", ["c"], most).collect()}
    assert got == {(c, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for c, vs in groups.items() for v in vs}
    wanted = {"a": 0.05, "b": 0.5, "d": 0.95, "e": 0.0, "f": 1.0}
    for r in ranks.cohort_quantiles(df, "v", ["c"], wanted, most).collect():
        vs = groups.pop(r["c"])
        assert [r[k] for k in wanted] == pytest.approx(list(np.quantile(np.array(vs), list(wanted.values()))), rel=1e-12)
        assert (r["n"], r["least"], r["greatest"]) == (len(vs), min(vs), max(vs))
    assert not groups


def test_equal_to_windows(spark):
    """The same bits as Spark's own percentile over a window."""
    df = spark.createDataFrame(rows(), "c string, v double")
    df.createOrReplaceTempView("plain")
    want = spark.sql("SELECT c, percentile(v, 0.05) AS a, percentile(v, 0.3) AS b, median(v) AS d FROM plain GROUP BY c HAVING count(v) > 0").collect()
    got = ranks.cohort_quantiles(df, "v", ["c"], {"a": 0.05, "b": 0.3, "d": 0.5}, most=50).select("c", "a", "b", "d").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_no_window_holds_a_cohort(spark):
    """Ranges of a wide cohort are ordered by themselves."""
    df = spark.range(5000).selectExpr("'all' AS c", "cast(id * id % 4999 AS double) AS v")
    plan = ranks.cumulative(df, "v", ["c"], most=500)._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window" in line and "v#" in line and "ASC" in line]
    assert ordered and all("__range" in line for line in ordered)
    assert ranks.cumulative(df.limit(0), "v", ["c"]).collect() == []
