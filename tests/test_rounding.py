"""Results next to a half do not depend on the order in which values are added."""

from math import floor, fsum

import pytest
from pyspark.sql import functions as F

from scholarframe import plans
from scholarframe.operators import attribution as att
from scholarframe.operators.exact import means_in_order


def test_counted_weights_have_no_order(spark):
    counts = [1, 3, 6, 7, 5, 7, 3, 6, 7, 1, 7, 6]
    rows = [(g, n, 1, 1 / n) for g in range(8) for n in (counts[g:] + counts[:g])]
    df = spark.createDataFrame(rows, "g long, n_slots long, n_affiliations long, weight double").repartition(3)
    got = {r["weight"] for r in att.counted_weights(df, "g").collect()}
    assert len(got) == 1
    assert got.pop() == pytest.approx(fsum(1 / n for n in counts), rel=1e-15)
    assert att.counted_weights(df.where(F.col("g") < 0), "g").collect() == []


def test_means_are_added_in_the_order_of_events(spark, tmp_path):
    """Events that are dealt over files in no order give the same as those of one file in order."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    events.repartition(13, "ts").write.parquet(str(tmp_path / "events.parquet"))
    want = plans.QUERIES["half_up_rounding"](spark, "/root/testdata/sf0.01")
    got = plans.QUERIES["half_up_rounding"](spark, str(tmp_path))
    sums = {}
    for r in sorted(events.collect(), key=lambda r: r["event_id"]):
        s, n = sums.get((r["event_type"], r["user_id"]), (0.0, 0))
        sums[r["event_type"], r["user_id"]] = s + r["value"], n + 1
    exact = {(*k, floor(s / n * 10 + 0.5) / 10) for k, (s, n) in sums.items()}
    assert {tuple(r) for r in want.collect()} == {tuple(r) for r in got.collect()} == exact


def test_means_in_order_leave_nulls_out(spark):
    rows = [("a", i, v) for i, v in enumerate([1e16, None, 1.0, -1e16])] + [("b", 1, None), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, value double").repartition(4)
    assert {r["g"]: r["mean"] for r in means_in_order(df, ["g"], "value", "i").collect()} == {"a": 0.0, "b": None, None: 3.0}
