"""Keyed state with timers: a stream in batches against the table, and timers that fire without input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholarframe.streaming import recheck

DAY0 = datetime(2024, 1, 1)


def day(d):
    return DAY0 + timedelta(days=d)


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    recheck.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """Batches of a stream, one file each, taken one at a time."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.n = spark, tmp_path, 0
        self.rows = []

    def give(self, *rows):
        self.n += 1
        self.rows += rows
        self.spark.createDataFrame(rows, "id string, at timestamp, revision long").coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self.run()

    def run(self):
        got = []
        stream = self.spark.readStream.schema("id string, at timestamp, revision long").parquet(f"{self.path}/in")
        found = recheck.checked(stream, "id", "at", "revision", "0 days")
        found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.path}/c").foreachBatch(lambda d, _: got.extend(map(tuple, d.collect()))).start().awaitTermination()
        return sorted(got, key=str)


def test_timer_fires_without_input(spark, tmp_path, state_store):
    feed = Feed(spark, tmp_path)
    assert feed.give(("a", day(0), 1)) == [("a", "current", day(0), 1)]
    assert feed.give(("b", day(3), 1)) == [("b", "current", day(3), 1)]
    # input for b alone moves event time on; a becomes due
    assert feed.give(("b", day(8), 2)) == [("a", "due", day(7), 1), ("b", "current", day(8), 2), ("b", "superseded", day(8), 1)]
    # a revised after it was due: no second time due for the old one; a late revision of b is no revision
    assert feed.give(("a", day(9), 2), ("b", day(8), 1)) == [("a", "current", day(9), 2), ("a", "superseded", day(9), 1)]
    assert feed.give(("c", day(40), 1)) == [("a", "due", day(16), 2), ("b", "due", day(15), 2), ("c", "current", day(40), 1)]


def test_stream_equals_table(spark, tmp_path, state_store):
    import random

    rng = random.Random(4)
    rows = sorted({(rng.choice("abcdef"), DAY0 + timedelta(hours=rng.randint(0, 24 * 90)), rng.randint(1, 3)) for _ in range(150)}, key=lambda r: r[1])
    rows += [("a", None, 1), (None, day(1), 1), ("a", day(95), None)]
    feed, got = Feed(spark, tmp_path), []
    for k in range(0, 150, 40):
        got += feed.give(*rows[k : k + 40])
    got += feed.give(*rows[160:], ("z", day(200), 1))
    table = spark.createDataFrame([*rows, ("z", day(200), 1)], "id string, at timestamp, revision long")
    want = recheck.checks(table, "id", "at", "revision", F.lit(day(200))).collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)


def test_table_literals(spark):
    df = spark.createDataFrame([("a", day(0), 1), ("a", day(2), 2), ("a", day(2), 1), ("a", day(9), 3), ("a", day(0), 1)], "id string, at timestamp, revision long")
    want = [
        ("a", "current", day(0), 1), ("a", "superseded", day(2), 1), ("a", "current", day(2), 1), ("a", "superseded", day(2), 1),
        ("a", "current", day(2), 2), ("a", "due", day(9), 2), ("a", "superseded", day(9), 2), ("a", "current", day(9), 3),
    ]
    assert sorted(map(tuple, recheck.checks(df, "id", "at", "revision", F.lit(day(10))).collect())) == sorted(want)
    assert recheck.checks(df.limit(0), "id", "at", "revision", F.lit(day(10))).count() == 0
