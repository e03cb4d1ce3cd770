"""Components kept over batches of links against a full run."""

import random

from pyspark.sql import functions as F

from scholarframe.operators.components import connected_components
from scholarframe.streaming import incremental as inc
from scholarframe.streaming import merging
from tests.test_components import brute


def frame(spark, links):
    return spark.createDataFrame(links, "src long, dst long")


def labels(spark, store):
    return {r["vertex"]: r["component"] for r in merging.component_labels(spark, store).collect()}


def test_ten_batches(spark, tmp_path):
    rng, store, links, before = random.Random(8), str(tmp_path / "store"), [], {}
    for n in range(10):
        own = [(rng.randrange(120), rng.randrange(120)) for _ in range(9)]
        own = [x for x in own if x[0] != x[1]] + [(5, 5), (None, 3), (7, None)]
        links += own[:-3]
        assert merging.add_links(frame(spark, own), store, n)
        now = labels(spark, store)
        assert now == brute(links)
        written = {r["vertex"] for r in inc.log_rows(spark, store).where(F.col(inc.BATCH) == n).collect()}
        assert written == {v for v, c in now.items() if before.get(v) != c}  # what is as it was is not written
        before = now
        if n == 4:
            merging.add_links(frame(spark, own), store, n)  # the batch again
            assert labels(spark, store) == now
        if n == 6:
            inc.compact(spark, store, ["vertex"], [], upto=5)
            assert labels(spark, store) == now and not merging.add_links(frame(spark, own), store, 3)
    full = connected_components(frame(spark, links))
    assert labels(spark, store) == {r["vertex"]: r["component"] for r in full.collect()}


def test_empty_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    merging.add_links(frame(spark, []), store, 0)
    assert labels(spark, store) == {}
    merging.add_links(frame(spark, [(3, 2), (2, 3)]), store, 1)
    assert labels(spark, store) == {2: 2, 3: 2}
