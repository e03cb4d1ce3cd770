import random

import pytest

from scholarframe.operators.components import connected_components


def brute(links):
    root = {}

    def up(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((up(a), up(b)))
        root[y] = x
    return {k: up(k) for k in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cliques"])
def test_components(spark, kind):
    rng = random.Random(4)
    links = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)],
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(150)],
        "cliques": [(10 * c + i, 10 * c + j) for c in range(8) for i in range(7) for j in range(i)],
    }[kind]
    links = [x for x in links if x[0] != x[1]]
    got = connected_components(spark.createDataFrame(links + links[:5], "src long, dst long").repartition(4))
    assert {r["vertex"]: r["component"] for r in got.collect()} == brute(links)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).collect() == []


def test_intermediate_results_can_be_cleared(spark):
    from pathlib import Path

    from scholarframe import session

    session.clear_stored(spark)
    kept = session.stored(spark.range(5).toDF("k"), "some")
    folder = Path(kept.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert kept.count() == 5 and folder.exists()
    assert session.clear_stored(spark) == 1 and not folder.exists()
