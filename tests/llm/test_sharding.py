import hashlib
from collections import Counter

import pytest

from scholarframe.llm.sharding import fill_table, place


def brute(shards, slots):
    """Whole preference lists, and turns taken one by one."""
    prefer = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefer.append([(first + k * step) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, p in enumerate(prefer):
            if len(owner) < slots:
                owner[next(x for x in p if x not in owner)] = i
    return [owner[k] for k in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 3), (3, 7), (7, 101), (16, 499)])
def test_table(n, slots):
    names = [f"s{i}" for i in range(n)]
    table = fill_table(names, slots)
    assert table == brute(names, slots)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    a, b = fill_table(names, 4999), fill_table(names[:-1], 4999)
    assert sum(x != y and x != 19 for x, y in zip(a, b)) < 0.15 * 4999


def test_bad_tables():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 1, 2), ([str(i) for i in range(9)], 7)):
        with pytest.raises(ValueError):
            fill_table(names, slots)


def test_place(spark):
    rows = [(i, "t", "old", 5) for i in range(300)] + [(None, None, None, None), (7, "again", "old", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").repartition(3)
    names = [f"s{i}" for i in range(5)]
    table, got = fill_table(names, 101), place(df, names, slots=101)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    for r in got.collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert got.count() == 302
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan
    assert place(df.limit(0), names, slots=101).collect() == []
