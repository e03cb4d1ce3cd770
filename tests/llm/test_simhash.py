from collections import Counter

import numpy as np
import pytest
import xxhash

from scholarframe.llm import simhash
from scholarframe.llm.simhash import fingerprint_links, keep_one, simhash_groups

SCHEMA = "doc_id long, text string, fp string, id string"


def brute(rows):
    """Components by comparing all pairs of fingerprints made bit by bit."""
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return Counter((k, f"{fps[i]:016x}", least[root(i)]) for i, (k, _) in enumerate(rows))


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def cases():
    rng = np.random.default_rng(5)
    rows, base = [], [words(rng, n) for n in (300, 800, 2000, 40)]
    for i, text in enumerate(base * 6):
        w = text.split()
        for at in rng.integers(0, len(w), rng.integers(0, 4)):
            w[at] = "changed"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, words(rng, 60)) for i in range(40)]
    rows += [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "one"), (2005, "ONE"), (2006, "one two"), (2006, "three four five six seven"), (2007, "é Ü x")]
    rows += [(3000, words(rng, 30000))] * 2
    return rows


def test_groups_match_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute(rows)


def test_large_groups_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(8)
    text = words(rng, 900).split()
    rows = [(i, " ".join(text)) for i in range(400)]
    for i in range(400, 800):
        w = list(text)
        w[i - 400] = "other"
        rows.append((i, " ".join(w)))
    got = Counter(tuple(r) for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f")], [(None, None), (7, None)]])
def test_empty_and_null_ids(spark, rows):
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    known = [k for k, _ in rows if k is not None]
    assert len(got) == len(rows)
    assert all(r["component_id"] == (min(known) if known else None) for r in got)


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_links_of_hot_buckets(spark, monkeypatch, most):
    """Thousands of fingerprints around a few centres, with and without cutting their buckets, batch by batch."""
    rng = np.random.default_rng(9)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 3).tolist() + [0, (1 << 64) - 1]:
        for _ in range(250):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 9))).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 63, 300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    want = Counter(frozenset(k for k in range(len(fps)) if root(k) == r) for r in {root(i) for i in range(len(fps))})
    monkeypatch.setattr(simhash, "TOGETHER", 200)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        links = [tuple(r) for r in fingerprint_links(df, most=most).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parent = list(range(len(fps)))
    for a, b in links:
        parent[root(a)] = root(b)
    assert Counter(frozenset(k for k in range(len(fps)) if root(k) == r) for r in {root(i) for i in range(len(fps))}) == want


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(2)
    text = [words(rng, 200) for _ in range(4)]
    near = " ".join(["other", *text[0].split()[1:]])
    rows = [(7, text[0], "a"), (3, near, "b"), (3, near, "a"), (3, near, "a"), (3, text[1], "c"), (None, text[1], "d"), (None, text[2], "e"), (None, text[2], "e"), (9, None, "f"), (8, "", "g"), (8, text[3], "h"), (8, text[3] + " ", "i")]
    schema = "doc_id long, text string, fp string"
    want = {(3, text[1], "c"), (None, text[2], "e")}
    for parts in (1, 5):
        got = [tuple(r) for r in keep_one(spark.createDataFrame(rows, schema).repartition(parts)).collect()]
        assert want <= set(got) and len(got) == 5
        assert sorted(k for k, _, _ in got if k is not None) == [3, 3, 8, 8]
        assert sum(t == near for _, t, _ in got) == 1 and {t for _, t, _ in got} <= {near, text[1], text[2], "", text[3], text[3] + " "}
    again = {tuple(tuple(r) for r in sorted(keep_one(spark.createDataFrame(rows, schema).repartition(p)).collect(), key=str)) for p in (1, 2, 4)}
    assert len(again) == 1
    assert keep_one(spark.createDataFrame([], schema)).collect() == []
