"""Fuzzy name matching against brute force."""

import random

import duckdb
import pytest

from scholarframe import plans
from scholarframe.operators import identity
from scholarframe.operators.identity import fuzzy_match


def grams(s):
    t = s.replace(" ", "")
    return {t} if len(t) < 2 else {t[i : i + 2] for i in range(len(t) - 1)}


def brute(mentions, names, bar=0.75, margin=0.05, keep=3):
    out = []
    for m in {k for k, _ in mentions}:
        best = {}
        for _, x in (r for r in mentions if r[0] == m and r[1] is not None):
            for e, y in (r for r in names if r[1] is not None):
                s = 2 * len(grams(x) & grams(y)) / (len(grams(x)) + len(grams(y)))
                if x[:1] == y[:1] and s >= bar:
                    best[e] = max(best.get(e, 0), s)
        ranked = sorted(best.items(), key=lambda r: (-r[1], r[0]))
        for i, (e, s) in enumerate(ranked[:keep]):
            out.append((m, e, round(s, 9), i + 1, i == 0 and (len(ranked) == 1 or s - ranked[1][1] >= margin)))
    return sorted(out)


@pytest.mark.parametrize("bar", [0.3, 0.75, 1.0])
def test_fuzzy_match_is_brute_force(spark, bar):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aabcd ") for _ in range(rng.randint(0, 12))).strip()
    mentions, names = [(rng.randint(0, 60), word()) for _ in range(80)] + [(70, None)], [(rng.randint(0, 150), word()) for _ in range(200)] + [(200, None), (201, "")]
    got = fuzzy_match(spark.createDataFrame(mentions, "m long, term string"), spark.createDataFrame(names, "e long, term string"), "m", "term", "e", bar=bar)
    assert sorted((r["m"], r["e"], round(r["similarity"], 9), r["rank"], r["clear"]) for r in got.collect()) == brute(mentions, names, bar)


def test_blocks_of_common_bigrams(spark, monkeypatch):
    """Blocks of a few names each give the same as one block."""
    monkeypatch.setattr(identity, "BLOCK_ROWS", 7)
    test_fuzzy_match_is_brute_force(spark, 0.5)


def test_copies_are_compared_once(spark, monkeypatch):
    """Many mentions and entities of few names: as many rows in the blocks as there are names, the same result."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(12)]
    mentions = [(i, rng.choice(words)) for i in range(90)]
    names = [(i, rng.choice(words)) for i in range(300)]
    # entities of many names, each the smallest of its set, do not crowd out the others
    names += [(-1, "abcabc" + "a" * i + x) for i in range(3) for x in "xyz"]
    whole, seen = identity._best_in_block, spark.sparkContext.accumulator(0)

    def counted(left, right, *rest):
        seen.add(len(set(right.column("key").to_pylist())))
        return whole(left, right, *rest)

    monkeypatch.setattr(identity, "_best_in_block", counted)
    got = fuzzy_match(spark.createDataFrame(mentions, "m long, term string"), spark.createDataFrame(names, "e long, term string"), "m", "term", "e", bar=0.3)
    assert sorted((r["m"], r["e"], round(r["similarity"], 9), r["rank"], r["clear"]) for r in got.collect()) == brute(mentions, names, 0.3)
    assert 0 < seen.value < 200


@pytest.mark.parametrize("bar", [0.3, 0.75])
def test_high_bars_first_are_brute_force(spark, monkeypatch, bar):
    """Sets that are looked up at bar after bar, in small blocks and products, give the same as all at once."""
    for name, value in {"FEW_PAIRS": 0, "BLOCK_ROWS": 40, "PRODUCT_ROWS": 5, "PRODUCT_CELLS": 400}.items():
        monkeypatch.setattr(identity, name, value)
    test_fuzzy_match_is_brute_force(spark, bar)


def test_few_pairs_leave_the_blocks(spark, monkeypatch):
    """Names that are all unlike and share most bigrams: blocks hand on some rows for a mention, not some for each block and bigram."""
    monkeypatch.setattr(identity, "FEW_PAIRS", 0, raising=False)
    monkeypatch.setattr(identity, "BLOCK_ROWS", 50)
    mentions, names = [(i, f"supplier{i:09d}") for i in range(150)], [(i, f"supplier{i:09d}") for i in range(1200)]
    whole, handed = identity._best_in_block, spark.sparkContext.accumulator(0)

    def counted(*args):
        found = whole(*args)
        handed.add(found.num_rows)
        return found

    monkeypatch.setattr(identity, "_best_in_block", counted)
    got = fuzzy_match(spark.createDataFrame(mentions, "m long, term string"), spark.createDataFrame(names, "e long, term string"), "m", "term", "e").collect()
    assert sorted((r["m"], r["e"], round(r["similarity"], 9), r["rank"], r["clear"]) for r in got) == brute(mentions, names)
    assert 0 < handed.value < 60 * len(mentions)


@pytest.mark.parametrize("name", ["fuzzy_bigram_match", "fuzzy_bigram_match_all"])
def test_all_customers_are_candidates(spark, name):
    """Against SQL at a size where more customers exist than the first 300."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rows = plans.QUERIES[name](spark, folder)
    want = con.sql(plans.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in rows.columns]
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    assert any(r[rows.columns.index("entity" if name == "fuzzy_bigram_match" else "mention")] > 300 for r in got)
