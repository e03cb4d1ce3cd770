import math

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import fields, indicators, rollup, scales

KEYS = "entity_type string, entity_id string, field_id string"


def test_unmapped_mass(spark):
    rows = [("p", "a", "f"), ("p", "b", None), ("q", "c", None)]
    got = {(r["paper_id"], r["field_id"]): r["weight"] for r in fields.field_ledger(spark.createDataFrame(rows, "paper_id string, category string, field_id string")).collect()}
    assert got == {("p", "f"): 0.5, ("p", None): 0.5, ("q", None): 1.0}


def test_ontology_problems(spark):
    rows = [("root", None, "branch"), ("a", "root", "leaf"), ("b", "a", "leaf"), ("c", "gone", "leaf"), ("x", "y", "branch"), ("y", "x", "branch"), ("a", "root", "leaf")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, kind string")
    got = {(r["id"], r["problem"]) for r in fields.ontology_problems(nodes, fields.descendants(spark, nodes, max_depth=6)).collect()}
    assert got == {("a", "repeated id"), ("b", "parent is a leaf"), ("c", "missing parent"), ("x", "cycle"), ("y", "cycle")}


def test_zero_citations_are_data_and_missing_ones_are_not(spark):
    rows = [("i", "e", "f", f"p{k}", 1998, "1998-01-01", "article", c, 1.0) for k, c in enumerate([0, None, 4, 8])]
    df = spark.createDataFrame(rows, f"{KEYS}, paper_id string, year int, publication_date string, document_type string, citations int, weight double").withColumn("publication_date", F.to_date("publication_date"))
    got = indicators.impact(df, indicators.citation_cohorts(df), "2001-01-01", least_cohort=2, least_papers=1).first()
    assert (got["mncs"], got["n_eligible"], got["citation_coverage"]) == (pytest.approx(1.0), 3, 0.75)


@pytest.mark.parametrize(("since", "until", "months"), [("2022-03-31", "2024-03-30", 23), ("2022-03-30", "2024-03-30", 24), ("2024-01-31", "2024-02-29", 0)])
def test_whole_months(spark, since, until, months):
    row = spark.range(1).select(indicators.months_elapsed(F.lit(since).cast("date"), F.lit(until).cast("date")).alias("m")).first()
    assert row["m"] == months


def test_momentum_is_the_log_ratio(spark):
    rows = [("i", "e", "f", 1995 + k, w) for k, w in enumerate([5.0, 5.0, 0.0, 10.0, 10.0, 0.0])]
    got = indicators.momentum(spark.createDataFrame(rows, f"{KEYS}, year int, weight double"), 2000).first()
    assert (got["recent"], got["baseline"], got["log_change"]) == (20.0, 10.0, pytest.approx(math.log(2)))
    short = indicators.momentum(spark.createDataFrame(rows[:3], f"{KEYS}, year int, weight double"), 2000).first()
    assert short["log_change"] is None


def test_diversity_counts_the_whole_universe(spark):
    rows = [("i", "e", "f", c, 10.0) for c in ("a", "b")] + [("i", "one", "f", "a", 20.0), ("i", "small", "f", "a", 1.0)]
    got = {r["entity_id"]: r["evenness"] for r in indicators.diversity(spark.createDataFrame(rows, f"{KEYS}, category string, weight double"), 4).collect()}
    assert got == {"e": pytest.approx(0.5), "one": pytest.approx(0), "small": None}


def test_connectivity_leaves_out_the_unknown(spark):
    rows = [("i", "e", "f", "p", w, flag) for w, flag in ((1.0, True), (1.0, False), (2.0, None))]
    got = indicators.connectivity(spark.createDataFrame(rows, f"{KEYS}, paper_id string, weight double, flag boolean"), "flag").first()
    assert (got["share"], got["relationship_coverage"], got["accepted"]) == (0.5, 0.5, False)


def test_midrank_of_ties(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 3.0), ("a", 9.0), ("b", 2.0), ("b", 2.0)], "c string, v double")
    got = sorted((r["c"], r["v"], r["percentile"]) for r in scales.midrank(df, "v", ["c"]).collect())
    assert got == [("a", 0.0, pytest.approx(100 / 6)), ("a", 0.0, pytest.approx(100 / 6)), ("a", 3.0, pytest.approx(200 / 3)), ("a", 9.0, 100.0), ("b", 2.0, 50.0), ("b", 2.0, 50.0)]


def test_cohorts_without_spread(spark):
    df = spark.createDataFrame([("same", 5.0), ("same", 5.0), ("single", 1.0)], "c string, v double")
    assert {r["score"] for r in scales.winsorised_log(df, "v", ["c"], 1).collect()} == {None}
    assert [r["score"] for r in scales.centred_change(df, "v", ["c"], 2).orderBy("c").collect()] == [50.0, 50.0, None]


def test_symmetric_change(spark):
    row = spark.range(1).select(scales.symmetric_change(F.lit(20.0), F.lit(10.0)).alias("a"), scales.symmetric_change(F.lit(1.0), F.lit(1.0), 5).alias("b")).first()
    assert row["a"] == pytest.approx(1 / 3) and row["b"] is None


def test_weight_configurations():
    known = {"a", "b"}
    assert rollup.weight_problems({"a": 49.5, "b": 50.5}, known) == []
    assert rollup.weight_problems({"a": 49.5, "b": 50.0}, known) == ["weights add up to 100"]
    assert len(rollup.weight_problems({"a": 99.7}, known)) == 3
    assert all(sum(p) == 100 for p in rollup.PROFILES.values())


def test_composite_needs_every_metric_in_one_version(spark):
    rows = [("full", "a", 10.0, "1"), ("full", "b", 20.0, "1"), ("short", "a", 10.0, "1"), ("mixed", "a", 10.0, "1"), ("mixed", "b", 10.0, "2"), ("null", "a", None, "1"), ("null", "b", 1.0, "1")]
    df = spark.createDataFrame(rows, "e string, metric_id string, value double, version string")
    got = rollup.composite(df, {"a": 60, "b": 40, "off": 0}, ["e"], version="version").collect()
    assert [(r["e"], r["composite"]) for r in got] == [("full", pytest.approx(14.0))]


def test_roll_up_gate(spark):
    df = spark.createDataFrame([("e", 10.0), ("e", 30.0), ("e", None), ("x", 5.0)], "e string, score double")
    got = {r["e"]: r["mean_score"] for r in rollup.equal_field_mean(df, ["e"], expected=2).collect()}
    assert got == {"e": 20.0, "x": None}


def test_corpus_windows_are_brute_force(spark):
    """Windows, flags and sets of fields against plain sums; a period with nothing in its window has no row."""
    papers = [
        ("e", 1995, ["a", "b"], 0.5, True, True), ("e", 1996, ["a"], 0.25, True, False), ("e", 1999, ["a", "b", "c"], 1.0, False, False),
        ("e", 2000, ["c"], 0.5, True, True), ("g", 1990, ["a"], 1.0, False, False), ("g", 2001, ["b"], 1.0, True, True),
    ]
    last, want = 2000, {}
    for key, field in {(p[0], f) for p in papers for f in p[2]}:
        for period in range(1990, last + 1):
            own = [(y, f, w / len(f), k, j) for e, y, f, w, k, j in papers if e == key and field in f]
            inside = [p for p in own if period - 2 <= p[0] <= period]
            if not inside:
                continue
            mix = {c: sum(p[2] / len(p[1]) for p in inside if c in p[1]) for c in "abc"}
            total, known = sum(p[2] for p in inside), sum(p[2] for p in inside if p[3])
            base = sum(p[2] for p in own if period - 5 <= p[0] <= period - 3)
            entropy = -sum(m / total * math.log(m / total) for m in mix.values() if m) / math.log(4)
            want[key, field, period] = (total, sum(p[2] for p in inside if p[3] and p[4]) / known if known else None, entropy, math.log(total / base) if base else None)
    df = spark.createDataFrame(papers, "entity_id string, year int, fields array<string>, weight double, known boolean, joint boolean")
    for n_rows in (None, len(papers), 10**6):
        rows = indicators.corpus_windows(df, "entity_id", last, 4, n_rows=n_rows).collect()
        got = {(r["entity_id"], r["field_id"], r["period"]): tuple(r[c] for c in ("activity", "collaboration", "diversity", "momentum")) for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys()
        for k, v in want.items():
            assert [x is None for x in got[k]] == [x is None for x in v]
            assert [x for x in got[k] if x is not None] == pytest.approx([x for x in v if x is not None], abs=1e-12)
