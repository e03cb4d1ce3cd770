"""What one task gets is bounded by the size of the table, and no row is copied for each distinct count."""

import re

import pytest
from pyspark.sql import functions as F

from scholarframe import plans, session
from scholarframe.operators import attribution as att
from scholarframe.operators import indicators as ind
from scholarframe.operators import scales
from scholarframe.sources import artifacts
from scholarframe.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_rows_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    t = Tables(spark, SF)
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    n = t.rows("lineitem")
    shares = att.attribution_shares(t.affiliations, n)
    sizes = [r["count"] for r in shares.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= n / 200 * 0.9 and max(sizes) < 3 * 200
    assert sorted(map(tuple, shares.collect()), key=repr) == sorted(map(tuple, att.attribution_shares(t.affiliations).collect()), key=repr)


@pytest.mark.parametrize("name", ["relationship_tristate", "metric_gate", "activity_raw", "normalisation_cohorts", "pilot_accumulators", "collaborators_selfjoin", "corpus_shares"])
def test_distinct_counts_copy_no_rows(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    if name == "pilot_accumulators":
        assert "distinct" not in plan


@pytest.mark.parametrize("name", ["attributed_partners", "attribution_coverage", "metric_engine", "paper_conservation"])
def test_papers_are_dealt_once_by_the_size_of_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt_to = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*paper_id[^)]*, (\d+)\)", plan)]
    assert dealt_to and min(dealt_to) >= Tables(spark, SF).rows("lineitem") / 200


@pytest.mark.parametrize("name", ["activity_raw", "activity_scaled", "branch_rollup"])
def test_researchers_are_told_apart_by_the_size_of_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    made = []
    monkeypatch.setattr(scales, "winsorised_log", lambda df, *_: made.append(df) or df.withColumn("score", F.lit(1.0)))
    found = plans.QUERIES[name](spark, SF)
    plan = (made or [found])[0]._jdf.queryExecution().executedPlan().toString()
    dealt_to = [int(n) for n in re.findall(r"hashpartitioning\(entity_id[^)]*researcher_id[^)]*, (\d+)\)", plan)]
    assert dealt_to and min(dealt_to) >= Tables(spark, SF).rows("lineitem") / 200


def test_activity_is_the_same_however_its_rows_are_dealt(spark):
    rows = [("i", k, f, p, 2000, s, r) for k in (1, 2, None) for f in "ab" for p in range(3) for s, r in ((1, 5), (2, 5), (3, p), (4, None))]
    df = spark.createDataFrame(rows, "entity_type string, entity_id int, field_id string, paper_id int, year int, slot int, researcher_id int")
    df = df.withColumns({"weight": F.lit(0.25), "first_row": F.col("slot") == 1})
    want = sorted(map(tuple, ind.activity(df, 2000).collect()), key=repr)
    assert [w[3:6] for w in want] == [(3.0, 3, 4)] * 6
    for n_rows in (None, len(rows), 10**6):
        assert sorted(map(tuple, ind.activity(df, 2000, first="first_row", n_rows=n_rows).collect()), key=repr) == want


def test_pairs_of_fields_are_not_shuffled(spark):
    """A paper's rows are shuffled with its fields as a set; no shuffle is by category, and none is repeated for each measure."""
    plan = plans.QUERIES["corpus_shares"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not [x for x in shuffles if "category" in x]
    assert 0 < len(shuffles) <= 6


def test_missing_places_are_no_conflict(spark):
    rows = [("p", 1, True, 2, 5, "a"), ("p", 1, True, 2, 5, "b"), ("q", 1, False, 2, 5, None), ("q", 1, False, 2, 5, None), ("r", 1, True, 1, 1, "a"), ("r", 1, True, 0, 9, "b")]
    df = spark.createDataFrame(rows, "paper_id string, slot int, present boolean, priority int, recency int, value string")
    got = {r["paper_id"]: (r["value"], r["conflict"]) for r in att.selected_evidence(df, ["paper_id", "slot"], "priority", "recency", "present", "value", 10**6).collect()}
    assert got == {"p": (None, True), "q": (None, False), "r": ("a", False)}


def test_payloads_are_verified_by_name(spark, tmp_path):
    refs = artifacts.put_payloads(spark.createDataFrame([("one",), ("two",), ("three",)], "text string"), "text", str(tmp_path))
    named = {r["sha256"]: r["size"] for r in refs.collect()}
    gone, damaged, whole = sorted(named)
    (tmp_path / artifacts.name_of(gone)).unlink()
    (tmp_path / artifacts.name_of(damaged)).write_bytes(b"x" * named[damaged])
    got = {r["sha256"]: r["verified"] for r in artifacts.verified_payloads(refs, str(tmp_path)).collect()}
    assert got == {gone: None, damaged: False, whole: True}
