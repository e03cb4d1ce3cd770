import pytest
from pyspark.sql import functions as F

from scholarframe.operators import attribution as att

SCHEMA = "paper_id string, slot int, assertion_id string, researcher_id string, institution_id string, country_id string"


def shares(spark, rows):
    df = att.attribution_shares(spark.createDataFrame(rows, SCHEMA))
    return sorted((r["slot"], r["institution_id"] or "", round(r["weight"], 12), r["status"]) for r in df.collect())


def test_one_author_one_affiliation(spark):
    assert shares(spark, [("p", 1, "a", "r", "i", "c")]) == [(1, "i", 1.0, "allocated")]


def test_two_authors_at_one_institution(spark):
    rows = [("p", 1, "a", "r1", "i", "c"), ("p", 2, "b", "r2", "i", "c")]
    assert shares(spark, rows) == [(1, "i", 0.5, "allocated"), (2, "i", 0.5, "allocated")]
    weights = att.entity_weights(att.attribution_shares(spark.createDataFrame(rows, SCHEMA)), "institution_id").collect()
    assert [(r["institution_id"], r["weight"]) for r in weights] == [("i", 1.0)]


def test_unresolved_mass_is_withheld(spark):
    rows = [("p", 1, "a", "r", "i", "c"), ("p", 1, "b", "r", None, None)]
    assert shares(spark, rows) == [(1, "", 0.5, "withheld-unresolved"), (1, "i", 0.5, "allocated")]


def test_author_without_affiliation(spark):
    rows = [("p", 1, None, "r1", None, None), ("p", 2, "b", "r2", "i", "c")]
    assert shares(spark, rows) == [(1, "", 0.5, "withheld-no-affiliation"), (2, "i", 0.5, "allocated")]


def test_repeated_assertions_do_not_dilute(spark):
    rows = [("p", 1, "a", "r", "i", "c"), ("p", 1, "b", "r", "i", "c"), ("p", 1, "c", "r", "j", "c")]
    assert shares(spark, rows) == [(1, "i", 0.5, "allocated"), (1, "j", 0.5, "allocated")]


def test_conflicting_countries_are_reported(spark):
    rows = [("p", 1, "a", "r", "i", "c"), ("p", 1, "b", "r", "i", "d")]
    assert [r["institution_id"] for r in att.conflicting_countries(spark.createDataFrame(rows, SCHEMA)).collect()] == ["i"]


def test_mass_is_conserved_in_any_order(spark):
    rows = [(f"p{k % 7}", k % 5 + 1, f"a{k}", f"r{k % 11}", f"i{k % 3}" if k % 4 else None, "c" if k % 4 else None) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, att.attribution_shares(df).collect()), key=str)
    two = sorted(map(tuple, att.attribution_shares(df.orderBy(F.rand(3)).repartition(5)).collect()), key=str)
    assert one == two
    mass = att.mass_totals(att.attribution_shares(df), "paper_id").collect()
    assert all(r["total_mass"] == pytest.approx(1) and r["allocated_mass"] + r["withheld_mass"] == pytest.approx(1) for r in mass)
    assert att.mass_violations(att.attribution_shares(df)).count() == 0


def test_relationships_are_tri_state(spark):
    rows = [("two", 1, "a", "r", "i", "c"), ("two", 2, "b", "s", "j", "c"), ("one", 1, "a", "r", "i", "c"), ("open", 1, "a", "r", "i", "c"), ("open", 2, "b", "s", None, None)]
    got = {r["paper_id"]: (r["cross_institution"], r["international"]) for r in att.paper_relationships(att.attribution_shares(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {"two": (True, False), "one": (False, False), "open": (None, None)}


def test_countries_are_split_by_distinct_country(spark):
    rows = [("p", 1, "a", "r", "i", "c"), ("p", 1, "b", "r", "j", "c"), ("p", 1, "d", "r", "k", "e")]
    got = {r["country_id"]: r["weight"] for r in att.distinct_country_weights(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"c": 0.5, "e": 0.5}


def test_evidence_conflicts_are_withheld(spark):
    rows = [("p", 1, True, 3, 5, "x"), ("p", 1, True, 3, 5, "y"), ("q", 1, False, 9, 9, "z"), ("q", 1, True, 1, 1, "w")]
    df = spark.createDataFrame(rows, "paper_id string, slot int, present boolean, priority int, recency int, value string")
    got = {r["paper_id"]: (r["value"], r["conflict"]) for r in att.selected_evidence(df, ["paper_id", "slot"], "priority", "recency", "present", "value").collect()}
    assert got == {"p": (None, True), "q": ("w", False)}
