"""Impact with sessions and stated coverage, populations of scores, and definitions in force."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import evidence as evi
from scholarframe.operators import indicators as ind

DAY1, DAY2, START, END = date(2020, 3, 1), date(2020, 3, 2), date(2020, 3, 1), date(2020, 3, 7)
PAPER = "entity_type string, entity_id string, field_id string, paper_id int, year int, document_type string, publication_date date, weight double, citations double, observed_at date"
OBSERVATION = "paper_id int, field_id string, year int, document_type string, citations double, observed_at date, session_id string, started_at date, ended_at date"


def observation(paper, citations, day=DAY1, session="s", start=START, end=END):
    return (paper, "f", 2017, "article", citations, day, session, start, end)


def paper(entity, n, citations, day=DAY1, weight=1.0, published=date(2017, 5, 5)):
    return ("institution", entity, "f", n, 2017, "article", published, weight, citations, day)


def found(spark, papers, observations, supplied=None, **options):
    cohorts = ind.session_cohorts(spark.createDataFrame(observations, OBSERVATION), "2020-03-31", least_cohort=4)
    stated = None if supplied is None else spark.createDataFrame(supplied, "entity_type string, entity_id string, field_id string, supplied_coverage double")
    rows = ind.session_impact(spark.createDataFrame(papers, PAPER), cohorts, least_cohort=4, least_papers=1, supplied=stated, **options).collect()
    return {r["entity_id"]: r for r in rows}


COHORT = [observation(n, c) for n, c in ((1, 0.0), (2, 2.0), (3, 4.0), (4, 10.0))]  # mean 4


def test_session_values(spark):
    papers = [paper("a", 1, 0.0), paper("a", 4, 10.0, weight=3.0), paper("b", 3, 4.0), paper("b", 9, None), paper("c", 3, 4.0, published=date(2018, 5, 5))]
    got = found(spark, papers, [*COHORT, observation(5, None)])
    assert got["a"]["value"] == pytest.approx((0 + 3 * 2.5) / 4) and got["a"]["top_share"] == pytest.approx(0.75) and got["a"]["citation_coverage"] == 1.0
    assert got["b"]["value"] is None and got["b"]["mncs"] == 1.0 and got["b"]["citation_coverage"] == 0.5
    assert got["b"]["reasons"] == ["citation coverage is below the threshold"]
    assert got["c"]["n_eligible"] == 0 and got["c"]["citation_coverage"] == 1.0  # comparable, but not two years old on its day


def test_each_paper_on_its_own_date(spark):
    """A paper counts on the date of its observation, and is as old as on that date."""
    cohort = [*COHORT[:3], observation(4, 10.0, DAY2)]
    papers = [paper("a", 4, 10.0, DAY2), paper("b", 4, 10.0, DAY1), paper("c", 4, 10.0, DAY2, published=date(2018, 3, 2)), paper("d", 3, 4.0, DAY1, published=date(2018, 3, 2))]
    got = found(spark, papers, cohort)
    assert (got["a"]["value"], got["b"]["n_eligible"], got["b"]["citation_coverage"]) == (2.5, 0, 0.0)
    assert got["c"]["value"] == 2.5 and got["d"]["n_eligible"] == 0  # two years old on the second of March, not on the first


def test_sessions_do_not_mix(spark):
    other = [observation(n, c, session="t") for n, c in ((11, 1.0), (12, 1.0), (13, 1.0), (14, 1.0))]
    got = found(spark, [paper("a", 3, 4.0), paper("a", 11, 1.0), paper("b", 11, 1.0)], [*COHORT, *other])
    assert got["a"]["value"] is None and got["a"]["reasons"] == ["papers of several sessions"]
    assert got["b"]["value"] == 1.0  # against its own session's mean


def test_observations_that_are_no_evidence(spark):
    late, outside = observation(1, 0.0, end=date(2020, 4, 2)), observation(2, 2.0, day=date(2020, 3, 9))
    got = found(spark, [paper("a", 3, 4.0)], [late, outside, *COHORT[2:]])
    assert got["a"]["n_eligible"] == 0  # a cohort of two
    again = found(spark, [paper("a", 4, 12.0, DAY2)], [*COHORT, observation(4, 11.0, DAY2), observation(4, 12.0, DAY2)])
    assert again["a"]["value"] == pytest.approx(12 / 4.5)  # the last observation counts
    differs = found(spark, [paper("a", 4, 9.0)], COHORT)
    assert differs["a"]["value"] is None and differs["a"]["reasons"] == ["a count differs from its cohort's"]


def test_stated_coverage(spark):
    papers = [paper("a", 3, 4.0), paper("b", 3, 4.0), paper("c", 3, 4.0), paper("d", 3, 4.0), paper("d", 99, 1.0)]
    got = found(spark, papers, COHORT, [("institution", "a", "f", 0.5), ("institution", "b", "f", 0.95), ("institution", "c", "f", None), ("institution", "d", "f", 1.0)])
    assert {k: (r["citation_coverage"], r["value"]) for k, r in got.items()} == {"a": (0.5, None), "b": (0.95, 1.0), "c": (1.0, 1.0), "d": (0.5, None)}


def test_populations_of_scores(spark):
    rows = [(e, "v1", "s", x) for e, x in (("a", 1.0), ("b", 2.0), ("c", 9.0), ("d", None))]
    rows += [(e, "v2", "s", 5.0) for e in "abab"] + [("a", None, "s", 1.0), ("b", None, "s", 3.0), ("c", None, "s", 4.0), ("a", "v3", "s", 1.0), ("b", "v4", "s", 3.0), ("b", "v4", "t", 3.0), ("a", "v5", "s", 2.0), ("b", "v5", "s", 2.0), ("c", "v5", "s", 2.0)]
    df = spark.createDataFrame(rows, "entity string, version string, session string, v double")
    got = {}
    for r in evi.scored_populations(df, "entity", "v", 3, ["version"], ["session"]).collect():
        got.setdefault((r["version"], r["session"]), []).append((r["entity"], r["score"] is not None, r["reason"]))
    assert sorted(got["v1", "s"]) == [("a", True, None), ("b", True, None), ("c", True, None), ("d", False, "no value")]
    assert set(got["v2", "s"]) == {(e, False, "a population holds each entity once") for e in "ab"}
    assert sorted(got[None, "s"]) == [(e, True, None) for e in "abc"]
    assert {x[2] for k in (("v3", "s"), ("v4", "s"), ("v4", "t")) for x in got[k]} == {"too few entities"}
    assert {x[2] for x in got["v5", "s"]} == {"no spread"}
    assert len(evi.VERSIONS) == 14


def test_definitions_in_force(spark):
    rows = [("m", "9", "2020-01-01"), ("m", "10", "2020-02-01"), ("m", "11", "2021-01-01"), ("n", "v1.9.3", "2020-01-01"), ("n", "v1.10", "2020-01-01"), ("n", "v1.2", "2020-01-05"), ("p", "draft", "2020-01-01"), ("p", "1", "2020-01-01"), ("q", "1", "2022-01-01")]
    definitions = spark.createDataFrame(rows, "metric string, version string, since string").withColumn("since", F.to_date("since"))
    force = evi.definitions_in_force(definitions, "metric", "version", "since", F.lit("2020-06-01").cast("date"))
    assert dict(map(tuple, force.collect())) == {"m": "10", "n": "v1.10", "p": "1"}
    observations = spark.createDataFrame([(1, "m", "10"), (2, "m", "9"), (3, "m", "1"), (4, "n", "v1.10"), (5, "q", "1"), (6, "m", None)], "id int, metric string, version string")
    assert sorted(r["id"] for r in evi.of_definitions(observations, force, "metric", "version").collect()) == [1, 4]
