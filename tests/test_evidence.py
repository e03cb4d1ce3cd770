import gzip
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import evidence, exact, indicators, scales
from scholarframe.sources import providers, sinks
from scholarframe.streaming import incremental


@pytest.mark.parametrize(
    ("local", "author", "n", "want"),
    [
        (["a"], ["b"], 2, (["a"], "affiliation-local-ror-author-level-set-unaligned", False)),
        (["b", "a"], None, 2, (["a", "b"], "affiliation-local-ror", False)),
        ([], ["a"], 2, ([], "unresolved-author-ror-not-positionally-aligned", False)),
        (None, None, 3, ([], "no-ror-evidence", False)),
        (["a", "a"], ["a"], 1, (["a"], "single-affiliation-local-author-ror-corroborated", False)),
        (["a"], ["b"], 1, (["a", "b"], "conflicted-single-affiliation-local-vs-author-ror", True)),
        (["a"], [], 1, (["a"], "affiliation-local-ror", False)),
        ([], ["a"], 1, (["a"], "single-affiliation-author-ror", False)),
        ([], ["b", "a"], 1, (["a", "b"], "conflicted-single-affiliation-multiple-author-rors", True)),
        ([], [], 1, ([], "no-ror-evidence", False)),
    ],
)
def test_identifiers_are_aligned_with_single_affiliations_only(spark, local, author, n, want):
    df = spark.createDataFrame([(local, author, n)], "l array<string>, a array<string>, n int")
    r = df.select(evidence.aligned_identifiers(F.col("l"), F.col("a"), F.col("n")).alias("x")).first()["x"]
    assert (r["identifiers"], r["alignment"], r["conflict"]) == want


def test_reasons_of_records_without_a_match(spark):
    rows = [("matched", None, None, True), ("unmatched", ["missing-or-invalid"], ["ror"], True), ("unmatched", ["other"], ["ROR"], True), ("ambiguous", None, ["grid"], True), ("unmatched", [], [], False), ("unmatched", None, None, None)]
    df = spark.createDataFrame(rows, "status string, why array<string>, schemes array<string>, requires boolean")
    got = [r["x"] for r in df.select(evidence.unmatched_reason(F.col("status"), F.col("why"), F.col("schemes"), ("ror",), F.col("requires")).alias("x")).collect()]
    assert got == [None, "missing-or-invalid", "unclassified", "authority-identifier-required", "unclassified", "unclassified"]


def test_a_cursor_moves_on_only_when_every_record_passed(spark):
    attempts = spark.createDataFrame([("a", 5, True), ("a", 7, True), ("b", 6, True), ("b", 9, False), ("d", 4, None)], "source string, cursor int, ok boolean")
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "source string, old int")
    got = {r["source"]: (r["cursor"], r["n_failed"], r["replay"]) for r in evidence.next_cursors(attempts, "source", "cursor", "ok", before, "old").collect()}
    assert got == {"a": (7, 0, False), "b": (2, 1, True), "c": (3, 0, False), "d": (4, 1, True)}


def test_small_rules(spark):
    rows = [(["Ab", "aB", "c", "AB", "C"], ["x", None, "x"]), ([], ["x", "y"]), (None, [])]
    got = spark.createDataFrame(rows, "s array<string>, r array<string>").select(evidence.first_wins_strings(F.col("s")).alias("s"), evidence.category_role(F.col("r")).alias("r")).collect()
    assert [(r["s"], r["r"]) for r in got] == [(["Ab", "c"], "x"), ([], "mixed"), (None, None)]


def test_sums_and_digests_do_not_depend_on_order(spark):
    values = [0.1] * 30 + [1e9 + 0.25, -1e9] + [1 / 3] * 7
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    sums = {exact.exact_sums(df.orderBy(F.desc("v") if k % 2 else F.col("v")).repartition(k), [], s=F.col("v")).first()["s"] for k in (1, 3, 7)}
    assert sums == {math.fsum(values)}
    digests = {tuple(exact.table_digest(df.repartition(k)).first()) for k in (1, 4)}
    assert len(digests) == 1 and exact.table_digest(df.where("i > 0")).first()["digest"] != digests.pop()[1]
    assert exact.table_digest(df.limit(0)).first()["n_rows"] == 0


def test_missing_counts_get_no_rank(spark):
    rows = [("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 10.0), ("none", None)]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, k string, v double")
    got = {r["k"]: r["percentile"] for r in scales.midrank(df, "v", ["f"], minimum=4).collect()}
    assert got == {"a": pytest.approx(100 / 6), "b": pytest.approx(100 / 6), "c": pytest.approx(200 / 3), "d": 100.0, "none": None}
    assert {r["percentile"] for r in scales.midrank(df, "v", ["f"], minimum=5).collect()} == {None}
    tied = spark.createDataFrame([("f", 0.0)] * 3, "f string, v double")
    assert {r["percentile"] for r in scales.midrank(tied, "v", ["f"], minimum=3).collect()} == {50.0}


def test_impact_takes_eligible_papers_only(spark):
    """Immature, unobserved and uncounted papers enter neither the mean nor the share of top papers."""
    ten = [(f"p{k}", "1998-01-01", k + 1, "2001-08-01") for k in range(10)]
    rows = ten + [("young", "2000-01-01", 50, "2001-08-01"), ("late", "1998-01-01", 50, "2001-08-02"), ("none", "1998-01-01", None, "2001-08-01")]
    df = spark.createDataFrame([("i", "e", "f", p, int(d[:4]), d, "article", c, 1.0, o) for p, d, c, o in rows], "entity_type string, entity_id string, field_id string, paper_id string, year int, publication_date string, document_type string, citations int, weight double, seen string")
    df = df.withColumns({"publication_date": F.to_date("publication_date"), "seen": F.to_date("seen")})
    cohorts = indicators.citation_cohorts(df.where("seen = date'2001-08-01'"), least_cohort=10)
    got = indicators.impact(df, cohorts, "2001-08-01", observed=F.col("seen"), least_cohort=10).first()
    assert (got["n_eligible"], got["eligible_mass"]) == (10, 10.0)
    assert got["mncs"] == pytest.approx(1.0) and got["top_share"] == pytest.approx(0.1)
    assert got["citation_coverage"] == pytest.approx(11 / 13)
    assert got["value"] is None and got["reasons"] == ["citation coverage is below the threshold"]
    open_ = indicators.impact(df, cohorts, "2001-08-01", observed=F.col("seen"), least_cohort=10, least_coverage=0.8).first()
    assert open_["value"] == pytest.approx(1.0) and open_["reasons"] == []


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(f"v{i:03d}",) for i in range(200)], "v string").repartition(7)
    got = [(r["v"], r["n"]) for r in sinks.numbered(df, ["v"], "n").orderBy("v").collect()]
    assert got == [(f"v{i:03d}", i) for i in range(200)]
    ids = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7, 3, None)], "k int")
    batches = {r["k"]: r["batch"] for r in providers.lookup_batches(ids, spark.createDataFrame([(9,)], "k int"), "k", size=2).collect()}
    assert batches == {1: 0, 3: 0, 5: 1, 7: 1}


def test_ledgers_come_back(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (4, "a")], "k int, s string")
    compact, words = sinks.interned(df, "s")
    assert sorted(map(tuple, sinks.recovered(compact, "s", words).select("k", "s").collect())) == [(1, "x"), (2, None), (3, "x"), (4, "a")]


def test_only_named_shards_are_opened(spark, tmp_path):
    rows = spark.createDataFrame([(i % 10, i, i % 4) for i in range(80)], "k int, v int, shard int")
    folder = f"{tmp_path}/s"
    sinks.write_shards(rows, folder, "shard")
    index = sinks.inverted_index(rows, "k", "shard")
    found = sinks.read_shards(spark, folder, rows.schema, index, "k", [3], "shard")
    assert {r["shard"] for r in found.collect()} == {1, 3}
    for path in (*Path(folder).glob("shard=0/*.parquet"), *Path(folder).glob("shard=2/*.parquet")):
        path.write_bytes(b"spoilt")
    assert sinks.read_shards(spark, folder, rows.schema, index, "k", [3], "shard").where("k = 3").count() == 8
    assert sinks.read_shards(spark, folder, rows.schema, index, "k", [77], "shard").count() == 0


def test_rows_that_fail_a_check_stay_apart(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write("\n".join([json.dumps({"k": 1, "v": 2.0}), "{broken", json.dumps({"k": 2, "v": -1.0}), json.dumps({"k": 3})]))
    good, bad = sinks.read_validated(spark, str(tmp_path), "k long, v double", ("negative", F.col("v") >= 0))
    assert [tuple(r) for r in good.collect()] == [(1, 2.0)]
    assert sorted((r["k"] or 0, r["problems"]) for r in bad.collect()) == [(0, ["not well formed", "negative"]), (2, ["negative"]), (3, ["negative"])]


def test_compaction_keeps_the_state(spark, tmp_path):
    store = f"{tmp_path}/log"
    for number, rows in enumerate(([("a", 1, 10), ("b", 1, 20)], [("a", 2, 11)], [("c", 1, 30), ("b", 0, 99)])):
        incremental.append_batch(spark.createDataFrame(rows, "k string, rev int, v int"), store, number)
    state = lambda: sorted(map(tuple, incremental.current_state(spark, store, ["k"], ["rev"]).select("k", "v").collect()))
    want = [("a", 11), ("b", 20), ("c", 30)]
    assert state() == want
    for _ in range(2):
        incremental.compact(spark, store, ["k"], ["rev"], upto=1)
        assert state() == want
    assert incremental.log_rows(spark, store).count() == 4
