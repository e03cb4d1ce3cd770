import pytest
from pyspark.sql import functions as F

from scholarframe.functions import dates, identifiers, numbers, text
from scholarframe.operators import relational as rel


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("École  Normale & Co.", "ecole normale and co"), ("ÅØß", "a ss"), ("  ", ""), ("MIT-CSAIL", "mit csail")])
def test_search_term(spark, raw, want):
    assert one(spark, text.search_term(F.lit(raw))) == want


def test_text_helpers(spark):
    assert one(spark, text.slug(F.lit("Tokyo — Univ."))) == "tokyo-univ"
    assert one(spark, text.slug(F.lit("日本"))) == "unresolved"
    assert one(spark, text.unicode_term(F.lit("日本, Tokyo"))) == "日本 tokyo"
    assert one(spark, text.acronym(F.lit("institute of advanced study"))) == "ias"
    assert one(spark, text.lookup_terms(F.lit("a new term new"))) == ["a new term new", "new", "term"]
    assert one(spark, text.bigram_dice(F.lit("night"), F.lit("nacht"))) == pytest.approx(0.25)


@pytest.mark.parametrize(("query", "term", "score"), [("cern", "cern", 1.0), ("ias", "institute advanced study", 0.97), ("inst", "institute", 0.91), ("zzzz", "institute", None), ("xy", "xyz", None)])
def test_search_score(spark, query, term, score):
    got = one(spark, text.search_score(F.lit(query), F.lit(term), F.lit(1.0)))
    assert got == (None if score is None else pytest.approx(score))


@pytest.mark.parametrize(
    ("scheme", "raw", "want"),
    [
        ("doi", "https://doi.org/10.1000/ABC", "10.1000/abc"), ("doi", "doi: 10.1/x", "10.1/x"), ("doi", "11.1/x", None),
        ("orcid", "https://orcid.org/0000-0002-1825-0097", "0000-0002-1825-0097"), ("orcid", "0000-0002-1825-0098", None), ("orcid", "0000-0002-9079-593x", "0000-0002-9079-593X"),
        ("ror", "https://ror.org/02mhbdp94", "02mhbdp94"), ("ror", "ror: short", None), ("arxiv", "https://arxiv.org/abs/2101.00001v3", "2101.00001"), ("arxiv", "hep-th/9901001", "hep-th/9901001"),
        ("arxiv", "arXiv:2101.00001.pdf", "2101.00001"), ("inspire", "https://inspirehep.net/literature/123", "123"), ("inspire", "https://inspirehep.net/authors/123", None), ("other", "x", None),
    ],
)
def test_identifiers(spark, scheme, raw, want):
    assert one(spark, identifiers.normalised(F.lit(scheme), F.lit(raw))) == want


@pytest.mark.parametrize(("url", "ok"), [("https://example.org/x", True), ("http://127.0.0.1/", False), ("ftp://example.org", False), ("https://user@example.org", False), ("http://localhost", False)])
def test_public_urls(spark, url, ok):
    assert one(spark, identifiers.public_url(F.lit(url))) is ok


def test_partial_dates(spark):
    got = [(str(one(spark, dates.first_day(F.lit(s)))), str(one(spark, dates.last_day(F.lit(s))))) for s in ("2024", "2024-02", "2024-02-10", "x")]
    assert got == [("2024-01-01", "2024-12-31"), ("2024-02-01", "2024-02-29"), ("2024-02-10", "2024-02-10"), ("None", "None")]


def test_numbers(spark):
    assert one(spark, numbers.round_half_up(F.lit(2.25))) == 2.3
    assert [one(spark, numbers.bin_index(F.lit(c), 5)) for c in (0.0, 0.2, 1.0)] == [0, 1, 4]
    assert one(spark, numbers.text_hash(F.lit("ab"))) == 97 * 31 + 98


def test_observations_fail_closed(spark):
    rows = [("e", 1, 1, "x"), ("e", 2, 2, "x"), ("f", 1, 1, "x"), ("f", 2, 2, "y")]
    df = spark.createDataFrame(rows, "k string, at int, id int, algorithm string")
    assert [(r["k"], r["id"]) for r in rel.current_observations(df, ["k"], ["at", "id"], "algorithm").collect()] == [("e", 2)]


def test_upsert_and_equality(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "new"), (3, "c")]))
    merged = rel.upsert(a, b, ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "new"), (3, "c")]
    assert rel.same_rows(merged, merged.repartition(3)).count() == 0
    assert rel.same_rows(a, b).count() == 4


def test_periods_with_open_ends(spark):
    rows = spark.createDataFrame([(None, 1999), (2000, None), (None, None), (2001, 2005)], "a int, b int")
    assert [r["x"] for r in rows.select(rel.covers_year(F.col("a"), F.col("b"), F.lit(2000)).alias("x")).collect()] == [False, True, True, False]
