"""Affiliation texts against a registry: what is matched and every reason why not."""

import pytest
from pyspark.sql import functions as F

from scholarframe.operators import affiliations as aff

NAMES = "names array<struct<value:string,types:array<string>>>"
PLACES = "locations array<struct<country_code:string,city:string,subdivision:string,subdivision_code:string>>"


def name(value, *types):
    return (value, list(types))


REGISTRY = [
    ("cern", [name("European Organization for Nuclear Research", "ror_display", "label"), name("CERN", "acronym"), name("Conseil Européen", "alias")], [("CH", "Geneva", "Geneva", "GE")], 1954, ["related"]),
    ("bonn", [name("University of Bonn", "ror_display"), name("Universität Bonn", "label")], [("DE", "Bonn", "North Rhine-Westphalia", "NW")], 1818, []),
    ("anu", [name("Australian National University", "ror_display")], [("AU", "Canberra", "Australian Capital Territory", "ACT")], 1946, ["child"]),
    ("york", [name("University of York", "ror_display")], [("GB", "York", None, None)], 1963, []),
    ("new york", [name("University of New York", "ror_display")], [("US", "New York", "New York", "NY")], 1831, []),
    ("twin a", [name("National Institute", "ror_display")], [("US", "Boston", None, None)], None, []),
    ("twin b", [name("National Institute", "label")], [("US", "Dallas", None, None)], None, []),
    ("old", [name("Old Academy", "ror_display")], [("DE", "Berlin", None, None)], 1700, ["successor"]),
    ("new", [name("New Academy", "ror_display")], [("DE", "Berlin", None, None)], 2015, []),
    ("two", [name("Two Cities College", "ror_display")], [("DE", "Berlin", None, None), ("DE", "Potsdam", None, None)], None, None),
    ("nowhere", [name("Nowhere College", "ror_display")], None, None, []),
    ("niger", [name("Abdou Institute", "ror_display")], [("NE", "Niamey", None, None)], None, []),
]
COUNTRIES = [("CH", "CHE", ["Switzerland", "Swiss Confederation"]), ("DE", "DEU", ["Germany", "Federal Republic of Germany"]), ("AU", "AUS", ["Australia"]), ("GB", "GBR", ["United Kingdom"]), ("US", "USA", ["United States", "United States of America"]), ("NE", "NER", ["Niger"]), ("NG", "NGA", ["Nigeria"])]

CASES = [
    ("European Organization for Nuclear Research, Geneva, Switzerland", ("cern", "CH", "Geneva", None)),
    ("  EUROPEAN  organization for Nuclear Research ;CH", ("cern", "CH", None, None)),
    ("CERN, Geneva, Switzerland", (None, None, None, aff.NO_CANDIDATE)),  # an acronym names nobody
    ("conseil européen, Geneva, GE, Switzerland", ("cern", "CH", "Geneva", None)),
    ("Department of Physics, University of Bonn, Bonn, Germany", ("bonn", "DE", "Bonn", None)),
    ("Dept. of physics and astronomy, Universität Bonn, 53115 Bonn, North Rhine-Westphalia, DEU", ("bonn", "DE", "Bonn", None)),
    ("Institute X, University of Bonn, Bonn, Germany", (None, None, None, aff.SUBUNIT)),
    ("Department of Physics at Other University, University of Bonn, Bonn, Germany", (None, None, None, aff.SUBUNIT)),
    ("University of Bonn", (None, None, None, aff.NO_PLACE)),
    ("University of Bonn, Bonn", (None, None, None, aff.COUNTRY)),
    ("University of Bonn, Bonn, Germany, Switzerland", (None, None, None, aff.COUNTRY)),
    ("University of Bonn, Geneva, Switzerland", (None, None, None, aff.OTHER_COUNTRY)),
    ("University of Bonn, Berlin, Germany", (None, "DE", None, aff.CITY)),
    ("University of Bonn, Nussallee 12, Bonn, Germany", (None, "DE", "Bonn", aff.LEFTOVER)),
    ("University of Bonn, 12, Bonn, Germany", ("bonn", "DE", "Bonn", None)),
    ("Two Cities College, Berlin, Potsdam, Germany", (None, "DE", None, aff.CITY)),
    ("Two Cities College, Potsdam, Germany", ("two", "DE", "Potsdam", None)),
    ("National Institute, Boston, USA", (None, None, None, aff.NO_CLAUSE)),
    ("University of Bonn, Australian National University, Canberra, Australia", (None, None, None, aff.NO_CLAUSE)),
    ("University of Bonn, University of Bonn, Bonn, Germany", (None, None, None, aff.NO_CLAUSE)),
    ("The University of Bonn, Bonn, Germany", (None, None, None, aff.NO_CANDIDATE)),  # the clause is not the whole name
    ("Old Academy, Berlin, Germany", (None, "DE", "Berlin", aff.SUCCESSION)),
    ("New Academy, Berlin, Germany", (None, "DE", "Berlin", aff.POSTDATES)),
    ("Nowhere College, Berlin, Germany", (None, None, None, aff.NO_LOCATION)),
    ("Abdou Institute, Niamey, Niger", ("niger", "NE", "Niamey", None)),
    ("Abdou Institute, Niamey, Nigeria", (None, None, None, aff.OTHER_COUNTRY)),
    ("University of New York, New York, United States of America", ("new york", "US", "New York", None)),
    ("University of York, York, United Kingdom", ("york", "GB", "York", None)),
    ("Australian National University, Canberra, ACT, Australia", ("anu", "AU", "Canberra", None)),
    ("Australian National University\nCanberra\nAustralia", ("anu", "AU", "Canberra", None)),
    ("", (None, None, None, aff.NO_CANDIDATE)),
    (None, (None, None, None, aff.NO_CANDIDATE)),
    (", ;", (None, None, None, aff.NO_CANDIDATE)),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(REGISTRY, f"entity string, {NAMES}, {PLACES}, established int, relationships array<string>")


@pytest.fixture(scope="module")
def countries(spark):
    return spark.createDataFrame(COUNTRIES, "code string, code3 string, names array<string>")


def test_matches_and_refusals(spark, registry, countries):
    texts = spark.createDataFrame([(i, t, 2010) for i, (t, _) in enumerate(CASES)] * 2 + [(900, CASES[22][0], 2020)], "id int, raw string, year int")
    got = {}
    for r in aff.affiliation_matches(texts, "id", "raw", "year", registry, countries).collect():
        got.setdefault(r["id"], []).append((r["entity"], r["country_code"], r["city"], r["reason"]))
        assert r["state"] == ("certified" if r["reason"] is None else "needs_review")
    for i, (text, want) in enumerate(CASES):
        assert got[i] == [want] * 2, text
    assert got[900] == [("new", "DE", "Berlin", None)]  # founded in time for this paper


def test_places_of_names(spark):
    texts = spark.createDataFrame([(1, "the university of new york at york"), (2, "new york"), (3, "newyork, york"), (4, "c.e.r.n. of york's"), (5, "")], "t int, text string")
    names = spark.createDataFrame([("a", "new york"), ("b", "york"), ("c", "university of new york"), ("d", "new york"), ("e", "--"), ("f", "york at york")], "n string, name string")

    def found(longest):
        return sorted(map(tuple, aff.placed_names(texts, ["t"], "text", names, "n", "name", longest).select("t", "n", "start", "stop", "whole").collect()))

    assert found(True) == [(1, "c", 1, 5, False), (1, "f", 4, 7, False), (2, "a", 0, 2, True), (2, "d", 0, 2, True), (3, "b", 1, 2, False), (4, "b", 5, 6, False)]
    assert set(found(False)) - set(found(True)) == {(1, "a", 3, 5, False), (1, "d", 3, 5, False), (1, "b", 4, 5, False), (1, "b", 6, 7, False), (2, "b", 1, 2, False)}


def test_common_first_words_are_no_keys(spark):
    """A hundred names begin with one word; each text meets only the name whose rarest word it holds."""
    names = spark.createDataFrame([(i, f"university of place{i}") for i in range(100)], "n int, name string")
    texts = spark.createDataFrame([(i, f"university of place{i}") for i in range(100)], "t int, text string")
    placed = aff.placed_names(texts, ["t"], "text", names, "n", "name")
    assert sorted((r["t"], r["n"]) for r in placed.collect()) == [(i, i) for i in range(100)]


SLOT = "id string, raw string, provider_id string, local array<string>, provider array<string>, grid string, provider_countries array<string>, matched string, matched_country string, match_state string, match_reason string, paper_year int"


def slot(id, raw="text", provider_id=None, local=(), provider=None, grid=None, provider_countries=None, matched=None, matched_country=None, match_state=None, match_reason=None, paper_year=2010):
    return (id, raw, provider_id, list(local), provider, grid, provider_countries, matched, matched_country, match_state, match_reason, paper_year)


def test_order_of_evidence(spark):
    registry = spark.createDataFrame([("a", 1900, [], ["DE"]), ("b", 1900, ["related"], ["FR"]), ("young", 2015, [], ["DE"]), ("gone", 1900, ["successor"], ["DE"]), ("wide", 1900, [], ["DE", "FR"]), ("bare", None, None, None)], "institution_id string, established int, relationships array<string>, countries array<string>")
    certified, short, review, conflict = "certified", "insufficient_evidence", "needs_review", "conflicted"
    cases = {
        "paper": (slot("", local=["a"], provider=["a"], grid="b"), ("a", "DE", "paper", certified, None)),
        "provider": (slot("", provider_id="7", provider=["b"], grid="a"), ("b", "FR", "provider", certified, None)),
        "crosswalk": (slot("", provider_id="7", grid="a", provider_countries=["DE", "DE"]), ("a", "DE", "crosswalk", certified, None)),
        "text": (slot("", matched="a", matched_country="DE", match_state=certified), ("a", "DE", "text", certified, None)),
        "empty": (slot("", raw=None), (None, None, None, short, "empty-paper-time-affiliation-entry")),
        "two of the paper": (slot("", local=["a", "b"]), (None, None, "paper", conflict, "multiple-paper-native-ror-targets")),
        "one twice": (slot("", local=["a", "a"]), ("a", "DE", "paper", certified, None)),
        "disagree": (slot("", local=["a"], provider=["b"]), (None, None, "paper", conflict, "provider-and-paper-ror-assertions-conflict")),
        "two of the provider": (slot("", provider=["a", "b"]), (None, None, "provider", conflict, "provider-and-paper-ror-assertions-conflict")),
        "young": (slot("", local=["young"]), (None, None, "paper", short, "institution-authority-established-after-paper")),
        "in time": (slot("", local=["young"], paper_year=2015), ("young", "DE", "paper", certified, None)),
        "gone": (slot("", provider=["gone"]), (None, None, "provider", short, "institution-lifecycle-requires-dated-resolution")),
        "no date": (slot("", local=["a"], paper_year=None), (None, None, "paper", short, "institution-exact-paper-time-date-missing")),
        "other country": (slot("", provider_id="7", grid="a", provider_countries=["FR"]), (None, None, "crosswalk", conflict, "grid-authority-country-conflict")),
        "unknown": (slot("", local=["zzz"]), (None, None, "paper", short, "exact-ror-authority-unavailable")),
        "wide": (slot("", local=["wide"]), (None, None, "paper", short, "authority-country-missing-or-ambiguous")),
        "bare": (slot("", local=["bare"]), (None, None, "paper", short, "authority-country-missing-or-ambiguous")),
        "text refused": (slot("", match_state=review, match_reason=aff.CITY), (None, None, None, review, aff.CITY)),
        "text elsewhere": (slot("", matched="a", matched_country="FR", match_state=certified), (None, None, "text", conflict, "matched-ror-country-is-not-unambiguous")),
        "text without date": (slot("", matched="a", matched_country="DE", match_state=certified, paper_year=None), (None, None, "text", short, "raw-affiliation-exact-paper-date-missing")),
        "link only": (slot("", provider_id="7"), (None, None, None, short, "paper-native-institution-link-has-no-ror-authority")),
        "nothing": (slot(""), (None, None, None, short, "paper-native-affiliation-has-no-resolved-authority")),
    }
    slots = spark.createDataFrame([(k, *row[1:]) for k, (row, _) in cases.items()], SLOT)
    got = {r["id"]: (r["institution_id"], r["country_code"], r["method"], r["state"], r["reason"]) for r in aff.launch_resolution(slots, registry).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}
    assert aff.launch_resolution(slots, registry.limit(0)).where(F.col("state") == "certified").count() == 0
