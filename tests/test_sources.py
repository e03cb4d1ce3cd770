import json

import pytest
from pyspark.sql import functions as F

from scholarframe.sources import providers, sinks
from scholarframe.streaming import events as ev

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A  title
 on lines</title><summary> Text </summary><published>2021-01-02T03:04:05Z</published><updated>2021-02-03T00:00:00Z</updated>
<author><name>Ann A</name></author><author><name>Bo B</name></author><arxiv:primary_category term="hep-th" scheme="s"/><category term="gr-qc" scheme="s"/></entry></feed>"""


def test_inspire(spark, tmp_path):
    hit = {"id": "7", "metadata": {"titles": [{"title": "T"}], "dois": [{"value": "10.1/A"}], "earliest_date": "2020-05", "authors": [{"full_name": "A, B"}], "citation_count": 0}}
    (tmp_path / "a.json").write_text(json.dumps({"hits": {"hits": [hit, {"id": "8", "metadata": {}}]}}))
    a, b = providers.inspire_papers(spark, str(tmp_path)).orderBy("record_id").collect()
    assert (a["record_id"], a["title"], a["doi"], a["date"], a["document_type"], a["citation_count"], a["arxiv_id"]) == ("7", "T", "10.1/a", "2020-05", "article", 0, None)
    assert (b["title"], b["citation_count"]) == (None, None)


def test_crossref_ror_orcid(spark, tmp_path):
    for name, doc in {
        "crossref": {"message": {"items": [{"DOI": "10.1/X", "title": ["T"], "issued": {"date-parts": [[2019, 3]]}, "author": [{"given": "A", "family": "B"}, {"name": "Group"}]}]}},
        "ror": {"items": [{"id": "https://ror.org/02mhbdp94", "names": [{"value": "Alias", "types": ["alias"]}, {"value": "Main", "types": ["ror_display"]}], "locations": [{"geonames_details": {"country_code": "CO", "name": "Bogotá", "lat": 4.6, "lng": -74.1}}]}]},
        "orcid": {"orcid-identifier": {"path": "0000-0002-1825-0097"}, "person": {"name": {"given-names": {"value": "Jo"}, "family-name": {"value": "Do"}}}},
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(doc, ensure_ascii=False))
    paper = providers.crossref_papers(spark, str(tmp_path / "crossref")).first()
    assert (paper["doi"], paper["title"], paper["year"], paper["authors"]) == ("10.1/x", "T", 2019, ["A B", "Group"])
    place = providers.ror_institutions(spark, str(tmp_path / "ror")).first()
    assert (place["record_id"], place["name"], place["aliases"], place["country"], place["city"]) == ("02mhbdp94", "Main", ["Alias"], "CO", "Bogotá")
    assert tuple(providers.orcid_people(spark, str(tmp_path / "orcid")).first()) == ("0000-0002-1825-0097", "Jo Do")


def test_arxiv(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    row = providers.arxiv_papers(spark, str(tmp_path)).first()
    assert (row["record_id"], row["title"], row["abstract"], str(row["published"]), row["authors"]) == ("2101.00001", "A title on lines", "Text", "2021-01-02", ["Ann A", "Bo B"])
    assert [(c["category"], c["role"]) for c in row["categories"]] == [("hep-th", "primary"), ("gr-qc", "secondary")]


def test_streams_equal_batches(spark):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for make, mode in ((lambda d: ev.tumbling(d, "1 day", "event_type"), "complete"), (lambda d: ev.sliding(d, "2 days", "1 day"), "complete")):
        assert sorted(map(str, ev.drained(make(ev.table_stream(spark, folder, "events")), mode).collect())) == sorted(map(str, make(batch).collect()))


def test_yearly_files_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, 2000 + k % 3, "x" * k) for k in range(50)], "k int, period int, text string")
    sinks.write_yearly(df, str(tmp_path / "y"))
    assert sorted(p.name for p in (tmp_path / "y").glob("period=*")) == ["period=2000", "period=2001", "period=2002"]
    assert spark.read.parquet(str(tmp_path / "y")).where("period = 2001").count() == 17
    shards = sinks.sized_shards(df, ["k"], F.length("text"), 100).groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect()
    assert max(r["n"] for r in shards) < 200


def test_interning_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, v string")
    rows, dictionary = sinks.interned(df, "v")
    back = rows.join(dictionary, "v_id", "left").select("k", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
