"""Export, certification and seeding of whole datasets."""

import pytest
from pyspark.sql import functions as F

from scholarframe.sources import dataset as ds

SPEC = {
    "field": ds.Table("field_id string, name string", ["field_id"]),
    "institution": ds.Table("institution_id int, name string, weight double", ["institution_id"]),
    "observation": ds.Table("institution_id int, field_id string, year int, value double", ["institution_id", "field_id", "year"], {"institution_id": "institution", "field_id": "field"}),
    "lineage": ds.Table("institution_id int, sources array<string>", ["institution_id"], {"institution_id": "institution"}),
}


@pytest.fixture
def tables(spark):
    return {
        "field": spark.createDataFrame([("a", "A é"), ("b", None)], SPEC["field"].schema),
        "institution": spark.range(60).select(F.col("id").cast("int").alias("institution_id"), F.concat(F.lit("I "), "id").alias("name"), (F.col("id") / 7).alias("weight")),
        "observation": spark.range(120).select((F.col("id") / 2).cast("int").alias("institution_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("field_id"), F.lit(2020).alias("year"), F.when(F.col("id") % 9 > 0, F.col("id") / 3).alias("value")),
        "lineage": spark.range(60).select(F.col("id").cast("int").alias("institution_id"), F.array(F.concat(F.lit("r"), "id"), F.lit("x")).alias("sources")),
    }


def rows(tables):
    return {n: sorted(map(str, t.collect())) for n, t in tables.items()}


def test_round_trip(spark, tables, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "target")
    shards = ds.export_dataset(tables, SPEC, store, "v1", limit=2000)
    assert {r["kind"] for r in shards.collect()} == set(SPEC) and shards.where("n_bytes > 2000").count() == 0
    assert ds.certified_export(spark, store, "v1", SPEC, tables).where("not passed").collect() == []
    assert all(t.isEmpty() for t in ds.seeded(spark, target, SPEC).values())
    assert ds.seed_dataset(spark, store, "v1", SPEC, target).collect() == []
    got = ds.seeded(spark, target, SPEC)
    assert rows(got) == rows(tables)
    assert [r["name"] for r in ds.entity(got, SPEC, "institution", 7).collect()] == ["I 7"]
    assert ds.entity(got, SPEC, "observation", 7, "b", 2020).count() == 1
    with pytest.raises(ValueError):
        ds.entity(got, SPEC, "observation", 7)


def test_refused_and_unseen(spark, tables, tmp_path):
    """Every kind of problem is found, and a refused export leaves the dataset that was there."""
    store, target = str(tmp_path / "store"), str(tmp_path / "target")
    ds.export_dataset(tables, SPEC, store, "v1", limit=2000)
    ds.seed_dataset(spark, store, "v1", SPEC, target)
    bad = dict(tables)
    bad["field"] = tables["field"].where("field_id = 'a'")
    bad["institution"] = tables["institution"].unionAll(tables["institution"].where("institution_id = 3")).unionAll(spark.createDataFrame([(None, "no key", 1.0)], SPEC["institution"].schema))
    ds.export_dataset(bad, SPEC, store, "v2", limit=2000)
    problems = {(r["table"], r["problem"]): r["n"] for r in ds.seed_dataset(spark, store, "v2", SPEC, target).collect()}
    assert problems == {("institution", "key missing"): 1, ("institution", "key repeated"): 1, ("observation", "field_id names no field"): 60}
    gates = {r["gate"]: (r["passed"], r["n"]) for r in ds.certified_export(spark, store, "v2", SPEC, tables).collect()}
    assert gates == {"shards": (True, 0), "rows": (True, 0), "keys": (False, 2), "references": (False, 60), "population": (False, 3)}
    assert rows(ds.seeded(spark, target, SPEC)) == rows(tables)
    shard = next(p for p in (tmp_path / "store").glob("??/*") if p.is_file() and p.name in {r["sha256"] for r in ds.art.shard_manifest(spark, store, "v1").where("kind = 'lineage'").collect()})
    shard.write_bytes(shard.read_bytes() + b"!")
    found = {(r["table"], r["problem"]) for r in ds.seed_dataset(spark, store, "v1", SPEC, target).collect()}
    assert found == {("lineage", "shard: size differs")}
    wrong = {**SPEC, "field": ds.Table("field_id string, name int", ["field_id"])}
    found = {(r["table"], r["problem"]) for r in ds.read_export(spark, store, "v2", wrong)[1].collect()}
    assert ("field", "not well formed") in found
