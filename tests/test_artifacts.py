"""Shards and payloads under the digest of their bytes."""

import gzip
import hashlib
import tracemalloc

import pytest
from pyspark.sql import functions as F

from scholarframe.sources import artifacts as art


def named(store):
    return sorted(p for p in store.glob("??/*") if p.is_file())


def people(spark, n=2000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "paper").otherwise("affiliation").alias("kind"), F.col("id").alias("k"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))


def test_shards_round_trip(spark, tmp_path):
    store, df = tmp_path / "store", people(spark)
    shards = art.write_artifact_shards(df.repartition(7), str(store), "v1", "kind", ["k"], limit=5000).collect()
    assert len(shards) > 10 and {s["kind"] for s in shards} == {"paper", "affiliation"}
    for s in shards:
        stored = (store / s["sha256"][:2] / s["sha256"]).read_bytes()
        plain = gzip.decompress(stored)
        assert hashlib.sha256(stored).hexdigest() == s["sha256"] and len(stored) == s["n_stored"]
        assert len(plain) == s["n_bytes"] <= 5000 and plain.count(b"\n") == s["n_rows"]
    lines = art.read_artifact_shards(spark, str(store), "v1").select("line", "problem").collect()
    assert {r["problem"] for r in lines} == {None}
    assert sorted(r["line"] for r in lines) == sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    for kind in ("paper", "affiliation"):  # the shards of a kind, in order of their ids, hold its rows in order
        own = sorted((s for s in shards if s["kind"] == kind), key=lambda s: s["id"])
        keys = [(int(s["first"]), int(s["last"])) for s in own]
        assert keys == sorted(keys) and all(a <= b for a, b in keys)
    only = art.read_artifact_shards(spark, str(store), "v1", kinds=["paper"])
    assert only.where(F.get_json_object("line", "$.kind") != "paper").count() == 0 and only.count() == 667


def test_the_same_rows_give_the_same_names(spark, tmp_path):
    df = people(spark, 300)
    a = art.write_artifact_shards(df.coalesce(1), str(tmp_path / "a"), "v1", "kind", ["k"], limit=3000).collect()
    again = art.write_artifact_shards(df.coalesce(1), str(tmp_path / "a"), "v1", "kind", ["k"], limit=3000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, again))
    assert {p.name for p in named(tmp_path / "a")} == {s["sha256"] for s in a}


def test_failed_job_names_no_part(spark, tmp_path):
    """Tasks that fail leave no file under a name, and the job no manifest."""
    store = tmp_path / "store"
    bad = people(spark).withColumn("text", F.when(F.col("k") == 1234, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    spark.dataSource.register(art.ShardSink)
    with pytest.raises(Exception, match="lost"):
        bad.select("kind", F.col("k").cast("string").alias("key"), F.col("text").alias("line")).repartition(1).write.format("artifact_shards").mode("append").options(dataset="v1", limit=2000).save(str(store))
    assert named(store) == [] and not (store / "manifests").exists()
    with pytest.raises(Exception, match="alone is larger"):
        art.write_artifact_shards(people(spark), str(store), "v1", "kind", ["k"], limit=60)
    assert not (store / "manifests").exists()
    assert all(hashlib.sha256(p.read_bytes()).hexdigest() == p.name for p in named(store))
    art.write_artifact_shards(people(spark), str(store), "v1", "kind", ["k"], limit=2000)
    assert art.read_artifact_shards(spark, str(store), "v1").where("problem is null").count() == 2000


def test_damage_is_refused(spark, tmp_path):
    store = tmp_path / "store"
    shards = sorted(art.write_artifact_shards(people(spark, 500), str(store), "v1", "kind", ["k"], limit=3000).collect(), key=lambda s: s["id"])
    flipped, short, gone = (store / s["sha256"][:2] / s["sha256"] for s in shards[:3])
    content = bytearray(flipped.read_bytes())
    content[len(content) // 2] ^= 1
    flipped.write_bytes(content)
    short.write_bytes(short.read_bytes()[:-1])
    gone.unlink()
    got = art.read_artifact_shards(spark, str(store), "v1").collect()
    assert sorted((r["path"][3:], r["problem"]) for r in got if r["line"] is None) == sorted(zip((s["sha256"] for s in shards[:3]), ("digest differs", "size differs", "missing"), strict=True))
    assert sum(r["line"] is not None for r in got) == sum(s["n_rows"] for s in shards[3:])
    checked = {r["sha256"]: r["verified"] for r in art.verified_artifacts(spark, str(store)).collect()}
    assert sorted(k for k, ok in checked.items() if not ok) == sorted(s["sha256"] for s in shards[:2])


def test_plain_lines(spark, tmp_path):
    """Blank lines are no rows, the last line needs no end, and counts that are off are refused."""
    files = {"a": b'{"x":1}\n\n{"x":2}', "b": b"", "c": b"one\ntwo\n", "d": b"one\n"}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    entries = spark.createDataFrame([(k, hashlib.sha256(v).hexdigest(), {"a": 2, "b": 0, "c": 3, "d": None}[k]) for k, v in files.items()], "path string, sha256 string, n_rows long")
    got = sorted(map(tuple, art.verified_lines(entries, str(tmp_path)).collect()), key=str)
    assert got == [("a", 0, '{"x":1}', None), ("a", 2, '{"x":2}', None), ("c", None, None, "number of rows differs"), ("d", 0, "one", None)]
    packed = art.verified_lines(entries.where("path = 'd'").withColumn("n_rows", F.lit(1)), str(tmp_path), zipped=True).collect()
    assert [r["problem"] for r in packed] == ["not a compressed file"]


def test_large_file_needs_little_memory(tmp_path):
    place = tmp_path / "large"
    digest = hashlib.sha256()
    with place.open("wb") as f:
        for i in range(64):
            block = (f"line {i} " + "x" * 1000 + "\n").encode() * 1000
            digest.update(block)
            f.write(block)
    system, path = art._opened(str(place))
    tracemalloc.start()
    assert art.problem_of(system, path, digest.hexdigest()) is None
    assert sum(len(some) for some in art._lines(art._blocks(system, path), False, hashlib.sha256())) == 64_001
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_payloads(spark, tmp_path):
    store = tmp_path / "store"
    rows = [(b"one",), (b"two",), (b"one",), (None,), (b"",)] + [(b"hot",)] * 500
    refs = {r["sha256"]: r["size"] for r in art.put_payloads(spark.createDataFrame(rows, "p binary").repartition(8), "p", str(store)).collect()}
    assert refs == {hashlib.sha256(p).hexdigest(): len(p) for p in (b"one", b"two", b"", b"hot")}
    assert {p.name: p.read_bytes() for p in named(store)} == {hashlib.sha256(p).hexdigest(): p for p in (b"one", b"two", b"", b"hot")}
    art.put_payloads(spark.createDataFrame(rows, "p binary"), "p", str(store))
    assert len(named(store)) == 4 and not list(store.glob("_attempts/*"))
    assert all(r["verified"] for r in art.verified_artifacts(spark, str(store)).collect())
