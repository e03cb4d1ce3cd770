"""The record source, the log of batches, and changes since a cursor."""

import json

import pytest
from pyspark.sql import functions as F

from scholarframe.sources import cursor
from scholarframe.streaming import incremental as inc


class Provider:
    """A provider that lists revisions by (updated, id) and gives them in pages."""

    def __init__(self, folder):
        self.folder, self.n = folder, 0
        folder.mkdir()

    def page(self, *records):
        self.n += 1
        lines = [json.dumps({"id": k, "updated": u, "title": t}) for k, u, t in records]
        (self.folder / f"{self.n:04d}.jsonl").write_text("\n".join(lines) + "\n")


@pytest.fixture
def provider(spark, tmp_path):
    spark.dataSource.register(cursor.RecordSource)
    return Provider(tmp_path / "pages")


def stream(spark, provider, **options):
    return spark.readStream.format("provider_records").options(**options).load(f"file://{provider.folder}")


def state(spark, store):
    return sorted(map(tuple, inc.current_state(spark, store, ["id"], ["updated"]).select("id", "updated").collect()))


def test_late_revisions_and_equal_instants(spark, provider, tmp_path):
    store, checkpoint, mark = str(tmp_path / "store"), str(tmp_path / "checkpoint"), f"file://{tmp_path}/cursor"
    run = lambda: inc.apply_stream(stream(spark, provider, cursor=mark), store, checkpoint)
    provider.page(("a", "2020-01-01", "A"), ("b", "2020-01-02", "B"))
    run()
    provider.page(("c", "2020-01-02", "C"), ("d", "2020-01-02", "D"))  # the instant of b goes on behind the page's end
    provider.page(("d", "2020-01-02", "D"), ("a", "2020-01-03", "A2"))  # a page that repeats a record, and a late revision
    run()
    assert state(spark, store) == [("a", "2020-01-03"), ("b", "2020-01-02"), ("c", "2020-01-02"), ("d", "2020-01-02")]
    assert inc.log_rows(spark, store).where(F.col(inc.BATCH) == 0).count() == 2
    run()  # nothing new, nothing written
    assert inc.log_rows(spark, store).select("id", "updated").distinct().count() == 5
    assert cursor.committed(mark) <= ("2020-01-03", "a")
    everything = spark.read.format("provider_records").load(f"file://{provider.folder}")
    assert everything.count() == 6


def test_failed_batch_comes_again(spark, provider, tmp_path):
    """The batch whose writing failed is read once more in the same range, though new pages came meanwhile."""
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    provider.page(("a", "2020-01-01", "A"), ("b", "2020-01-02", "B"))
    seen = []

    def write(fail):
        def each(batch, number):
            seen.append((number, sorted(r["id"] for r in batch.select("id").collect())))
            if fail:
                raise RuntimeError("lost")
            inc.append_batch(batch, store, number)

        return stream(spark, provider).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()

    with pytest.raises(Exception, match="lost"):
        write(True).awaitTermination()
    assert inc.manifest(spark, store) == inc.Manifest()
    provider.page(("c", "2020-01-05", "C"))
    for _ in range(2):  # first the batch that failed, then what came meanwhile
        write(False).awaitTermination()
    assert seen[:2] == [(0, ["a", "b"]), (0, ["a", "b"])]
    assert sorted(k for n, ids in seen[1:] for k in ids) == ["a", "b", "c"]
    assert [k for k, _ in state(spark, store)] == ["a", "b", "c"]


def test_cursor_without_checkpoint_and_overlap(spark, provider, tmp_path):
    """A stream without checkpoint starts at the committed cursor, less the overlap."""
    mark = tmp_path / "cursor"
    mark.write_text(json.dumps({"updated": "2020-01-02T00:00:00Z", "id": "b"}))
    provider.page(("a", "2020-01-01T23:59:30Z", "A"), ("b", "2020-01-02T00:00:00Z", "B"), ("c", "2020-01-02T00:00:00Z", "C"), ("d", "2020-01-03T00:00:00Z", "D"))
    for overlap, want in (("0", ["c", "d"]), ("60", ["a", "b", "c", "d"])):
        store = str(tmp_path / f"store{overlap}")
        inc.apply_stream(stream(spark, provider, cursor=f"file://{mark}", overlap=overlap), store, str(tmp_path / f"c{overlap}"))
        assert [k for k, _ in state(spark, store)] == want
        mark.write_text(json.dumps({"updated": "2020-01-02T00:00:00Z", "id": "b"}))


def test_unordered_page_is_refused(spark, provider):
    provider.page(("b", "2020-01-02", "B"), ("a", "2020-01-01", "A"))
    with pytest.raises(Exception, match="not in the order"):
        spark.read.format("provider_records").load(f"file://{provider.folder}").collect()


def test_long_lines_and_empty_pages(spark, provider):
    (provider.folder / "0000.jsonl").write_text("\n\n")
    provider.page(("a", "1", "x" * 300_000), ("b", "2", "y" * 300_000))
    assert cursor._bounds(f"file://{provider.folder}", str(provider.folder / "0001.jsonl")) == (("1", "a"), ("2", "b"))
    assert cursor._bounds(f"file://{provider.folder}", str(provider.folder / "0000.jsonl")) is None
    assert spark.read.format("provider_records").load(f"file://{provider.folder}").count() == 2


# --- the log


def rows(spark, *values):
    return spark.createDataFrame(values, "k string, at int, v string")


def log(spark, store):
    return sorted((r["k"], r["at"], r["v"]) for r in inc.current_state(spark, store, ["k"], ["at"]).collect())


def test_replay_of_compacted_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    batches = [rows(spark, ("a", 1, "x"), ("b", 1, "x")), rows(spark, ("b", 2, "y"), ("c", 2, "y")), rows(spark, ("c", 3, "z"))]
    for n, b in enumerate(batches):
        assert inc.append_batch(b, store, n)
    want = [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]
    assert log(spark, store) == want
    inc.compact(spark, store, ["k"], ["at"], upto=1)
    assert log(spark, store) == want
    assert not inc.append_batch(batches[1], store, 1) and not inc.append_batch(batches[0], store, 0)  # as after a restart
    assert inc.append_batch(batches[2], store, 2)
    assert log(spark, store) == want
    inc.compact(spark, store, ["k"], ["at"], upto=1)  # once more changes nothing
    inc.compact(spark, store, ["k"], ["at"], upto=2)
    assert log(spark, store) == want and inc.log_rows(spark, store).count() == 3
    assert inc.vacuum(spark, store) > 0
    assert log(spark, store) == want and inc.manifest(spark, store).batches == {}
    inc.append_batch(rows(spark, ("a", 9, "new")), store, 3)
    assert log(spark, store) == [("a", 9, "new"), *want[1:]]


def test_crash_between_the_writes(spark, tmp_path, monkeypatch):
    """Data without a manifest do not count; the writer's next try is whole."""
    store = str(tmp_path / "store")
    inc.append_batch(rows(spark, ("a", 1, "x"), ("b", 1, "x")), store, 0)
    inc.append_batch(rows(spark, ("a", 2, "y")), store, 1)
    want = log(spark, store)
    before = inc.log_rows(spark, store)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(inc, "commit", lost)
        for broken in (lambda: inc.append_batch(rows(spark, ("b", 5, "z")), store, 2), lambda: inc.compact(spark, store, ["k"], ["at"], upto=1)):
            with pytest.raises(RuntimeError):
                broken()
            assert log(spark, store) == want
    inc.compact(spark, store, ["k"], ["at"], upto=1)
    assert log(spark, store) == want
    assert before.count() == 3  # a reader that began earlier still finds its state
    inc.append_batch(rows(spark, ("b", 5, "z")), store, 2)
    assert log(spark, store) == [("a", 2, "y"), ("b", 5, "z")]


def test_replaced_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    inc.append_batch(rows(spark, ("a", 1, "x"), ("b", 1, "x")), store, 0)
    inc.append_batch(rows(spark, ("a", 1, "x")), store, 0)
    assert log(spark, store) == [("a", 1, "x")]


def test_changes_since(spark):
    revisions = [("new", 5, "p"), ("new", 6, "q"), ("old", 1, "p"), ("changed", 1, "p"), ("changed", 5, "q"), ("same", 2, "p"), ("same", 4, "q"), ("same", 5, "p"), ("edge", 3, "p"), ("none", None, "p"), ("nulls", 1, None), ("nulls", 5, None), ("set", 1, None), ("set", 5, "p")]
    df = spark.createDataFrame(revisions, "id string, at int, own string")
    got = {r["id"]: (r["at"], r["own"], r["change"]) for r in inc.changes_since(df, "id", "at", F.lit(3), ["own"]).collect()}
    assert got == {"new": (6, "q", "created"), "changed": (5, "q", "updated"), "same": (5, "p", "unchanged"), "nulls": (5, None, "unchanged"), "set": (5, "p", "updated")}
