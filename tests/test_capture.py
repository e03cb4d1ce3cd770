"""Pages, receipts and where a capture goes on."""

from pyspark.sql import functions as F

from scholarframe.sources import capture

PAGE = "partition string, page int, cursor string, next_cursor string, payload string, n_records long, expected long"


def points(spark, receipts, plan):
    rows = capture.resume_points(spark.createDataFrame([(p,) for p in plan], "partition string"), receipts).collect()
    return {r["partition"]: (r["next_page"], r["next_cursor"], r["n_records"], r["state"]) for r in rows}


def test_where_a_capture_goes_on(spark, tmp_path):
    store = str(tmp_path / "store")
    pages = [
        ("done", 0, None, "x", "d0", 3, 5), ("done", 1, "x", None, "d1", 2, 5),
        ("open", 0, None, "y", "o0", 3, 9), ("open", 1, "y", "z", "o1", 3, 9),
        ("gap", 0, None, "g", "g0", 1, None), ("gap", 2, "h", None, "g2", 1, None),
        ("broken chain", 0, None, "a", "b0", 1, 3), ("broken chain", 1, "other", None, "b1", 1, 3),
        ("short", 0, None, None, "s0", 4, 7),
        ("late start", 1, "x", None, "l1", 1, 1),
        ("twice", 0, None, "t", "t0", 2, 3), ("twice", 1, "old", None, "t1 old", 9, 3), ("twice", 1, "t", None, "t1", 1, 3), ("twice", 1, "t", None, "t1", 1, 3),
        ("lost", 0, None, "k", "k0", 1, 2), ("lost", 1, "k", None, "k1", 1, 2),
        ("not planned", 0, None, None, "n0", 1, 1),
    ]
    receipts = capture.kept_pages(spark.createDataFrame(pages, PAGE), store)
    lost = receipts.where("partition = 'lost' and page = 1").first()["sha256"]
    (tmp_path / "store" / lost[:2] / lost).unlink()
    plan = ["done", "open", "gap", "broken chain", "short", "late start", "twice", "lost", "new"]
    assert points(spark, capture.verified_receipts(receipts, store), plan) == {
        "done": (2, None, 5, "complete"), "open": (2, "z", 6, "open"), "gap": (1, "g", 1, "open"), "broken chain": (1, "a", 1, "open"), "short": (0, None, 4, "count differs"),
        "late start": (0, None, 0, "not begun"), "twice": (2, None, 3, "complete"), "lost": (1, "k", 1, "open"), "new": (0, None, 0, "not begun"),
    }
    # the page that was lost is fetched again, and the partition is complete
    capture.kept_pages(spark.createDataFrame([p for p in pages if p[4] == "k1"], PAGE), store)
    assert points(spark, capture.verified_receipts(receipts, store), ["lost"])["lost"] == (2, None, 2, "complete")


def test_empty(spark, tmp_path):
    receipts = spark.createDataFrame([], f"{capture.RECEIPT}, verified boolean")
    assert points(spark, receipts, ["a"]) == {"a": (0, None, 0, "not begun")}
    assert capture.resume_points(receipts.select("partition").limit(0), receipts).where(F.lit(True)).count() == 0
