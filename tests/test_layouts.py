"""Pages from a directory of ranges, and reads that files answer by what they know of their keys."""

import pytest
from pyspark.sql import functions as F

from scholarframe.sources import sinks

SF = "/root/testdata/sf0.01"
ORDER = ["o_orderdate", "o_orderkey"]


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate", "o_custkey")


def files(df):
    return df.inputFiles()


def test_any_page(spark, orders, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_pages(orders.repartition(6), str(tmp_path / "p"), ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = [tuple(r) for r in orders.orderBy(*ORDER).collect()]
    ranges = spark.read.parquet(str(tmp_path / "p" / "directory")).orderBy("first").collect()
    assert len(ranges) == 4
    border = ranges[1]["first"] // 25  # a page over the border of two ranges
    for size, number in ((25, 0), (25, 1), (25, border), (25, 599), (25, 600), (7, 1000), (20_000, 0)):
        page, total = sinks.read_page(spark, str(tmp_path / "p"), number, size)
        assert [tuple(r) for r in page.collect()] == whole[number * size : (number + 1) * size] and total == len(whole)
    page, _ = sinks.read_page(spark, str(tmp_path / "p"), 300, 25)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters") == 1 and "__range" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        sinks.read_page(spark, str(tmp_path / "p"), -1, 25)
    sinks.write_pages(orders.limit(0), str(tmp_path / "e"), ORDER)
    assert sinks.read_page(spark, str(tmp_path / "e"), 0, 25)[1] == 0


def scanned(df):
    """Rows that the scan of a query handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith(("Scan", "ColumnarToRow")) and node.nodeName().startswith("Scan"):
            return node.metrics().get("numOutputRows").get().value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if hasattr(node, "executedPlan") and node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
    raise AssertionError("no scan")


def test_files_skip_by_key(spark, tmp_path):
    """Sorted by k; read by a key that is scattered over all files and lies within every row group's bounds."""
    df = spark.range(200_000).select("id", (F.xxhash64("id") % 1_000_000_007).alias("other"))
    plain, keyed = str(tmp_path / "plain"), str(tmp_path / "keyed")
    df.repartitionByRange(4, "id").sortWithinPartitions("id").write.option("parquet.block.size", 100_000).parquet(plain)
    sinks.write_keyed(df, keyed, ["id"], ["other"], distinct=10_000, block_bytes=100_000)
    value = df.where("id = 123456").first()["other"]
    for folder in (plain, keyed):
        found = sinks.read_keyed(spark, folder, "other", [value])
        assert [r["id"] for r in found.collect()] == [123456]
    with_filter, without = scanned(sinks.read_keyed(spark, keyed, "other", [value])), scanned(sinks.read_keyed(spark, plain, "other", [value]))
    assert with_filter * 4 < without
    assert sinks.read_keyed(spark, keyed, "other", []).count() == 0
