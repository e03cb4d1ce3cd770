"""Event-time operators; each works on a batch table and on a stream alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.session import shared_dir


def tumbling(events: DataFrame, size: str, *by: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums in windows that do not overlap."""
    return sliding(events, size, size, *by, ts=ts, value=value, late=late)


def sliding(events: DataFrame, size: str, step: str, *by: str, ts: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums in windows of ``size`` that begin every ``step``; ``late`` is the watermark's delay."""
    rows = events.withWatermark(ts, late) if late else events
    found = rows.groupBy(F.window(ts, size, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    rows = events.withWatermark(ts, late) if late else events
    found = rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all input there is now, as a table in the shared folder.

    In complete mode every batch replaces the result; in append mode each batch
    has a folder of its own, named by the batch, so a batch that is run again
    replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def table_stream(spark, folder: str, name: str) -> DataFrame:
    """A stream of the files of one table; times without a zone become times in the session's, as watermarks need."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in table.dtypes if kind == "timestamp_ntz"})
