"""Incremental updates: replay-safe batches, latest revision wins, and what has to be computed again.

The store is a log of batches.  Data go to folders with names of their own that
are never written twice; which of them count is said by the newest of a series
of small manifests, written after the data.  So a batch that is handed over
again replaces itself or, once it was compacted, changes nothing; a write that
breaks off leaves what readers see as it was; and a reader sees one manifest's
state, whatever is written meanwhile.  One writer at a time is assumed.  The
current state is the latest revision of each key.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators.relational import latest
from scholarframe.session import deleted

#: The batch number of a row, kept when batches are compacted.
BATCH = "__batch"


def content_hash(*columns: str) -> Column:
    """A digest of the content of a row."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def unseen(batch: DataFrame, applied: DataFrame, on: str = "content_hash") -> DataFrame:
    """Rows of a batch whose content was not applied yet, each once."""
    return batch.dropDuplicates([on]).join(applied.select(on).distinct(), on, "left_anti")


@dataclass(frozen=True)
class Manifest:
    """Which folders of a log count: one for each batch after ``upto``, and one for all up to there."""

    version: int = 0
    upto: int = -1
    base: str = ""
    batches: dict[int, str] = field(default_factory=dict)

    @property
    def folders(self) -> list[str]:
        return [f for f in (self.base, *(self.batches[n] for n in sorted(self.batches))) if f]


_MANIFEST = "upto long, base string, batches array<struct<number:long,folder:string>>, version long"


def manifest(spark: SparkSession, store: str) -> Manifest:
    """The newest manifest of the log at ``store``; of an absent log an empty one."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{store}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return Manifest()
        raise
    newest = rows.orderBy(F.col("version").desc()).first()
    return Manifest(newest["version"], newest["upto"], newest["base"], dict(map(tuple, newest["batches"] or []))) if newest else Manifest()


def commit(spark: SparkSession, store: str, new: Manifest) -> None:
    """One file, which Spark moves into its place when it is complete."""
    row = spark.createDataFrame([(new.upto, new.base, list(new.batches.items()), new.version + 1)], _MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(f"{store}/log/version={new.version + 1}")


def append_batch(batch: DataFrame, store: str, number: int) -> bool:
    """Adds a batch to the log, or replaces it; nothing is done, and false returned, where it was compacted already."""
    spark = batch.sparkSession
    now = manifest(spark, store)
    if number <= now.upto:
        return False
    folder = f"data/batch-{number}-{uuid.uuid4().hex}"
    batch.withColumn(BATCH, F.lit(number).cast("long")).write.parquet(f"{store}/{folder}")
    commit(spark, store, replace(now, batches=now.batches | {number: folder}))
    return True


def log_rows(spark: SparkSession, store: str) -> DataFrame:
    """All rows that count in the log at ``store``, with the number of their batch."""
    return spark.read.option("mergeSchema", "true").parquet(*(f"{store}/{f}" for f in manifest(spark, store).folders))


def compact(spark: SparkSession, store: str, keys: list[str], order: list[str], upto: int) -> None:
    """Puts the latest revision of each key in place of the batches up to ``upto``.

    Revisions that lost are not read again afterwards.  Older folders stay for
    readers that still have them open, until :func:`vacuum`.
    """
    now = manifest(spark, store)
    old = [f for f in (now.base, *(f for n, f in sorted(now.batches.items()) if n <= upto)) if f]
    if upto <= now.upto or not old:
        return
    folder = f"data/upto-{upto}-{uuid.uuid4().hex}"
    rows = spark.read.option("mergeSchema", "true").parquet(*(f"{store}/{f}" for f in old))
    latest(rows, keys, [*order, BATCH]).write.parquet(f"{store}/{folder}")
    commit(spark, store, Manifest(now.version, upto, folder, {n: f for n, f in now.batches.items() if n > upto}))


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes folders that the newest manifest does not name, and older manifests; call it when no older state is read any more."""
    now = manifest(spark, store)
    keep = {f.rpartition("/")[2] for f in now.folders}
    gone = deleted(spark, f"{store}/data", lambda name: name not in keep)
    return gone + deleted(spark, f"{store}/log", lambda name: name != f"version={now.version}")


def apply_stream(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Appends all input there is now to the log at ``store``."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, store, number)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()


def current_state(spark: SparkSession, store: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest revision of each key in the log at ``store``."""
    return latest(log_rows(spark, store), keys, [*order, BATCH]).drop(BATCH)


def changes_since(revisions: DataFrame, key: str, at: str, cursor: Column, content: list[str]) -> DataFrame:
    """``(key, at, *content, change)``: each record revised after ``cursor`` in its latest revision.

    ``change`` is ``created`` for records that had no revision up to the
    cursor, ``updated`` where the content differs from the one they had then,
    and ``unchanged`` where it came back to it.  Of revisions of one instant
    the one with the greatest content counts.  One aggregation by record; the
    cursor is a value, revisions without time are no changes.
    """
    own = F.struct(*content)
    before = F.when(F.col(at) <= cursor, F.struct(F.col(at), own.alias("own")))
    after = F.when(F.col(at) > cursor, F.struct(F.col(at), own.alias("own")))
    found = revisions.groupBy(key).agg(F.max(before).alias("before"), F.max(after).alias("after")).where("after is not null")
    change = F.when(F.col("before").isNull(), "created").when(F.col("before.own").eqNullSafe(F.col("after.own")), "unchanged").otherwise("updated")
    return found.select(key, F.col("after")[at].alias(at), "after.own.*", change.alias("change"))


def affected_partitions(batch: DataFrame, keys: list[str]) -> DataFrame:
    """The partitions that a batch touches."""
    return batch.select(*keys).distinct()


def recompute(facts: DataFrame, touched: DataFrame, keys: list[str], compute) -> DataFrame:
    """``compute`` over the touched partitions only."""
    return compute(facts.join(touched, keys, "left_semi"))


def replaced_partitions(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the partitions that ``fresh`` holds replaced."""
    return base.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


#: Days between updates of each source.
CADENCE = {"inspire": 1, "arxiv": 1, "ror": 7}


def due_sources(state: DataFrame, now: Column, cadence: dict[str, int] = CADENCE) -> DataFrame:
    """Sources that were never updated, have a checkpoint pending, or are past their cadence."""
    days = F.create_map(*[F.lit(x) for kv in cadence.items() for x in kv])
    due = F.col("last_success").isNull() | F.col("checkpoint_pending") | (F.datediff(now, F.col("last_success")) >= F.element_at(days, F.col("source")))
    return state.withColumn("due", F.coalesce(due, F.lit(False)))


def overlap_years(year: Column, current: int, overlap: int) -> Column:
    """Whether a year is fetched again because its records still change."""
    return year > current - overlap
