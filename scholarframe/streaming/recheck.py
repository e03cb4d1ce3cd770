"""The current revision of each record in a stream, and when it has to be checked again.

Each key keeps its latest revision and a timer.  A newer revision supersedes
the one before and sets the timer anew; an older one, come late, changes
nothing.  When event time has passed the term without a newer revision, the
timer fires and the record is due, although no input for its key came.  The
result does not depend on how the input falls into batches as long as rows are
no later than the watermark allows, and :func:`checks` gives the same rows for
a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: After this many days without a newer revision a record is checked again.
TERM_DAYS = 7
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _naive(at: datetime) -> datetime:
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


class Recheck(StatefulProcessor):
    """Emits ``(key, kind, at, revision)`` with kind ``current``, ``superseded`` or ``due``."""

    def __init__(self, key: str, at: str, revision: str, days: int):
        self.key, self.at, self.revision, self.term = key, at, revision, timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at timestamp, revision long, waits boolean")

    def _row(self, key: Any, kind: str, at: datetime, revision: int) -> Row:
        return Row(**{self.key: key[0], "kind": kind, "at": at, "revision": revision})

    def _timer(self, at: datetime) -> int:
        due = at + self.term  # a timer counts whole milliseconds and fires when all of them have passed
        return -(-int((due.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        # time and number of the key's rows of one batch, which maxFilesPerTrigger and the like bound
        coming = sorted({(_naive(r[self.at]), r[self.revision]) for r in rows if r[self.at] is not None and r[self.revision] is not None})
        known = self.latest.get()
        at, revision, waits = (_naive(known[0]), known[1], known[2]) if known else (None, None, False)
        before = at if waits else None
        for new in coming:
            if at is not None and new <= (at, revision):
                continue
            if at is not None:
                if waits and new[0] >= at + self.term:
                    yield self._row(key, "due", at + self.term, revision)
                yield self._row(key, "superseded", new[0], revision)
            (at, revision), waits = new, True
            yield self._row(key, "current", at, revision)
        if at is None or (before is not None and before == at):
            return
        if before is not None:
            self.handle.deleteTimer(self._timer(before))
        if waits:
            self.handle.registerTimer(self._timer(at))
        self.latest.update((at, revision, waits))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        at, revision, waits = self.latest.get()
        at = _naive(at)
        if waits:
            self.latest.update((at, revision, False))
            yield self._row(key, "due", at + self.term, revision)

    def close(self) -> None:
        """Nothing is held beyond the state."""


def checked(stream: DataFrame, key: str, at: str, revision: str, late: str, days: int = TERM_DAYS) -> DataFrame:
    """``(key, kind, at, revision)`` of a stream of revisions, by keyed state with timers in event time.

    Rows later than ``late`` are dropped.  Needs the RocksDB state store:
    :func:`use_state_store`.
    """
    key_type = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(at).cast("timestamp").alias(at), F.col(revision).cast("long").alias(revision)).where(F.col(key).isNotNull()).withWatermark(at, late)
    return rows.groupBy(key).transformWithState(Recheck(key, at, revision, days), f"`{key}` {key_type}, kind string, at timestamp, revision long", "append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """State in RocksDB, which timers need; it is checkpointed with the stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def checks(revisions: DataFrame, key: str, at: str, revision: str, until: F.Column, days: int = TERM_DAYS) -> DataFrame:
    """The rows of :func:`checked` for a table, with records due up to the time ``until``."""
    rows = revisions.select(key, F.col(at).cast("timestamp").alias("at"), F.col(revision).cast("long").alias("revision")).dropna().distinct()
    w = Window.partitionBy(key).orderBy("at", "revision")
    rows = rows.withColumns({"next": F.lead("at").over(w), "due": F.col("at") + F.make_interval(days=F.lit(days))})
    is_due = F.when(F.col("next").isNull(), F.col("due") <= until).otherwise(F.col("next") >= F.col("due"))
    events = F.array(
        F.struct(F.lit("current").alias("kind"), F.col("at")),
        F.struct(F.lit("superseded").alias("kind"), F.col("next").alias("at")),
        F.struct(F.lit("due").alias("kind"), F.when(is_due, F.col("due")).alias("at")),
    )
    return rows.select(key, "revision", F.inline(events)).where("at is not null").select(key, "kind", "at", "revision")
