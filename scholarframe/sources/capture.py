"""Pages of a capture with their receipts, and where each partition goes on.

A page's payload lies in the artifact store under its digest; its receipt says
which page of which partition it is, the cursor it was asked with, the one it
gave, and how many records it holds.  A partition's pages count as far as they
follow on one another without a gap, each asked with the cursor that the page
before gave and each with the payload that the receipt names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.sources import artifacts as art

RECEIPT = "partition string, page int, cursor string, next_cursor string, sha256 string, n_records long, expected long"


def kept_pages(pages: DataFrame, store: str) -> DataFrame:
    """Puts the payloads of ``pages`` into the store, and gives their receipts with ``sha256`` in the payload's place.

    Writing a page again writes the same file and gives the same receipt.
    """
    art.put_payloads(pages, "payload", store)
    return pages.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256)).drop("payload")


def verified_receipts(receipts: DataFrame, store: str) -> DataFrame:
    """``receipts`` with ``verified``: whether the file with the page's payload is there and as named; each file is read once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = art._opened(store)
        for batch in batches:
            names = batch.column(0).to_pylist()
            good = [art.problem_of(system, f"{root}/{art.name_of(n)}", n) is None for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_())], ["sha256", "verified"])

    files = receipts.select("sha256").where("sha256 is not null").distinct().mapInArrow(check, "sha256 string, verified boolean")
    return receipts.join(files, "sha256", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def resume_points(plan: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(partition, next_page, next_cursor, n_records, state)`` for every partition of the plan.

    ``receipts`` are verified; of several for one page the one asked with the
    right cursor counts, then the one with the smallest digest.  ``state`` is
    ``not begun``, ``open``, ``complete`` when the last page gives no cursor
    and the records are as many as expected, or ``count differs``, in which
    case the partition is captured again from its first page.
    """
    # a partition's receipts, some hundred pages, follow on one another: the first that does not ends the chain
    once = receipts.where("verified").groupBy("partition", "page").agg(F.array_sort(F.collect_set(F.struct("cursor", "sha256", "next_cursor", "n_records", "expected"))).alias("options"))
    lists = once.groupBy("partition").agg(F.array_sort(F.collect_list(F.struct("page", "options"))).alias("pages"))
    start = F.struct(F.lit(0).alias("next"), F.lit(None).cast("string").alias("cursor"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("expected"), F.lit(False).alias("ended"))

    def step(chain: F.Column, page: F.Column) -> F.Column:
        fits = F.get(F.filter(page["options"], lambda o: o["cursor"].eqNullSafe(chain["cursor"])), F.lit(0))
        goes_on = ~chain["ended"] & (page["page"] == chain["next"]) & fits.isNotNull()
        more = F.struct(
            (chain["next"] + 1).alias("next"), fits["next_cursor"].alias("cursor"), (chain["n"] + fits["n_records"]).alias("n"), F.coalesce(fits["expected"], chain["expected"]).alias("expected"), fits["next_cursor"].isNull().alias("ended")
        )
        return F.when(goes_on, more).otherwise(chain)

    chained = lists.select("partition", F.aggregate("pages", start, step).alias("c"))
    joined = plan.select("partition").distinct().join(chained, "partition", "left")
    whole = F.col("c.expected").isNull() | (F.col("c.expected") == F.col("c.n"))
    state = F.when(F.coalesce("c.next", F.lit(0)) == 0, "not begun").when(~F.col("c.ended"), "open").when(whole, "complete").otherwise("count differs")
    again = state == "count differs"
    return joined.select(
        "partition",
        F.when(again, 0).otherwise(F.coalesce("c.next", F.lit(0))).alias("next_page"),
        F.when(~again, F.col("c.cursor")).alias("next_cursor"),
        F.coalesce("c.n", F.lit(0)).cast("long").alias("n_records"),
        state.alias("state"),
    )
