"""Sums and digests that do not depend on the order of rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scholarframe.session import cut

#: Bits of a limb; the lowest limb takes the last bits of the smallest double.
LIMB_BITS, LOWEST_LIMB = 24, -45
#: Limb numbers that count values that are not finite.
NAN, INFINITE, MINUS_INFINITE = 1000, 1001, 1002


def limbs(value: Column) -> Column:
    """A double as whole numbers times powers of ``2 ** LIMB_BITS``: an array of ``(limb, part)``, null for null.

    Nothing is rounded: the value is scaled by powers of two, which is exact,
    and cut into at most four parts.  The exponent is an estimate that may be
    off by one; a part is then a bit longer or the first one zero.
    """
    x = value.cast("double")
    top = F.floor(F.log2(F.abs(x)) / LIMB_BITS).cast("int")
    half = F.pow(F.lit(2.0), top * (-LIMB_BITS // 2))  # in two steps, as the whole power may be out of range

    def pieces(rest: Column, limb: Column, left: int) -> list[Column]:
        whole = rest.cast("long")
        own = F.struct(limb.alias("limb"), whole.alias("part"))
        return [own, *(pieces((rest - whole) * float(1 << LIMB_BITS), limb - 1, left - 1) if left else [])]

    def special(code: int) -> Column:
        return F.array(F.struct(F.lit(code).alias("limb"), F.lit(1).cast("long").alias("part")))

    scaled = F.filter(F.transform(F.array(x * half * half), lambda r: F.array(*pieces(r, top, 3)))[0], lambda p: (p["part"] != 0) | (p["limb"] == top))
    zero = F.array(F.struct(F.lit(0).alias("limb"), F.lit(0).cast("long").alias("part")))
    return (
        F.when(F.isnan(x), special(NAN))
        .when(x == float("inf"), special(INFINITE))
        .when(x == float("-inf"), special(MINUS_INFINITE))
        .when(x == 0, zero)
        .when(x.isNotNull(), scaled)
    )


def accumulated(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """``(*by, name, limb, part)``: the sums of ``values`` in limbs.

    Whole numbers add without rounding, so the rows are the same whatever the
    order and partitioning, sums of several tables are merged by
    :func:`merged`, and each task hands on a few rows for a group.  A group
    whose values are all null keeps a row without limb.  A part is below
    ``2 ** 25``, so a long holds the sum of ``2 ** 38`` of them.
    """

    def named(name: str, value: Column) -> Column:
        own = F.coalesce(limbs(value), F.array().cast("array<struct<limb:int,part:bigint>>"))
        return F.transform(own, lambda p: F.struct(F.lit(name).alias("name"), p["limb"].alias("limb"), p["part"].alias("part")))

    parts = [named(*v) for v in values.items()]
    return merged(df.select(*by, F.inline_outer(F.concat(*parts))), by)


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Accumulated sums, of one table or the union of several, added up."""
    return parts.groupBy(*by, "name", "limb").agg(F.sum("part").alias("part"))


def _rounded(parts: list[dict] | None) -> float | None:
    """The double next to the value of limbs; infinite beyond the largest one."""
    known = {p["limb"]: p["part"] for p in parts or []}
    if not known:
        return None
    up, down = known.pop(INFINITE, 0), known.pop(MINUS_INFINITE, 0)
    if known.pop(NAN, 0) or (up and down):
        return float("nan")
    if up or down:
        return float("inf") if up else float("-inf")
    total = sum(part << LIMB_BITS * (limb - LOWEST_LIMB) for limb, part in known.items())
    try:
        return total / (1 << LIMB_BITS * -LOWEST_LIMB)  # whole numbers divide with one rounding
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


@F.arrow_udf(DoubleType())
def _value(parts: pa.Array) -> pa.Array:
    return pa.array([_rounded(p) for p in parts.to_pylist()], pa.float64())


def totals(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``(*by, *names)``: accumulated sums as doubles, each rounded once; null where no value was there.

    A group has at most 90 limbs for each name.
    """
    found = parts.groupBy(*by).agg(F.collect_list(F.struct("name", "limb", "part")).alias("parts"))

    def own(name: str) -> Column:
        return _value(F.transform(F.filter("parts", lambda p: p["name"] == name), lambda p: F.struct(p["limb"].alias("limb"), p["part"].alias("part"))))

    return found.select(*by, *(own(n).alias(n) for n in names))


def exact_sums(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """The sums of ``values`` in each group, exact and then rounded once, whatever the order of rows."""
    return totals(accumulated(df, by, **values), by, list(values))


def means_in_order(df: DataFrame, by: list[str], value: str, *order: str) -> DataFrame:
    """``(*by, mean)``: means of doubles that are added one by one in the given order.

    It is what a query gives that reads the rows in that order in one thread,
    whatever files and tasks they come from.  Rows of a group meet in one task,
    which reads them sorted and spills what it cannot hold.
    """
    rows = Window.partitionBy(*by).orderBy(*order)
    so_far = F.avg(value).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead(F.lit(False), 1, True).over(rows)
    return df.select(*by, value, *order).withColumns({"mean": so_far, "__last": last}).where("__last").select(*by, "mean")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of a row, nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


#: Rows whose digests a task sorts together, and hexadecimal digits that a round takes off.
DIGEST_ROWS, DIGEST_STEP = 1 << 16, 2


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(n_rows, digest)`` of a table, whatever the order and partitioning of its rows.

    Rows' digests are sorted and hashed in buckets of their own first digits,
    as many as keep a bucket at about ``DIGEST_ROWS`` rows, and the buckets'
    digests in turn in buckets of fewer digits, 256 at a time.  Equal rows are
    counted first, so that many copies of a row are one entry.
    """
    rows = df.select(row_digest(columns or df.columns).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    rows = cut(rows)
    digits = 0
    while rows.count() >> 4 * digits > DIGEST_ROWS:
        digits += DIGEST_STEP
    entry = F.concat_ws(":", "d", "n")
    level = rows.groupBy(F.substring("d", 1, digits).alias("b")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("digest"))
    while digits:
        digits -= DIGEST_STEP
        own = F.array_sort(F.collect_list(F.struct("b", "digest")))  # at most 256
        level = level.groupBy(F.substring("b", 1, digits).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(own, lambda x: x["digest"]), ","), 256).alias("digest")).withColumnRenamed("up", "b")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))
