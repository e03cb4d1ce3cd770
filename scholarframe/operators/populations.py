"""Whether two tables hold the same rows, and which differ, without moving what is equal.

A table is summed up by ranges of its rows' digests: how many rows a range has,
and the sums of two 64-bit halves of their digests.  Sums do not depend on
order, and tasks add up their own rows first.  Ranges with equal sums hold the
same rows and are left alone; only rows of the others are looked at again, in
finer ranges, and compared one by one at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.operators.exact import row_digest
from scholarframe.session import stored

#: Hexadecimal digits of a digest that cut a table into ranges, more in each round.
FIRST_DIGITS, STEP_DIGITS, MOST_DIGITS = 2, 2, 6
#: Rows in unlike ranges that are compared one by one.
FEW_ROWS = 1 << 20


def _halves(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in (0, 1)]


def multiset_digest(digest: Column) -> list[Column]:
    """Aggregates that are equal for equal multisets of rows: a count and two sums of halves of the rows' digests."""
    return [F.count("*").alias("n"), *(F.sum(h).alias(f"s{i}") for i, h in enumerate(_halves(digest)))]


def _summary(rows: DataFrame, digits: int) -> DataFrame:
    return rows.groupBy(F.substring("d", 1, digits).alias("range")).agg(*multiset_digest(F.col("d")))


def _unlike(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """``range, n``: the ranges in which the tables differ, at most ``16 ** digits``."""
    x, y = (_summary(t, digits).select("range", F.struct("n", "s0", "s1").alias(side)) for t, side in ((a, "x"), (b, "y")))
    both = x.join(y, "range", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("range", (F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))).alias("n"))


def row_differences(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(*columns, only_in, surplus)``: the rows that one table has more often than the other, ``left`` or ``right``, and how much more often.

    Empty where both hold the same rows, repeats included.  Equal tables cost
    two scans and a shuffle of a few hundred sums.
    """
    columns = columns or a.columns
    digest = row_digest(columns).alias("d")
    own = [t.select(*columns, digest) for t in (a, b)]
    digits = FIRST_DIGITS
    while True:
        ranges = stored(_unlike(own[0].select("d"), own[1].select("d"), digits), "ranges")
        left = ranges.agg(F.sum("n").alias("n"), F.count("*").alias("ranges")).first()
        if not left["ranges"] or (left["n"] or 0) <= FEW_ROWS or digits >= MOST_DIGITS:
            break
        digits += STEP_DIGITS
    # at most 16 ** MOST_DIGITS ranges; they are broadcast as far as they are few
    ranges = F.broadcast(ranges) if left["ranges"] <= 1 << 16 else ranges
    inside = [t.withColumn("range", F.substring("d", 1, digits)).join(ranges.select("range"), "range", "left_semi").drop("range") for t in own]
    counts = inside[0].withColumn("x", F.lit(1)).unionByName(inside[1].withColumn("x", F.lit(-1)))
    found = counts.groupBy("d", *columns).agg(F.sum("x").alias("x")).where("x <> 0")
    return found.select(*columns, F.when(F.col("x") > 0, "left").otherwise("right").alias("only_in"), F.abs("x").alias("surplus"))


def incomplete_members(members: DataFrame, member: str, peers: DataFrame, peer: str, seen: DataFrame) -> DataFrame:
    """``(member, peer, only_in)``: pairs of every member with every peer that are not seen (``left``), and seen pairs of others (``right``).

    The table of all pairs is never made: a member whose distinct peers have
    the digest of all peers is complete, and only the others meet the peers
    they lack.  ``peers`` are few, at most :data:`FEW_ROWS`; ``seen`` may
    repeat pairs, and pairs with a null are of no one.
    """
    every = peers.select(F.col(peer).alias("p")).where("p is not null").distinct()
    total = every.agg(*multiset_digest(F.sha2(F.col("p").cast("string"), 256)), F.collect_set("p").alias("all")).first()
    if total["n"] > FEW_ROWS:
        raise ValueError(f"at most {FEW_ROWS} peers")
    pairs = seen.select(F.col(member).alias("m"), F.col(peer).alias("p")).where("m is not null and p is not null").distinct()
    sums = pairs.groupBy("m").agg(*multiset_digest(F.sha2(F.col("p").cast("string"), 256)))
    whole = sums.where((F.col("n") == total["n"]) & (F.col("s0") == F.lit(total["s0"])) & (F.col("s1") == F.lit(total["s1"]))).select("m")
    unlike = members.select(F.col(member).alias("m")).where("m is not null").distinct().join(whole, "m", "left_anti")
    lacking = unlike.withColumn("p", F.explode(F.lit(total["all"]))).join(pairs, ["m", "p"], "left_anti").withColumn("only_in", F.lit("left"))
    known = members.select(F.col(member).alias("m")).distinct()
    others = pairs.join(known, "m", "left_anti").unionByName(pairs.join(every, "p", "left_anti")).distinct().withColumn("only_in", F.lit("right"))
    return lacking.unionByName(others.select("m", "p", "only_in")).select(F.col("m").alias(member), F.col("p").alias(peer), "only_in")
