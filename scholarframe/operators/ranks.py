"""Exact ranks and quantiles of cohorts of any size, by counting in value ranges.

Equal values are counted first, in tasks and then by value, so no task holds
the rows of a cohort.  Where a cohort has more distinct values than a task
should order, estimated quantiles cut them into ranges; the ranges are counted
exactly, and each is ordered by itself.  The estimates decide only how even
the ranges are, never a rank.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.session import stored

#: Distinct values that one task orders, and rows of cut points that are broadcast at most.
MOST_VALUES, MOST_BROADCAST = 1 << 16, 1 << 20


def beside(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of the one row of ``facts`` for its keys, nulls being equal; null where there is none."""
    named = facts.select(*(F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)), *(c for c in facts.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    joined = df.join(named, reduce(and_, same), "left") if keys else df.join(named)  # without keys, one row
    return joined.drop(*(f"__key_{i}" for i in range(len(keys))))


def cumulative(df: DataFrame, value: str, cohort: list[str], most: int | None = None) -> DataFrame:
    """``(*cohort, value, ties, below, cohort_size)``: how many values of a cohort equal each distinct one, and how many are below.

    Missing values do not count.  ``most`` distinct values of a cohort are
    ordered in one task, :data:`MOST_VALUES` by default.
    """
    most = most or MOST_VALUES
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*cohort, value).agg(F.count("*").alias("ties")), "counts")
    sizes = counts.groupBy(*cohort).agg(F.count("*").alias("n_values"))
    found = sizes.agg(F.max("n_values").alias("widest"), F.count("*").alias("n")).first()
    pieces = ceil((found["widest"] or 0) / most)
    own = Window.partitionBy(*cohort)
    if pieces <= 1:
        before = F.sum("ties").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumns({"below": F.coalesce(before, F.lit(0)), "cohort_size": F.sum("ties").over(own)})
    cuts = counts.groupBy(*cohort).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], F.lit(max(10_000, 20 * pieces))).alias("__cuts"))
    cuts = F.broadcast(cuts) if found["n"] * pieces <= MOST_BROADCAST else cuts
    ranged = beside(counts, cuts, cohort).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy(*cohort, "__range").agg(F.sum("ties").alias("__sum"))
    base = F.coalesce(F.sum("__sum").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select(*cohort, "__range", base.alias("__base"), F.sum("__sum").over(own).alias("cohort_size"))  # as many rows as ranges
    within = Window.partitionBy(*cohort, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = beside(ranged.withColumn("__within", F.coalesce(F.sum("ties").over(within), F.lit(0))), bases, [*cohort, "__range"])
    return placed.select(*cohort, value, "ties", (F.col("__base") + F.col("__within")).alias("below"), "cohort_size")


def cohort_quantiles(df: DataFrame, value: str, cohort: list[str], wanted: dict[str, float], most: int | None = None) -> DataFrame:
    """``(*cohort, *wanted, n, least, greatest)``: exact, linearly interpolated quantiles of each cohort with a value."""
    ranked = cumulative(df, value, cohort, most)
    first, size = F.col("below"), F.col("cohort_size")

    def at(rank: F.Column) -> F.Column:
        return F.max(F.when((first <= rank) & (rank < first + F.col("ties")), F.col(value)))

    def place(q: float) -> F.Column:
        return F.lit(q) * (size - 1)

    sides = [side.alias(f"__{name}_{x}") for name, q in wanted.items() for x, side in (("lo", at(F.floor(place(q)))), ("hi", at(F.ceil(place(q)))))]
    found = ranked.groupBy(*cohort).agg(*sides, F.max("cohort_size").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"))

    def between(name: str, q: float) -> F.Column:
        where = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return F.when(low == high, low).otherwise((F.ceil(where) - where) * low + (where - F.floor(where)) * high).alias(name)

    return found.select(*cohort, *(between(*w) for w in wanted.items()), "n", "least", "greatest")
