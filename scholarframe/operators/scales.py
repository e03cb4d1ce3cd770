"""Scores within a cohort: exact quantiles, ranks and robust centring, whatever the size of the cohort.

Cohorts are summarised by :mod:`scholarframe.operators.ranks`, so no task holds
all rows of one, and the summaries are joined to the rows.  All take the cohort's key columns.  A cohort that is too small or has no
spread gives no score, except where ties have a middle score of 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.operators.ranks import beside, cohort_quantiles, cumulative
from scholarframe.session import stored

DEGENERATE = 1e-12


def winsorised_log(df: DataFrame, value: str, cohort: list[str], minimum: int, low: float = 0.05, high: float = 0.95, into: str = "score") -> DataFrame:
    """``log1p`` of the value, clipped to the cohort's quantiles and stretched to 0 to 100."""
    rows = stored(df.withColumn("__x", F.log1p(value)), "scaled")
    facts = cohort_quantiles(rows, "__x", cohort, {"__low": low, "__high": high}).select(*cohort, "__low", "__high", F.col("n").alias("__n"))
    spread = F.col("__high") - F.col("__low")
    score = 100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__x") - F.col("__low")) / spread))
    fits = F.col(value).isNotNull() & (F.col("__n") >= minimum) & (spread > DEGENERATE)
    return beside(rows, facts, cohort).withColumn(into, F.when(fits, score)).drop("__x", "__low", "__high", "__n")


def value_ranks(df: DataFrame, value: str, cohort: list[str], minimum: int = 2, into: str = "percentile") -> DataFrame:
    """``cohort``, ``value``, ``ties``, ``cohort_size`` and the middle-rank percentile of each distinct value of each cohort.

    Missing values neither get a rank nor count in the cohort's size.  Cohorts
    of one value give 50, those of fewer than ``minimum`` rows null.
    """
    ranked = cumulative(df, value, cohort)
    middle = 100 * (F.col("below") + (F.col("ties") - 1) / 2) / (F.col("cohort_size") - 1)
    percentile = F.when(F.col("cohort_size") < minimum, None).when(F.col("ties") == F.col("cohort_size"), 50.0).otherwise(middle)
    return ranked.withColumn(into, percentile).drop("below")


def midrank(df: DataFrame, value: str, cohort: list[str], minimum: int = 2, into: str = "percentile") -> DataFrame:
    """``df`` with :func:`value_ranks` of each row's value; null where the value is missing or the cohort too small."""
    ranks = value_ranks(df, value, cohort, minimum, into).select(*cohort, value, into)
    return df.drop(into).join(ranks, [*cohort, value], "left")


def centred_change(df: DataFrame, value: str, cohort: list[str], minimum: int, clip: float = 3.0, into: str = "score") -> DataFrame:
    """Distance from the cohort's median in robust deviations, clipped, around 50.

    The deviation is the median absolute one times 1.4826, or the quartile
    range over 1.349 where that is zero; without either, 50 if all values are
    tied, else no score.
    """
    rows = stored(df, "changes")
    facts = cohort_quantiles(rows, value, cohort, {"__mid": 0.5, "__q1": 0.25, "__q3": 0.75}).withColumnsRenamed({"n": "__n", "least": "__lo", "greatest": "__hi"})
    rows = stored(beside(rows, facts, cohort).withColumn("__away", F.abs(F.col(value) - F.col("__mid"))), "centred")
    away = cohort_quantiles(rows, "__away", cohort, {"__mad": 0.5}).select(*cohort, (F.col("__mad") * 1.4826).alias("__mad"))
    df = beside(rows, away, cohort)
    wide = (F.col("__q3") - F.col("__q1")) / 1.349
    scale = F.when(F.col("__mad") > DEGENERATE, F.col("__mad")).when(wide > DEGENERATE, wide)
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - F.col("__mid")) / scale))
    tied = F.col("__hi") - F.col("__lo") <= DEGENERATE
    score = F.when(F.col(value).isNull() | (F.col("__n") < minimum), None).when(tied, 50.0).otherwise(50 + 50 / clip * z)
    return df.withColumn(into, score).drop("__mid", "__n", "__q1", "__q3", "__lo", "__hi", "__mad", "__away")


def minmax(df: DataFrame, value: str, cohort: list[str], constant: float = 50.0, into: str = "score") -> DataFrame:
    """0 to 100 between the cohort's extremes, to one decimal, halves up; ``constant`` where they meet."""
    w = Window.partitionBy(*cohort)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.floor((F.col(value) - low) / (high - low) * 1000 + 0.5) / 10
    return df.withColumn(into, F.when(high == low, F.when(high > 0, constant).otherwise(0.0)).otherwise(scaled))


def symmetric_change(recent: Column, baseline: Column, least_total: float = 0.0) -> Column:
    """``(R - B) / (R + B)``, unknown below the least total."""
    total = recent + baseline
    return F.when((total > 0) & (total >= least_total), (recent - baseline) / total)


def pilot_change(recent: Column, baseline: Column) -> Column:
    """``(R - B) / max(1, R + B)``."""
    return (recent - baseline) / F.greatest(F.lit(1.0), recent + baseline)
