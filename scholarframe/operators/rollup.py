"""Scores rolled up over fields, and user-weighted composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_field_mean(scores: DataFrame, keys: list[str], expected: int, gate: float = 0.9, score: str = "score") -> DataFrame:
    """The plain mean of available field scores, given when enough of the expected fields are there.

    A field without a score lowers the coverage; it is not a zero.
    """
    found = scores.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_fields"))
    return found.withColumn("coverage", F.col("n_fields") / expected).withColumn("mean_score", F.when(F.col("coverage") >= gate, F.col("mean_score")))


def branch_mean(scores: DataFrame, leaves: DataFrame, keys: list[str], gate: float = 0.9, score: str = "score") -> DataFrame:
    """The mean over the leaves of each branch; ``leaves`` is ``branch_id, field_id``."""
    expected = leaves.groupBy("branch_id").agg(F.count("*").alias("expected"))
    found = scores.join(leaves, "field_id").groupBy(*keys, "branch_id").agg(F.avg(score).alias("mean_score"), F.count(score).alias("n_fields"))
    found = found.join(expected, "branch_id")
    return found.withColumn("mean_score", F.when(F.col("n_fields") / F.col("expected") >= gate, F.col("mean_score")))


#: Weight profiles of activity, impact, collaboration, diversity and momentum.
PROFILES = {
    "balanced": (25, 25, 20, 15, 15),
    "output": (20, 45, 15, 10, 10),
    "recent": (20, 20, 20, 20, 20),
    "network": (15, 20, 45, 10, 10),
}


#: Why a weight configuration is refused, in order.
UNKNOWN_METRICS, STEPS, TOTAL = "weights name other metrics than the known ones", "weights are multiples of 0.5 from 0", "weights add up to 100"


def weight_problems(weights: dict[str, float], known: set[str]) -> list[str]:
    """Why a weight configuration is refused; empty when it is fine."""
    found = []
    if set(weights) != known:
        found.append(UNKNOWN_METRICS)
    if any(w < 0 or w * 2 != int(w * 2) for w in weights.values()):
        found.append(STEPS)
    if abs(sum(weights.values()) - 100) > 1e-9:
        found.append(TOTAL)
    return found


def profile_problems(weights: DataFrame, known: DataFrame, profile: str, metric: str, weight: str) -> DataFrame:
    """``(profile, problems)``: :func:`weight_problems` of every configuration of a table; a metric named twice is not a known set."""
    rows = weights.join(known.select(F.col(metric)).distinct().withColumn("__known", F.lit(True)), metric, "left")
    n = known.select(metric).distinct().count()
    w = F.col(weight)
    found = rows.groupBy(profile).agg(
        F.count("*").alias("__rows"), F.count_distinct(F.when(F.col("__known"), F.col(metric))).alias("__of"),
        F.bool_or(w.isNull() | (w < 0) | (w * 2 != F.floor(w * 2))).alias("__steps"), F.coalesce(F.sum(w), F.lit(0.0)).alias("__sum"),
    )
    checks = ((F.col("__rows") != n) | (F.col("__of") != n), UNKNOWN_METRICS), (F.col("__steps"), STEPS), (F.abs(F.col("__sum") - 100) > 1e-9, TOTAL)
    return found.select(profile, F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in checks))).alias("problems"))


def composite(observations: DataFrame, weights: dict[str, float], keys: list[str], metric: str = "metric_id", value: str = "value", version: str | None = None) -> DataFrame:
    """The weighted mean of metrics, only where every metric with weight is there, in one version."""
    active = {m: w for m, w in weights.items() if w}
    share = F.create_map(*[x for m, w in active.items() for x in (F.lit(m), F.lit(float(w)))])
    own = observations.where(F.col(metric).isin(*active))
    found = own.groupBy(*keys).agg(
        F.sum(F.element_at(share, F.col(metric)) * F.col(value) / 100).alias("composite"),
        F.count_distinct(F.when(F.col(value).isNotNull(), F.col(metric))).alias("n"),
        F.count("*").alias("rows"),
        (F.count_distinct(version) if version else F.lit(1)).alias("versions"),
    )
    return found.where((F.col("n") == len(active)) & (F.col("rows") == len(active)) & (F.col("versions") == 1)).select(*keys, "composite")
