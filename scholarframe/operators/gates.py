"""Gates: tables of violations and of reasons, never silent repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first version's thresholds.
THRESHOLDS = {
    "paper_time_affiliation": 0.90, "canonical_institution": 0.95, "citation": 0.90, "field_attribution": 0.90, "collaboration_relationship": 0.90,
    "least_mass": 10.0, "least_researchers": 5, "cohort": 30, "reference_cohort": 50, "maturity_months": 24, "diversity_mass": 15.0, "momentum_years": 6, "z_clip": 3.0,
}


def coverage_reasons(coverage: dict[str, Column], thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """A reason for each coverage that is unknown or below its threshold."""
    checks = [F.when(c.isNull() | (c < thresholds[name]), F.lit(f"{name.replace('_', ' ')} coverage is below the threshold")) for name, c in coverage.items()]
    return F.array_compact(F.array(*checks))


def reference_violations(*links: tuple[str, DataFrame, str, DataFrame, str]) -> DataFrame:
    """``(path, key)`` of every reference without a target; each link is (path, child, key, parent, parent key)."""

    def lost(path: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
        keys = child.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
        return keys.join(parent.select(F.col(parent_key).cast("string").alias("key")), "key", "left_anti").select(F.lit(path).alias("path"), "key")

    return reduce(DataFrame.unionByName, [lost(*x) for x in links])


def uniqueness_violations(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(path).alias("path"), F.concat_ws("-", *keys).alias("key"), F.col("count").alias("n"))


def joint_gate(metrics: DataFrame, keys: list[str], expected: int, metric: str, passed: str, version: str) -> DataFrame:
    """Whether all expected metrics of a scope are there once, pass, and agree on a version."""
    found = metrics.groupBy(*keys).agg(F.count_distinct(metric).alias("n_metrics"), F.count("*").alias("n_rows"), F.every(passed).alias("all_pass"), F.count_distinct(version).alias("n_versions"))
    checks = [
        F.when(F.col("n_metrics") != expected, F.lit("metrics are missing")),
        F.when(F.col("n_rows") != F.col("n_metrics"), F.lit("a metric occurs more than once")),
        F.when(~F.col("all_pass"), F.lit("a metric does not pass")),
        F.when(F.col("n_versions") != 1, F.lit("versions differ")),
    ]
    return found.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn("active", F.size("reasons") == 0)


def reconciled(expected: DataFrame, seen: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Expected totals against records seen and distinct records, partition by partition."""
    counts = seen.groupBy(*keys).agg(F.count("*").alias("n_seen"), F.count_distinct(id_col).alias("n_unique"))
    joined = expected.join(counts, keys, "full")
    ok = (F.col("expected") == F.col("n_seen")) & (F.col("n_seen") == F.col("n_unique"))
    return joined.withColumn("certified", F.coalesce(ok, F.lit(False)))


def certified_cohorts(papers: DataFrame, keys: list[str], cutoff: str, mature: str, least: int = 50) -> DataFrame:
    """Reference cohorts with one cutoff, enough papers, and only mature ones."""
    found = papers.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(cutoff) == F.max(cutoff)).alias("one_cutoff"), F.every(mature).alias("all_mature"))
    return found.withColumn("certified", F.col("one_cutoff") & F.col("all_mature") & (F.col("n") >= least))


def population_problems(source: DataFrame, decisions: DataFrame, key: str, decision: str) -> DataFrame:
    """Source keys without exactly one decision, and decisions without a source."""
    made = decisions.groupBy(key).agg(F.count("*").alias("n"), F.min(decision).alias("decision"))
    joined = source.select(key, F.lit(True).alias("__there")).join(made, key, "full")
    problem = F.when(F.col("__there").isNull(), "unknown source").when(F.col("n").isNull(), "no decision").when(F.col("n") > 1, "several decisions")
    return joined.select(key, problem.alias("problem")).where("problem is not null")


def exactly_once(df: DataFrame, keys: list[str], member: str, expected: int) -> DataFrame:
    """Groups in which every expected member occurs once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(member).alias("n_members")).withColumn("complete", (F.col("n") == expected) & (F.col("n_members") == expected))


def previous_of(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with the value of ``column`` in the row before."""
    return df.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))
