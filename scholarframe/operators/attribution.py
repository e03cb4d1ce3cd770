"""Conserved fractional attribution of papers to institutions, countries and researchers.

A paper has weight 1, split evenly over its author slots and then over the
distinct effective affiliations of a slot.  What cannot be resolved is
withheld, never given to others and never turned into zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.session import dealt

ALLOCATED, UNRESOLVED, NO_AFFILIATION = "allocated", "withheld-unresolved", "withheld-no-affiliation"


def effective_affiliations(assertions: DataFrame, n_rows: int | None = None) -> DataFrame:
    """One row for each distinct affiliation of a slot: resolved ones by institution, others by assertion.

    A slot whose only row has neither stays, as a slot without affiliation.
    Rows are dealt by paper here, which serves every later step on papers and
    slots; few rows repeat an affiliation, so combining before would gain little.
    ``n_rows``, if it is known, bounds what a task gets.
    """
    key = F.coalesce(F.concat(F.lit("i:"), F.col("institution_id").cast("string")), F.concat(F.lit("a:"), F.col("assertion_id").cast("string")))
    return dealt(assertions.withColumn("affiliation", key), n_rows, "paper_id").groupBy("paper_id", "slot", "affiliation").agg(
        F.min("institution_id").alias("institution_id"),
        F.min("country_id").alias("country_id"),
        F.min("researcher_id").alias("researcher_id"),
        F.count_distinct("country_id").alias("n_countries"),
    )


def conflicting_countries(assertions: DataFrame) -> DataFrame:
    """Institutions that are asserted in more than one country within a slot: an error of the evidence."""
    return effective_affiliations(assertions).where("n_countries > 1").select("paper_id", "slot", "institution_id", "n_countries")


def attribution_shares(assertions: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``paper_id, slot, researcher_id, institution_id, country_id, n_slots, n_affiliations, weight, status``.

    The weight is ``1 / (n_slots * n_affiliations)``; both counts are kept, so
    that it can be recovered exactly.  Both are running counts of windows over
    the paper's rows, so nothing is joined back.
    """
    own = effective_affiliations(assertions, n_rows)
    per_slot = Window.partitionBy("paper_id", "slot")
    per_paper = Window.partitionBy("paper_id")
    counted = own.withColumn("n_affiliations", F.count("*").over(per_slot))
    # the affiliations of a slot add up to one slot
    counted = counted.withColumn("n_slots", F.round(F.sum(1 / F.col("n_affiliations")).over(per_paper)).cast("long"))
    status = F.when(F.col("affiliation").isNull(), NO_AFFILIATION).when(F.col("institution_id").isNull(), UNRESOLVED).otherwise(ALLOCATED)
    return counted.select(
        "paper_id", "slot", "researcher_id", "institution_id", "country_id", "n_slots", "n_affiliations",
        (1 / (F.col("n_slots") * F.col("n_affiliations"))).alias("weight"), status.alias("status"),
    )


def allocated(shares: DataFrame) -> DataFrame:
    return shares.where(F.col("status") == ALLOCATED)


def entity_weights(shares: DataFrame, entity: str) -> DataFrame:
    """``paper_id, <entity>, weight``: a paper's mass by institution or country (allocated) or researcher (any status)."""
    rows = shares if entity == "researcher_id" else allocated(shares)
    return rows.groupBy("paper_id", entity).agg(F.sum("weight").alias("weight"))


def counted_weights(shares: DataFrame, *by: str) -> DataFrame:
    """The mass of each group, the same whatever the order of rows.

    Weights are one over a whole number, so rows are counted by that number,
    and only the few quotients of a group are added, in its order.
    """
    of = (F.col("n_slots") * F.col("n_affiliations")).alias("of")
    counts = shares.groupBy(*by, of).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("of", "n")))
    return counts.groupBy(*by).agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["n"] / p["of"]).alias("weight"))


def distinct_country_weights(assertions: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Country mass split over the distinct countries of each slot, not over its institutions."""
    slots = dealt(assertions, n_rows, "paper_id").groupBy("paper_id", "slot").agg(F.collect_set("country_id").alias("countries"))
    sized = slots.withColumn("n_slots", F.count("*").over(Window.partitionBy("paper_id")))
    each = sized.select("paper_id", F.explode("countries").alias("country_id"), (1 / (F.col("n_slots") * F.size("countries"))).alias("weight"))
    return each.groupBy("paper_id", "country_id").agg(F.sum("weight").alias("weight"))


def mass_totals(shares: DataFrame, *by: str) -> DataFrame:
    """Total, allocated and withheld mass and their ratio, by any grouping."""
    mine = F.when(F.col("status") == ALLOCATED, F.col("weight"))
    return shares.groupBy(*by).agg(
        F.sum("weight").alias("total_mass"),
        F.coalesce(F.sum(mine), F.lit(0.0)).alias("allocated_mass"),
        F.coalesce(F.sum(F.when(F.col("status") != ALLOCATED, F.col("weight"))), F.lit(0.0)).alias("withheld_mass"),
        (F.coalesce(F.sum(mine), F.lit(0.0)) / F.sum("weight")).alias("coverage"),
    )


def position_problems(slots: DataFrame) -> DataFrame:
    """Papers whose author positions are not exactly 1 to n, each once."""
    found = slots.groupBy("paper_id").agg(F.min("slot").alias("lowest"), F.max("slot").alias("highest"), F.count("*").alias("n"), F.count_distinct("slot").alias("n_distinct"))
    return found.where((F.col("lowest") != 1) | (F.col("highest") != F.col("n")) | (F.col("n") != F.col("n_distinct")))


def mass_violations(weights: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Papers that give out more than their weight of 1."""
    return weights.groupBy("paper_id").agg(F.sum("weight").alias("mass")).where(F.col("mass") > 1 + tolerance)


def relationship_indicator(n_known: Column, complete: Column) -> Column:
    """True with two known partners, false with one when all are known, otherwise unknown."""
    return F.when(n_known >= 2, True).when((n_known >= 1) & complete, False)


def paper_relationships(shares: DataFrame) -> DataFrame:
    """Tri-state collaboration of each paper: across institutions and across countries."""
    # a paper's extremes tell none, one and several apart without a row for each value
    def up_to_two(c: str) -> Column:
        return F.when(F.min(c).isNull(), 0).when(F.min(c) == F.max(c), 1).otherwise(2)

    known = shares.groupBy("paper_id").agg(
        up_to_two("institution_id").alias("n_institutions"),
        up_to_two("country_id").alias("n_countries"),
        up_to_two("slot").alias("n_authors"),
        F.every(F.col("status") == ALLOCATED).alias("complete"),
    )
    return known.select(
        "paper_id",
        relationship_indicator(F.col("n_institutions"), F.col("complete")).alias("cross_institution"),
        relationship_indicator(F.col("n_countries"), F.col("complete")).alias("international"),
        (F.col("n_authors") >= 2).alias("collaborative"),
    )


def selected_evidence(evidence: DataFrame, keys: list[str], priority: str, recency: str, present: str, value: str, n_rows: int | None = None) -> DataFrame:
    """The best evidence of each key: present before absent, then priority, then recency.

    Keys whose best rows disagree on the value are flagged and their value withheld.
    """
    rank = Window.partitionBy(*keys).orderBy(F.col(present).desc(), F.col(priority).desc(), F.col(recency).desc())
    best = dealt(evidence, n_rows, *keys).withColumn("__rank", F.rank().over(rank)).where("__rank = 1")
    chosen = best.groupBy(*keys).agg(F.min(value).alias("__value"), F.max(value).alias("__other"))
    conflict = F.coalesce(F.col("__value") != F.col("__other"), F.lit(False))
    return chosen.select(*keys, F.when(~conflict, F.col("__value")).alias(value), conflict.alias("conflict"))
