"""What evidence says about identity and place, and why it says nothing: explicit conflicts, never a guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.operators.ranks import beside
from scholarframe.operators.scales import winsorised_log


def aligned_identifiers(local: Column, author: Column, n_affiliations: Column) -> Column:
    """``struct<identifiers, alignment, conflict>`` of the identifiers at one affiliation and those at its author.

    Identifiers of an author belong to an affiliation only if it is the
    author's single one.  Where both name something else, both are kept and the
    conflict is explicit.  Takes arrays; nulls are empty.
    """
    none = F.array().cast("array<string>")
    own, wide = (F.array_sort(F.array_distinct(F.coalesce(c, none))) for c in (local, author))
    has_own, has_wide, single = F.size(own) > 0, F.size(wide) > 0, n_affiliations == 1
    # The names of the alignments.
    kind = (
        F.when(~has_own & ~has_wide, "no-ror-evidence")
        .when(~single & has_own & has_wide, "affiliation-local-ror-author-level-set-unaligned")
        .when(~single & ~has_own, "unresolved-author-ror-not-positionally-aligned")
        .when(~has_wide, "affiliation-local-ror")
        .when(has_own & (own == wide), "single-affiliation-local-author-ror-corroborated")
        .when(has_own, "conflicted-single-affiliation-local-vs-author-ror")
        .when(F.size(wide) == 1, "single-affiliation-author-ror")
        .otherwise("conflicted-single-affiliation-multiple-author-rors")
    )
    kept = F.when(single, F.array_sort(F.array_union(own, wide))).otherwise(own)
    return F.struct(kept.alias("identifiers"), kind.alias("alignment"), kind.startswith("conflicted").alias("conflict"))


#: Identifier schemes that count as authorities, by kind of entity.
AUTHORITIES = {"institution": ("ror",), "researcher": ("orcid", "inspire"), "paper": ("doi", "arxiv", "inspire")}


def unmatched_reason(status: Column, evidence_reasons: Column, schemes: Column, authorities: tuple[str, ...], requires_authority: Column) -> Column:
    """Why a record was not matched, null when it was: missing or invalid input, no authority identifier, or unclassified."""
    known = F.exists(F.coalesce(schemes, F.array().cast("array<string>")), lambda s: F.lower(s).isin(*authorities))
    # The names of the reasons.
    return (
        F.when(status == "matched", None)
        .when(F.array_contains(F.coalesce(evidence_reasons, F.array().cast("array<string>")), "missing-or-invalid"), "missing-or-invalid")
        .when(F.coalesce(requires_authority, F.lit(False)) & ~known, "authority-identifier-required")
        .otherwise("unclassified")
    )


def referenced(rows: DataFrame, url: str, path: str, targets: DataFrame, key: str, into: str) -> DataFrame:
    """``rows`` with the key that a reference URL names after ``path``, if there is such a target; others stay unresolved."""
    named = rows.withColumn(into, F.nullif(F.regexp_extract(F.col(url), f"/{path}/([0-9]+)/?$", 1), F.lit("")).cast("long"))
    known = targets.select(F.col(key).alias("__known")).distinct()
    joined = named.join(known, F.col(into) == F.col("__known"), "left")
    status = F.when(F.col("__known").isNotNull(), "resolved").when(F.col(into).isNotNull(), "unknown target").otherwise("no reference")
    return joined.withColumn("status", status).withColumn(into, F.col("__known")).drop("__known")


def any_presence(rows: DataFrame, keys: list[str], **found: Column) -> DataFrame:
    """For each key whether any of its duplicates shows each kind of evidence."""
    return rows.groupBy(*keys).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in found.items()))


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, the one value its rows agree on, and whether it is admitted; several values, or none, admit nothing."""
    found = rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("__value"))
    reason = F.when(F.col("n_values") == 0, "no value").when(F.col("n_values") > 1, "several values")
    return found.select(key, F.when(F.col("n_values") == 1, F.col("__value")).alias(value), "n_values", reason.alias("reason"))


def certified_institutions(institutions: DataFrame, key: str, authority: str, crosswalk: DataFrame, cross_key: str, cross_value: str, lived: DataFrame, first: str, last: str, used: DataFrame, used_key: str, year: str) -> DataFrame:
    """``key, reasons, certified``: an authority, one crosswalk target, and no use outside the years of its life.

    ``lived`` has the first and last year of each key, nulls open; ``used`` the
    years in which it is named.
    """
    targets = crosswalk.groupBy(F.col(cross_key).alias(key)).agg(F.count_distinct(cross_value).alias("n_targets"))
    outside = used.select(F.col(used_key).alias(key), year).join(lived, key).where((F.col(year) < F.col(first)) | (F.col(year) > F.col(last)))
    outside = outside.groupBy(key).agg(F.count("*").alias("n_outside"))
    joined = institutions.select(key, authority).join(targets, key, "left").join(outside, key, "left")
    checks = [
        F.when(F.col(authority).isNull(), F.lit("no authority")),
        F.when(F.coalesce("n_targets", F.lit(0)) == 0, F.lit("no crosswalk target")),
        F.when(F.col("n_targets") > 1, F.lit("several crosswalk targets")),
        F.when(F.col("n_outside") > 0, F.lit("used outside its lifetime")),
    ]
    return joined.select(key, F.array_compact(F.array(*checks)).alias("reasons")).withColumn("certified", F.size("reasons") == 0)


def composed(gates: dict[str, DataFrame], keys: list[str], passed: str = "passed") -> DataFrame:
    """Partitions with the gates that they miss or fail, in the order given; certified when none is left."""
    rows = reduce(DataFrame.unionByName, [g.select(*keys, F.lit(name).alias("gate"), F.col(passed).alias("__passed")) for name, g in gates.items()])
    found = rows.groupBy(*keys).agg(F.collect_set(F.when(F.col("__passed"), F.col("gate"))).alias("held"))
    return found.select(*keys, F.array_except(F.array(*map(F.lit, gates)), F.col("held")).alias("failed")).withColumn("certified", F.size("failed") == 0)


#: What scores must agree on before they are put on one scale.
VERSIONS = (
    "entity_type field_id period metric_definition_version algorithm_version normalization_version dataset_version acquisition_scope evidence_cutoff "
    "attribution_policy_version ontology_version mapping_policy_version citation_policy_version threshold_version"
).split()


def scored_populations(results: DataFrame, entity: str, value: str, minimum: int, versions: list[str] = VERSIONS, session: list[str] | None = None) -> DataFrame:
    """``results`` with a score on the scale of their population, and a reason where there is none.

    A population agrees on every version column, a null agreeing with a null,
    and on the ``session`` columns where results have them.  One in which an
    entity occurs twice is refused as a whole, so neither row is picked.
    """
    keys = [*versions, *(session or [])]
    found = results.groupBy(*keys).agg(F.count("*").alias("__rows"), F.count_distinct(entity).alias("__entities"), F.count(value).alias("__values"))
    rows = beside(results, found, keys)
    twice = F.col("__rows") != F.col("__entities")
    scored = winsorised_log(rows.withColumn("__value", F.when(~twice, F.col(value))), "__value", keys, minimum)
    reason = (
        F.when(twice, "a population holds each entity once")
        .when(F.col(value).isNull(), "no value")
        .when(F.col("__values") < minimum, "too few entities")
        .when(F.col("score").isNull(), "no spread")
    )
    return scored.withColumn("reason", reason).drop("__rows", "__entities", "__values", "__value")


def version_order(version: Column) -> Column:
    """A version's numbers, which compare as numbers; parts that are none come first."""
    return F.transform(F.split(F.regexp_replace(version, "^[vV]", ""), r"[.\\-]"), lambda p: p.try_cast("bigint"))


def definitions_in_force(definitions: DataFrame, metric: str, version: str, since: str, as_of: Column) -> DataFrame:
    """``(metric, version)``: the greatest version of each metric that was introduced by a date, compared number by number."""
    known = definitions.where(F.col(since) <= as_of)
    return known.groupBy(metric).agg(F.max_by(F.col(version), F.struct(version_order(F.col(version)), F.col(version))).alias(version))


def of_definitions(observations: DataFrame, definitions: DataFrame, metric: str, version: str) -> DataFrame:
    """The observations of exactly the definitions given; those of other versions, or of none, are not served."""
    return observations.join(definitions.select(metric, version).distinct(), [metric, version], "left_semi")


def next_cursors(attempts: DataFrame, source: str, cursor: str, succeeded: str, before: DataFrame, old: str) -> DataFrame:
    """Where each source goes on: at the batch's last cursor if every record passed, else where it was.

    ``replay`` tells that the same records come again.
    """
    done = attempts.groupBy(source).agg(F.max(cursor).alias("__last"), F.every(F.coalesce(succeeded, F.lit(False))).alias("__all"), F.count_if(~F.coalesce(succeeded, F.lit(False))).alias("n_failed"))
    joined = before.join(done, source, "left")
    return joined.select(source, F.when(F.col("__all"), F.col("__last")).otherwise(F.col(old)).alias("cursor"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce(~F.col("__all"), F.lit(False)).alias("replay"))


def first_wins_strings(values: Column) -> Column:
    """Distinct strings, upper and lower case alike, the first spelling of each in order."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def category_role(roles: Column) -> Column:
    """One role for all, ``mixed`` for several, null for none."""
    own = F.array_distinct(F.array_compact(roles))
    return F.when(F.size(own) == 1, own[0]).when(F.size(own) > 1, F.lit("mixed"))


def partners(rows: DataFrame, paper: str, entity: str) -> DataFrame:
    """``paper, entity, partners``: the other entities of each paper, in order."""
    every = Window.partitionBy(paper)
    return rows.select(paper, entity).distinct().withColumn("partners", F.array_sort(F.array_except(F.collect_set(entity).over(every), F.array(entity))))
