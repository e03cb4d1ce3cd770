"""Entity search: a term index, prefix lookup and fuzzy scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarframe.functions.text import lookup_terms, search_score, search_term

#: Scores of exact and prefix answers, and of entities that are searched by name only.
EXACT, PREFIX, SIMPLE = 1.0, 0.96, 0.9


def candidates(*kinds: tuple[str, DataFrame, str, str]) -> DataFrame:
    """``entity_type, entity_id, label`` of several tables, each given as (type, table, id column, name column)."""
    parts = [df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.col(name).alias("label")) for kind, df, key, name in kinds]
    return reduce(DataFrame.unionByName, parts)


def term_index(entities: DataFrame) -> DataFrame:
    """``entity_type, entity_id, label, term``: whole normalised names and their words, each once."""
    whole = entities.withColumn("__whole", search_term(F.col("label"))).where("__whole <> ''")
    return whole.select("entity_type", "entity_id", "label", F.explode(lookup_terms(F.col("__whole"))).alias("term"))


def prefix_search(index: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Entities with a term that begins with the text, equal terms first."""
    wanted = search_term(F.lit(text))
    hits = index.where(F.col("term").startswith(wanted)).withColumn("score", F.when(F.col("term") == wanted, EXACT).otherwise(PREFIX))
    best = hits.groupBy("entity_type", "entity_id", "label").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "label", "entity_type", "entity_id").limit(limit)


def fuzzy_search(entities: DataFrame, text: str, ceiling: Column | None = None, limit: int = 8) -> DataFrame:
    """Entities whose name answers the text by any of the rules of :func:`search_score`."""
    ceiling = F.lit(1.0) if ceiling is None else ceiling
    scored = entities.withColumn("score", search_score(search_term(F.lit(text)), search_term(F.col("label")), ceiling)).where("score is not null")
    best = scored.groupBy("entity_type", "entity_id").agg(F.max("score").alias("score"), F.min("label").alias("label"))
    return best.orderBy(F.desc("score"), "label", "entity_type", "entity_id").limit(limit)
