"""Queries over the test tables, registered by name."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.plans import evidence, gates, graph, identity, knowledge, layouts, metrics, more, serving, streams
from scholarframe.plans.registry import ORACLE_SQL, QUERIES
from scholarframe.sources.tables import Tables

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "evidence", "gates", "graph", "identity", "knowledge", "layouts", "metrics", "more", "serving", "streams"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled research activity of institutions by field, best first."""
    return metrics.activity_scores(Tables(spark, sf_dir), minimum=2).orderBy(F.col("score").desc(), "field_id", "entity_id")
