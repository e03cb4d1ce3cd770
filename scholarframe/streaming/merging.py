"""Connected components that are kept while links come in batches.

Labels are a log of batches.  A batch's links are contracted to the labels that
their ends have; components are found among those few labels, and only
vertices whose label changed, and new ones, are written.  Vertices of
components that a batch does not touch are neither moved nor written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators.components import connected_components
from scholarframe.operators.relational import latest
from scholarframe.session import stored
from scholarframe.streaming import incremental as inc


def _labels(spark: SparkSession, store: str, before: int | None, vertex_type: str) -> DataFrame:
    now = inc.manifest(spark, store)
    if not now.folders or (before is not None and now.upto < 0 and not any(n < before for n in now.batches)):
        return spark.createDataFrame([], f"vertex {vertex_type}, component {vertex_type}")
    rows = inc.log_rows(spark, store)
    rows = rows if before is None else rows.where(F.col(inc.BATCH) < before)
    return latest(rows, ["vertex"], [inc.BATCH]).select("vertex", "component")


def component_labels(spark: SparkSession, store: str, vertex_type: str = "long") -> DataFrame:
    """``(vertex, component)`` of all vertices that were linked so far; component is the smallest vertex."""
    return _labels(spark, store, None, vertex_type)


def add_links(links: DataFrame, store: str, number: int, src: str = "src", dst: str = "dst") -> bool:
    """Adds a batch of links to the components at ``store``; false where the batch was compacted already.

    The same batch handed over again gives the same labels.  Links that are
    null or to itself connect nothing.  :func:`incremental.compact` with key
    ``vertex`` and no order folds old batches.
    """
    spark = links.sparkSession
    if number <= inc.manifest(spark, store).upto:
        return False
    kind = links.schema[src].dataType.simpleString()
    own = stored(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct(), "links")
    ends = own.select(F.col("a").alias("vertex")).union(own.select("b")).distinct()
    known = _labels(spark, store, number, kind)
    labels = stored(ends.join(known, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("label"), F.col("component").isNull().alias("new")), "ends")
    a, b = (labels.select(F.col("vertex").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b"))
    contracted = own.join(a, "a").join(b, "b").select("label_a", "label_b")
    roots = stored(connected_components(contracted, "label_a", "label_b"), "roots")  # (label, its new component)
    moved = roots.where("vertex <> component").select(F.col("vertex").alias("component"), F.col("component").alias("root"))
    changed = known.join(moved, "component").select("vertex", F.col("root").alias("component"))
    fresh = labels.where("new").join(roots, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
    return inc.append_batch(changed.unionByName(fresh), store, number)
