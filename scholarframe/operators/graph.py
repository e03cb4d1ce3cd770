"""The knowledge graph: typed nodes and edges as two tables, checked and bounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(*kinds: tuple[str, DataFrame, str, str]) -> DataFrame:
    """``node_type, node_id, label``; each kind is (type, table, id column, name column)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("node_type"), F.concat(F.lit(f"{k}:"), F.col(key)).alias("node_id"), F.col(name).alias("label")) for k, df, key, name in kinds])


def edges(*kinds: tuple[str, DataFrame, tuple[str, str], tuple[str, str]]) -> DataFrame:
    """``edge_type, source_id, target_id``, each once; each kind names the two ends as (type, column)."""

    def one(kind: str, df: DataFrame, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
        ends = [F.concat(F.lit(f"{k}:"), F.col(c)).alias(name) for (k, c), name in ((source, "source_id"), (target, "target_id"))]
        return df.where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull()).select(F.lit(kind).alias("edge_type"), *ends).distinct()

    return reduce(DataFrame.unionByName, [one(*k) for k in kinds])


def dangling_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = node.select("node_id")
    lost = [edge.join(ids, F.col(end) == F.col("node_id"), "left_anti").withColumn("missing", F.lit(end)) for end in ("source_id", "target_id")]
    return lost[0].unionByName(lost[1])


def bounded(node: DataFrame, edge: DataFrame, budgets: dict[str, int], edge_limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes of each type within its budget, and the edges between them, in order of id."""
    kept = reduce(DataFrame.unionByName, [node.where(F.col("node_type") == kind).orderBy("node_id").limit(n) for kind, n in budgets.items()])
    ids = kept.select("node_id")
    inside = edge.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return kept, inside.orderBy("edge_type", "source_id", "target_id").limit(edge_limit).select("edge_type", "source_id", "target_id")


def boundary(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    used = edge.select(F.col("source_id").alias("node_id")).unionByName(edge.select(F.col("target_id").alias("node_id"))).distinct()
    return node.join(used, "node_id", "left_anti")


def bounded_summary(node: DataFrame, edge: DataFrame, budgets: dict[str, int], edge_limit: int) -> DataFrame:
    """``n_nodes, n_edges, truncated`` of :func:`bounded`; truncated when it left out nodes of a kind, or edges between those kept."""
    kept, inside = bounded(node, edge, budgets, edge_limit + 1)
    total = node.where(F.col("node_type").isin(*budgets)).agg(F.count("*").alias("there"))
    counts = kept.agg(F.count("*").alias("n_nodes")).join(inside.agg(F.count("*").alias("found"))).join(total)  # three rows of one number
    cut = (F.col("n_nodes") < F.col("there")) | (F.col("found") > edge_limit)
    return counts.select("n_nodes", F.least("found", F.lit(edge_limit)).cast("long").alias("n_edges"), cut.alias("truncated"))


def split_budget(total: int, first_available: int, second_available: int) -> tuple[int, int]:
    """Half of a budget to each of two kinds; what one leaves goes to the other."""
    first = min(first_available, max(total - total // 2, total - second_available))
    return first, min(second_available, total - first)
