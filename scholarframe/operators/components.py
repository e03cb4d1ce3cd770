"""Connected components of an undirected link table, with DataFrame joins only.

Alternating large-star and small-star rounds: every round re-links each vertex
to the smallest vertex it can see, the number of links never grows, and the
rounds needed are few even for long chains.  Nothing is collected but two
numbers per round, which tell whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a vertex to the smallest vertex around it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a vertex, and itself, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(vertex, component)`` for every vertex of a link; component is its smallest vertex.

    Self links and links with a null end connect nothing.  A vertex named only
    by self links is not returned: it is its own component.  Repeated links,
    either direction, count once.  An empty table gives an empty result.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    edges = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("vertex")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        roots.select("vertex", F.col("vertex").alias("component"))
    )
