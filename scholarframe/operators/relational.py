"""Row choice, merging and comparison of tables: the relational core of updates and serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``, one aggregation without a sort."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables, the incoming ones where keys meet."""
    return base.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def current_observations(df: DataFrame, keys: list[str], order: list[str], algorithm: str) -> DataFrame:
    """The newest row of each key, and none where its rows disagree on the algorithm."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({
        "__rank": F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order])),
        "__agree": F.coalesce(F.min(algorithm).over(w) == F.max(algorithm).over(w), F.lit(True)),
    })
    return ranked.where("__rank = 1 and __agree").drop("__rank", "__agree")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value given; None leaves a column open."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), [kv for kv in wanted.items() if kv[1] is not None], df)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a totally ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def covers_year(start: Column, end: Column, year: Column) -> Column:
    """Whether a period with open ends covers a year."""
    return (start.isNull() | (start <= year)) & (end.isNull() | (end >= year))


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The exact number of rows of each table."""
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()])


def missing_keys(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with the side; empty when both hold the same."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))
