"""Whole datasets: exported as artifacts with their observations and lineage, certified, and seeded all or nothing.

An export is one content-addressed set of shards, the kind of a shard being the
table of its rows.  Nothing is seeded from it before every shard was found as
described, every row well formed, every key single and every reference met; and
a seeded dataset is seen from the moment its manifest is written, never in part.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.operators.populations import row_differences
from scholarframe.session import stored
from scholarframe.sources import artifacts as art
from scholarframe.streaming import incremental as inc


@dataclass(frozen=True)
class Table:
    """A table of a dataset: its columns, its key, and the tables that columns refer to."""

    schema: str
    key: list[str]
    references: dict[str, str] = field(default_factory=dict)


Spec = dict[str, Table]


def export_dataset(tables: dict[str, DataFrame], spec: Spec, store: str, dataset: str, limit: int = art.SHARD_BYTES) -> DataFrame:
    """Writes all tables as JSON lines in shards, and gives their descriptors.

    A table's rows are in the order of its key.  Tables without rows have no shard.
    """
    rows = [tables[n].select(F.lit(n).alias("table"), F.concat_ws(":", *(F.col(k).cast("string") for k in t.key)).alias("key"), F.to_json(F.struct(*tables[n].columns), {"ignoreNullFields": "false"}).alias("row")) for n, t in spec.items()]
    return art.write_artifact_shards(reduce(DataFrame.unionByName, rows), store, dataset, "table", ["key"], limit)


def _counts(rows: DataFrame, table: str, problem: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(problem).alias("problem"), "n")


def read_export(spark: SparkSession, store: str, dataset: str, spec: Spec) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of an export, and ``(table, problem, n)`` of all that speaks against it, empty where nothing does.

    Rows of shards that are not as described are left out of the tables.
    """
    lines = stored(art.read_artifact_shards(spark, store, dataset), "lines")
    parsed = lines.where("line is not null").select(F.from_json("line", "`table` string, `key` string, `row` string").alias("r")).select("r.*")
    known = art.shard_manifest(spark, store, dataset)
    shards = lines.where("problem is not null").join(known.select(F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("path"), "kind"), "path")
    problems = [shards.groupBy(F.col("kind").alias("table"), F.concat(F.lit("shard: "), "problem").alias("problem")).agg(F.count("*").alias("n"))]
    problems.append(parsed.where(~F.col("table").isin(*spec)).groupBy("table").agg(F.count("*").alias("n")).select("table", F.lit("unknown table").alias("problem"), "n"))
    tables = {}
    for name, t in spec.items():
        own = parsed.where(F.col("table") == name).select(F.from_json("row", f"{t.schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
        own = stored(own, name)
        problems.append(_counts(own.where("_corrupt is not null"), name, "not well formed"))
        own = own.where("_corrupt is null").drop("_corrupt")
        problems.append(_counts(own.where(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in t.key))), name, "key missing"))
        problems.append(_counts(own.dropna(subset=t.key).groupBy(*t.key).count().where("count > 1"), name, "key repeated"))
        tables[name] = own
    for name, t in spec.items():
        for column, parent in t.references.items():
            (key,) = spec[parent].key
            lost = tables[name].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)), column, "left_anti")
            problems.append(_counts(lost, name, f"{column} names no {parent}"))
    found = reduce(DataFrame.unionByName, problems).where("n > 0").orderBy("table", "problem")
    return tables, stored(found, "problems")


def certified_export(spark: SparkSession, store: str, dataset: str, spec: Spec, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(gate, passed, n)``: every gate of an export and how much fails it.

    ``shards``: all are as described; ``rows``: all are well formed, of known
    tables; ``keys``: each is there and single; ``references``: all are met;
    ``population``, with the tables it was made from: it holds their rows and
    no others.
    """
    tables, problems = read_export(spark, store, dataset, spec)
    gate = (
        F.when(F.col("problem").startswith("shard: "), "shards")
        .when(F.col("problem").isin("not well formed", "unknown table"), "rows")
        .when(F.col("problem").startswith("key "), "keys")
        .otherwise("references")
    )
    failed = problems.groupBy(gate.alias("gate")).agg(F.sum("n").alias("n"))
    names = ["shards", "rows", "keys", "references"]
    if sources is not None:
        names.append("population")
        off = [row_differences(sources[n].select(*tables[n].columns), tables[n]).agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("n")) for n in spec]
        total = reduce(DataFrame.unionAll, off).agg(F.sum("n").alias("n")).select(F.lit("population").alias("gate"), "n")
        failed = failed.unionByName(total.where("n > 0"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("gate"))
    return every.join(failed, "gate", "left").select("gate", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def seed_dataset(spark: SparkSession, store: str, dataset: str, spec: Spec, target: str) -> DataFrame:
    """Loads an export into the dataset at ``target``, whole or not at all; gives the problems, none where it was loaded.

    Readers see the dataset that was there before until all tables of the new
    one stand; an export that was refused leaves it as it was.
    """
    tables, problems = read_export(spark, store, dataset, spec)
    if problems.isEmpty():
        folder = f"versions/{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{target}/{folder}/{name}")
        inc.commit(spark, target, replace(inc.manifest(spark, target), base=folder))
    return problems


def seeded(spark: SparkSession, target: str, spec: Spec) -> dict[str, DataFrame]:
    """The tables of the dataset at ``target``; empty ones where none was seeded."""
    folder = inc.manifest(spark, target).base
    return {n: spark.read.schema(t.schema).parquet(f"{target}/{folder}/{n}") if folder else spark.createDataFrame([], t.schema) for n, t in spec.items()}


def entity(tables: dict[str, DataFrame], spec: Spec, table: str, *key) -> DataFrame:
    """The row of a table with a key, which the files are filtered by."""
    if len(key) != len(spec[table].key):
        raise ValueError(f"the key of {table} is {', '.join(spec[table].key)}")
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), zip(spec[table].key, key, strict=True), tables[table])
