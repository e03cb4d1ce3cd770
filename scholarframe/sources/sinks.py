"""Output layouts: size-bound shards, inverted indexes, dictionaries, exports and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarframe.session import stored


def running(df: DataFrame, order: list[str], size: Column, into: str) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before a row in an order, without one task that sees all rows.

    Rows are dealt to ranges of the order, summed up within each, and moved on
    by the sums of the ranges before, one small row for each range.
    """
    ranges = stored(df.withColumn("__size", size.cast("long")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    sums = ranges.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    bases = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a range is broadcast
    return ranges.join(F.broadcast(bases), "__part").withColumn(into, F.col("__base") + before).drop("__part", "__base", "__size")


def sized_shards(df: DataFrame, order: list[str], size: Column, limit: int) -> DataFrame:
    """``df`` with ``n_bytes`` and a shard number in a stable order, the rows of a shard holding about ``limit`` bytes.

    A row belongs to the shard in which it begins, so a shard is over the limit by less than one row.
    """
    rows = running(df.withColumn("n_bytes", size.cast("long")), order, F.col("n_bytes"), "shard")
    return rows.withColumn("shard", F.floor(F.col("shard") / limit))


def inverted_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key with its sorted distinct values."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("members"))


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """``df`` with a dense number from 0 in an order, without ordering all rows in one task.

    Rows are dealt to ranges and sorted there; a row's number is its place in
    its range and the sizes of the ranges before, one small row for each.
    """
    ranges = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    return ranges.join(F.broadcast(bases), part == F.col("__part")).withColumn(into, F.col("__base") + place).drop("__at", "__part", "__base")


def interned(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with a number in place of a repeated value, and the dictionary; :func:`recovered` undoes it."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    dictionary = numbered(values, [column], f"{column}_id")
    return df.join(dictionary, column, "left").drop(column), dictionary


def recovered(ledger: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """The rows that :func:`interned` was given."""
    return ledger.join(dictionary, f"{column}_id", "left").drop(f"{column}_id")


def shard_descriptors(sharded: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``shard, n_rows, n_bytes, sha256``: what a reader checks a shard against.  A shard holds a bounded number of bytes."""
    line = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    rows = sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct(*key, line.alias("line")))).alias("lines"))
    return rows.select("shard", "n_rows", "n_bytes", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("sha256"))


def write_shards(df: DataFrame, folder: str, shard: str) -> None:
    """One folder a shard, so that readers open only those they need."""
    df.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema, index: DataFrame, key: str, wanted: list, shard: str) -> DataFrame:
    """The rows of the shards that an inverted index (``key``, ``members``) names for the wanted keys; others are not opened."""
    named = index.where(F.col(key).isin(*wanted)).select(F.explode("members").alias("shard")).distinct()
    needed = [r["shard"] for r in named.collect()]  # shards of the keys asked for
    return spark.read.schema(schema).parquet(folder).where(F.col(shard).isin(*needed) if needed else F.lit(False))


def write_keyed(df: DataFrame, folder: str, order: list[str], keys: list[str], distinct: int = 1 << 16, block_bytes: int = 8 << 20) -> None:
    """Rows sorted by ``order`` in ranges, with Bloom filters of ``keys`` beside the least and greatest values of every row group.

    A read of a few values of any of these columns, :func:`read_keyed`, skips
    the row groups that do not hold them, whether the table is sorted by the
    column or not, and no index is kept or looked up.  ``distinct`` is about
    how many values of a key a row group holds.
    """
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", block_bytes)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", distinct)
    writer.parquet(folder)


def read_keyed(spark: SparkSession, folder: str, key: str, wanted: list) -> DataFrame:
    """The rows with one of a few values of a key; the filter goes to the files."""
    return spark.read.parquet(folder).where(F.col(key).isin(*wanted) if wanted else F.lit(False))


def write_pages(df: DataFrame, folder: str, order: list[str]) -> None:
    """Rows in ranges of a total order, each in a folder of its own, and a directory of the ranges.

    ``__place`` is a row's number in its range.  The directory has a row for
    each range, with how many rows come before it.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    placed.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
    placed.write.mode("overwrite").partitionBy("__range").parquet(f"{folder}/rows")
    sizes = _paged(df.sparkSession, folder).groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    sizes.select("__range", "n", before.alias("first")).write.mode("overwrite").parquet(f"{folder}/directory")


def _paged(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/rows")


def read_page(spark: SparkSession, folder: str, number: int, size: int) -> tuple[DataFrame, int]:
    """Page ``number`` from 0, in order, and how many rows there are in all; only the ranges it lies in are opened."""
    if number < 0 or size < 1:
        raise ValueError("pages are numbered from 0 and hold at least one row")
    directory = spark.read.parquet(f"{folder}/directory")
    total = directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    start, stop = number * size, (number + 1) * size
    met = directory.where((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).collect()  # the ranges of one page
    rows, wanted = _paged(spark, folder), F.lit(False)
    for r in met:
        wanted = wanted | ((F.col("__range") == r["__range"]) & (F.col("__place") >= max(0, start - r["first"])) & (F.col("__place") < stop - r["first"]))
    return rows.where(wanted).orderBy("__range", "__place").drop("__range", "__place"), total


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as gzip-compressed JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(folder)


def write_archive(df: DataFrame, folder: str, order: list[str]) -> None:
    """Rows as gzip-compressed JSON lines in a fixed order: ranges of the order, each sorted, in files named by their range."""
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip").text(folder)


def read_validated(spark: SparkSession, folder: str, schema: str, *checks: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """JSON lines that are well formed and pass every check, and the others with the problems found."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    problems = F.array_compact(F.array(F.when(F.col("_corrupt").isNotNull(), F.lit("not well formed")), *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks)))
    marked = rows.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems", "_corrupt"), marked.where(F.size("problems") > 0)


def export_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON document for each row."""
    return df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("document"))


def write_yearly(df: DataFrame, path: str, period: str = "period") -> None:
    """Parquet files by period, so that a reader of one period opens only those."""
    df.repartition(period).sortWithinPartitions(period).write.mode("overwrite").partitionBy(period).parquet(path)


def deduplicated_payloads(df: DataFrame, payload: str) -> DataFrame:
    """Each distinct payload once, by checksum, with how often it occurs."""
    return df.groupBy(F.sha2(payload, 256).alias("sha256")).agg(F.min(payload).alias("payload"), F.count("*").alias("n_refs"))


def current_flags(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``is_current``, true for the newest row of each key."""
    return df.withColumn("is_current", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def summary(df: DataFrame, *by: str, payload: str) -> DataFrame:
    """Rows and bytes of a ledger by kind and state."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length(payload)).alias("n_bytes"))
