"""How filters of documents interact, from counts of joint failures.

For every set of filters the documents that fail all of them are counted, as
sums of products of failure flags.  These sums are all that is needed: by
inclusion and exclusion (the Moebius inversion over sets) they give what any
order of the filters keeps and removes at any step, what a filter alone would
catch, and, read as Harsanyi dividends of the game "documents removed by these
filters", the Shapley value of each filter.  No order is ever run, and rows
are read once whatever the number of orders.

Documents are reduced to cells before anything is counted: equal texts, whose
flags agree, meet by their digest after each task has counted its own.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most filters that are audited together: the orders are their factorial.
MOST_FILTERS = 6
MEASURES = ("n", "good", "toxic")
_SALTS = 1024


def _words(text: Column) -> Column:
    """The white-space separated words of a text, one empty word where there are none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def text_failures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with booleans A to D, true where a whole text fails a filter; null is the empty text.

    A: under 200 words; B: distinct words are under half of the words; C: more
    than 3 % of the code points are A-Z; D: one of ``#$%&*|`` occurs.  Existing
    columns of these names are replaced.
    """
    rows = docs.withColumns({"__text": F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    rows = rows.withColumn("__words", _words(F.col("__text")))
    none = (F.col("__words")[0] == "").cast("int")
    rows = rows.withColumns({"__n": F.size("__words") - none, "__distinct": F.size(F.array_distinct("__words")) - none})
    capitals = F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]+", ""))
    return rows.withColumns({
        "A": F.col("__n") < 200,
        "B": F.col("__distinct").cast("long") * 100 < F.col("__n").cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length("__text").cast("long") * 3,
        "D": F.col("__text").rlike("[#$%&*|]"),
    }).drop("__text", "__words", "__n", "__distinct")


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, is_good, is_toxic, A, B, C, D, E, n)``: documents counted by what they are and what they fail.

    A to D as in :func:`text_failures`; E: the text equals that of a document
    with a smaller id anywhere in the table.  Rows that share an id are not
    each other's copies, and a row without an id has no smaller one and is
    smaller than none.  A null part is the empty string.  ``labels`` has
    ``quality`` and ``toxic`` by id; of several labels of an id a 1 counts, and
    documents without label are neither good nor toxic.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = text_failures(rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))).drop("text")
    # rows without id have no label: they are dealt out, as one key may hold many of them
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.monotonically_increasing_id() % _SALTS).otherwise(0).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(*(F.max((F.col(c) == 1).cast("int")).alias(into) for c, into in (("quality", "is_good"), ("toxic", "is_toxic")))).withColumn("salt", F.lit(0))
    rows = rows.join(known, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("is_good", "is_toxic")})
    kinds = ["digest", "part", "is_good", "is_toxic", "A", "B", "C", "D"]
    each = rows.groupBy("id", "salt", *kinds).agg(F.count("*").alias("copies"))
    mine = F.when(F.col("id").isNotNull(), F.struct("id", "copies"))
    cells = each.groupBy(*kinds).agg(F.sum("copies").alias("all"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("copies"))), F.lit(0)).alias("nameless"), F.min(mine).alias("least"))
    # a digest has at most one row for each part and label here
    cells = cells.withColumn("first", F.min(F.col("least")["id"]).over(Window.partitionBy("digest")))
    originals = F.col("nameless") + F.when(F.col("least")["id"] == F.col("first"), F.col("least")["copies"]).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("E"), originals.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("all") - originals).alias("n")))
    return cells.select(*kinds[1:], F.inline(both)).where("n > 0")


def joint_failures(cells: DataFrame, filters: list[str], by: list[str], measures: dict[str, Column]) -> DataFrame:
    """``(*by, subset, *measures)``: sums over the rows that fail every filter of a subset, for all subsets.

    ``filters`` are boolean columns, a null fails nothing; bit ``i`` of
    ``subset`` stands for filter ``i``, and subset 0 sums over all rows.
    ``measures`` are columns to be summed.  A row counts for the subsets whose
    product of flags is 1; subsets that no row fails have no row.  One
    aggregation that combines in tasks, to at most ``2 ** len(filters)`` rows
    for each value of ``by``.
    """
    if not filters or len(filters) > MOST_FILTERS:
        raise ValueError(f"audit 1 to {MOST_FILTERS} filters together")
    flags = [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in filters]
    products = [F.when(reduce(mul, [f for i, f in enumerate(flags) if s >> i & 1], F.lit(1)) == 1, F.lit(s)) for s in range(1 << len(filters))]
    rows = cells.select(*by, *(c.cast("long").alias(f"__m{i}") for i, c in enumerate(measures.values())), F.explode(F.array_compact(F.array(*products))).alias("subset"))
    return rows.groupBy(*by, "subset").agg(*(F.coalesce(F.sum(f"__m{i}"), F.lit(0)).alias(m) for i, m in enumerate(measures)))


def _fixed(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    columns = [pa.array(c) if isinstance(c[0], str) else pa.array(c, pa.int32()) for c in zip(*rows, strict=True)]
    return spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True))))


def _signs(spark: SparkSession, k: int) -> DataFrame:
    """What each joint count adds to each result, for a filter ``at`` after the filters ``before``: of fixed size for ``k`` filters."""
    rows = []
    for at in range(k):
        for before in range(1 << k):
            if before >> at & 1:
                continue
            for s in range(1 << k):
                size, fails = s.bit_count(), s >> at & 1
                inside = s & ~(before | 1 << at) == 0
                kept = (-1) ** size if inside else 0
                removed = (-1) ** (size - 1) if inside and fails else 0
                alone = (-1) ** (size - 1) if fails else 0
                # a dividend is shared by the filters of its subset alike; k! is a multiple of every size
                share = alone * factorial(k) // size if fails else 0
                if kept or alone:
                    rows.append((at, before, s, kept, removed, int(s == 1 << at) - removed, alone, share))
    return _fixed(spark, rows, ["at", "before", "subset", "kept_by", "removed_by", "redundant_by", "unique_by", "share_by"])


def _orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    """``(filter_order, step, at, before)`` for all orders of the filters."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, at in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, at, before))
            before |= 1 << at
    return _fixed(spark, rows, ["filter_order", "step", "at", "before"])


def interactions(joint: DataFrame, filters: list[str], by: list[str], measures: list[str]) -> DataFrame:
    """What every order of the filters does at every step, from joint counts alone.

    One row for each value of ``by``, order and step: ``kept`` after the step
    and ``removed`` by it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), ``<m>_lost`` for each measure
    after the first (removed by the step), and ``shapley``, the filter's removed
    summed over all orders.  The first measure counts rows.  The joined tables
    depend on the number of filters only.
    """
    spark, k, count = joint.sparkSession, len(filters), measures[0]
    signed = joint.join(F.broadcast(_signs(spark, k)), "subset")  # at most k * 4 ** k rows are broadcast
    lost = [F.sum(F.col(m) * F.col("removed_by")).alias(f"{m}_lost") for m in measures[1:]]
    sums = [F.sum(F.col(count) * F.col(f"{c}_by")).alias(into) for c, into in (("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("unique", "unique_fails"))]
    found = signed.groupBy(*by, "at", "before").agg(*sums, *lost, F.sum(F.col(count) * F.col("share_by")).alias("shapley"))
    orders = F.broadcast(_orders(spark, filters))  # k * k! rows, k is at most MOST_FILTERS
    columns = [*by, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in measures[1:]), "shapley"]
    return found.join(orders, ["at", "before"]).select(*columns)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters of :func:`failure_cells` audited in each part.

    An empty table has no parts and gives no row.
    """
    cells = failure_cells(docs, labels, id_col, text_col, part_col)
    filters, n = ["A", "B", "C", "D", "E"], F.col("n")
    joint = joint_failures(cells, filters, ["part"], {"n": n, "good": n * F.col("is_good"), "toxic": n * F.col("is_toxic")})
    return interactions(joint, filters, ["part"], list(MEASURES))
