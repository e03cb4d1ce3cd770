"""Subject categories, fields, and the hierarchy above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarframe.session import dealt


def field_sets(paper_fields: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``paper_id, fields``: the distinct fields of each paper.

    ``n_rows``, if it is known, bounds what a task gets, as in
    :func:`~scholarframe.operators.attribution.attribution_shares`, to whose rows they are joined.
    """
    return (dealt(paper_fields, n_rows, "paper_id") if n_rows else paper_fields).groupBy("paper_id").agg(F.collect_set("field_id").alias("fields"))


def equal_shares(paper_fields: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``paper_id, field_id, share``: a paper's weight split evenly over its distinct fields, as :func:`field_sets` has them."""
    own = field_sets(paper_fields, n_rows)
    return own.select("paper_id", F.explode("fields").alias("field_id"), (1 / F.size("fields")).alias("share"))


def mapped_categories(categories: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """Categories with the field a rule gives them; unmapped ones stay, with a null field."""
    return categories.join(rules, on, "left")


def field_ledger(mapped: DataFrame) -> DataFrame:
    """``paper_id, field_id, weight`` and a row with a null field for unmapped mass.

    The unmapped mass is the share of unmapped categories; the rest is split
    evenly over the fields found.
    """
    # the sets of one paper are small, and are combined before the only shuffle
    counts = mapped.groupBy("paper_id").agg(
        F.size(F.collect_set("category")).alias("n"),
        F.size(F.collect_set(F.when(F.col("field_id").isNull(), F.col("category")))).alias("unmapped"),
        F.collect_set("field_id").alias("fields"),
    )
    lost = F.when(F.size("fields") == 0, F.lit(1.0)).otherwise(F.col("unmapped") / F.col("n"))
    each = F.transform("fields", lambda f: F.struct(f.alias("field_id"), ((1 - lost) / F.size("fields")).alias("weight")))
    rest = F.when(lost > 0, F.array(F.struct(F.lit(None).cast("string").alias("field_id"), lost.alias("weight")))).otherwise(F.array().cast("array<struct<field_id:string,weight:double>>"))
    return counts.select("paper_id", F.inline(F.concat(each, rest)))


def reconciled_categories(categories: DataFrame) -> DataFrame:
    """Each (provider, taxonomy, category) of a paper once, with the roles and snapshots that named it."""
    return categories.groupBy("paper_id", "provider", "taxonomy", "category").agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("snapshot_id")).alias("snapshot_ids")
    ).withColumn("role", F.when(F.size("roles") == 1, F.col("roles")[0]).when(F.size("roles") > 1, "mixed"))


def descendants(spark: SparkSession, ontology: DataFrame, max_depth: int = 20) -> DataFrame:
    """``ancestor, descendant, depth`` for every node and all nodes below it, itself at depth 0.

    The ontology is a small table; the recursion is Spark's own.
    """
    ontology.createOrReplaceTempView("__ontology")
    return spark.sql(f"""
        WITH RECURSIVE closure(ancestor, descendant, depth) AS (
            SELECT id, id, 0 FROM __ontology
            UNION ALL
            SELECT c.ancestor, o.id, c.depth + 1 FROM closure c JOIN __ontology o ON o.parent_id = c.descendant WHERE c.depth < {max_depth}
        ) SELECT ancestor, descendant, depth FROM closure
    """)


def ontology_problems(ontology: DataFrame, closure: DataFrame) -> DataFrame:
    """Repeated ids, missing parents, parents that are leaves, and cycles, as ``(id, problem)``."""
    repeated = ontology.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    parents = ontology.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    children = ontology.where("parent_id is not null").join(parents, "parent_id", "left")
    missing = children.where("parent_kind is null").select("id", F.lit("missing parent").alias("problem"))
    leaf = children.where("parent_kind = 'leaf'").select("id", F.lit("parent is a leaf").alias("problem"))
    cycles = closure.where("ancestor = descendant and depth > 0").select(F.col("ancestor").alias("id"), F.lit("cycle").alias("problem")).distinct()
    return repeated.unionByName(missing).unionByName(leaf).unionByName(cycles)


def branch_conditional(weights: DataFrame, branch_of: DataFrame) -> DataFrame:
    """Weights restricted to a branch: ``branch_mass`` of the paper there, and each leaf's share of it."""
    own = weights.join(branch_of, "field_id")
    mass = F.sum("weight").over(Window.partitionBy("paper_id", "branch_id"))
    return own.withColumn("branch_mass", mass).withColumn("conditional", F.col("weight") / F.col("branch_mass"))
