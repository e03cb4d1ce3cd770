"""Named tables of a folder, and the bibliographic views the test tables stand for.

Orders are papers, line items are affiliations of author slots, parts are
researchers, suppliers institutions, nations countries, part types leaf fields
and part brands finer categories; a returned line is an unresolved affiliation,
and of papers with the lowest totals the citation count is missing.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily read tables of one folder; every view is a plain DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """How many rows a table has, by what its files say of themselves."""
        if name not in self._rows:
            self._rows[name] = self.read(name).count()
        return self._rows[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def papers(self) -> DataFrame:
        """``paper_id, publication_date, year, document_type, citations``."""
        return self.read("orders").select(
            F.col("o_orderkey").alias("paper_id"),
            F.to_date("o_orderdate").alias("publication_date"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderstatus").alias("document_type"),
            F.when(F.col("o_totalprice") >= 15000, F.floor(F.col("o_totalprice") / 10000).cast("long")).alias("citations"),
        )

    @cached_property
    def affiliations(self) -> DataFrame:
        """``paper_id, slot, assertion_id, researcher_id, institution_id, country_id``; null places are unresolved."""
        lines = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        places = self.read("supplier").select("s_suppkey", "s_nationkey")
        known = F.col("l_returnflag") != "R"
        return lines.join(places, lines["l_suppkey"] == places["s_suppkey"]).select(
            F.col("l_orderkey").alias("paper_id"),
            F.col("l_linenumber").alias("slot"),
            F.concat_ws("-", "l_partkey", "l_suppkey").alias("assertion_id"),
            F.col("l_partkey").alias("researcher_id"),
            F.when(known, F.col("l_suppkey")).alias("institution_id"),
            F.when(known, F.col("s_nationkey")).alias("country_id"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        """``paper_id, field_id, category``: the field and category of each line's part."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey")
        parts = self.read("part").select("p_partkey", "p_type", "p_brand")
        return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
            F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("field_id"), F.col("p_brand").alias("category")
        )
