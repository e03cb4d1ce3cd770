"""Readers of provider files: landed JSON and XML as normalised papers and institutions.

Schemas are explicit, so that reading needs no pass of inference and a field
that a provider leaves out is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.sources.sinks import numbered

INSPIRE = """hits struct<hits: array<struct<id: string, metadata: struct<control_number: bigint, titles: array<struct<title: string>>, arxiv_eprints: array<struct<value: string, categories: array<string>>>,
    dois: array<struct<value: string>>, abstracts: array<struct<value: string>>, earliest_date: string, document_type: array<string>, inspire_categories: array<struct<term: string>>,
    authors: array<struct<full_name: string, recid: bigint, ids: array<struct<schema: string, value: string>>, affiliations: array<struct<value: string, record: struct<`$ref`: string>>>>>,
    citation_count: bigint, citation_count_without_self_citations: bigint>>>>"""
CROSSREF = """message struct<items: array<struct<DOI: string, title: array<string>, subject: array<string>, issued: struct<`date-parts`: array<array<int>>>, `alternative-id`: array<string>,
    author: array<struct<given: string, family: string, name: string, ORCID: string, affiliation: array<struct<name: string>>>>>>>"""
ROR = """items array<struct<id: string, names: array<struct<value: string, types: array<string>>>, links: array<struct<type: string, value: string>>,
    locations: array<struct<geonames_details: struct<country_code: string, name: string, lat: double, lng: double>>>>>"""
ORCID = """orcid struct<path: string>, `orcid-identifier` struct<path: string>, person struct<name: struct<`given-names`: struct<value: string>, `family-name`: struct<value: string>>>"""
ARXIV = """id string, title string, summary string, published string, updated string, author array<struct<name: string, affiliation: string>>,
    category array<struct<_term: string, _scheme: string>>, primary_category struct<_term: string>"""


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def inspire_papers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each literature record."""
    m = F.col("hit.metadata")
    rows = spark.read.schema(INSPIRE).option("multiLine", True).json(path).select(F.explode("hits.hits").alias("hit"))
    return rows.select(
        F.coalesce(m["control_number"].cast("string"), F.col("hit.id")).alias("record_id"),
        _first(m["titles"])["title"].alias("title"),
        _first(m["arxiv_eprints"])["value"].alias("arxiv_id"),
        F.lower(_first(m["dois"])["value"]).alias("doi"),
        _first(m["abstracts"])["value"].alias("abstract"),
        m["earliest_date"].alias("date"),
        F.coalesce(_first(m["document_type"]), F.lit("article")).alias("document_type"),
        m["inspire_categories"]["term"].alias("categories"),
        m["authors"].alias("authors"),
        m["citation_count"].alias("citation_count"),
        m["citation_count_without_self_citations"].alias("citation_count_without_self"),
    )


def crossref_papers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each work."""
    rows = spark.read.schema(CROSSREF).option("multiLine", True).json(path).select(F.explode("message.items").alias("w"))
    w = F.col("w")
    return rows.select(
        F.lower(w["DOI"]).alias("record_id"),
        _first(w["title"]).alias("title"),
        _first(_first(w["issued"]["date-parts"])).alias("year"),
        w["subject"].alias("categories"),
        F.lower(w["DOI"]).alias("doi"),
        _first(F.filter(w["alternative-id"], lambda x: x.rlike("(?i)arxiv"))).alias("arxiv_id"),
        F.transform(w["author"], lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
    )


def ror_institutions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each institution: the display name, other names, and the first location."""
    rows = spark.read.schema(ROR).option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    i = F.col("i")
    display = F.coalesce(_first(F.filter(i["names"], lambda n: F.array_contains(n["types"], "ror_display")))["value"], _first(i["names"])["value"])
    place = _first(i["locations"])["geonames_details"]
    return rows.select(
        F.regexp_extract(i["id"], "([0-9a-z]{9})$", 1).alias("record_id"),
        display.alias("name"),
        F.array_except(i["names"]["value"], F.array(display)).alias("aliases"),
        place["country_code"].alias("country"),
        place["name"].alias("city"),
        place["lat"].alias("latitude"),
        place["lng"].alias("longitude"),
        F.filter(i["links"], lambda x: x["type"] == "website")["value"].alias("websites"),
    )


def orcid_people(spark: SparkSession, path: str) -> DataFrame:
    """One row for each researcher record."""
    name = F.col("person.name")
    rows = spark.read.schema(ORCID).option("multiLine", True).json(path)
    return rows.select(F.col("orcid-identifier")["path"].alias("record_id"), F.concat_ws(" ", name["given-names"]["value"], name["family-name"]["value"]).alias("name"))


def arxiv_papers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Atom entry; a primary category that is not listed comes first."""
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(ARXIV).load(path)
    terms, primary = F.col("category._term"), F.col("primary_category._term")
    listed = F.when(primary.isNull() | F.array_contains(terms, primary), terms).otherwise(F.concat(F.array(primary), terms))
    return rows.select(
        F.regexp_extract("id", "abs/(.+?)(v\\d+)?$", 1).alias("record_id"),
        F.trim(F.regexp_replace("title", "\\s+", " ")).alias("title"),
        F.trim("summary").alias("abstract"),
        F.to_date(F.substring("published", 1, 10)).alias("published"),
        F.to_date(F.substring("updated", 1, 10)).alias("updated"),
        F.col("author.name").alias("authors"),
        F.transform(listed, lambda c: F.struct(c.alias("category"), F.when(c == primary, "primary").otherwise("secondary").alias("role"))).alias("categories"),
    )


def capture_plan(categories: DataFrame, first: int, last: int, done: DataFrame, column: str = "category") -> DataFrame:
    """The (category, year) tasks that are not done."""
    tasks = categories.select(column).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return tasks.join(done, [column, "year"], "left_anti")


def lookup_batches(ids: DataFrame, known: DataFrame, column: str, size: int = 40) -> DataFrame:
    """Unknown ids in batches of ``size``, in order; no task orders them all."""
    new = ids.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column), column, "left_anti")
    return numbered(new, [column], "place").withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def in_scope(rows: DataFrame, **scope) -> DataFrame:
    """The rows of an acquisition scope: for each column a list of values, or a (first, last) pair of bounds, either of them None."""
    for name, wanted in scope.items():
        if isinstance(wanted, tuple):
            first, last = wanted
            rows = rows.where(F.col(name) >= first) if first is not None else rows
            rows = rows.where(F.col(name) <= last) if last is not None else rows
        elif wanted is not None:
            rows = rows.where(F.col(name).isin(*wanted))
    return rows


def paired(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of two captures of one scope, and which of them has each."""
    a, b = (df.select(*keys).distinct().withColumn(f"__{x}", F.lit(True)) for df, x in ((first, "a"), (second, "b")))
    found = F.when(F.col("__b").isNull(), "first only").when(F.col("__a").isNull(), "second only").otherwise("both")
    return a.join(b, keys, "full").select(*keys, found.alias("captured"))


def unpacked(df: DataFrame, columns: str = "columns", rows: str = "rows") -> DataFrame:
    """Column-name lists and row arrays as one map for each row."""
    return df.select(F.posexplode(rows).alias("place", "__row"), columns).select("place", F.map_from_arrays(columns, "__row").alias("record"))
