"""Named queries over the test tables, each beside SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarframe.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of :class:`Tables` under its own name."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Tables(spark, sf_dir))

        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add


# The bibliographic views in SQL, in step with scholarframe.sources.tables.
PAPERS = """papers AS (SELECT o_orderkey AS paper_id, CAST(o_orderdate AS DATE) AS publication_date, CAST(year(o_orderdate) AS INTEGER) AS year,
    o_orderstatus AS document_type, CASE WHEN o_totalprice >= 15000 THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS citations FROM orders)"""
AFFILIATIONS = """aff AS (SELECT l_orderkey AS paper_id, l_linenumber AS slot, l_partkey || '-' || l_suppkey AS assertion_id, l_partkey AS researcher_id,
    CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS institution_id, CASE WHEN l_returnflag <> 'R' THEN s_nationkey END AS country_id
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
CATEGORIES = """cats AS (SELECT l_orderkey AS paper_id, p_type AS field_id, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SHARES = f"""{AFFILIATIONS},
    eff AS (SELECT paper_id, slot, coalesce('i:' || institution_id, 'a:' || assertion_id) AS affiliation, min(institution_id) AS institution_id,
        min(country_id) AS country_id, min(researcher_id) AS researcher_id FROM aff GROUP BY 1, 2, 3),
    n_slots AS (SELECT paper_id, count(DISTINCT slot) AS n_slots FROM eff GROUP BY 1),
    counted AS (SELECT *, count(*) OVER (PARTITION BY paper_id, slot) AS n_affiliations FROM eff JOIN n_slots USING (paper_id)),
    shares AS (SELECT paper_id, slot, researcher_id, institution_id, country_id, n_slots, n_affiliations, 1.0::DOUBLE / (n_slots * n_affiliations) AS weight,
        CASE WHEN affiliation IS NULL THEN 'withheld-no-affiliation' WHEN institution_id IS NULL THEN 'withheld-unresolved' ELSE 'allocated' END AS status FROM counted)"""
FIELD_SHARES = f"""{CATEGORIES},
    field_shares AS (SELECT paper_id, field_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY paper_id) AS share FROM (SELECT DISTINCT paper_id, field_id FROM cats))"""


def attributed_sql(entity: str) -> str:
    """CTEs ending in ``attributed``, as :func:`scholarframe.plans.metrics.attributed` makes it."""
    return f"""{SHARES}, {FIELD_SHARES}, {PAPERS},
    attributed AS (SELECT '{entity}' AS entity_type, {entity}_id AS entity_id, field_id, paper_id, year, publication_date, document_type, citations,
        researcher_id, weight * share AS weight FROM shares JOIN field_shares USING (paper_id) JOIN papers USING (paper_id) WHERE status = 'allocated')"""
