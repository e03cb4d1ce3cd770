"""Validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.operators import attribution as att
from scholarframe.operators import gates
from scholarframe.operators.indicators import effective_coverage, window_is_complete
from scholarframe.plans.registry import AFFILIATIONS, PAPERS, SHARES, query
from scholarframe.sources.tables import Tables


@query(f"""WITH {SHARES}, y AS (SELECT paper_id, round(sum(weight) FILTER (status = 'allocated') / sum(weight), 9) AS cov FROM shares GROUP BY 1)
    SELECT paper_id, concat_ws('; ', CASE WHEN cov IS NULL OR cov < 0.9 THEN 'paper time affiliation coverage is below the threshold' END, CASE WHEN cov IS NULL OR cov < 0.95 THEN 'canonical institution coverage is below the threshold' END) AS reasons FROM y""")
def coverage_gate(t: Tables) -> DataFrame:
    allocated = F.sum(F.when(F.col("status") == att.ALLOCATED, F.col("weight")))
    cov = att.attribution_shares(t.affiliations, t.rows("lineitem")).groupBy("paper_id").agg(F.round(allocated / F.sum("weight"), 9).alias("cov"))
    reasons = gates.coverage_reasons({"paper_time_affiliation": F.col("cov"), "canonical_institution": F.col("cov")})
    return cov.select("paper_id", F.array_join(reasons, "; ").alias("reasons"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS n_metrics, count(*) AS n_rows, bool_and(value >= 5) AS all_pass, count(DISTINCT json_extract_string(props, '$.k')) AS n_versions,
    count(DISTINCT event_type) = 5 AND count(*) = count(DISTINCT event_type) AND bool_and(value >= 5) AND count(DISTINCT json_extract_string(props, '$.k')) = 1 AS active FROM events GROUP BY 1, 2""")
def joint_gate(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type", (F.col("value") >= 5).alias("passed"), F.get_json_object("props", "$.k").alias("version"))
    return gates.joint_gate(rows, ["user_id", "day"], 5, "event_type", "passed", "version").drop("reasons")


@query("""SELECT 'orders.custkey' AS path, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) HAVING count(*) > 0
    UNION ALL SELECT 'events.user', count(*) FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)) HAVING count(*) > 0
    UNION ALL SELECT 'labels.doc', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) HAVING count(*) > 0""")
def fk_integrity(t: Tables) -> DataFrame:
    lost = gates.reference_violations(
        ("orders.custkey", t.orders, "o_custkey", t.customer, "c_custkey"), ("events.user", t.events, "user_id", t.supplier, "s_suppkey"), ("labels.doc", t.labels, "doc_id", t.documents, "doc_id")
    )
    return lost.groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT 'lineitem' AS path, l_orderkey || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def uniqueness_gate(t: Tables) -> DataFrame:
    return gates.uniqueness_violations(t.lineitem, "lineitem", "l_orderkey", "l_linenumber")


@query(f"""WITH {PAPERS}, c AS (SELECT document_type, count(DISTINCT year) FILTER (year BETWEEN 1998 AND 2000) = 3 AS three, count(DISTINCT year) FILTER (year BETWEEN 1995 AND 2000) = 6 AS six, count(DISTINCT year) FILTER (year BETWEEN 1994 AND 1996) = 3 AS early FROM papers WHERE year <= 2000 GROUP BY 1)
    SELECT document_type, three, six, early FROM c""")
def window_completeness(t: Tables) -> DataFrame:
    years = t.papers.where("year <= 2000").groupBy("document_type").agg(F.collect_set("year").alias("complete"))
    done = F.col("complete")
    return years.select("document_type", window_is_complete(done, 2000, 3).alias("three"), window_is_complete(done, 2000, 6).alias("six"), window_is_complete(done, 1996, 3).alias("early"))


@query(f"""WITH {PAPERS} SELECT document_type, year, count(*) AS n, min(citations // 20) = max(citations // 20) AS one_cutoff, bool_and(publication_date <= DATE '1999-08-01') AS all_mature,
    min(citations // 20) = max(citations // 20) AND bool_and(publication_date <= DATE '1999-08-01') AND count(*) >= 50 AS certified FROM papers GROUP BY 1, 2""")
def cohort_certification(t: Tables) -> DataFrame:
    rows = t.papers.select("document_type", "year", F.floor(F.col("citations") / 20).alias("cutoff"), (F.col("publication_date") <= F.lit("1999-08-01").cast("date")).alias("mature"))
    return gates.certified_cohorts(rows, ["document_type", "year"], "cutoff", "mature")


@query(f"""WITH {PAPERS}, seen AS (SELECT year, count(*) AS n_seen, count(DISTINCT o_custkey) AS n_unique FROM orders JOIN papers ON paper_id = o_orderkey GROUP BY 1), e AS (SELECT year, count(*) AS expected FROM papers WHERE year < 2001 GROUP BY 1)
    SELECT coalesce(e.year, s.year) AS year, expected, n_seen, n_unique, coalesce(expected = n_seen AND n_seen = n_unique, false) AS certified FROM e FULL OUTER JOIN seen s ON e.year = s.year""")
def source_reconciliation(t: Tables) -> DataFrame:
    expected = t.papers.where("year < 2001").groupBy("year").agg(F.count("*").alias("expected"))
    seen = t.orders.select(F.year("o_orderdate").alias("year"), "o_custkey")
    return gates.reconciled(expected, seen, ["year"], "o_custkey")


@query("""WITH d AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), j AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'unknown source' WHEN n IS NULL THEN 'no decision' WHEN n > 1 THEN 'several decisions' END AS problem FROM orders FULL OUTER JOIN d ON o_orderkey = k)
    SELECT * FROM j WHERE problem IS NOT NULL""")
def population_reconcile(t: Tables) -> DataFrame:
    decisions = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("decision"))
    return gates.population_problems(t.orders, decisions, "o_orderkey", "decision")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_members, count(*) = 5 AND count(DISTINCT event_type) = 5 AS complete FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1")
def exactly_once_gate(t: Tables) -> DataFrame:
    return gates.exactly_once(t.events.where("ts < '2024-01-03'"), ["user_id"], "event_type", 5)


@query(f"""WITH {AFFILIATIONS}, a AS (SELECT paper_id, count(institution_id) / count(*)::DOUBLE AS x, CASE WHEN paper_id % 4 <> 0 THEN (paper_id % 10) / 10.0::DOUBLE END AS y FROM aff GROUP BY 1) SELECT paper_id, round(least(x, y), 6) AS coverage FROM a""")
def effective_coverage_minimum(t: Tables) -> DataFrame:
    x = t.affiliations.groupBy("paper_id").agg((F.count("institution_id") / F.count("*")).alias("x"))
    supplied = F.when(F.col("paper_id") % 4 != 0, F.col("paper_id") % 10 / 10)
    return x.select("paper_id", F.round(effective_coverage(F.col("x"), supplied), 6).alias("coverage"))


@query(f"""WITH {AFFILIATIONS}, p AS (SELECT DISTINCT paper_id, institution_id FROM aff WHERE institution_id IS NOT NULL), s AS (SELECT DISTINCT paper_id, slot FROM aff WHERE institution_id IS NOT NULL)
    SELECT 'papers' AS item, count(DISTINCT paper_id) AS n FROM p UNION ALL SELECT 'slots', count(*) FROM s UNION ALL SELECT 'orphans', count(*) FROM p WHERE paper_id NOT IN (SELECT o_orderkey FROM orders)""")
def affiliation_matches_authorship(t: Tables) -> DataFrame:
    known = t.affiliations.where("institution_id is not null")
    orphans = known.select("paper_id", "institution_id").distinct().join(t.papers, "paper_id", "left_anti")
    parts = [known.agg(F.lit("papers").alias("item"), F.count_distinct("paper_id").alias("n")), known.agg(F.lit("slots").alias("item"), F.count_distinct("paper_id", "slot").alias("n")), orphans.agg(F.lit("orphans").alias("item"), F.count("*").alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
