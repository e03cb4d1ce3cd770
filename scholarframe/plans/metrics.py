"""Attribution, fields, indicators, scales and roll-ups over the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.functions.numbers import round_half_up, synthetic
from scholarframe.operators import attribution as att
from scholarframe.operators import fields as fld
from scholarframe.operators import indicators as ind
from scholarframe.operators import rollup, scales
from scholarframe.operators.exact import means_in_order
from scholarframe.plans.registry import AFFILIATIONS, CATEGORIES, FIELD_SHARES, PAPERS, SHARES, attributed_sql, query
from scholarframe.sources.tables import Tables

#: The last complete year of the test tables.
TERMINAL = 2000


def r(x: F.Column | str, digits: int = 6) -> F.Column:
    return F.round(x, digits)


def attributed(t: Tables, entity: str) -> DataFrame:
    """Paper mass of an entity type by field: allocated shares times field shares."""
    shares = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem")))
    # the rows of one entity in a paper are counted as a paper once, without sets of papers
    shares = shares.withColumn("first_row", F.row_number().over(Window.partitionBy("paper_id", f"{entity}_id").orderBy("slot")) == 1)
    joined = shares.join(fld.equal_shares(t.categories, t.rows("lineitem")), "paper_id").join(t.papers, "paper_id")
    return joined.select(
        F.lit(entity).alias("entity_type"), F.col(f"{entity}_id").alias("entity_id"), "field_id", "paper_id", "year", "publication_date", "document_type", "citations",
        "researcher_id", "first_row", (F.col("weight") * F.col("share")).alias("weight"),
    )


# --- attribution -----------------------------------------------------------


@query(f"WITH {SHARES} SELECT paper_id, slot, researcher_id, institution_id, country_id, n_slots, n_affiliations, round(weight, 9) AS weight, status FROM shares")
def attribution_shares(t: Tables) -> DataFrame:
    return att.attribution_shares(t.affiliations, t.rows("lineitem")).withColumn("weight", r("weight", 9))


@query(f"""WITH {SHARES} SELECT paper_id, round(sum(weight), 6) AS total_mass, round(coalesce(sum(weight) FILTER (status = 'allocated'), 0), 6) AS allocated_mass,
    round(coalesce(sum(weight) FILTER (status <> 'allocated'), 0), 6) AS withheld_mass, round(coalesce(sum(weight) FILTER (status = 'allocated'), 0) / sum(weight), 6) AS coverage FROM shares GROUP BY 1""")
def attribution_coverage(t: Tables) -> DataFrame:
    found = att.mass_totals(att.attribution_shares(t.affiliations, t.rows("lineitem")), "paper_id")
    return found.select("paper_id", *[r(c).alias(c) for c in ("total_mass", "allocated_mass", "withheld_mass", "coverage")])


@query(f"WITH {SHARES} SELECT status, count(*) AS n_shares, round(sum(weight), 4) AS mass FROM shares GROUP BY 1")
def attribution_withheld(t: Tables) -> DataFrame:
    return att.attribution_shares(t.affiliations, t.rows("lineitem")).groupBy("status").agg(F.count("*").alias("n_shares"), r(F.sum("weight"), 4).alias("mass"))


@query(f"WITH {SHARES} SELECT institution_id, round(sum(weight), 4) AS weight, count(DISTINCT paper_id) AS n_papers FROM shares WHERE status = 'allocated' GROUP BY 1")
def institution_weights(t: Tables) -> DataFrame:
    each = att.entity_weights(att.attribution_shares(t.affiliations, t.rows("lineitem")), "institution_id")
    return each.groupBy("institution_id").agg(r(F.sum("weight"), 4).alias("weight"), F.count("*").alias("n_papers"))


@query(f"WITH {SHARES} SELECT researcher_id, round(sum(weight), 4) AS weight FROM shares GROUP BY 1")
def researcher_weights(t: Tables) -> DataFrame:
    each = att.entity_weights(att.attribution_shares(t.affiliations, t.rows("lineitem")), "researcher_id")
    return each.groupBy("researcher_id").agg(r(F.sum("weight"), 4).alias("weight"))


@query(f"""WITH {AFFILIATIONS}, slots AS (SELECT paper_id, count(DISTINCT slot) AS n FROM aff GROUP BY 1), own AS (SELECT DISTINCT paper_id, slot, country_id FROM aff WHERE country_id IS NOT NULL),
    sized AS (SELECT *, count(*) OVER (PARTITION BY paper_id, slot) AS k FROM own JOIN slots USING (paper_id))
    SELECT paper_id, country_id, round(sum(1.0::DOUBLE / (n * k)), 6) AS weight FROM sized GROUP BY 1, 2""")
def country_weights_distinct(t: Tables) -> DataFrame:
    return att.distinct_country_weights(t.affiliations, t.rows("lineitem")).withColumn("weight", r("weight"))


@query(f"WITH {SHARES} SELECT count(*) AS n_papers, count(*) FILTER (abs(mass - 1) > 1e-9) AS n_broken FROM (SELECT paper_id, sum(weight) AS mass FROM shares GROUP BY 1)")
def paper_conservation(t: Tables) -> DataFrame:
    mass = att.attribution_shares(t.affiliations, t.rows("lineitem")).groupBy("paper_id").agg(F.sum("weight").alias("mass"))
    return mass.agg(F.count("*").alias("n_papers"), F.count_if(F.abs(F.col("mass") - 1) > 1e-9).alias("n_broken"))


@query(f"""WITH {AFFILIATIONS} SELECT paper_id, CAST(min(slot) AS INTEGER) AS lowest, CAST(max(slot) AS INTEGER) AS highest, count(*) AS n, count(DISTINCT slot) AS n_distinct FROM aff GROUP BY 1
    HAVING min(slot) <> 1 OR max(slot) <> count(*) OR count(*) <> count(DISTINCT slot)""")
def author_positions(t: Tables) -> DataFrame:
    return att.position_problems(t.affiliations)


@query(f"""WITH {SHARES}, k AS (SELECT paper_id, count(DISTINCT institution_id) AS ni, count(DISTINCT country_id) AS nc, count(DISTINCT slot) AS na, bool_and(status = 'allocated') AS complete FROM shares GROUP BY 1)
    SELECT paper_id, CASE WHEN ni >= 2 THEN true WHEN ni >= 1 AND complete THEN false END AS cross_institution, CASE WHEN nc >= 2 THEN true WHEN nc >= 1 AND complete THEN false END AS international, na >= 2 AS collaborative FROM k""")
def relationship_tristate(t: Tables) -> DataFrame:
    return att.paper_relationships(att.attribution_shares(t.affiliations, t.rows("lineitem")))


@query(f"""WITH {AFFILIATIONS}, e AS (SELECT *, institution_id IS NOT NULL AS present, slot % 3 AS priority, researcher_id AS recency FROM aff),
    ranked AS (SELECT *, rank() OVER (PARTITION BY paper_id, slot ORDER BY present DESC, priority DESC, recency DESC) AS rk FROM e)
    SELECT paper_id, slot, CASE WHEN count(DISTINCT institution_id) <= 1 THEN min(institution_id) END AS institution_id, count(DISTINCT institution_id) > 1 AS conflict FROM ranked WHERE rk = 1 GROUP BY 1, 2""")
def selected_slot_evidence(t: Tables) -> DataFrame:
    evidence = t.affiliations.withColumns({"present": F.col("institution_id").isNotNull(), "priority": F.col("slot") % 3, "recency": F.col("researcher_id")})
    return att.selected_evidence(evidence, ["paper_id", "slot"], "priority", "recency", "present", "institution_id", t.rows("lineitem"))


# --- fields ------------------------------------------------------------------

_RULES = "rules AS (SELECT DISTINCT p_brand AS category, CASE WHEN substr(p_brand, -1) <> '5' THEN p_brand END AS mapped FROM part)"


def _mapped(t: Tables) -> DataFrame:
    """Brands as provider categories; those ending in 5 have no mapping rule."""
    rules = t.part.select(F.col("p_brand").alias("category")).distinct().where(~F.col("category").endswith("5")).withColumn("field_id", F.col("category"))
    return fld.mapped_categories(t.categories.drop("field_id"), rules, ["category"])


_LEDGER = f"""{CATEGORIES}, {_RULES}, u AS (SELECT DISTINCT paper_id, category, mapped FROM cats JOIN rules USING (category)),
    n AS (SELECT paper_id, count(*) AS n, count(*) FILTER (mapped IS NULL) AS lost, count(DISTINCT mapped) AS k FROM u GROUP BY 1),
    ledger AS (SELECT paper_id, mapped AS field_id, (1 - lost / n::DOUBLE) / k AS weight FROM u JOIN n USING (paper_id) WHERE mapped IS NOT NULL
        UNION ALL SELECT paper_id, NULL, lost / n::DOUBLE FROM n WHERE lost > 0)"""


@query(f"WITH {_LEDGER} SELECT paper_id, field_id, round(weight, 6) AS weight FROM ledger")
def field_share_ledger(t: Tables) -> DataFrame:
    return fld.field_ledger(_mapped(t)).withColumn("weight", r("weight"))


@query(f"WITH {_LEDGER} SELECT coalesce(field_id, 'unmapped') AS field_id, round(sum(weight), 4) AS mass, count(*) AS n_papers FROM ledger GROUP BY 1")
def unmapped_mass(t: Tables) -> DataFrame:
    return fld.field_ledger(_mapped(t)).groupBy(F.coalesce("field_id", F.lit("unmapped")).alias("field_id")).agg(r(F.sum("weight"), 4).alias("mass"), F.count("*").alias("n_papers"))


@query(f"WITH {_LEDGER} SELECT paper_id, round(sum(weight), 9) AS mass FROM ledger GROUP BY 1 HAVING abs(sum(weight) - 1) > 1e-9 UNION ALL SELECT count(DISTINCT paper_id), 1.0 FROM ledger")
def field_mass_check(t: Tables) -> DataFrame:
    ledger = fld.field_ledger(_mapped(t))
    bad = ledger.groupBy("paper_id").agg(r(F.sum("weight"), 9).alias("mass")).where(F.abs(F.col("mass") - 1) > 1e-9)
    return bad.unionByName(ledger.agg(F.count_distinct("paper_id").alias("paper_id"), F.lit(1.0).alias("mass")))


@query("""WITH c AS (SELECT l_orderkey AS paper_id, l_returnflag AS provider, l_linestatus AS taxonomy, p_type AS category, CASE WHEN l_linenumber = 1 THEN 'primary' ELSE 'secondary' END AS role, l_suppkey % 5 AS snapshot_id
    FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT paper_id, provider, taxonomy, category, CASE WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'mixed' END AS role, string_agg(DISTINCT snapshot_id::VARCHAR, ',' ORDER BY snapshot_id::VARCHAR) AS snapshots FROM c GROUP BY 1, 2, 3, 4""")
def category_reconciliation(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("taxonomy"), F.col("p_type").alias("category"),
        F.when(F.col("l_linenumber") == 1, "primary").otherwise("secondary").alias("role"), (F.col("l_suppkey") % 5).cast("string").alias("snapshot_id"),
    )
    return fld.reconciled_categories(rows).select("paper_id", "provider", "taxonomy", "category", "role", F.array_join("snapshot_ids", ",").alias("snapshots"))


def _ontology(t: Tables) -> DataFrame:
    """Regions above nations above suppliers, under one root."""
    root = t.spark.range(1).select(F.lit("world").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("branch").alias("kind"))
    regions = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("world").alias("parent_id"), F.lit("branch").alias("kind"))
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit("branch").alias("kind"))
    leaves = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.lit("leaf").alias("kind"))
    return root.unionByName(regions).unionByName(nations).unionByName(leaves)


_ONTOLOGY = """ontology AS (SELECT 'world' AS id, NULL AS parent_id UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    closure(ancestor, descendant, depth) AS (SELECT id, id, 0 FROM ontology UNION ALL SELECT c.ancestor, o.id, c.depth + 1 FROM closure c JOIN ontology o ON o.parent_id = c.descendant)"""


@query(f"WITH RECURSIVE {_ONTOLOGY} SELECT ancestor, descendant, depth FROM closure")
def ontology_descendants(t: Tables) -> DataFrame:
    return fld.descendants(t.spark, _ontology(t))


@query(f"WITH RECURSIVE {_ONTOLOGY} SELECT 'nodes' AS problem, count(*) AS n FROM ontology")
def ontology_validation(t: Tables) -> DataFrame:
    nodes = _ontology(t)
    problems = fld.ontology_problems(nodes, fld.descendants(t.spark, nodes))
    return problems.groupBy("problem").agg(F.count("*").alias("n")).unionByName(nodes.agg(F.lit("nodes").alias("problem"), F.count("*").alias("n")))


@query(f"""WITH {FIELD_SHARES}, b AS (SELECT DISTINCT p_type AS field_id, substr(p_type, 1, 1) AS branch_id FROM part)
    SELECT paper_id, branch_id, field_id, round(sum(share) OVER (PARTITION BY paper_id, branch_id), 6) AS branch_mass, round(share / sum(share) OVER (PARTITION BY paper_id, branch_id), 6) AS conditional
    FROM field_shares JOIN b USING (field_id)""")
def branch_conditional(t: Tables) -> DataFrame:
    branches = t.part.select(F.col("p_type").alias("field_id"), F.substring("p_type", 1, 1).alias("branch_id")).distinct()
    found = fld.branch_conditional(fld.equal_shares(t.categories, t.rows("lineitem")).withColumnRenamed("share", "weight"), branches)
    return found.select("paper_id", "branch_id", "field_id", r("branch_mass").alias("branch_mass"), r("conditional").alias("conditional"))


# --- indicators ----------------------------------------------------------------

_K = "entity_type, entity_id, field_id"
_ACTIVITY = f"""activity AS (SELECT {_K}, sum(weight) AS mass, count(DISTINCT paper_id) AS n_papers, count(DISTINCT researcher_id) AS n_researchers
    FROM attributed WHERE year BETWEEN {TERMINAL - 2} AND {TERMINAL} GROUP BY {_K})"""


@query(f"""WITH {attributed_sql('institution')}, {_ACTIVITY} SELECT {_K}, round(mass, 6) AS mass, n_papers, n_researchers,
    concat_ws('; ', CASE WHEN mass < 10 THEN 'attributed mass is below the threshold' END, CASE WHEN n_researchers < 5 THEN 'too few researchers' END) AS reasons FROM activity""")
def activity_raw(t: Tables) -> DataFrame:
    found = ind.activity(attributed(t, "institution"), TERMINAL, first="first_row", n_rows=t.rows("lineitem"))
    return found.withColumns({"mass": r("mass"), "reasons": F.array_join("reasons", "; ")})


def _winsor(source: str, value: str, cohort: str, minimum: int, extra: str = "") -> str:
    return f"""q AS (SELECT {cohort}, quantile_cont(ln(1 + {value}), 0.05) AS lo, quantile_cont(ln(1 + {value}), 0.95) AS hi, count({value}) AS n FROM {source} GROUP BY {cohort}),
        scored AS (SELECT s.*, CASE WHEN {value} IS NOT NULL AND n >= {minimum} AND hi - lo > 1e-12 THEN 100 * least(1, greatest(0, (ln(1 + {value}) - lo) / (hi - lo))) END AS score {extra} FROM {source} s JOIN q USING ({cohort}))"""


def activity_scores(t: Tables, minimum: int) -> DataFrame:
    """Institutions that pass the thresholds, on the field's scale."""
    accepted = ind.activity(attributed(t, "institution"), TERMINAL, first="first_row", n_rows=t.rows("lineitem")).where(F.size("reasons") == 0)
    return scales.winsorised_log(accepted, "mass", ["entity_type", "field_id"], minimum)


@query(f"""WITH {attributed_sql('institution')}, {_ACTIVITY}, ok AS (SELECT * FROM activity WHERE mass >= 10 AND n_researchers >= 5), {_winsor('ok', 'mass', 'entity_type, field_id', 30)}
    SELECT {_K}, round(mass, 6) AS mass, round(score, 6) AS score FROM scored""")
def activity_scaled(t: Tables) -> DataFrame:
    return activity_scores(t, 30).select("entity_type", "entity_id", "field_id", r("mass").alias("mass"), r("score").alias("score"))


AS_OF = "2001-08-01"
#: Counts of papers published on the last day of a long month came a day late, so they are not comparable.
_ON_TIME = "day(publication_date) <> 31"
_COHORTS = f"""pf AS (SELECT paper_id, field_id, year, document_type, citations FROM field_shares JOIN papers USING (paper_id) WHERE citations IS NOT NULL AND {_ON_TIME}),
    cohorts AS (SELECT field_id, year, document_type, avg(citations) AS cohort_mean, count(*) AS cohort_size FROM pf GROUP BY 1, 2, 3),
    ranked AS (SELECT *, rank() OVER (PARTITION BY field_id, year, document_type ORDER BY citations) - 1 AS below, count(*) OVER (PARTITION BY field_id, year, document_type, citations) AS ties,
    count(*) OVER (PARTITION BY field_id, year, document_type) AS n FROM pf),
    mid AS (SELECT paper_id, field_id, CASE WHEN n < 50 THEN NULL WHEN ties = n THEN 50.0 ELSE 100 * (below + (ties - 1) / 2.0::DOUBLE) / (n - 1) END AS percentile FROM ranked)"""
_MONTHS = f"((year(DATE '{AS_OF}') - year(publication_date)) * 12 + month(DATE '{AS_OF}') - month(publication_date) - CASE WHEN day(DATE '{AS_OF}') < day(publication_date) THEN 1 ELSE 0 END)"
_FITS = f"{_MONTHS} >= 24 AND citations IS NOT NULL AND {_ON_TIME} AND cohort_size >= 50 AND cohort_mean > 0"
_IMPACT = f"""impact AS (SELECT {_K}, sum(weight * citations / cohort_mean) FILTER ({_FITS}) / sum(weight) FILTER ({_FITS}) AS mncs,
    sum(weight * CASE WHEN percentile >= 90 THEN 1 ELSE 0 END) FILTER ({_FITS}) / sum(weight) FILTER ({_FITS}) AS top_share,
    count(DISTINCT paper_id) FILTER ({_FITS}) AS n_eligible, coalesce(sum(weight) FILTER (citations IS NOT NULL AND {_ON_TIME}), 0) / sum(weight) AS citation_coverage
    FROM attributed LEFT JOIN cohorts USING (field_id, year, document_type) LEFT JOIN mid USING (paper_id, field_id) WHERE year BETWEEN {TERMINAL - 2} AND {TERMINAL} GROUP BY {_K}),
    gated AS (SELECT *, concat_ws('; ', CASE WHEN citation_coverage < 0.9 THEN 'citation coverage is below the threshold' END, CASE WHEN n_eligible < 10 THEN 'too few eligible papers' END,
    CASE WHEN n_eligible = 0 THEN 'no eligible citation evidence' END) AS reasons FROM impact)"""


def _cohort_papers(t: Tables) -> DataFrame:
    return fld.equal_shares(t.categories, t.rows("lineitem")).join(t.papers, "paper_id")


def _on_time() -> F.Column:
    return F.dayofmonth("publication_date") != 31


def _impact(t: Tables) -> DataFrame:
    """Impact of institutions over the last three years."""
    papers = attributed(t, "institution").where(ind.in_window(F.col("year"), TERMINAL, 3))
    cohorts = ind.citation_cohorts(_cohort_papers(t).where(_on_time()))
    seen = F.when(_on_time(), F.lit(AS_OF).cast("date")).otherwise(F.date_add(F.lit(AS_OF).cast("date"), 1))
    return ind.impact(papers, cohorts, AS_OF, observed=seen)


@query(f"""WITH {attributed_sql('institution')}, {_COHORTS}, {_IMPACT} SELECT {_K}, round(mncs, 6) AS mncs, round(CASE WHEN reasons = '' THEN mncs END, 6) AS value, n_eligible, round(citation_coverage, 6) AS citation_coverage, reasons FROM gated""")
def impact_mncs(t: Tables) -> DataFrame:
    found = _impact(t)
    return found.select("entity_type", "entity_id", "field_id", r("mncs").alias("mncs"), r("value").alias("value"), "n_eligible", r("citation_coverage").alias("citation_coverage"), F.array_join("reasons", "; ").alias("reasons"))


#: Counts of the session are taken within a week; the day of the month decides when.
_SEEN = "DATE '2001-08-01' + CAST(day(publication_date) % 9 AS INTEGER)"
_SMONTHS = f"((year({_SEEN}) - year(publication_date)) * 12 + month({_SEEN}) - month(publication_date) - CASE WHEN day({_SEEN}) < day(publication_date) THEN 1 ELSE 0 END)"
_SFITS = f"{_SMONTHS} >= 24 AND citations IS NOT NULL AND day(publication_date) % 9 <= 7 AND cohort_size >= 50 AND cohort_mean > 0"


@query(f"""WITH {attributed_sql('institution')}, pf AS (SELECT field_id, year, document_type, citations FROM field_shares JOIN papers USING (paper_id) WHERE citations IS NOT NULL AND day(publication_date) % 9 <= 7),
    cohorts AS (SELECT field_id, year, document_type, avg(citations) AS cohort_mean, count(*) AS cohort_size FROM pf GROUP BY 1, 2, 3),
    f AS (SELECT {_K}, sum(weight * citations / cohort_mean) FILTER ({_SFITS}) / sum(weight) FILTER ({_SFITS}) AS mncs, count(DISTINCT paper_id) FILTER ({_SFITS}) AS n_eligible,
    least(coalesce(sum(weight) FILTER (citations IS NOT NULL AND day(publication_date) % 9 <= 7), 0) / sum(weight), min(CASE WHEN entity_id % 4 <> 0 THEN (80 + entity_id % 20) / 100.0::DOUBLE END)) AS citation_coverage
    FROM attributed LEFT JOIN cohorts USING (field_id, year, document_type) WHERE year BETWEEN {TERMINAL - 2} AND {TERMINAL} GROUP BY {_K})
    SELECT {_K}, round(mncs, 6) AS mncs, n_eligible, round(citation_coverage, 6) AS citation_coverage, round(CASE WHEN citation_coverage >= 0.8 AND n_eligible >= 10 THEN mncs END, 6) AS value FROM f""")
def impact_of_session(t: Tables) -> DataFrame:
    """Impact from counts taken over a session of a week, with the coverage that the source states where that is lower."""
    seen = F.date_add(F.lit("2001-08-01").cast("date"), F.dayofmonth("publication_date") % 9)
    observed = _cohort_papers(t).withColumns({"observed_at": seen, "session_id": F.lit("s"), "started_at": F.lit("2001-08-01").cast("date"), "ended_at": F.lit("2001-08-08").cast("date")})
    cohorts = ind.session_cohorts(observed, "2001-08-31")
    papers = attributed(t, "institution").where(ind.in_window(F.col("year"), TERMINAL, 3)).withColumn("observed_at", seen)
    stated = papers.select(*ind.KEYS).distinct().withColumn("supplied_coverage", F.when(F.col("entity_id") % 4 != 0, (80 + F.col("entity_id") % 20) / 100.0))
    found = ind.session_impact(papers, cohorts, least_coverage=0.8, supplied=stated)
    return found.select("entity_type", "entity_id", "field_id", r("mncs").alias("mncs"), "n_eligible", r("citation_coverage").alias("citation_coverage"), r("value").alias("value"))


@query(f"""WITH {attributed_sql('institution')}, {_COHORTS}, {_IMPACT}, ok AS (SELECT {_K}, mncs FROM gated WHERE reasons = ''), {_winsor('ok', 'mncs', 'entity_type, field_id', 30)}
    SELECT {_K}, round(score, 5) AS score FROM scored""")
def impact_scaled(t: Tables) -> DataFrame:
    found = _impact(t).where("value is not null")
    return scales.winsorised_log(found, "value", ["entity_type", "field_id"], 30).select("entity_type", "entity_id", "field_id", r("score", 5).alias("score"))


@query(f"WITH {FIELD_SHARES}, {PAPERS}, {_COHORTS} SELECT paper_id, field_id, round(percentile, 6) AS percentile FROM field_shares LEFT JOIN mid USING (paper_id, field_id)")
def midrank_percentile(t: Tables) -> DataFrame:
    papers = _cohort_papers(t).withColumn("citations", F.when(_on_time(), F.col("citations")))
    return scales.midrank(papers, "citations", ind.COHORT, 50).select("paper_id", "field_id", r("percentile").alias("percentile"))


@query(f"""WITH {attributed_sql('institution')}, {_COHORTS}, {_IMPACT} SELECT {_K}, round(top_share, 6) AS top_share, n_eligible FROM gated""")
def impact_pp_top10(t: Tables) -> DataFrame:
    return _impact(t).select("entity_type", "entity_id", "field_id", r("top_share").alias("top_share"), "n_eligible")


@query(f"""WITH {attributed_sql('institution')}, k AS (SELECT paper_id, count(DISTINCT institution_id) AS ni, bool_and(status = 'allocated') AS complete FROM shares GROUP BY 1),
    ti AS (SELECT paper_id, CASE WHEN ni >= 2 THEN true WHEN ni >= 1 AND complete THEN false END AS flag FROM k)
    SELECT {_K}, round(coalesce(sum(weight) FILTER (flag), 0) / sum(weight) FILTER (flag IS NOT NULL), 6) AS share, round(coalesce(sum(weight) FILTER (flag IS NOT NULL), 0) / sum(weight), 6) AS relationship_coverage,
    round(sum(weight), 6) AS mass, coalesce(sum(weight) FILTER (flag IS NOT NULL), 0) / sum(weight) >= 0.9 AS accepted FROM attributed JOIN ti USING (paper_id) WHERE year BETWEEN {TERMINAL - 2} AND {TERMINAL} GROUP BY {_K}""")
def connectivity_share(t: Tables) -> DataFrame:
    flags = att.paper_relationships(att.attribution_shares(t.affiliations, t.rows("lineitem"))).select("paper_id", "cross_institution")
    papers = attributed(t, "institution").where(ind.in_window(F.col("year"), TERMINAL, 3)).join(flags, "paper_id")
    found = ind.connectivity(papers, "cross_institution")
    return found.select("entity_type", "entity_id", "field_id", *[r(c).alias(c) for c in ("share", "relationship_coverage", "mass")], "accepted")


@query(f"""WITH {SHARES}, {CATEGORIES}, {PAPERS}, cs AS (SELECT paper_id, category, 1.0::DOUBLE / count(*) OVER (PARTITION BY paper_id) AS share FROM (SELECT DISTINCT paper_id, category FROM cats)),
    m AS (SELECT country_id AS entity_id, category, sum(weight * share) AS m FROM shares JOIN cs USING (paper_id) JOIN papers USING (paper_id) WHERE status = 'allocated' AND year BETWEEN {TERMINAL - 2} AND {TERMINAL} GROUP BY 1, 2),
    tot AS (SELECT entity_id, sum(m) AS mass, count(*) AS n FROM m GROUP BY 1)
    SELECT entity_id, round(mass, 6) AS mass, n AS n_categories, round(CASE WHEN mass >= 15 THEN -sum(m / mass * ln(m / mass)) / ln(25) END, 6) AS evenness FROM m JOIN tot USING (entity_id) GROUP BY entity_id, mass, n""")
def diversity_evenness(t: Tables) -> DataFrame:
    shares = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem"))).join(fld.equal_shares(t.categories.select("paper_id", F.col("category").alias("field_id")), t.rows("lineitem")), "paper_id")
    papers = shares.join(t.papers, "paper_id").where(ind.in_window(F.col("year"), TERMINAL, 3))
    rows = papers.select(F.lit("country").alias("entity_type"), F.col("country_id").alias("entity_id"), F.lit("all").alias("field_id"), F.col("field_id").alias("category"), (F.col("weight") * F.col("share")).alias("weight"))
    return ind.diversity(rows, universe=25).select("entity_id", r("mass").alias("mass"), "n_categories", r("evenness").alias("evenness"))


_YEARLY = f"""ent AS (SELECT DISTINCT {_K} FROM attributed), spine AS (SELECT *, unnest(generate_series({TERMINAL - 5}, {TERMINAL})) AS year FROM ent),
    ym AS (SELECT {_K}, year, sum(weight) AS m FROM attributed GROUP BY ALL), yearly AS (SELECT {_K}, CAST(year AS INTEGER) AS year, coalesce(m, 0.0) AS mass FROM spine LEFT JOIN ym USING ({_K}, year)),
    steps AS (SELECT *, ln(1 + mass) - lag(ln(1 + mass)) OVER (PARTITION BY {_K} ORDER BY year) AS change FROM yearly)"""
_MOMENTUM = f"""{_YEARLY}, mo AS (SELECT {_K}, sum(mass) FILTER (year > {TERMINAL - 3}) AS recent, sum(mass) FILTER (year <= {TERMINAL - 3}) AS baseline, count(*) FILTER (change > 0) AS rises, median(change) AS median_change FROM steps GROUP BY {_K})"""


@query(f"""WITH {attributed_sql('country')}, {_MOMENTUM} SELECT {_K}, round(recent, 6) AS recent, round(baseline, 6) AS baseline, rises,
    round(CASE WHEN recent >= 10 AND baseline >= 10 THEN ln(recent / baseline) END, 6) AS log_change FROM mo""")
def momentum_log_change(t: Tables) -> DataFrame:
    found = ind.momentum(attributed(t, "country"), TERMINAL)
    return found.select("entity_type", "entity_id", "field_id", r("recent").alias("recent"), r("baseline").alias("baseline"), "rises", r("log_change").alias("log_change"))


@query(f"""WITH {attributed_sql('country')}, {_MOMENTUM} SELECT {_K}, round(median(abs(change - median_change)), 6) AS volatility FROM steps JOIN mo USING ({_K}) WHERE change IS NOT NULL GROUP BY {_K}""")
def momentum_volatility(t: Tables) -> DataFrame:
    return ind.momentum(attributed(t, "country"), TERMINAL).select("entity_type", "entity_id", "field_id", r("volatility").alias("volatility"))


_CENTRED = """st AS (SELECT field_id, median(v) AS mid, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(v) AS n, min(v) AS lo, max(v) AS hi FROM src GROUP BY 1),
    md AS (SELECT field_id, median(abs(v - mid)) * 1.4826 AS mad FROM src JOIN st USING (field_id) GROUP BY 1),
    centred AS (SELECT src.*, CASE WHEN v IS NULL OR n < 20 THEN NULL WHEN hi - lo <= 1e-12 THEN 50 ELSE 50 + 50 / 3.0::DOUBLE * greatest(-3, least(3, (v - mid) / CASE WHEN mad > 1e-12 THEN mad WHEN (q3 - q1) / 1.349 > 1e-12 THEN (q3 - q1) / 1.349 END)) END AS score
        FROM src JOIN st USING (field_id) JOIN md USING (field_id))"""


@query(f"""WITH {attributed_sql('country')}, {_MOMENTUM}, src AS (SELECT {_K}, ln(recent / baseline) AS v FROM mo WHERE recent >= 10 AND baseline >= 10), {_CENTRED} SELECT {_K}, round(score, 5) AS score FROM centred""")
def momentum_scaled(t: Tables) -> DataFrame:
    found = ind.momentum(attributed(t, "country"), TERMINAL).where("log_change is not null")
    return scales.centred_change(found, "log_change", ["field_id"], 20).select("entity_type", "entity_id", "field_id", r("score", 5).alias("score"))


@query("""WITH src AS (SELECT p_partkey AS id, p_type AS field_id, CAST(p_size AS DOUBLE) AS v FROM part), """ + _CENTRED + """ SELECT id, field_id, round(score, 6) AS score FROM centred""")
def robust_centered_change(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("field_id"), F.col("p_size").cast("double").alias("v"))
    return scales.centred_change(rows, "v", ["field_id"], 20).select("id", "field_id", r("score").alias("score"))


@query(f"""WITH src AS (SELECT p_partkey AS id, p_type AS field_id, p_retailprice AS v FROM part), {_winsor('src', 'v', 'field_id', 2)} SELECT id, field_id, round(score, 5) AS score FROM scored""")
def winsorized_log(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("field_id"), F.col("p_retailprice").alias("v"))
    return scales.winsorised_log(rows, "v", ["field_id"], 2).select("id", "field_id", r("score", 5).alias("score"))


@query(f"""WITH {SHARES}, {PAPERS}, y AS (SELECT institution_id, year, sum(weight) AS m FROM shares JOIN papers USING (paper_id) WHERE status = 'allocated' GROUP BY 1, 2)
    SELECT institution_id, year, CASE WHEN max(m) OVER w = min(m) OVER w THEN CASE WHEN max(m) OVER w > 0 THEN 50.0 ELSE 0.0 END ELSE floor((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) * 1000 + 0.5) / 10 END AS score
    FROM y WINDOW w AS (PARTITION BY year)""")
def minmax_year_scale(t: Tables) -> DataFrame:
    papers = att.attribution_shares(t.affiliations, t.rows("lineitem")).join(t.papers.select("paper_id", "year"), "paper_id")
    yearly = att.counted_weights(att.allocated(papers), "institution_id", "year").withColumnRenamed("weight", "m")
    return scales.minmax(yearly, "m", ["year"]).select("institution_id", "year", "score")


_INST_YEAR = f"{SHARES}, {PAPERS}, y AS (SELECT institution_id, year, sum(weight) AS m FROM shares JOIN papers USING (paper_id) WHERE status = 'allocated' GROUP BY 1, 2)"


def _institution_years(t: Tables) -> DataFrame:
    return att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem"))).join(t.papers, "paper_id").groupBy("institution_id", "year").agg(F.sum("weight").alias("m"))


@query(f"WITH {_INST_YEAR} SELECT institution_id, year, round(sum(m) OVER (PARTITION BY institution_id ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS trailing FROM y")
def trailing_three_year(t: Tables) -> DataFrame:
    y = _institution_years(t)
    return y.select("institution_id", "year", r(ind.windowed(y, "m", ["institution_id"], -2, 0)).alias("trailing"))


@query(f"WITH {_INST_YEAR} SELECT institution_id, year, round(sum(m) OVER (PARTITION BY institution_id ORDER BY year RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING), 6) AS baseline, round(sum(m) OVER (PARTITION BY institution_id ORDER BY year RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING), 6) AS mature FROM y")
def baseline_window(t: Tables) -> DataFrame:
    y = _institution_years(t)
    return y.select("institution_id", "year", r(ind.windowed(y, "m", ["institution_id"], -5, -3)).alias("baseline"), r(ind.windowed(y, "m", ["institution_id"], -4, -2)).alias("mature"))


@query(f"WITH {attributed_sql('country')}, {_YEARLY} SELECT {_K}, year, round(mass, 6) AS mass, round(change, 6) AS change FROM steps")
def annual_log_diff(t: Tables) -> DataFrame:
    y = ind.annual_masses(attributed(t, "country"), TERMINAL - 5, TERMINAL)
    change = F.log1p("mass") - F.lag(F.log1p("mass")).over(Window.partitionBy(*ind.KEYS).orderBy("year"))
    return y.select(*ind.KEYS, "year", r("mass").alias("mass"), r(change).alias("change"))


@query(f"""WITH {_INST_YEAR}, w AS (SELECT institution_id, sum(m) FILTER (year BETWEEN 1998 AND 2000) AS rec, sum(m) FILTER (year BETWEEN 1995 AND 1997) AS base FROM y GROUP BY 1)
    SELECT institution_id, round((rec - base) / greatest(1.0, rec + base), 6) AS pilot, round(CASE WHEN rec + base > 0 AND rec + base >= 20 THEN (rec - base) / (rec + base) END, 6) AS symmetric FROM w""")
def symmetric_change(t: Tables) -> DataFrame:
    rec = F.sum(F.when(F.col("year").between(1998, 2000), F.col("m")))
    base = F.sum(F.when(F.col("year").between(1995, 1997), F.col("m")))
    w = _institution_years(t).groupBy("institution_id").agg(rec.alias("rec"), base.alias("base"))
    return w.select("institution_id", r(scales.pilot_change(F.col("rec"), F.col("base"))).alias("pilot"), r(scales.symmetric_change(F.col("rec"), F.col("base"), 20)).alias("symmetric"))


# --- corpus build and roll-ups -------------------------------------------------------


@query(f"""WITH {attributed_sql('institution')}, cm AS (SELECT field_id, year, avg(citations) AS mean FROM (SELECT DISTINCT paper_id, field_id, year, citations FROM field_shares JOIN papers USING (paper_id)) GROUP BY 1, 2),
    yr AS (SELECT {_K}, year, sum(weight) AS mass, sum(weight * citations / mean) FILTER (mean > 0) AS num, sum(weight) FILTER (mean > 0 AND citations IS NOT NULL) AS den FROM attributed JOIN cm USING (field_id, year) GROUP BY {_K}, year)
    SELECT {_K}, year, round(sum(mass) OVER (PARTITION BY {_K} ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS activity,
    round(sum(num) OVER m / sum(den) OVER m, 6) AS impact FROM yr WINDOW m AS (PARTITION BY {_K} ORDER BY year RANGE BETWEEN 4 PRECEDING AND 2 PRECEDING)""")
def corpus_metrics(t: Tables) -> DataFrame:
    papers = attributed(t, "institution")
    means = _cohort_papers(t).groupBy("field_id", "year").agg(F.avg("citations").alias("mean"))
    ok, w = (F.col("mean") > 0) & F.col("citations").isNotNull(), F.col("weight")
    yearly = papers.join(means, ["field_id", "year"]).groupBy(*ind.KEYS, "year").agg(F.sum(w).alias("mass"), F.sum(F.when(ok, w * F.col("citations") / F.col("mean"))).alias("num"), F.sum(F.when(ok, w)).alias("den"))
    sums = {c: ind.windowed(yearly, c, ind.KEYS, *span) for c, span in (("mass", (-2, 0)), ("num", (-4, -2)), ("den", (-4, -2)))}
    return yearly.select(*ind.KEYS, "year", r(sums["mass"]).alias("activity"), r(sums["num"] / sums["den"]).alias("impact"))


@query(f"""WITH {attributed_sql('institution')}, k AS (SELECT paper_id, count(DISTINCT institution_id) FILTER (status = 'allocated') AS ni, bool_and(status = 'allocated') AS complete FROM shares GROUP BY 1),
    rows AS (SELECT entity_id, field_id, paper_id, year, weight, complete OR ni > 1 AS known, ni > 1 AS joint FROM attributed JOIN k USING (paper_id)),
    spread AS (SELECT *, unnest(generate_series(year, least(year + 2, {TERMINAL}))) AS period FROM rows), ahead AS (SELECT entity_id, field_id, weight, unnest(generate_series(year + 3, least(year + 5, {TERMINAL}))) AS period FROM rows WHERE year + 3 <= {TERMINAL}),
    c AS (SELECT entity_id, field_id, period, sum(weight) AS mass, coalesce(sum(weight) FILTER (known AND joint), 0) / sum(weight) FILTER (known) AS collaboration FROM spread GROUP BY 1, 2, 3),
    b AS (SELECT entity_id, field_id, period, sum(weight) AS base FROM ahead GROUP BY 1, 2, 3),
    mix AS (SELECT entity_id, s.field_id, period, f.field_id AS sub, sum(weight * share) AS m FROM spread s JOIN field_shares f USING (paper_id) GROUP BY 1, 2, 3, 4),
    d AS (SELECT entity_id, field_id, period, -sum(m / total * ln(m / total)) / ln((SELECT count(DISTINCT p_type) FROM part)) AS diversity FROM (SELECT *, sum(m) OVER (PARTITION BY entity_id, field_id, period) AS total FROM mix) GROUP BY 1, 2, 3)
    SELECT entity_id, field_id, CAST(period AS INTEGER) AS period, round(mass, 6) AS activity, round(collaboration, 6) AS collaboration, round(diversity, 6) AS diversity, round(CASE WHEN base > 0 THEN ln(mass / base) END, 6) AS momentum
    FROM c JOIN d USING (entity_id, field_id, period) LEFT JOIN b USING (entity_id, field_id, period)""")
def corpus_shares(t: Tables) -> DataFrame:
    """Collaboration, category diversity and momentum of the observed corpus, for every period that a window reaches."""
    n_rows = t.rows("lineitem")
    shares = att.attribution_shares(t.affiliations, n_rows)
    allocated, paper = F.col("status") == "allocated", Window.partitionBy("paper_id")
    # a row for each institution of a paper, and one for what is withheld
    own = shares.groupBy("paper_id", F.when(allocated, F.col("institution_id")).alias("entity_id")).agg(F.sum("weight").alias("weight"), F.every(allocated).alias("sure"))
    own = own.withColumns({"joint": F.min("entity_id").over(paper) < F.max("entity_id").over(paper), "complete": F.every("sure").over(paper)}).where("entity_id is not null")
    rows = own.withColumn("known", F.col("complete") | F.col("joint")).join(fld.field_sets(t.categories, n_rows), "paper_id").join(t.papers.select("paper_id", "year"), "paper_id")
    return ind.corpus_windows(rows, "entity_id", TERMINAL, t.part.agg(F.count_distinct("p_type")).first()[0], n_rows=n_rows).select(
        "entity_id", "field_id", "period", *(r(c).alias(c) for c in ("activity", "collaboration", "diversity", "momentum"))
    )


@query(f"""WITH {attributed_sql('institution')}, {_ACTIVITY}, {_winsor('activity', 'mass', 'entity_type, field_id', 2)}
    SELECT entity_type, entity_id, count(score) AS n_fields, round(count(score) / 6.0::DOUBLE, 6) AS coverage, round(CASE WHEN count(score) / 6.0 >= 0.9 THEN avg(score) END, 5) AS mean_score FROM scored GROUP BY 1, 2""")
def physics_wide_mean(t: Tables) -> DataFrame:
    scored = scales.winsorised_log(ind.activity(attributed(t, "institution"), TERMINAL, first="first_row", n_rows=t.rows("lineitem")), "mass", ["entity_type", "field_id"], 2)
    found = rollup.equal_field_mean(scored, ["entity_type", "entity_id"], expected=6)
    return found.select("entity_type", "entity_id", "n_fields", r("coverage").alias("coverage"), r("mean_score", 5).alias("mean_score"))


@query(f"""WITH {attributed_sql('institution')}, {_ACTIVITY}, {_winsor('activity', 'mass', 'entity_type, field_id', 2)}, b AS (SELECT DISTINCT p_type AS field_id, substr(p_type, 1, 1) AS branch_id FROM part),
    ex AS (SELECT branch_id, count(*) AS expected FROM b GROUP BY 1)
    SELECT entity_type, entity_id, branch_id, count(score) AS n_fields, expected, round(CASE WHEN count(score) / expected::DOUBLE >= 0.9 THEN avg(score) END, 5) AS mean_score FROM scored JOIN b USING (field_id) JOIN ex USING (branch_id) GROUP BY 1, 2, 3, 5""")
def branch_rollup(t: Tables) -> DataFrame:
    scored = scales.winsorised_log(ind.activity(attributed(t, "institution"), TERMINAL, first="first_row", n_rows=t.rows("lineitem")), "mass", ["entity_type", "field_id"], 2)
    leaves = t.part.select(F.substring("p_type", 1, 1).alias("branch_id"), F.col("p_type").alias("field_id")).distinct()
    found = rollup.branch_mean(scored, leaves, ["entity_type", "entity_id"])
    return found.select("entity_type", "entity_id", "branch_id", "n_fields", "expected", r("mean_score", 5).alias("mean_score"))


_EVENTS = "obs AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH {_EVENTS}, w AS (SELECT * FROM (VALUES ('click', 40.0::DOUBLE), ('error', 30.0), ('purchase', 20.0), ('signup', 10.0)) AS v(event_type, wt))
    SELECT user_id, round(sum(value * wt / 100), 6) AS composite FROM obs JOIN w USING (event_type) WHERE wt IS NOT NULL GROUP BY 1 HAVING count(*) = 4""")
def composite_weighted(t: Tables) -> DataFrame:
    observations = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    found = rollup.composite(observations, {"click": 40.0, "error": 30.0, "purchase": 20.0, "signup": 10.0}, ["user_id"], metric="event_type")
    return found.withColumn("composite", r("composite"))


@query("""WITH w AS (SELECT p_brand AS profile, p_type AS metric, sum(p_size) / 10.0::DOUBLE AS weight FROM part GROUP BY 1, 2), k AS (SELECT DISTINCT p_type AS metric FROM part)
    SELECT profile, concat_ws('; ', CASE WHEN count(*) <> (SELECT count(*) FROM k) THEN 'weights name other metrics than the known ones' END, CASE WHEN bool_or(weight < 0 OR weight * 2 <> floor(weight * 2)) THEN 'weights are multiples of 0.5 from 0' END,
    CASE WHEN abs(sum(weight) - 100) > 1e-9 THEN 'weights add up to 100' END) AS problems FROM w GROUP BY 1""")
def weight_profiles(t: Tables) -> DataFrame:
    """Why each weight configuration of a table is refused, empty where it is fine."""
    weights = t.part.groupBy(F.col("p_brand").alias("profile"), F.col("p_type").alias("metric")).agg((F.sum("p_size") / 10.0).alias("weight"))
    known = t.part.select(F.col("p_type").alias("metric")).distinct()
    return rollup.profile_problems(weights, known, "profile", "metric", "weight").withColumn("problems", F.array_join("problems", "; "))


@query("""SELECT event_type, user_id, floor(avg(value) * 10 + 0.5) / 10 AS rounded FROM events GROUP BY 1, 2""")
def half_up_rounding(t: Tables) -> DataFrame:
    # means next to a half go by the order of additions, so that is the events' own
    means = means_in_order(t.events, ["event_type", "user_id"], "value", "event_id")
    return means.select("event_type", "user_id", round_half_up(F.col("mean")).alias("rounded"))


@query("""WITH k AS (SELECT s_suppkey, s_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(s_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM supplier)
    SELECT s_suppkey, h AS name_hash, round(greatest(0, least(100, 60 * 0.8 + 50 * 0.2 + 15 * (h / 4294967295.0::DOUBLE * 2 - 1))), 6) AS value FROM k""")
def synthetic_transform(t: Tables) -> DataFrame:
    from scholarframe.functions.numbers import text_hash

    return t.supplier.select("s_suppkey", text_hash(F.col("s_name")).alias("name_hash"), r(synthetic(F.lit(60.0), F.col("s_name"), 0.8, 15.0)).alias("value"))


@query(f"WITH {SHARES}, {PAPERS} SELECT year, round(sum(weight) FILTER (status = 'allocated') / sum(weight), 6) AS coverage_ratio FROM shares JOIN papers USING (paper_id) GROUP BY 1")
def coverage_ratio(t: Tables) -> DataFrame:
    found = att.mass_totals(att.attribution_shares(t.affiliations, t.rows("lineitem")).join(t.papers, "paper_id"), "year")
    return found.select("year", r("coverage").alias("coverage_ratio"))


@query(f"""WITH {SHARES}, m AS (SELECT institution_id, sum(weight) AS observed FROM shares WHERE status = 'allocated' GROUP BY 1), u AS (SELECT sum(weight) AS lost FROM shares WHERE status <> 'allocated')
    SELECT institution_id, round(observed, 4) AS observed, round(lost, 4) AS unresolved_possible, round(observed + lost, 4) AS possible FROM m, u""")
def attribution_bounds(t: Tables) -> DataFrame:
    shares = att.attribution_shares(t.affiliations, t.rows("lineitem"))
    lost = shares.where("status <> 'allocated'").agg(F.sum("weight").alias("lost"))
    observed = att.allocated(shares).groupBy("institution_id").agg(F.sum("weight").alias("observed"))
    # a single row is joined to every institution
    return observed.join(F.broadcast(lost)).select("institution_id", r("observed", 4).alias("observed"), r("lost", 4).alias("unresolved_possible"), r(F.col("observed") + F.col("lost"), 4).alias("possible"))


@query(f"""WITH {SHARES}, inst AS (SELECT DISTINCT paper_id, institution_id FROM shares WHERE status = 'allocated')
    SELECT a.institution_id, count(DISTINCT b.institution_id) AS n_partners, count(DISTINCT a.paper_id) AS n_papers FROM inst a LEFT JOIN inst b ON a.paper_id = b.paper_id AND a.institution_id <> b.institution_id GROUP BY 1""")
def pilot_partners(t: Tables) -> DataFrame:
    inst = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem"))).select("paper_id", "institution_id").distinct()
    other = inst.select(F.col("paper_id").alias("p"), F.col("institution_id").alias("partner"))
    pairs = inst.join(other, (F.col("paper_id") == F.col("p")) & (F.col("institution_id") != F.col("partner")), "left")
    return pairs.groupBy("institution_id").agg(F.count_distinct("partner").alias("n_partners"), F.count_distinct("paper_id").alias("n_papers"))
