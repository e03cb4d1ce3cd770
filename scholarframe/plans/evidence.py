"""Identity evidence, certification, exact sums and checkpoints over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.operators import attribution as att
from scholarframe.operators import evidence as evi
from scholarframe.operators import exact, gates
from scholarframe.operators import fields as fld
from scholarframe.plans.metrics import attributed
from scholarframe.plans.registry import AFFILIATIONS, CATEGORIES, PAPERS, SHARES, attributed_sql, query
from scholarframe.sources.tables import Tables

# --- identity evidence -----------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n, list_sort(list(DISTINCT l_linestatus) FILTER (l_returnflag <> 'R')) AS own, list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity > 10)) AS wide FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, coalesce(len(own), 0) AS a, coalesce(len(wide), 0) AS b FROM s)
    SELECT l_orderkey, l_partkey, CASE WHEN a + b = 0 THEN 'no-ror-evidence' WHEN n > 1 AND a > 0 AND b > 0 THEN 'affiliation-local-ror-author-level-set-unaligned' WHEN n > 1 AND a = 0 THEN 'unresolved-author-ror-not-positionally-aligned'
        WHEN b = 0 THEN 'affiliation-local-ror' WHEN a > 0 AND own = wide THEN 'single-affiliation-local-author-ror-corroborated' WHEN a > 0 THEN 'conflicted-single-affiliation-local-vs-author-ror'
        WHEN b = 1 THEN 'single-affiliation-author-ror' ELSE 'conflicted-single-affiliation-multiple-author-rors' END AS alignment,
    array_to_string(CASE WHEN n = 1 THEN list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(wide, [])))) ELSE coalesce(own, []) END, ',') AS identifiers FROM k""")
def evidence_alignment(t: Tables) -> DataFrame:
    own = F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")))
    slots = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), own.alias("own"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("wide"))
    found = slots.withColumn("a", evi.aligned_identifiers(F.col("own"), F.col("wide"), F.col("n")))
    return found.select("l_orderkey", "l_partkey", "a.alignment", F.array_join("a.identifiers", ",").alias("identifiers"))


@query("""WITH e AS (SELECT event_id, CASE WHEN value > 60 THEN 'matched' WHEN value > 30 THEN 'ambiguous' ELSE 'unmatched' END AS status, user_id % 7 = 0 AS invalid, event_type = 'signup' AS has_ror, event_type IN ('click', 'signup', 'error') AS requires FROM events)
    SELECT event_id, status, CASE WHEN status = 'matched' THEN NULL WHEN invalid THEN 'missing-or-invalid' WHEN requires AND NOT has_ror THEN 'authority-identifier-required' ELSE 'unclassified' END AS reason FROM e""")
def identity_reasons(t: Tables) -> DataFrame:
    status = F.when(F.col("value") > 60, "matched").when(F.col("value") > 30, "ambiguous").otherwise("unmatched")
    why = F.when(F.col("user_id") % 7 == 0, F.array(F.lit("missing-or-invalid")))
    schemes = F.when(F.col("event_type") == "signup", F.array(F.lit("ROR"), F.lit("grid"))).otherwise(F.array(F.lit("grid")))
    rows = t.events.select("event_id", status.alias("status"), why.alias("why"), schemes.alias("schemes"), F.col("event_type").isin("click", "signup", "error").alias("requires"))
    return rows.select("event_id", "status", evi.unmatched_reason(F.col("status"), F.col("why"), F.col("schemes"), evi.AUTHORITIES["institution"], F.col("requires")).alias("reason"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_quantity > 45 THEN l_suppkey + 1000000 ELSE l_suppkey END AS named FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, s_suppkey AS institution_id, CASE WHEN s_suppkey IS NOT NULL THEN 'resolved' WHEN named IS NOT NULL THEN 'unknown target' ELSE 'no reference' END AS status FROM a LEFT JOIN supplier ON s_suppkey = named""")
def affiliation_references(t: Tables) -> DataFrame:
    base = F.lit("https://provider.example/api/institutions/")
    url = F.when(F.col("l_returnflag") == "R", "https://provider.example/about").when(F.col("l_quantity") > 45, F.concat(base, F.col("l_suppkey") + 1000000)).otherwise(F.concat(base, F.col("l_suppkey")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", url.alias("url"))
    return evi.referenced(rows, "url", "institutions", t.supplier, "s_suppkey", "institution_id").select("l_orderkey", "l_linenumber", "l_suppkey", "institution_id", "status")


@query("SELECT l_orderkey AS paper_id, coalesce(bool_or(l_quantity > 45), false) AS has_citation, coalesce(bool_or(l_discount = 0), false) AS has_reference FROM lineitem GROUP BY 1")
def citation_presence(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), "l_quantity", "l_discount")
    return evi.any_presence(rows, ["paper_id"], has_citation=F.col("l_quantity") > 45, has_reference=F.col("l_discount") == 0)


@query("""WITH k AS (SELECT l_partkey, count(DISTINCT l_linestatus || l_returnflag) FILTER (l_quantity > 40) AS n_values, min(l_linestatus || l_returnflag) FILTER (l_quantity > 40) AS v FROM lineitem GROUP BY 1)
    SELECT l_partkey, CASE WHEN n_values = 1 THEN v END AS identity, n_values, CASE WHEN n_values = 0 THEN 'no value' WHEN n_values > 1 THEN 'several values' END AS reason FROM k""")
def researcher_admission(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", F.when(F.col("l_quantity") > 40, F.concat("l_linestatus", "l_returnflag")).alias("identity"))
    return evi.unambiguous(rows, "l_partkey", "identity")


@query(f"""WITH {AFFILIATIONS}, {PAPERS}, cross_ AS (SELECT s_suppkey, count(DISTINCT n_regionkey) FILTER (s_acctbal > 0) AS n_targets FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5 AND n_regionkey = s_suppkey % 3 GROUP BY 1),
    used AS (SELECT institution_id AS s_suppkey, count(*) AS n_outside FROM aff JOIN papers USING (paper_id) JOIN supplier ON s_suppkey = institution_id WHERE year < CASE WHEN s_suppkey % 4 = 0 THEN 1996 END OR year > 2000 + s_suppkey % 3 GROUP BY 1)
    SELECT s_suppkey, concat_ws('; ', CASE WHEN s_acctbal <= 0 THEN 'no authority' END, CASE WHEN coalesce(n_targets, 0) = 0 THEN 'no crosswalk target' END, CASE WHEN n_targets > 1 THEN 'several crosswalk targets' END,
    CASE WHEN n_outside > 0 THEN 'used outside its lifetime' END) AS reasons FROM supplier LEFT JOIN cross_ USING (s_suppkey) LEFT JOIN used USING (s_suppkey)""")
def institution_certification(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.concat(F.lit("ror:"), k)).alias("authority"), "s_acctbal")
    nation = t.nation.select("n_nationkey", "n_regionkey")
    cross = t.supplier.where("s_acctbal > 0").join(nation, (F.col("n_nationkey") % 5 == k % 5) & (F.col("n_regionkey") == k % 3)).select(k.alias("source"), "n_regionkey")
    lived = t.supplier.select("s_suppkey", F.when(k % 4 == 0, 1996).alias("first_year"), (F.lit(2000) + k % 3).alias("last_year"))
    used = t.affiliations.where("institution_id is not null").join(t.papers, "paper_id").select("institution_id", "year")
    found = evi.certified_institutions(rows, "s_suppkey", "authority", cross, "source", "n_regionkey", lived, "first_year", "last_year", used, "institution_id", "year")
    return found.select("s_suppkey", F.array_join("reasons", "; ").alias("reasons"))


# --- certification ------------------------------------------------------------

_LINKS = (
    ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"), ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"), ("customer.c_nationkey", "customer", "c_nationkey", "nation", "n_nationkey"), ("supplier.s_nationkey", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation.n_regionkey", "nation", "n_regionkey", "region", "r_regionkey"), ("events.user_id", "events", "user_id", "customer", "c_custkey"), ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"), ("documents.doc_id", "documents", "doc_id", "labels", "doc_id"),
    ("orders.o_orderkey", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("part.p_partkey", "part", "p_partkey", "lineitem", "l_partkey"), ("supplier.s_suppkey", "supplier", "s_suppkey", "lineitem", "l_suppkey"),
)
_KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("region", "r_name"), ("nation", "n_name"))
_PRESENT = (("orders", "o_orderdate"), ("orders", "o_totalprice"), ("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"), ("events", "ts"), ("events", "value"), ("documents", "text"), ("documents", "lang"), ("labels", "quality"), ("lineitem", "l_quantity"))


def _counted(df: DataFrame, checks: dict[str, F.Column]) -> DataFrame:
    """``(check_name, n_violations)``: the rows that each check finds, in one scan."""
    each = df.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())))
    return each.select(F.inline(F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("n_violations")) for i, name in enumerate(checks)))))


@query(
    " UNION ALL ".join(
        [f"SELECT 'reference {p}' AS check_name, count(DISTINCT {k}) AS n_violations FROM {a} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {b} WHERE {pk} IS NOT NULL)" for p, a, k, b, pk in _LINKS]
        + [f"SELECT 'unique {a}.{k}', count(*) FROM (SELECT {k} FROM {a} GROUP BY 1 HAVING count(*) > 1)" for a, k in _KEYS]
        + [f"SELECT 'present {a}.{k}', count(*) FILTER ({k} IS NULL) FROM {a}" for a, k in _PRESENT]
        + ["SELECT 'range lineitem.l_discount', count(*) FILTER (l_discount < 0 OR l_discount > 1) FROM lineitem", "SELECT 'range lineitem.l_quantity', count(*) FILTER (l_quantity <= 0) FROM lineitem", "SELECT 'range orders.o_totalprice', count(*) FILTER (o_totalprice < 0) FROM orders"]
    )
)
def dataset_integrity(t: Tables) -> DataFrame:
    """All checks of the data set in one table, clean ones with zero."""
    kinds = [(f"reference {p}", gates.reference_violations((p, t.read(a), k, t.read(b), pk))) for p, a, k, b, pk in _LINKS]
    kinds += [(f"unique {a}.{k}", gates.uniqueness_violations(t.read(a), a, k)) for a, k in _KEYS]
    counts = [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_violations")) for name, df in kinds]
    for table in dict.fromkeys(a for a, _ in _PRESENT):  # one scan a table
        counts.append(_counted(t.read(table), {f"present {a}.{k}": F.col(k).isNull() for a, k in _PRESENT if a == table}))
    discount = (F.col("l_discount") < 0) | (F.col("l_discount") > 1)
    counts += [_counted(t.lineitem, {"range lineitem.l_discount": discount, "range lineitem.l_quantity": F.col("l_quantity") <= 0}), _counted(t.orders, {"range orders.o_totalprice": F.col("o_totalprice") < 0})]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


@query(f"""WITH {AFFILIATIONS}, {CATEGORIES}, {PAPERS},
    m AS (SELECT paper_id, count(DISTINCT field_id) AS n_fields FROM cats GROUP BY 1), s AS (SELECT paper_id, count(DISTINCT slot) AS n_slots, max(slot) AS last_slot, count(*) FILTER (institution_id IS NULL) AS n_open FROM aff GROUP BY 1)
    SELECT paper_id, concat_ws('; ', CASE WHEN n_fields IS NULL THEN 'no field' END, CASE WHEN n_slots IS NULL THEN 'no author' END, CASE WHEN n_slots <> last_slot THEN 'author positions have gaps' END, CASE WHEN n_open > 0 THEN 'unresolved affiliation' END,
    CASE WHEN citations IS NULL THEN 'no citation count' END, CASE WHEN publication_date > DATE '2001-08-01' THEN 'published after the cutoff' END) AS problems FROM papers LEFT JOIN m USING (paper_id) LEFT JOIN s USING (paper_id)""")
def ecosystem_validation(t: Tables) -> DataFrame:
    """What speaks against each paper: links, identities, fields, citations and history."""
    fields = t.categories.groupBy("paper_id").agg(F.count_distinct("field_id").alias("n_fields"))
    slots = t.affiliations.groupBy("paper_id").agg(F.count_distinct("slot").alias("n_slots"), F.max("slot").alias("last_slot"), F.count_if(F.col("institution_id").isNull()).alias("n_open"))
    checks = [
        F.when(F.col("n_fields").isNull(), F.lit("no field")), F.when(F.col("n_slots").isNull(), F.lit("no author")), F.when(F.col("n_slots") != F.col("last_slot"), F.lit("author positions have gaps")),
        F.when(F.col("n_open") > 0, F.lit("unresolved affiliation")), F.when(F.col("citations").isNull(), F.lit("no citation count")), F.when(F.col("publication_date") > F.lit("2001-08-01").cast("date"), F.lit("published after the cutoff")),
    ]
    joined = t.papers.join(fields, "paper_id", "left").join(slots, "paper_id", "left")
    return joined.select("paper_id", F.array_join(F.array_compact(F.array(*checks)), "; ").alias("problems"))


@query(f"""WITH {SHARES}, {CATEGORIES}, {PAPERS}, y AS (SELECT DISTINCT year FROM papers),
    cov AS (SELECT year, sum(weight) FILTER (status = 'allocated') / sum(weight) >= 0.6 AS passed FROM shares JOIN papers USING (paper_id) GROUP BY 1), vol AS (SELECT year, count(*) >= 200 AS passed FROM papers GROUP BY 1),
    cit AS (SELECT year, count(citations) / count(*)::DOUBLE >= 0.97 AS passed FROM papers GROUP BY 1), fields AS (SELECT year, count(DISTINCT field_id) >= 6 AS passed FROM cats JOIN papers USING (paper_id) GROUP BY 1)
    SELECT year, concat_ws(',', CASE WHEN NOT cov.passed THEN 'attribution' END, CASE WHEN NOT vol.passed THEN 'population' END, CASE WHEN NOT cit.passed THEN 'citations' END, CASE WHEN NOT fields.passed THEN 'fields' END) AS failed,
    cov.passed AND vol.passed AND cit.passed AND fields.passed AS certified FROM y JOIN cov USING (year) JOIN vol USING (year) JOIN cit USING (year) JOIN fields USING (year)""")
def launch_certification(t: Tables) -> DataFrame:
    """Years certified by attribution, population, citations and fields together."""
    shares = att.mass_totals(att.attribution_shares(t.affiliations, t.rows("lineitem")).join(t.papers, "paper_id"), "year")
    papers = t.papers.groupBy("year").agg(F.count("*").alias("n"), F.count("citations").alias("known"))
    covered = t.categories.join(t.papers, "paper_id").groupBy("year").agg((F.count_distinct("field_id") >= 6).alias("passed"))
    found = evi.composed({
        "attribution": shares.select("year", (F.col("coverage") >= 0.6).alias("passed")), "population": papers.select("year", (F.col("n") >= 200).alias("passed")),
        "citations": papers.select("year", (F.col("known") / F.col("n") >= 0.97).alias("passed")), "fields": covered,
    }, ["year"])
    return found.select("year", F.array_join("failed", ",").alias("failed"), "certified")


_RESULTS = f"""{attributed_sql('institution')}, src AS (SELECT entity_type, entity_id, field_id, year, document_type, sum(weight) AS v, count(DISTINCT paper_id) % 2 = 0 AS even FROM attributed GROUP BY ALL)"""


@query(f"""WITH {_RESULTS}, q AS (SELECT field_id, year, document_type, even, quantile_cont(ln(1 + v), 0.05) AS lo, quantile_cont(ln(1 + v), 0.95) AS hi, count(*) AS n FROM src GROUP BY ALL)
    SELECT entity_id, field_id, CAST(year AS VARCHAR) AS period, document_type AS dataset_version, CASE WHEN n < 5 THEN 'too few entities' WHEN hi - lo <= 1e-12 THEN 'no spread' END AS reason,
    round(CASE WHEN n >= 5 AND hi - lo > 1e-12 THEN 100 * least(1, greatest(0, (ln(1 + v) - lo) / (hi - lo))) END, 5) AS score FROM src JOIN q USING (field_id, year, document_type, even)""")
def normalisation_cohorts(t: Tables) -> DataFrame:
    """Scores of institutions within their population, which agrees on all fourteen versions."""
    yearly = attributed(t, "institution").groupBy("entity_type", "entity_id", "field_id", "year", "document_type").agg(F.sum("weight").alias("v"), F.count_if("first_row").alias("n"))
    known = {"period": F.col("year").cast("string"), "dataset_version": F.col("document_type"), "acquisition_scope": (F.col("n") % 2).cast("string")}
    results = yearly.withColumns({c: known.get(c, F.lit("1")) for c in evi.VERSIONS if c not in ("entity_type", "field_id")})
    scored = evi.scored_populations(results, "entity_id", "v", 5)
    return scored.select("entity_id", "field_id", "period", "dataset_version", "reason", F.round("score", 5).alias("score"))


_OBSERVED = "o AS (SELECT event_id, event_type AS metric_id, json_extract_string(props, '$.k') AS version, ts, value FROM events)"


@query(f"""WITH {_OBSERVED}, d AS (SELECT metric_id, version, min(ts) AS since FROM o GROUP BY 1, 2), f AS (SELECT metric_id, version FROM d WHERE since <= TIMESTAMP '2024-01-02' QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY CAST(version AS INTEGER) DESC) = 1)
    SELECT event_id, metric_id, version, round(value, 6) AS value FROM o JOIN f USING (metric_id, version)""")
def definition_version_join(t: Tables) -> DataFrame:
    """Observations of the definitions that were in force on a day; those of other versions are not served."""
    rows = t.events.select("event_id", F.col("event_type").alias("metric_id"), F.get_json_object("props", "$.k").alias("version"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("value"))
    definitions = rows.groupBy("metric_id", "version").agg(F.min("ts").alias("since"))
    force = evi.definitions_in_force(definitions, "metric_id", "version", "since", F.lit("2024-01-02").cast("timestamp_ntz"))
    return evi.of_definitions(rows, force, "metric_id", "version").select("event_id", "metric_id", "version", "value")


@query("""WITH a AS (SELECT user_id, max(ts) AS last, bool_and(value <= 95) AS ok, count(*) FILTER (value > 95) AS n_failed FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT c_custkey AS user_id, CASE WHEN ok THEN last ELSE TIMESTAMP '2024-01-15' END AS cursor, coalesce(n_failed, 0) AS n_failed, coalesce(NOT ok, false) AS replay FROM customer LEFT JOIN a ON user_id = c_custkey""")
def checkpoint_cursors(t: Tables) -> DataFrame:
    """A source's cursor moves on only if all its records of the batch passed."""
    start = F.lit("2024-01-15").cast("timestamp_ntz")
    batch = t.events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") <= 95).alias("succeeded")).where(F.col("ts") >= start)
    before = t.customer.select(F.col("c_custkey").alias("user_id"), start.alias("old"))
    return evi.next_cursors(batch, "user_id", "ts", "succeeded", before, "old")


# --- sums, digests and small functions ----------------------------------------------


# a weight times 2 ** 80 is a whole number, and whole numbers add exactly
@query(f"WITH {SHARES} SELECT institution_id, round(CAST(sum(CAST(weight * pow(2.0, 80) AS HUGEINT)) AS DOUBLE) / pow(2.0, 80), 12) AS mass FROM shares WHERE status = 'allocated' GROUP BY 1")
def exact_masses(t: Tables) -> DataFrame:
    own = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem")))
    return exact.exact_sums(own, ["institution_id"], mass=F.col("weight")).withColumn("mass", F.round("mass", 12))


@query(f"""WITH {SHARES}, {PAPERS}, m AS (SELECT institution_id, year, sum(CAST(weight * pow(2.0, 80) AS HUGEINT)) AS m FROM shares JOIN papers USING (paper_id) WHERE status = 'allocated' GROUP BY 1, 2)
    SELECT institution_id, round(CAST(sum(m) AS DOUBLE) / pow(2.0, 80), 12) AS mass, count(*) AS n_years FROM m GROUP BY 1""")
def merged_masses(t: Tables) -> DataFrame:
    """Masses by year, kept in limbs, add up to those of all years without a second rounding."""
    own = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem"))).join(t.papers.select("paper_id", "year"), "paper_id")
    yearly = exact.accumulated(own, ["institution_id", "year"], mass=F.col("weight"))
    n_years = yearly.groupBy("institution_id").agg(F.count_distinct("year").alias("n_years"))
    every = exact.totals(exact.merged(yearly.drop("year"), ["institution_id"]), ["institution_id"], ["mass"])
    return every.withColumn("mass", F.round("mass", 12)).join(n_years, "institution_id")


@query("""WITH r AS (SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS d FROM nation),
    c AS (SELECT d, count(*) AS n FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d || ':' || n, ',' ORDER BY d || ':' || n)) AS digest FROM c""")
def canonical_digest(t: Tables) -> DataFrame:
    return exact.table_digest(t.nation, ["n_nationkey", "n_name", "n_regionkey"])


@query("""SELECT l_orderkey AS paper_id, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS role FROM lineitem GROUP BY 1""")
def category_roles(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("paper_id")).agg(evi.category_role(F.collect_set("l_returnflag")).alias("role"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || upper(p_name), ' ')) AS w, generate_subscripts(string_split(p_name || ' ' || upper(p_name), ' '), 1) AS i FROM part),
    f AS (SELECT p_partkey, lower(w) AS k, arg_min(w, i) AS w, min(i) AS i FROM w GROUP BY 1, 2) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1""")
def distinct_spellings(t: Tables) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", F.upper("p_name")), " ")
    return t.part.select("p_partkey", F.array_join(evi.first_wins_strings(words), " ").alias("words"))


@query(f"""WITH {SHARES}, own AS (SELECT DISTINCT paper_id, institution_id FROM shares WHERE status = 'allocated')
    SELECT a.paper_id, a.institution_id, coalesce(string_agg(b.institution_id::VARCHAR, ',' ORDER BY b.institution_id), '') AS partners FROM own a LEFT JOIN own b ON a.paper_id = b.paper_id AND a.institution_id <> b.institution_id GROUP BY 1, 2""")
def attributed_partners(t: Tables) -> DataFrame:
    own = att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem")))
    return evi.partners(own, "paper_id", "institution_id").withColumn("partners", F.array_join(F.transform("partners", lambda x: x.cast("string")), ","))


@query(f"""WITH {SHARES}, {CATEGORIES}, {PAPERS}, m AS (SELECT paper_id, count(DISTINCT category) AS n, count(DISTINCT category) FILTER (field_id IS NULL) AS lost FROM cats GROUP BY 1)
    SELECT year, count(*) AS n_papers, count(*) FILTER (n > 0 AND lost = 0) AS n_whole, round(count(*) FILTER (n > 0 AND lost = 0) / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (n > 0 AND lost = 0) / count(*)::DOUBLE >= 0.9 AS certified
    FROM papers LEFT JOIN m USING (paper_id) GROUP BY 1""")
def field_ledger_certification(t: Tables) -> DataFrame:
    """Years in which the ledgers of enough papers carry their whole mass."""
    ledger = fld.field_ledger(t.categories).groupBy("paper_id").agg(F.sum("weight").alias("mass"), F.count_if(F.col("field_id").isNull()).alias("lost"))
    whole = F.coalesce((F.abs(F.col("mass") - 1) < 1e-9) & (F.col("lost") == 0), F.lit(False))
    found = t.papers.join(ledger, "paper_id", "left").groupBy("year").agg(F.count("*").alias("n_papers"), F.count_if(whole).alias("n_whole"))
    ratio = F.col("n_whole") / F.col("n_papers")
    return found.select("year", "n_papers", "n_whole", F.round(ratio, 6).alias("ratio"), (ratio >= 0.9).alias("certified"))


@query("""SELECT event_type AS method, CASE WHEN value > 60 THEN 'matched' ELSE 'open' END AS status, count(*) AS n, round(avg(value / 100), 6) AS mean_confidence, round(count(*) FILTER (value > 60) / count(*)::DOUBLE, 6) AS matched_ratio FROM events GROUP BY 1, 2""")
def resolution_confidence(t: Tables) -> DataFrame:
    status = F.when(F.col("value") > 60, "matched").otherwise("open")
    return t.events.groupBy(F.col("event_type").alias("method"), status.alias("status")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("value") / 100), 6).alias("mean_confidence"), F.round(F.count_if(F.col("value") > 60) / F.count("*"), 6).alias("matched_ratio")
    )


@query("""SELECT event_id, strftime(ts - INTERVAL '90 minutes', '%Y-%m-%dT%H:%M:%SZ') AS utc, CAST(ts - INTERVAL '90 minutes' AS DATE) AS provider_date FROM events""")
def provider_timestamps(t: Tables) -> DataFrame:
    """Timestamps with an offset as instants of UTC; text that is none gives null."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))
    at = F.try_to_timestamp(written)
    return t.events.select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc"), F.to_date(at).alias("provider_date"))
