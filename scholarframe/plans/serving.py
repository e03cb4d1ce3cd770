"""Filters, joins, top-k, set operations and current observations, as the served store answers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.operators import populations as pop
from scholarframe.operators import relational as rel
from scholarframe.plans.registry import AFFILIATIONS, PAPERS, query
from scholarframe.session import dealt
from scholarframe.sources.tables import Tables

# --- observations ------------------------------------------------------------

_OBS = "o AS (SELECT event_id AS id, user_id AS entity_id, event_type AS metric_id, CAST(ts AS DATE) AS period, ts AS calculated_at, value, json_extract_string(props, '$.k') AS algorithm FROM events)"


def observations(t: Tables) -> DataFrame:
    """Events as re-run metric observations."""
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("metric_id"), F.to_date("ts").alias("period"),
        F.col("ts").alias("calculated_at"), "value", F.get_json_object("props", "$.k").alias("algorithm"),
    )


@query(f"WITH {_OBS} SELECT entity_id, metric_id, period, id, round(value, 6) AS value FROM o QUALIFY row_number() OVER (PARTITION BY entity_id, metric_id, period ORDER BY calculated_at DESC, id DESC) = 1")
def current_observation(t: Tables) -> DataFrame:
    found = rel.latest(observations(t), ["entity_id", "metric_id", "period"], ["calculated_at", "id"])
    return found.select("entity_id", "metric_id", "period", "id", F.round("value", 6).alias("value"))


@query(f"""WITH {_OBS} SELECT entity_id, metric_id, period, id, algorithm FROM o
    QUALIFY row_number() OVER (PARTITION BY entity_id, metric_id, period ORDER BY calculated_at DESC, id DESC) = 1 AND coalesce(min(algorithm) OVER (PARTITION BY entity_id, metric_id, period) = max(algorithm) OVER (PARTITION BY entity_id, metric_id, period), true)""")
def algorithm_conflict_failclosed(t: Tables) -> DataFrame:
    found = rel.current_observations(observations(t), ["entity_id", "metric_id", "period"], ["calculated_at", "id"], "algorithm")
    return found.select("entity_id", "metric_id", "period", "id", "algorithm")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def optional_filter_page(t: Tables) -> DataFrame:
    rows = rel.matching(t.orders, o_orderstatus="O", o_orderpriority=None)
    return rel.page(rows, [F.col("o_orderdate"), F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def page_total(t: Tables) -> DataFrame:
    return rel.matching(t.orders, o_orderstatus="O").agg(F.count("*").alias("total"))


@query(f"""WITH {AFFILIATIONS}, m AS (SELECT institution_id, count(DISTINCT paper_id) AS value FROM aff WHERE institution_id IS NOT NULL GROUP BY 1)
    SELECT institution_id, s_name AS name, value FROM m JOIN supplier ON s_suppkey = institution_id WHERE value >= 1 ORDER BY value DESC, name LIMIT 12""")
def map_nodes_topk(t: Tables) -> DataFrame:
    value = t.affiliations.where("institution_id is not null").groupBy("institution_id").agg(F.count_distinct("paper_id").alias("value"))
    named = value.where("value >= 1").join(t.supplier.select("s_suppkey", F.col("s_name").alias("name")), F.col("institution_id") == F.col("s_suppkey"))
    return named.orderBy(F.desc("value"), "name").limit(12).select("institution_id", "name", "value")


@query("SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_per_country(t: Tables) -> DataFrame:
    return rel.top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("SELECT year FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) ORDER BY abs(year - 2003), year DESC LIMIT 1")
def closest_year(t: Tables) -> DataFrame:
    return t.papers.select("year").distinct().orderBy(F.abs(F.col("year") - 2003), F.desc("year")).limit(1)


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY 1")
def available_years(t: Tables) -> DataFrame:
    return t.papers.select("year").distinct().orderBy("year")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1998 AND 2000")
def range_year_filter(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "2001-01-01")).select("o_orderkey", F.year("o_orderdate").alias("year"))


@query("""SELECT p_partkey, p_name, p_size FROM part WHERE p_size IS NULL OR p_size < 10 ORDER BY p_size ASC NULLS FIRST, p_partkey LIMIT 40""")
def stale_resources(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").isNull() | (F.col("p_size") < 10)).orderBy(F.asc_nulls_first("p_size"), "p_partkey").limit(40).select("p_partkey", "p_name", "p_size")


@query("""SELECT event_type, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS priority, count(*) AS n FROM events GROUP BY 1, 2""")
def case_priority(t: Tables) -> DataFrame:
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t.events.groupBy("event_type", priority.alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part WHERE lower(p_name) LIKE 'a%' OR p_brand = 'Brand#12'")
def prefix_or_equal(t: Tables) -> DataFrame:
    return t.part.where(F.lower("p_name").startswith("a") | (F.col("p_brand") == "Brand#12")).select("p_partkey", F.lower("p_name").alias("name"))


# --- joins ---------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS researcher_id FROM lineitem)"


@query(f"WITH {_PAIRS} SELECT a.researcher_id, count(DISTINCT b.researcher_id) AS n_collaborators, count(DISTINCT a.paper_id) AS n_joint FROM pairs a JOIN pairs b ON a.paper_id = b.paper_id AND a.researcher_id <> b.researcher_id GROUP BY 1")
def collaborators_selfjoin(t: Tables) -> DataFrame:
    rows = dealt(t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("researcher_id")), t.rows("lineitem"), "paper_id")
    joint = rows.groupBy("paper_id").agg(F.collect_set("researcher_id").alias("all")).where(F.size("all") > 1)  # the set of one paper is small
    each = joint.select("all", F.explode("all").alias("researcher_id"))
    pairs = each.select("researcher_id", F.posexplode(F.array_remove("all", F.col("researcher_id"))).alias("place", "other"))
    # a paper is counted at the first of the others
    return pairs.groupBy("researcher_id").agg(F.count_distinct("other").alias("n_collaborators"), F.count_if(F.col("place") == 0).alias("n_joint"))


_SPANS = "spans AS (SELECT l_partkey AS researcher_id, l_suppkey AS institution_id, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _dated_lines(t: Tables) -> DataFrame:
    """``paper_id, researcher_id, institution_id, year`` of every line with a paper, dealt by researcher."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("researcher_id"), F.col("l_suppkey").alias("institution_id"))
    n = t.rows("lineitem")
    return dealt(dealt(lines, n, "paper_id").join(t.papers.select("paper_id", "year"), "paper_id"), n, "researcher_id")


def affiliation_spans(t: Tables) -> DataFrame:
    """First and last year of each researcher at each institution."""
    return _dated_lines(t).groupBy("researcher_id", "institution_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query(f"WITH {_SPANS} SELECT researcher_id, institution_id, first_year, last_year, s_name AS name, n_name AS country FROM spans JOIN supplier ON s_suppkey = institution_id LEFT JOIN nation ON n_nationkey = s_nationkey")
def affiliation_history(t: Tables) -> DataFrame:
    named = affiliation_spans(t).join(t.supplier, F.col("institution_id") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return named.select("researcher_id", "institution_id", "first_year", "last_year", F.col("s_name").alias("name"), F.col("n_name").alias("country"))


@query(f"""WITH {_SPANS}, {PAPERS}, own AS (SELECT DISTINCT l_orderkey AS paper_id, l_partkey AS researcher_id FROM lineitem)
    SELECT institution_id, count(DISTINCT paper_id) AS n_papers FROM own JOIN papers USING (paper_id) JOIN spans USING (researcher_id) WHERE year BETWEEN first_year AND last_year GROUP BY 1""")
def affiliation_range_join(t: Tables) -> DataFrame:
    own = _dated_lines(t).select("paper_id", "researcher_id", "year")  # a paper that comes again is not counted again below
    joined = own.join(affiliation_spans(t), "researcher_id").where(rel.covers_year(F.col("first_year"), F.col("last_year"), F.col("year")))
    return joined.groupBy("institution_id").agg(F.count_distinct("paper_id").alias("n_papers"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 7)")
def semi_papers_by_institution(t: Tables) -> DataFrame:
    wanted = t.lineitem.join(t.supplier.where("s_nationkey = 7"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey")
    return t.orders.join(wanted, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_orphans(t: Tables) -> DataFrame:
    return rel.missing_keys(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey")


@query("SELECT l_suppkey AS source, l_partkey AS record, l_orderkey AS captured, l_quantity AS quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1")
def asof_latest_projection(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("record"), F.col("l_orderkey").alias("captured"), "l_linenumber", "l_extendedprice", F.col("l_quantity").alias("quantity"))
    return rel.latest(rows, ["source", "record"], ["captured", "l_linenumber", "l_extendedprice", "quantity"]).select("source", "record", "captured", "quantity")


@query("""SELECT r_name AS view_name, count(DISTINCT s_suppkey) AS n_institutions, count(DISTINCT n_nationkey) AS n_countries FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def geographic_view_rollup(t: Tables) -> DataFrame:
    views = t.nation.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("countries")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    members = views.select(F.col("r_name").alias("view_name"), F.explode("countries").alias("country_id"))
    return members.join(t.supplier, F.col("country_id") == F.col("s_nationkey"), "left").groupBy("view_name").agg(F.count_distinct("s_suppkey").alias("n_institutions"), F.count_distinct("country_id").alias("n_countries"))


@query("""SELECT e.event_id, e.user_id, c.c_name, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey AND e.value > 50 LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def three_way_outer(t: Tables) -> DataFrame:
    joined = t.events.where("value > 50").join(t.customer, F.col("user_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("event_id", "user_id", "c_name", "c_mktsegment")


@query("""SELECT coalesce(p.doc_id, l.doc_id) AS doc_id, p.doc_id IS NOT NULL AS has_document, l.doc_id IS NOT NULL AS has_label FROM (SELECT doc_id FROM documents) p FULL OUTER JOIN (SELECT doc_id FROM labels) l USING (doc_id)""")
def full_outer_keys(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.lit(True).alias("d"))
    labels = t.labels.select("doc_id", F.lit(True).alias("l"))
    return docs.join(labels, "doc_id", "full").select("doc_id", F.col("d").isNotNull().alias("has_document"), F.col("l").isNotNull().alias("has_label"))


@query("""SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last_purchase, count(*) FILTER (event_type IN ('click', 'view')) AS n_seen, bool_or(value > 95) AS any_high FROM events GROUP BY 1""")
def update_status(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.max(F.when(kind == "purchase", F.col("ts"))).alias("last_purchase"), F.count_if(kind.isin("click", "view")).alias("n_seen"), F.bool_or(F.col("value") > 95).alias("any_high"))


# --- sets and merges --------------------------------------------------------------


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1")
def first_wins_dedup(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return rel.first_wins(t.lineitem, ["l_partkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


_MERGE_OLD = "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0"
_MERGE_NEW = "SELECT c_custkey AS id, -c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0"


@query(f"WITH old AS ({_MERGE_OLD}), new AS ({_MERGE_NEW}) SELECT coalesce(new.id, old.id) AS id, coalesce(new.v, old.v) AS v FROM old FULL OUTER JOIN new ON old.id = new.id")
def incoming_wins_merge(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return rel.upsert(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").withColumn("v", -F.col("v")), ["id"])


@query("SELECT c, y FROM (SELECT DISTINCT p_brand AS c FROM part), (SELECT unnest(generate_series(1995, 2001)) AS y) EXCEPT SELECT DISTINCT p_brand, year(o_orderdate) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 48 AND p_size > 45")
def except_done(t: Tables) -> DataFrame:
    tasks = t.part.select(F.col("p_brand").alias("c")).distinct().select("c", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("y"))
    done = t.lineitem.where("l_quantity > 48").join(t.part.where("p_size > 45"), F.col("l_partkey") == F.col("p_partkey")).join(t.papers, F.col("l_orderkey") == F.col("paper_id"))
    return tasks.join(done.select(F.col("p_brand").alias("c"), F.col("year").cast("long").alias("y")).distinct(), ["c", "y"], "left_anti")


@query("SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersection(t: Tables) -> DataFrame:
    return t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")).intersect(t.customer.where("c_acctbal > 9000").select("c_nationkey"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region")
def set_union(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).union(t.region.select("r_regionkey", "r_name")).distinct()


@query("SELECT 'lineitem' AS table_name, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def storage_counts(t: Tables) -> DataFrame:
    return rel.counts_of({"lineitem": t.lineitem, "orders": t.orders, "part": t.part})


@query("SELECT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_equality(t: Tables) -> DataFrame:
    return pop.row_differences(t.documents, t.labels, ["doc_id"]).drop("surplus")


@query("SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events")
def previous_snapshot(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous_id"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS fields, count(DISTINCT p_type) AS n, max_by(p_name, (length(p_name), -p_partkey)) AS longest FROM part GROUP BY 1")
def set_accumulators(t: Tables) -> DataFrame:
    longest = F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("longest")
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("fields"), F.count_distinct("p_type").alias("n"), longest)


@query("""SELECT year, min(n) AS smallest, max(n) AS largest FROM (SELECT p_type, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def cohort_minimum(t: Tables) -> DataFrame:
    sizes = t.categories.join(t.papers, "paper_id").groupBy("field_id", "year").agg(F.count_distinct("paper_id").alias("n"))
    return sizes.groupBy("year").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (value > 50) AS n_high, round(avg(value), 6) AS mean_value, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1""")
def evidence_summary(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") > 50).alias("n_high"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_distinct(F.to_date("ts")).alias("n_days")
    )


@query("SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted_words FROM part WHERE list_contains(string_split(p_name, ' '), 'a') OR p_size = 7")
def array_containment(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.where(F.array_contains(words, "a") | (F.col("p_size") == 7)).select("p_partkey", F.array_join(F.array_sort(words), " ").alias("sorted_words"))
