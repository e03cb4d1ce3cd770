"""Graph, profiles, maps and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.operators import graph as gr
from scholarframe.operators import relational as rel
from scholarframe.plans.registry import AFFILIATIONS, PAPERS, query
from scholarframe.sources.tables import Tables

_NODES = """nodes AS (SELECT 'region' AS node_type, 'region:' || r_regionkey AS node_id, r_name AS label FROM region UNION ALL SELECT 'nation', 'nation:' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', 'part:' || p_partkey, p_name FROM part)"""
_EDGES = """edges AS (SELECT 'in_region' AS edge_type, 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id FROM nation UNION ALL SELECT 'in_nation', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
    UNION ALL SELECT DISTINCT 'supplies', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem)"""


def nodes(t: Tables) -> DataFrame:
    return gr.nodes(("region", t.region, "r_regionkey", "r_name"), ("nation", t.nation, "n_nationkey", "n_name"), ("supplier", t.supplier, "s_suppkey", "s_name"), ("part", t.part, "p_partkey", "p_name"))


def edges(t: Tables) -> DataFrame:
    return gr.edges(
        ("in_region", t.nation, ("nation", "n_nationkey"), ("region", "n_regionkey")),
        ("in_nation", t.supplier, ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
        ("supplies", t.lineitem, ("supplier", "l_suppkey"), ("part", "l_partkey")),
    )


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(t: Tables) -> DataFrame:
    return nodes(t)


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(t: Tables) -> DataFrame:
    return edges(t)


@query(f"WITH {_NODES}, {_EDGES} SELECT edge_type, count(*) AS n_edges, count(*) FILTER (source_id NOT IN (SELECT node_id FROM nodes) OR target_id NOT IN (SELECT node_id FROM nodes)) AS n_dangling FROM edges GROUP BY 1")
def graph_integrity(t: Tables) -> DataFrame:
    e = edges(t)
    lost = gr.dangling_edges(e, nodes(t)).groupBy("edge_type").agg(F.count_distinct("source_id", "target_id").alias("n"))
    return e.groupBy("edge_type").agg(F.count("*").alias("n_edges")).join(lost, "edge_type", "left").select("edge_type", "n_edges", F.coalesce("n", F.lit(0)).alias("n_dangling"))


@query(f"""WITH {_NODES}, {_EDGES}, kept AS ((SELECT node_id FROM nodes WHERE node_type = 'supplier' ORDER BY node_id LIMIT 50) UNION ALL (SELECT node_id FROM nodes WHERE node_type = 'part' ORDER BY node_id LIMIT 50))
    SELECT * FROM edges WHERE source_id IN (SELECT node_id FROM kept) AND target_id IN (SELECT node_id FROM kept) ORDER BY edge_type, source_id, target_id LIMIT 200""")
def graph_bounded(t: Tables) -> DataFrame:
    suppliers, parts = gr.split_budget(100, 1 << 30, 1 << 30)
    return gr.bounded(nodes(t), edges(t), {"supplier": suppliers, "part": parts}, 200)[1]


@query(f"""WITH {AFFILIATIONS}, {PAPERS}, own AS (SELECT DISTINCT institution_id, paper_id, researcher_id FROM aff WHERE institution_id IS NOT NULL)
    SELECT institution_id, s_name AS name, n_name AS country, count(DISTINCT paper_id) AS n_papers, count(DISTINCT researcher_id) AS n_researchers, min(publication_date) AS first_paper, max(publication_date) AS last_paper
    FROM own JOIN papers USING (paper_id) JOIN supplier ON s_suppkey = institution_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3""")
def institution_profile(t: Tables) -> DataFrame:
    own = t.affiliations.where("institution_id is not null").join(t.papers, "paper_id").groupBy("institution_id").agg(
        F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("researcher_id").alias("n_researchers"), F.min("publication_date").alias("first_paper"), F.max("publication_date").alias("last_paper")
    )
    named = own.join(t.supplier, F.col("institution_id") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("institution_id", F.col("s_name").alias("name"), F.col("n_name").alias("country"), "n_papers", "n_researchers", "first_paper", "last_paper")


@query(f"""WITH {AFFILIATIONS}, {PAPERS}, r AS (SELECT DISTINCT researcher_id, paper_id, publication_date FROM aff JOIN papers USING (paper_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY researcher_id ORDER BY publication_date DESC, paper_id) AS rk FROM r), n AS (SELECT researcher_id, count(DISTINCT institution_id) AS n_institutions FROM aff GROUP BY 1)
    SELECT researcher_id, n_institutions, string_agg(paper_id::VARCHAR, ',' ORDER BY rk) AS newest FROM k JOIN n USING (researcher_id) WHERE rk <= 5 GROUP BY 1, 2""")
def researcher_profile(t: Tables) -> DataFrame:
    papers = t.affiliations.select("researcher_id", "paper_id").distinct().join(t.papers.select("paper_id", "publication_date"), "paper_id")
    top = rel.top_per_group(papers, ["researcher_id"], [F.desc("publication_date"), F.col("paper_id")], 5)
    newest = top.groupBy("researcher_id").agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))).alias("top"))
    places = t.affiliations.groupBy("researcher_id").agg(F.count_distinct("institution_id").alias("n_institutions"))
    return newest.join(places, "researcher_id").select("researcher_id", "n_institutions", F.array_join(F.transform("top", lambda x: x["paper_id"].cast("string")), ",").alias("newest"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1)
    SELECT p_partkey AS entity_id, l_orderkey AS raw_id, l_suppkey AS source_id, s_name AS source, CAST(o_orderdate AS DATE) AS captured FROM part LEFT JOIN r ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey""")
def provenance_trace(t: Tables) -> DataFrame:
    newest = rel.latest(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    traced = t.part.join(newest, F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return traced.select(F.col("p_partkey").alias("entity_id"), F.col("l_orderkey").alias("raw_id"), F.col("l_suppkey").alias("source_id"), F.col("s_name").alias("source"), F.to_date("o_orderdate").alias("captured"))


@query(f"""WITH {AFFILIATIONS}, m AS (SELECT country_id, count(DISTINCT paper_id) AS value FROM aff WHERE country_id IS NOT NULL GROUP BY 1)
    SELECT n_name AS country, r_name AS view_name, value FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN m ON country_id = n_nationkey""")
def country_map(t: Tables) -> DataFrame:
    value = t.affiliations.where("country_id is not null").groupBy("country_id").agg(F.count_distinct("paper_id").alias("value"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(value, F.col("n_nationkey") == F.col("country_id"), "left")
    return named.select(F.col("n_name").alias("country"), F.col("r_name").alias("view_name"), "value")


@query("""SELECT s_suppkey, '{"type":"Feature","id":' || s_suppkey || ',"geometry":{"type":"Point","coordinates":[' || (s_suppkey % 360 - 180) || ',' || (s_suppkey % 180 - 90) || ']},"properties":{"name":"' || s_name || '"}}' AS feature FROM supplier""")
def geojson_features(t: Tables) -> DataFrame:
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("s_suppkey") % 360 - 180, F.col("s_suppkey") % 180 - 90).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("s_suppkey").alias("id"), point.alias("geometry"), F.struct(F.col("s_name").alias("name")).alias("properties"))
    return t.supplier.select("s_suppkey", F.to_json(feature).alias("feature"))


@query("""SELECT r_name AS domain, string_agg(n_name, ',' ORDER BY n_name) AS fields, count(*) AS n_fields FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def domain_listing(t: Tables) -> DataFrame:
    joined = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy(F.col("r_name").alias("domain")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("fields"), F.count("*").alias("n_fields"))


@query("""SELECT o_orderkey AS paper_id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS field_ids FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def paper_catalog_page(t: Tables) -> DataFrame:
    first = rel.page(rel.matching(t.orders, o_orderstatus="P"), [F.desc("o_orderdate"), F.col("o_orderkey")], 0, 100).select(F.col("o_orderkey").alias("paper_id"))
    return t.categories.join(F.broadcast(first), "paper_id").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("field_id")), ",").alias("field_ids"))


@query(f"""WITH {AFFILIATIONS}, mine AS (SELECT DISTINCT paper_id FROM aff WHERE institution_id = 3) SELECT m.paper_id, count(DISTINCT slot) AS n_authors, count(DISTINCT slot) = max(slot) AS complete FROM mine m JOIN aff USING (paper_id) GROUP BY 1""")
def scoped_entity_context(t: Tables) -> DataFrame:
    return entity_context(t, 3)


def entity_context(t: Tables, institution: int) -> DataFrame:
    """The papers of one institution, with all their author slots."""
    mine = t.affiliations.where(F.col("institution_id") == institution).select("paper_id").distinct()
    return t.affiliations.join(mine, "paper_id", "left_semi").groupBy("paper_id").agg(F.count_distinct("slot").alias("n_authors"), (F.count_distinct("slot") == F.max("slot")).alias("complete"))


@query("""SELECT p_type AS field_id, count(DISTINCT l_orderkey) AS n_papers, count(DISTINCT l_partkey) AS n_people, max(CAST(o_orderdate AS DATE)) AS newest FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def field_overview(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.papers, F.col("l_orderkey") == F.col("paper_id"))
    return rows.groupBy(F.col("p_type").alias("field_id")).agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("l_partkey").alias("n_people"), F.max("publication_date").alias("newest"))
