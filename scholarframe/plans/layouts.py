"""Shards, ledgers, exports and captures over the test tables: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarframe.operators import relational as rel
from scholarframe.plans.registry import PAPERS, query
from scholarframe.session import shared_dir
from scholarframe.sources import dataset as ds
from scholarframe.sources import capture, providers, sinks
from scholarframe.sources.tables import Tables


def folder_for(t: Tables, name: str) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey IN (3, 7)")
def sharded_relationships(t: Tables) -> DataFrame:
    """Relationships of two institutions from files sorted by researcher: what the files know of their keys tells which parts to skip."""
    folder = folder_for(t, "relationships")
    sinks.write_keyed(t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), folder, ["l_partkey", "l_orderkey", "l_linenumber"], ["l_suppkey", "l_orderkey"])
    return sinks.read_keyed(t.spark, folder, "l_suppkey", [3, 7])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 50 OFFSET 5000""")
def distant_page(t: Tables) -> DataFrame:
    """Page 100 of 50 rows each, read from the one range it lies in."""
    folder = folder_for(t, "pages")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").withColumn("__down", -F.col("l_extendedprice"))
    sinks.write_pages(rows, folder, ["__down", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    page, total = sinks.read_page(t.spark, folder, 100, 50)
    return page.drop("__down").withColumn("total", F.lit(total).cast("long"))


@query("""WITH s AS (SELECT p_partkey, p_name, strlen(p_name) AS n_bytes, CAST(floor(coalesce(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) AS BIGINT) AS shard FROM part)
    SELECT shard, count(*) AS n_rows, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, sha256(string_agg(p_partkey || '|' || p_name, chr(10) ORDER BY p_partkey)) AS sha256 FROM s GROUP BY 1""")
def shard_descriptors(t: Tables) -> DataFrame:
    rows = sinks.sized_shards(t.part.select("p_partkey", "p_name"), ["p_partkey"], F.octet_length("p_name"), 2000)
    return sinks.shard_descriptors(rows, ["p_partkey"], ["p_partkey", "p_name"])


@query("SELECT l_orderkey AS paper_id, count(DISTINCT l_partkey) AS n_authors, string_agg(DISTINCT (l_partkey % 16)::VARCHAR, ',' ORDER BY (l_partkey % 16)::VARCHAR) AS shards FROM lineitem GROUP BY 1")
def paper_shard_index(t: Tables) -> DataFrame:
    """For each paper its shards, and how many authors it has in all of them."""
    own = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), "l_partkey", (F.col("l_partkey") % 16).cast("string").alias("shard"))
    found = own.groupBy("paper_id").agg(F.count_distinct("l_partkey").alias("n_authors"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return found.withColumn("shards", F.array_join("shards", ","))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def ledger_recovery(t: Tables) -> DataFrame:
    """Decision rows with dictionary numbers in place of repeated strings, and back."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    compact, flags = sinks.interned(rows, "l_returnflag")
    compact, states = sinks.interned(compact, "l_linestatus")
    back = sinks.recovered(sinks.recovered(compact, "l_returnflag", flags), "l_linestatus", states)
    return back.select(*rows.columns)


@query("SELECT doc_id, sha256(text) AS sha256, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def payload_recovery(t: Tables) -> DataFrame:
    """Payloads archived once by checksum, and every reference answered from the archive."""
    archive = sinks.deduplicated_payloads(t.documents, "text").select("sha256", "payload")
    references = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    return references.join(archive, "sha256", "left").select("doc_id", "sha256", F.length("payload").alias("n_chars"))


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_acctbal >= 0")
def validated_load(t: Tables) -> DataFrame:
    """A table exported as gzip-compressed JSON lines and loaded again, rows that fail a check apart."""
    folder = folder_for(t, "export")
    sinks.write_json(t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal")), folder)
    return sinks.read_validated(t.spark, folder, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", ("negative balance", F.col("s_acctbal") >= 0), ("no name", F.col("s_name") != ""))[0]


@query("SELECT s_suppkey, 'negative balance' AS problems FROM supplier WHERE s_acctbal < 0")
def rejected_load(t: Tables) -> DataFrame:
    folder = folder_for(t, "export")
    sinks.write_json(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), folder)
    bad = sinks.read_validated(t.spark, folder, "s_suppkey long, s_name string, s_acctbal double", ("negative balance", F.col("s_acctbal") >= 0))[1]
    return bad.select("s_suppkey", F.array_join("problems", "; ").alias("problems"))


@query("""SELECT l_orderkey AS paper_id, '{"paper_id":' || l_orderkey || ',"sources":[' || string_agg('{"slot":' || l_linenumber || ',"researcher":' || l_partkey || ',"institution":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']}' AS document FROM lineitem GROUP BY 1""")
def export_with_lineage(t: Tables) -> DataFrame:
    """Each paper as a JSON document with the rows that it comes from."""
    source = F.struct(F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("researcher"), F.col("l_suppkey").alias("institution"))
    papers = t.lineitem.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return sinks.export_json(papers, "paper_id")


SPEC = {
    "region": ds.Table("r_regionkey int, r_name string", ["r_regionkey"]),
    "nation": ds.Table("n_nationkey int, n_name string, n_regionkey int", ["n_nationkey"], {"n_regionkey": "region"}),
    "supplier": ds.Table("s_suppkey long, s_name string, s_nationkey int", ["s_suppkey"], {"s_nationkey": "nation"}),
    "observation": ds.Table("s_suppkey long, field_id string, year int, n long", ["s_suppkey", "field_id", "year"], {"s_suppkey": "supplier"}),
    "lineage": ds.Table("observation string, sources array<long>", ["observation"]),
}
_OBSERVATIONS = "o AS (SELECT l_suppkey AS s_suppkey, p_type AS field_id, year(l_shipdate) AS year, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"


def _dataset(t: Tables) -> dict[str, DataFrame]:
    """Institutions with their places, yearly observations of them by field, and the papers that each observation comes from."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), F.col("p_type").alias("field_id"), F.year("l_shipdate").alias("year"), "l_orderkey")
    by = ["s_suppkey", "field_id", "year"]
    return {
        "region": t.region.select("r_regionkey", "r_name"),
        "nation": t.nation.select("n_nationkey", "n_name", "n_regionkey"),
        "supplier": t.supplier.select("s_suppkey", "s_name", "s_nationkey"),
        "observation": lines.groupBy(*by).agg(F.count("*").alias("n")),
        "lineage": lines.groupBy(F.concat_ws("/", *by).alias("observation")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("sources")),
    }


@query(f"""WITH {_OBSERVATIONS} SELECT 'region' AS table_name, count(*) AS n_rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'observation', count(*) FROM o UNION ALL SELECT 'lineage', count(*) FROM o""")
def dataset_seed(t: Tables) -> DataFrame:
    """A dataset exported with its observations and lineage, certified, loaded as a whole and read again."""
    store, target = folder_for(t, "export"), folder_for(t, "seeded")
    ds.export_dataset(_dataset(t), SPEC, store, "v1", limit=256 << 10)
    refused = ds.seed_dataset(t.spark, store, "v1", SPEC, target)
    if not refused.isEmpty():
        return refused
    return rel.counts_of(ds.seeded(t.spark, target, SPEC))


@query(f"""WITH {_OBSERVATIONS}, gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) SELECT 'shards' AS gate, true AS passed, 0::BIGINT AS n UNION ALL SELECT 'rows', true, 0 UNION ALL SELECT 'keys', true, 0
    UNION ALL SELECT 'references', count(*) = 0, count(*) FROM o WHERE s_suppkey IN (SELECT * FROM gone) UNION ALL SELECT 'population', count(*) = 0, count(*) FROM gone""")
def export_certification(t: Tables) -> DataFrame:
    """The gates of an export that lost some institutions: what refers to them, and what its source holds besides."""
    store, whole = folder_for(t, "export"), _dataset(t)
    kept = whole | {"supplier": t.supplier.where("s_acctbal >= 2000").select("s_suppkey", "s_name", "s_nationkey")}
    ds.export_dataset(kept, SPEC, store, "v2", limit=256 << 10)
    return ds.certified_export(t.spark, store, "v2", SPEC, whole)


# --- captures --------------------------------------------------------------------


@query("""WITH n AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS partition, (row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) - 1) // 100 AS page FROM orders),
    p AS (SELECT partition, page, count(*) AS n FROM n GROUP BY 1, 2), e AS (SELECT partition, max(page) AS last, sum(n) AS expected FROM p GROUP BY 1), f AS (SELECT partition, min(page) AS first_lost FROM p WHERE (page * 7 + partition::INTEGER) % 23 = 0 GROUP BY 1)
    SELECT partition, CAST(coalesce(first_lost, last + 1) AS INTEGER) AS next_page, CASE WHEN first_lost > 0 THEN 'after ' || (first_lost - 1) END AS next_cursor, CAST(coalesce((SELECT sum(n) FROM p WHERE p.partition = e.partition AND page < first_lost), CASE WHEN first_lost IS NULL THEN expected ELSE 0 END) AS BIGINT) AS n_records,
    CASE WHEN first_lost IS NULL THEN 'complete' WHEN first_lost = 0 THEN 'not begun' ELSE 'open' END AS state FROM e LEFT JOIN f USING (partition)""")
def capture_pages(t: Tables) -> DataFrame:
    """Yearly captures in pages of 100 records, some of whose files were lost: where each goes on."""
    store, year = folder_for(t, "pages"), F.year("o_orderdate").cast("string")
    placed = t.orders.select(year.alias("partition"), "o_orderkey").withColumn("at", F.row_number().over(Window.partitionBy("partition").orderBy("o_orderkey")) - 1)
    pages = placed.groupBy("partition", F.floor(F.col("at") / 100).cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("payload"), F.count("*").alias("n_records"))
    whole = Window.partitionBy("partition")
    cursor = F.when(F.col("page") > 0, F.concat(F.lit("after "), F.col("page") - 1))
    following = F.when(F.col("page") < F.max("page").over(whole), F.concat(F.lit("after "), "page"))
    pages = pages.withColumns({"cursor": cursor, "next_cursor": following, "expected": F.sum("n_records").over(whole)})
    lost = (F.col("page") * 7 + F.col("partition").cast("int")) % 23 == 0
    capture.kept_pages(pages.where(~lost), store)
    receipts = pages.withColumn("sha256", F.sha2(F.col("payload").cast("binary"), 256)).drop("payload")
    return capture.resume_points(pages.select("partition"), capture.verified_receipts(receipts, store))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31' AND o_totalprice >= 100000")
def acquisition_scope(t: Tables) -> DataFrame:
    first, last = (F.lit(x).cast("timestamp") for x in ("1997-01-01", "1999-12-31"))
    return providers.in_scope(t.orders, o_orderstatus=["F", "O"], o_orderdate=(first, last), o_totalprice=(100000, None), o_orderpriority=None).select("o_orderkey")


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N')
    SELECT l_partkey, CASE WHEN b.l_partkey IS NULL THEN 'first only' WHEN a.l_partkey IS NULL THEN 'second only' ELSE 'both' END AS captured FROM a FULL OUTER JOIN b USING (l_partkey)""")
def paired_capture(t: Tables) -> DataFrame:
    return providers.paired(t.lineitem.where("l_returnflag = 'A'"), t.lineitem.where("l_returnflag = 'N'"), ["l_partkey"])


@query(f"""WITH {PAPERS} SELECT year, count(DISTINCT paper_id) AS n_papers, count(DISTINCT l_suppkey) AS n_institutions, count(DISTINCT l_suppkey) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) AS n_unknown
    FROM papers JOIN lineitem ON l_orderkey = paper_id WHERE year BETWEEN 1996 AND 2000 GROUP BY 1""")
def pilot_ingestion(t: Tables) -> DataFrame:
    """A few years of papers, the institutions they refer to, and those still to be looked up."""
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("known"))
    rows = providers.in_scope(t.papers, year=(1996, 2000)).join(t.lineitem, F.col("paper_id") == F.col("l_orderkey")).join(known, F.col("l_suppkey") == F.col("known"), "left")
    return rows.groupBy("year").agg(F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("l_suppkey").alias("n_institutions"), F.count_distinct(F.when(F.col("known").isNull(), F.col("l_suppkey"))).alias("n_unknown"))


# --- lists as served ----------------------------------------------------------------


@query("""SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size >= 10 THEN 0 ELSE 1 END, p_size % 2 = 0 DESC, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#13' THEN 2 ELSE 6 END, p_retailprice > 1000 DESC, p_name, p_partkey) AS place
    FROM part QUALIFY place <= 200""")
def resource_order(t: Tables) -> DataFrame:
    """The first 200 resources: active, verified, in good health, primary, by label."""
    health = F.when(F.col("p_brand") == "Brand#11", 0).when(F.col("p_brand") == "Brand#12", 1).when(F.col("p_brand") == "Brand#13", 2).otherwise(6)
    order = [F.when(F.col("p_size") >= 10, 0).otherwise(1), F.desc(F.col("p_size") % 2 == 0), health, F.desc(F.col("p_retailprice") > 1000), F.col("p_name"), F.col("p_partkey")]
    first = t.part.orderBy(*order).limit(200)
    # 200 rows are numbered
    return first.agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("p_size") >= 10, 0).otherwise(1), F.when(F.col("p_size") % 2 == 0, 0).otherwise(1), health, F.when(F.col("p_retailprice") > 1000, 0).otherwise(1), "p_name", "p_partkey"))).alias("rows")).select(
        F.posexplode("rows").alias("place", "row")
    ).select("row.p_partkey", (F.col("place") + 1).cast("long").alias("place"))


@query("""WITH r AS (SELECT n_regionkey AS group_id, s_suppkey, s_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_name, s_suppkey) AS rk FROM supplier JOIN nation ON n_nationkey = s_nationkey), p AS (SELECT n_regionkey AS group_id, count(DISTINCT l_orderkey) AS n_papers, count(DISTINCT l_partkey) AS n_people FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
    SELECT r_name AS name, n_papers, n_people, string_agg(s_name, ',' ORDER BY rk) AS members FROM r JOIN p USING (group_id) JOIN region ON r_regionkey = group_id WHERE rk <= 100 GROUP BY 1, 2, 3""")
def group_profile(t: Tables) -> DataFrame:
    """Each group with its papers, people, and its first 100 members by name."""
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_regionkey").alias("group_id"))
    members = rel.top_per_group(places, ["group_id"], [F.col("s_name"), F.col("s_suppkey")], 100).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("rank", "s_name"))).alias("top"))
    counts = t.lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("group_id").agg(F.count_distinct("l_orderkey").alias("n_papers"), F.count_distinct("l_partkey").alias("n_people"))
    named = members.join(counts, "group_id").join(t.region, F.col("group_id") == F.col("r_regionkey"))
    return named.select(F.col("r_name").alias("name"), "n_papers", "n_people", F.array_join(F.transform("top", lambda x: x["s_name"]), ",").alias("members"))


@query(f"""WITH {PAPERS}, f AS (SELECT DISTINCT p_type AS field_id, l_orderkey AS paper_id FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT field_id, paper_id, row_number() OVER (PARTITION BY field_id ORDER BY publication_date DESC, paper_id) AS newest, row_number() OVER (PARTITION BY field_id ORDER BY publication_date, paper_id) AS oldest FROM f JOIN papers USING (paper_id))
    SELECT field_id, string_agg(paper_id::VARCHAR, ',' ORDER BY newest) FILTER (newest <= 5) AS newest, string_agg(paper_id::VARCHAR, ',' ORDER BY oldest) FILTER (oldest <= 5) AS oldest FROM k GROUP BY 1""")
def field_timeline(t: Tables) -> DataFrame:
    """The five newest and the five oldest papers of each field."""
    rows = t.categories.select("field_id", "paper_id").distinct().join(t.papers, "paper_id")
    top = rel.top_per_group(rows, ["field_id"], [F.desc("publication_date"), F.col("paper_id")], 5).select("field_id", "paper_id", "rank", F.lit("newest").alias("side"))
    low = rel.top_per_group(rows, ["field_id"], [F.col("publication_date"), F.col("paper_id")], 5).select("field_id", "paper_id", "rank", F.lit("oldest").alias("side"))
    both = top.unionByName(low).groupBy("field_id", "side").agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id"))).alias("own"))
    listed = both.withColumn("own", F.array_join(F.transform("own", lambda x: x["paper_id"].cast("string")), ","))
    return listed.groupBy("field_id").agg(*(F.max(F.when(F.col("side") == s, F.col("own"))).alias(s) for s in ("newest", "oldest")))


@query("""SELECT 'countries' AS catalog, count(*) AS total FROM nation UNION ALL SELECT 'views', count(*) FROM region UNION ALL SELECT 'institutions', count(*) FROM supplier UNION ALL SELECT 'researchers', count(*) FROM part UNION ALL SELECT 'papers', count(*) FROM orders UNION ALL SELECT 'affiliations', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def catalog_totals(t: Tables) -> DataFrame:
    return rel.counts_of({"countries": t.nation, "views": t.region, "institutions": t.supplier, "researchers": t.part, "papers": t.orders, "affiliations": t.lineitem, "events": t.events}).select(F.col("table_name").alias("catalog"), F.col("n_rows").alias("total"))


@query("""SELECT s_suppkey AS id, s_name AS name, n_name AS country FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey ORDER BY s_name, s_suppkey LIMIT 100""")
def institution_catalog_page(t: Tables) -> DataFrame:
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))
    return rel.page(named, [F.col("name"), F.col("id")], 0, 100)


@query("""SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 50""")
def event_catalog_page(t: Tables) -> DataFrame:
    return rel.page(t.events.where("event_type = 'purchase'"), [F.col("ts"), F.col("event_id")], 0, 50).select("event_id", "user_id", "event_type", "ts")


@query(f"""WITH {PAPERS}, y AS (SELECT DISTINCT year FROM papers), asked AS (SELECT * FROM (VALUES (1990, 'ASIA'), (1997, 'EUROPE'), (2005, 'ATLANTIS')) AS v(year, view_name))
    SELECT asked.year AS asked_year, arg_min(y.year, (abs(y.year - asked.year), -y.year)) AS year, view_name AS asked_view, CASE WHEN view_name IN (SELECT r_name FROM region) THEN view_name END AS view_name FROM asked, y GROUP BY asked.year, view_name""")
def navigation_repair(t: Tables) -> DataFrame:
    """A place asked for, moved to the closest year and to no view where the data set has none."""
    asked = t.spark.createDataFrame([(1990, "ASIA"), (1997, "EUROPE"), (2005, "ATLANTIS")], "asked_year int, asked_view string")
    years = t.papers.select("year").distinct().agg(F.collect_list("year").alias("years"))  # one row
    views = t.region.agg(F.collect_list("r_name").alias("views"))  # one row
    closest = F.array_sort(F.transform("years", lambda y: F.struct(F.abs(y - F.col("asked_year")).alias("away"), (-y).alias("less"))))[0]
    joined = asked.join(F.broadcast(years)).join(F.broadcast(views))
    return joined.select("asked_year", (-closest["less"]).alias("year"), "asked_view", F.when(F.array_contains("views", F.col("asked_view")), F.col("asked_view")).alias("view_name"))
