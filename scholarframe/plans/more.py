"""Further resolution, measurement and display queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.functions import geo
from scholarframe.operators import affiliations as aff
from scholarframe.operators import attribution as att
from scholarframe.operators import identity as idn
from scholarframe.operators import populations as pop
from scholarframe.operators import relational as rel
from scholarframe.operators import scales
from scholarframe.operators.components import connected_components
from scholarframe.plans.engine import MetricEngine
from scholarframe.plans.registry import AFFILIATIONS, PAPERS, SHARES, query
from scholarframe.sources.tables import Tables


@query("""WITH e AS (SELECT DISTINCT s_suppkey AS m, p_type AS f FROM supplier, part), g AS (SELECT DISTINCT l_suppkey AS m, p_type AS f FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND l_tax > 0.05)
    SELECT m, f, 'left' AS only_in FROM (SELECT * FROM e EXCEPT SELECT * FROM g) UNION ALL SELECT m, f, 'right' FROM (SELECT * FROM g EXCEPT SELECT * FROM e)""")
def field_population_gate(t: Tables) -> DataFrame:
    """Every expected (institution, field) peer present, by digests; only incomplete institutions are looked at pair by pair."""
    seen = t.lineitem.where("l_quantity > 45 and l_tax > 0.05").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("m"), F.col("p_type").alias("f"))
    return pop.incomplete_members(t.supplier.select(F.col("s_suppkey").alias("m")), "m", t.part.select(F.col("p_type").alias("f")), "f", seen)


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 400000 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 2000),
    k AS (SELECT o_orderkey, o_orderstatus, sum(x) AS x FROM (SELECT o_orderkey, o_orderstatus, 1 AS x FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, -1 FROM b) GROUP BY 1, 2)
    SELECT o_orderkey, o_orderstatus, CASE WHEN x > 0 THEN 'left' ELSE 'right' END AS only_in, CAST(abs(x) AS BIGINT) AS surplus FROM k WHERE x <> 0""")
def population_differences(t: Tables) -> DataFrame:
    """A capture that lost its dearest records and holds its cheapest twice, against the whole."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    other = rows.where("o_totalprice < 400000").unionAll(rows.where("o_totalprice < 2000"))
    return pop.row_differences(rows, other, ["o_orderkey", "o_orderstatus"])


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS id, 'b:' || CAST(floor(c_acctbal / 5) AS VARCHAR) AS v FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'm:' || (c_custkey // 3) FROM customer WHERE c_custkey % 4 = 0),
    e AS (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.v = b.v), r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS id, min(y) AS component FROM r GROUP BY 1""")
def researcher_components(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    value = F.when(key % 4 != 0, F.concat(F.lit("b:"), F.floor(F.col("c_acctbal") / 5).cast("string"))).otherwise(F.concat(F.lit("m:"), F.floor(key / 3).cast("string")))
    rows = t.customer.select(key.alias("id"), value.alias("v"))
    root = rows.groupBy("v").agg(F.min("id").alias("root"))
    found = connected_components(rows.join(root, "v").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    return rows.join(found, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("component"))


@query("""WITH y AS (SELECT s_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    w AS (SELECT s_nationkey, coalesce(sum(n) FILTER (year IN (1999, 2000)), 0)::DOUBLE AS r, coalesce(sum(n) FILTER (year IN (1997, 1998)), 0)::DOUBLE AS b FROM y GROUP BY 1) SELECT s_nationkey, round((r - b) / greatest(1.0, r + b), 6) AS momentum FROM w""")
def pilot_momentum(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.papers, F.col("l_orderkey") == F.col("paper_id"))
    both = rows.groupBy("s_nationkey").agg(F.count_if(F.col("year").isin(1999, 2000)).alias("r"), F.count_if(F.col("year").isin(1997, 1998)).alias("b"))
    return both.select("s_nationkey", F.round(scales.pilot_change(F.col("r"), F.col("b")), 6).alias("momentum"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'record:' || c_custkey WHEN c_custkey % 3 = 0 THEN 'orcid:' || c_nationkey ELSE 'name:' || c_mktsegment END AS key,
    CAST(CASE WHEN c_custkey % 5 = 0 THEN 0.99 WHEN c_custkey % 3 = 0 THEN 0.97 ELSE 0.62 END AS DOUBLE) AS confidence FROM customer""")
def identity_tiers(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    tiers = [(F.when(key % 5 == 0, key.cast("string")), 0.99, "record"), (F.when(key % 3 == 0, F.col("c_nationkey").cast("string")), 0.97, "orcid"), (F.col("c_mktsegment"), 0.62, "name")]
    return t.customer.select("c_custkey", idn.identity_key(tiers).alias("i")).select("c_custkey", "i.key", "i.confidence")


@query("""WITH a AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 3 = 0), c AS (SELECT s_suppkey AS k, 99 AS v FROM supplier WHERE s_suppkey % 7 = 0)
    SELECT s_suppkey AS k, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'local' WHEN b.v IS NOT NULL THEN 'registry' WHEN c.v IS NOT NULL THEN 'crosswalk' END AS method, len(list_distinct(list_filter([a.v, b.v, c.v], lambda x: x IS NOT NULL))) > 1 AS conflict
    FROM supplier LEFT JOIN a ON a.k = s_suppkey LEFT JOIN b ON b.k = s_suppkey LEFT JOIN c ON c.k = s_suppkey""")
def crosswalk_precedence(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("k"))
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")

    def source(keep: F.Column, value: F.Column) -> DataFrame:
        return t.supplier.where(keep).select(k.alias("k"), value.alias("v"))

    return idn.by_precedence(
        rows, "k", "v", ("local", source(k % 2 == 0, nation)), ("registry", source(k % 3 == 0, F.when(k % 5 == 0, -1).otherwise(nation))), ("crosswalk", source(k % 7 == 0, F.lit(99)))
    )


# every customer names an institution and its own nation; the institution's region stands for its city
_TEXTS = """t AS (SELECT c_custkey, s.*, c_nationkey, cn.n_name AS said, r_name, CAST(1990 + c_custkey % 20 AS INTEGER) AS year FROM customer JOIN supplier s ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier)
    JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region ON r_regionkey = sn.n_regionkey)"""


@query(f"""WITH {_TEXTS} SELECT c_custkey, CASE WHEN c_nationkey <> s_nationkey THEN 'paper-native country contradicts the chosen ROR location' WHEN 1980 + s_suppkey % 25 > year THEN 'chosen ROR organization postdates the paper-time affiliation' END AS reason,
    CASE WHEN c_nationkey = s_nationkey AND 1980 + s_suppkey % 25 <= year THEN s_suppkey END AS entity, CASE WHEN c_nationkey = s_nationkey THEN r_name END AS city FROM t""")
def affiliation_text_match(t: Tables) -> DataFrame:
    """Affiliation texts against institutions, with the reason where one is not matched."""
    size = t.supplier.agg(F.count("*").alias("n"), F.min("s_suppkey").alias("least")).first()
    nation, region = t.nation, t.region
    places = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "s_nationkey", "r_name")
    code = F.concat(F.lit("n"), F.col("s_nationkey"))
    registry = places.select(
        F.col("s_suppkey").alias("entity"), F.array(F.struct(F.col("s_name").alias("value"), F.array(F.lit("ror_display")).alias("types")), F.struct(F.lit("ACR").alias("value"), F.array(F.lit("acronym")).alias("types"))).alias("names"),
        F.array(F.struct(code.alias("country_code"), F.col("r_name").alias("city"), F.lit(None).cast("string").alias("subdivision"), F.lit(None).cast("string").alias("subdivision_code"))).alias("locations"),
        (1980 + F.col("s_suppkey") % 25).cast("int").alias("established"), F.array(F.lit("related")).alias("relationships"),
    )
    countries = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("code"), F.concat(F.lit("nn"), F.col("n_nationkey")).alias("code3"), F.array("n_name").alias("names"))
    said = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", (F.col("c_custkey") % size["n"] + size["least"]).alias("s_suppkey"))
    raw = F.concat(F.lit("Department of Physics, "), "s_name", F.lit(", "), "r_name", F.lit("; "), "n_name")
    texts = said.join(places, "s_suppkey").select("c_custkey", raw.alias("raw"), (1990 + F.col("c_custkey") % 20).cast("int").alias("year"))
    return aff.affiliation_matches(texts, "c_custkey", "raw", "year", registry, countries).select("c_custkey", "reason", "entity", "city")


@query("SELECT d.doc_id, d.source, l.quality AS review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'en'")
def review_left_outer(t: Tables) -> DataFrame:
    rows = t.documents.where("lang <> 'en'").select("doc_id", "source")
    return rows.join(t.labels.select("doc_id", F.col("quality").alias("review")), "doc_id", "left")


@query("SELECT event_id, value FROM events WHERE NOT isnan(value) AND isfinite(value) AND value >= 0")
def finite_filter(t: Tables) -> DataFrame:
    return t.events.where(~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") >= 0)).select("event_id", "value")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) AND p_retailprice > 0""")
def renderable_filter(t: Tables) -> DataFrame:
    return t.part.where("p_retailprice > 0").join(t.lineitem.where("l_discount > 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("""SELECT user_id, CAST(ts AS DATE) AS session_day, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def measurement_sessions(t: Tables) -> DataFrame:
    """Observations are compared within a measurement session only."""
    found = t.events.groupBy("user_id", F.to_date("ts").alias("session_day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return found.where("n >= 2")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 5")
def partition_cap(t: Tables) -> DataFrame:
    return rel.top_per_group(t.events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 5).select("user_id", "event_id", "ts")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_summary(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '6 hours'""")
def interval_join(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("t1"))
    b = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("second_id"), F.col("ts").alias("t2"))
    return a.join(b, "user_id").where("t2 > t1 and t2 <= t1 + interval 6 hours").select("user_id", "first_id", "second_id")


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey % 7 + 1)::DOUBLE AS w, (s_suppkey % 5 + 1)::DOUBLE AS h, s_suppkey::DOUBLE AS x FROM supplier) SELECT s_suppkey, w * h AS area, x + w / 2 AS cx, h / 2 AS cy FROM p""")
def polygon_area(t: Tables) -> DataFrame:
    x, w, h = F.col("s_suppkey").cast("double"), (F.col("s_suppkey") % 7 + 1).cast("double"), (F.col("s_suppkey") % 5 + 1).cast("double")
    zero = F.lit(0.0)
    ring = F.array(F.array(x, zero), F.array(x + w, zero), F.array(x + w, h), F.array(x, h), F.array(x, zero))
    rows = t.supplier.select("s_suppkey", ring.alias("ring"))
    return rows.select("s_suppkey", geo.ring_area(F.col("ring")).alias("area"), geo.ring_centre(F.col("ring")).alias("c")).select("s_suppkey", "area", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query("""WITH p AS (SELECT s_suppkey, (s_suppkey % 30 + 1)::DOUBLE AS w, (s_suppkey % 5 + 1)::DOUBLE AS h, (160 + s_suppkey % 19)::DOUBLE AS x FROM supplier)
    SELECT s_suppkey, CAST(CASE WHEN x + w > 180 THEN 2 ELSE 1 END AS INTEGER) AS n_pieces, round(w * h, 6) AS area, round(least(x + w, 180) - x, 6) * h AS west_of_it, round(greatest(x + w - 180, 0), 6) * h AS east_of_it FROM p""")
def antimeridian_split(t: Tables) -> DataFrame:
    """Rectangles that reach over the antimeridian, cut there: the pieces' areas add up."""
    k, zero = F.col("s_suppkey"), F.lit(0.0)
    x, w, h = (160 + k % 19).cast("double"), (k % 30 + 1).cast("double"), (k % 5 + 1).cast("double")
    end = F.when(x + w > 180, x + w - 360).otherwise(x + w)
    ring = F.array(F.array(x, zero), F.array(end, zero), F.array(end, h), F.array(x, h), F.array(x, zero))
    pieces = t.supplier.select("s_suppkey", geo.split_polygon(F.array(ring)).alias("pieces"))
    sized = pieces.select("s_suppkey", F.size("pieces").alias("n_pieces"), F.transform("pieces", lambda p: F.struct((geo.ring_middle(p[0]) > 0).alias("west"), F.abs(geo.ring_area(p[0])).alias("area"))).alias("a"))

    def total(west: bool) -> F.Column:
        return F.round(F.aggregate(F.filter("a", lambda x: x["west"] == F.lit(west)), F.lit(0.0), lambda s, x: s + x["area"]), 6)

    return sized.select("s_suppkey", "n_pieces", F.round(total(True) + total(False), 6).alias("area"), total(True).alias("west_of_it"), total(False).alias("east_of_it"))


@query(f"WITH {PAPERS} SELECT DISTINCT year, round(least(100, greatest(0, (year - 1995) / 6.0::DOUBLE * 100)), 6) AS position, round(270 - 2.7 * (year - 1995) * 10, 6)::DOUBLE AS hue FROM papers")
def timeline_scale(t: Tables) -> DataFrame:
    year = F.col("year")
    return t.papers.select("year").distinct().select("year", F.round(geo.timeline_position(year, 1995, 2001), 6).alias("position"), F.round(geo.hue((year - 1995) * 10), 6).alias("hue"))


@query(f"""WITH {AFFILIATIONS}, r AS (SELECT researcher_id, institution_id, count(DISTINCT paper_id) AS n FROM aff WHERE institution_id IS NOT NULL GROUP BY 1, 2)
    SELECT researcher_id, arg_max(institution_id, (n, -institution_id)) AS home, max(n) AS n_papers, count(*) AS n_institutions FROM r GROUP BY 1""")
def home_institution(t: Tables) -> DataFrame:
    each = t.affiliations.where("institution_id is not null").groupBy("researcher_id", "institution_id").agg(F.count_distinct("paper_id").alias("n"))
    return each.groupBy("researcher_id").agg(F.max_by("institution_id", F.struct("n", -F.col("institution_id"))).alias("home"), F.max("n").alias("n_papers"), F.count("*").alias("n_institutions"))


@query(f"""WITH {SHARES} SELECT institution_id, 'mass' AS metric_id, 'v1' AS metric_version, round(sum(weight), 4) AS value FROM shares WHERE status = 'allocated' GROUP BY 1
    UNION ALL SELECT institution_id, 'papers', 'v1', CAST(count(DISTINCT paper_id) AS DOUBLE) FROM shares WHERE status = 'allocated' GROUP BY 1""")
def metric_engine(t: Tables) -> DataFrame:
    engine = MetricEngine()
    engine.register("mass", "v1", lambda d: d.groupBy("institution_id").agg(F.round(F.sum("weight"), 4).alias("value")))
    engine.register("papers", "v1", lambda d: d.groupBy("institution_id").agg(F.count_distinct("paper_id").cast("double").alias("value")))
    return engine.calculate_all(att.allocated(att.attribution_shares(t.affiliations, t.rows("lineitem"))))


@query("""WITH d AS (SELECT doc_id, text, source, lang FROM documents), u AS (SELECT min(doc_id) AS doc_id, text FROM d GROUP BY text) SELECT d.source, count(*) AS n_rows, count(u.doc_id) AS n_selected FROM d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY 1""")
def exact_occurrence_selection(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    chosen = docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(1).alias("selected"))
    return docs.join(chosen, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.count("selected").alias("n_selected"))
