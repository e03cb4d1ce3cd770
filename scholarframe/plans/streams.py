"""Streams, incremental updates, sources and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.operators.relational import latest, upsert
from scholarframe.plans.layouts import folder_for
from scholarframe.plans.registry import query
from scholarframe.sources import artifacts, providers, sinks
from scholarframe.sources.cursor import RecordSource
from scholarframe.sources.tables import Tables
from scholarframe.streaming import events as ev
from scholarframe.streaming import incremental as inc
from scholarframe.streaming import recheck


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_tumbling(t: Tables) -> DataFrame:
    found = ev.drained(ev.tumbling(ev.table_stream(t.spark, t.folder, "events"), "1 hour", "event_type", late="1 hour"), "complete")
    return found.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), w AS (SELECT b AS window_start, event_type, value FROM e UNION ALL SELECT b - INTERVAL '30 minutes', event_type, value FROM e)
    SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""")
def event_sliding(t: Tables) -> DataFrame:
    found = ev.drained(ev.sliding(ev.table_stream(t.spark, t.folder, "events"), "1 hour", "30 minutes", "event_type", late="1 hour"), "complete")
    return found.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_session(t: Tables) -> DataFrame:
    found = ev.drained(ev.sessions(ev.table_stream(t.spark, t.folder, "events"), "2 hours", "user_id", late="1 hour"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, max(ts) AS newest FROM events")
def watermark_dedup(t: Tables) -> DataFrame:
    stream = ev.table_stream(t.spark, t.folder, "events")
    twice = stream.unionByName(stream.withColumn("value", F.col("value") + 1))
    found = ev.drained(ev.deduplicated(twice, ["event_id"], "365 days").select("event_id", "ts"))
    return found.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("""WITH r AS (SELECT user_id, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events WHERE event_type = 'signup'),
    k AS (SELECT *, ts + INTERVAL 7 DAY AS due, (SELECT max(ts) FROM events WHERE event_type = 'signup') AS until FROM r)
    SELECT user_id, 'current' AS kind, ts AS at, event_id AS revision FROM k UNION ALL SELECT user_id, 'superseded', next, event_id FROM k WHERE next IS NOT NULL
    UNION ALL SELECT user_id, 'due', due, event_id FROM k WHERE coalesce(next >= due, due <= until)""")
def resource_rechecks(t: Tables) -> DataFrame:
    """Which revisions became current, were superseded, or fell due for another check, from keyed state with timers."""
    recheck.use_state_store(t.spark)
    stream = ev.table_stream(t.spark, t.folder, "events").where("event_type = 'signup'")
    return ev.drained(recheck.checked(stream, "user_id", "ts", "event_id", "0 seconds")).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def incremental_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "ts", "event_id", F.round("value", 6).alias("value"))
    early, late = rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-15'")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    return upsert(latest(early, keys, order), latest(late, keys, order), keys).select("user_id", "event_type", "event_id", "value")


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def record_stream(t: Tables) -> DataFrame:
    """The state of a provider's records after its pages went through the stream, one of them twice."""
    t.spark.dataSource.register(RecordSource)
    base = folder_for(t, "records")
    rows = t.events.select(F.col("user_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated"), "event_id")
    for half in ("ts < '2024-01-16'", "ts >= '2024-01-14'"):
        own = rows.where(half.replace("ts", "updated"))
        own.repartitionByRange("updated", "id").sortWithinPartitions("updated", "id").write.mode("append").json(f"{base}/pages")
        inc.apply_stream(t.spark.readStream.format("provider_records").load(f"{base}/pages"), f"{base}/log", f"{base}/checkpoint")
    state = inc.current_state(t.spark, f"{base}/log", ["id"], ["updated"])
    return state.select("id", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def idempotent_replay(t: Tables) -> DataFrame:
    rows = t.events.withColumn("content_hash", inc.content_hash("event_id", "ts", "user_id", "event_type", "value", "props"))
    return inc.unseen(rows.unionByName(rows), rows.where("ts < '2024-01-10'")).select("event_id")


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-28'")
def affected_partitions(t: Tables) -> DataFrame:
    batch = t.events.where("ts >= '2024-01-28'").withColumn("day", F.to_date("ts"))
    return inc.affected_partitions(batch, ["user_id", "event_type", "day"])


@query("""WITH f AS (SELECT *, CAST(ts AS DATE) AS day FROM events), touched AS (SELECT DISTINCT user_id, day FROM f WHERE event_id % 97 = 0) SELECT user_id, day, count(*) AS n, round(sum(value), 6) AS total FROM f JOIN touched USING (user_id, day) GROUP BY 1, 2""")
def recomputed_partitions(t: Tables) -> DataFrame:
    facts = t.events.withColumn("day", F.to_date("ts"))
    touched = inc.affected_partitions(facts.where("event_id % 97 = 0"), ["user_id", "day"])
    return inc.recompute(facts, touched, ["user_id", "day"], lambda d: d.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")))


@query("""WITH s AS (SELECT n_nationkey AS k, (ARRAY['inspire', 'arxiv', 'ror'])[n_nationkey % 3 + 1] AS source, CASE WHEN n_nationkey % 5 <> 0 THEN DATE '2024-01-31' - CAST(n_nationkey % 9 AS INTEGER) END AS last_success, n_nationkey % 7 = 0 AS checkpoint_pending FROM nation)
    SELECT k, source, coalesce(last_success IS NULL OR checkpoint_pending OR DATE '2024-01-31' - last_success >= CASE source WHEN 'ror' THEN 7 ELSE 1 END, false) AS due FROM s""")
def due_sources(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    state = t.nation.select(
        k.alias("k"), F.element_at(F.array(*map(F.lit, ("inspire", "arxiv", "ror"))), (k % 3 + 1).cast("int")).alias("source"),
        F.when(k % 5 != 0, F.date_sub(F.lit("2024-01-31").cast("date"), (k % 9).cast("int"))).alias("last_success"), (k % 7 == 0).alias("checkpoint_pending"),
    )
    return inc.due_sources(state, F.lit("2024-01-31").cast("date")).select("k", "source", "due")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) > 1999 THEN 'fresh' ELSE 'kept' END AS origin, count(*) AS n FROM orders GROUP BY 1, 2")
def overlap_reprocess(t: Tables) -> DataFrame:
    base = t.papers.withColumn("origin", F.lit("kept"))
    fresh = t.papers.where(inc.overlap_years(F.col("year"), 2001, 2)).withColumn("origin", F.lit("fresh"))
    return inc.replaced_partitions(base, fresh, ["year"]).groupBy("year", "origin").agg(F.count("*").alias("n"))


# --- sinks and sources -------------------------------------------------------------


@query("""SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS n_bytes,
    CAST(floor(coalesce(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 2000) AS BIGINT) AS shard FROM part""")
def shard_sizing(t: Tables) -> DataFrame:
    return sinks.sized_shards(t.part.select("p_partkey", "p_name"), ["p_partkey"], F.octet_length("p_name"), 2000).drop("p_name")


@query("""SELECT p_brand AS kind, count(*) AS n_rows, CAST(sum(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}') + 1) AS BIGINT) AS n_bytes, 0::BIGINT AS n_refused FROM part GROUP BY 1""")
def artifact_shards(t: Tables) -> DataFrame:
    """Rows written as shards under the digest of their bytes and read back, each shard checked first."""
    folder = folder_for(t, "artifacts")
    artifacts.write_artifact_shards(t.part.select("p_partkey", "p_name", "p_brand"), folder, "parts", "p_brand", ["p_partkey"], limit=20_000)
    lines = artifacts.read_artifact_shards(t.spark, folder, "parts")
    kind = F.get_json_object("line", "$.p_brand").alias("kind")
    return lines.groupBy(kind).agg(F.count("line").alias("n_rows"), F.sum(F.octet_length("line") + 1).cast("long").alias("n_bytes"), F.count("problem").alias("n_refused"))


@query("SELECT sha256(text) AS sha256, CAST(max(strlen(text)) AS BIGINT) AS size, true AS verified FROM documents WHERE text IS NOT NULL GROUP BY 1")
def payload_store(t: Tables) -> DataFrame:
    """Each distinct payload in a file of its own, read back and held against its name."""
    folder = folder_for(t, "payloads")
    refs = artifacts.put_payloads(t.documents, "text", folder)
    return artifacts.verified_payloads(refs, folder)


@query("SELECT l_suppkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts FROM lineitem GROUP BY 1")
def inverted_index(t: Tables) -> DataFrame:
    found = sinks.inverted_index(t.lineitem.select("l_suppkey", F.col("l_partkey").cast("string").alias("part")), "l_suppkey", "part")
    return found.select("l_suppkey", F.array_join("members", ",").alias("parts"))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_id FROM part")
def dictionary_interning(t: Tables) -> DataFrame:
    return sinks.interned(t.part.select("p_partkey", "p_brand"), "p_brand")[0]


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS document FROM nation""")
def dataset_export(t: Tables) -> DataFrame:
    return sinks.export_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("SELECT sha256(text) AS sha256, count(*) AS n_refs, CAST(max(length(text)) AS INTEGER) AS n_chars FROM documents GROUP BY 1")
def payload_dedup(t: Tables) -> DataFrame:
    return sinks.deduplicated_payloads(t.documents, "text").select("sha256", "n_refs", F.length("payload").alias("n_chars"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS n_bytes FROM orders GROUP BY 1, 2")
def archive_summary(t: Tables) -> DataFrame:
    return sinks.summary(t.orders, "o_orderstatus", "o_orderpriority", payload="o_orderpriority")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events")
def scd_current_flags(t: Tables) -> DataFrame:
    return sinks.current_flags(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "is_current")


@query("SELECT p_type AS category, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT p_type FROM part), (SELECT unnest(generate_series(2018, 2026)) AS y) WHERE NOT (length(p_type) % 2 = 0 AND y < 2022)")
def capture_plan(t: Tables) -> DataFrame:
    categories = t.part.select(F.col("p_type").alias("category"))
    done = categories.distinct().where(F.length("category") % 2 == 0).withColumn("year", F.explode(F.sequence(F.lit(2018), F.lit(2021))))
    return providers.capture_plan(categories, 2018, 2026, done)


@query("WITH n AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)) SELECT l_partkey, CAST(floor((row_number() OVER (ORDER BY l_partkey) - 1) / 40) AS BIGINT) AS batch FROM n")
def lookup_batches(t: Tables) -> DataFrame:
    known = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return providers.lookup_batches(t.lineitem, known, "l_partkey").select("l_partkey", "batch")


@query("SELECT r_regionkey, CAST(i AS INTEGER) AS place, r_name || '-' || i AS name FROM region, (SELECT unnest(generate_series(0, 2)) AS i)")
def packed_decode(t: Tables) -> DataFrame:
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array(F.col("r_regionkey").cast("string"), F.concat("r_name", F.lit("-"), i)))
    packed = t.region.select(F.array(F.lit("key"), F.lit("name")).alias("columns"), names.alias("rows"))
    return providers.unpacked(packed).select(F.col("record.key").cast("int").alias("r_regionkey"), "place", F.col("record.name").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_extraction(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k string")["k"].alias("k")).where("k is not null")
