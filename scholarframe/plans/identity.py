"""Identity resolution, text functions and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.functions import dates, identifiers, text
from scholarframe.operators import identity as idn
from scholarframe.operators import search
from scholarframe.plans.layouts import folder_for
from scholarframe.plans.registry import query
from scholarframe.sources.tables import Tables
from scholarframe.streaming import merging

_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORM.format('p_name')} AS term, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def name_normalisation(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.search_term(F.col("p_name")).alias("term"), text.slug(F.col("p_brand")).alias("slug"))


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split({_NORM.format('p_name')}, ' '), lambda x: x <> '' AND x NOT IN ('and', 'at', 'de', 'der', 'for', 'in', 'of', 'the', 'und')) AS w FROM part)
    SELECT p_partkey, array_to_string(list_transform(w, lambda x: x[1]), '') AS acronym FROM w""")
def acronym_search(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.acronym(text.search_term(F.col("p_name"))).alias("acronym"))


@query("""WITH names AS (SELECT p_name AS term, count(DISTINCT p_partkey) AS n, min(p_partkey) AS k FROM part GROUP BY 1), m AS (SELECT event_id, 'Part ' || user_id AS term FROM events UNION ALL SELECT -p_partkey, p_name FROM part)
    SELECT event_id, term, CASE WHEN n = 1 THEN k END AS p_partkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM m LEFT JOIN names USING (term)""")
def exact_name_resolution(t: Tables) -> DataFrame:
    mentions = t.events.select("event_id", F.concat(F.lit("Part "), "user_id").alias("term"))
    mentions = mentions.unionByName(t.part.select((-F.col("p_partkey")).alias("event_id"), F.col("p_name").alias("term")))
    return idn.unique_name_match(mentions, t.part.select(F.col("p_name").alias("term"), "p_partkey"), "term", "p_partkey")


@query(f"""WITH names AS (SELECT {_NORM.format('n_name')} AS k, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) = 1),
    m AS (SELECT s_suppkey, n_name || ', ' || r_name || '; unit ' || s_suppkey AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    p AS (SELECT s_suppkey, raw, {_NORM.format("unnest(string_split_regex(raw, '[,;]'))")} AS k FROM m)
    SELECT s_suppkey, raw, min(id) AS n_nationkey FROM p JOIN names USING (k) GROUP BY 1, 2 HAVING count(DISTINCT id) = 1""")
def alias_unique_match(t: Tables) -> DataFrame:
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    mentions = placed.select("s_suppkey", F.concat("n_name", F.lit(", "), "r_name", F.lit("; unit "), "s_suppkey").alias("raw"))
    names = t.nation.select(text.search_term(F.col("n_name")).alias("k"), "n_nationkey")
    return idn.segment_match(mentions, "raw", names, "k", "n_nationkey", text.search_term).select("s_suppkey", "raw", "n_nationkey")


_BIGRAMS = "list_distinct(list_transform(generate_series(1, length(replace({0}, ' ', '')) - 1), lambda i: substr(replace({0}, ' ', ''), i, 2)))"


_FUZZY = f"""WITH a AS (SELECT s_suppkey AS m, {_NORM.format('s_name')} AS x FROM supplier), b AS (SELECT c_custkey AS e, {_NORM.format("replace(c_name, 'Customer', 'Supplier')")} AS y FROM customer),
    sc AS (SELECT m, e, 2 * len(list_intersect({_BIGRAMS.format('x')}, {_BIGRAMS.format('y')}))::DOUBLE / (len({_BIGRAMS.format('x')}) + len({_BIGRAMS.format('y')})) AS s FROM a JOIN b ON x[1] = y[1]),
    rk AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY s DESC, e) AS rank, lead(s) OVER (PARTITION BY m ORDER BY s DESC, e) AS nxt FROM sc WHERE s >= 0.75)
    SELECT m AS mention, e AS entity, round(s, 6) AS similarity, rank, rank = 1 AND (nxt IS NULL OR s - nxt >= 0.05) AS clear FROM rk WHERE rank <= 3"""


@query("""WITH n AS (SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '&', ' and '), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS term FROM documents)
    SELECT doc_id, md5(term) AS term_md5, CAST(length(term) AS INTEGER) AS n_chars FROM n""")
def unicode_terms(t: Tables) -> DataFrame:
    """Whole texts in the search form that keeps letters of every script."""
    term = text.unicode_term(F.col("text"))
    return t.documents.select("doc_id", F.md5(term).alias("term_md5"), F.length(term).alias("n_chars"))


@query(_FUZZY)
def fuzzy_bigram_match(t: Tables) -> DataFrame:
    """The best customers for the name of every supplier, all customers considered."""
    mentions = t.supplier.select(F.col("s_suppkey").alias("mention"), text.search_term(F.col("s_name")).alias("term"))
    # customers are renamed so that names are alike; both sides carry whole names
    names = t.customer.select(F.col("c_custkey").alias("entity"), text.search_term(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("term"))
    found = idn.fuzzy_match(mentions, names, "mention", "term", "entity")
    return found.select("mention", "entity", F.round("similarity", 6).alias("similarity"), "rank", "clear")


@query(_FUZZY.replace("SELECT m, e, 2 *", "SELECT e AS m, m AS e, 2 *"))
def fuzzy_bigram_match_all(t: Tables) -> DataFrame:
    """The other way round: the best suppliers for the name of every customer."""
    mentions = t.customer.select(F.col("c_custkey").alias("mention"), text.search_term(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("term"))
    names = t.supplier.select(F.col("s_suppkey").alias("entity"), text.search_term(F.col("s_name")).alias("term"))
    found = idn.fuzzy_match(mentions, names, "mention", "term", "entity")
    return found.select("mention", "entity", F.round("similarity", 6).alias("similarity"), "rank", "clear")


@query("""WITH m AS (SELECT DISTINCT p_name AS term, 'Brand#' || b AS context FROM part, (SELECT unnest(generate_series(1, 27)) AS b)),
    c AS (SELECT term || '@' || context AS mention, p_partkey AS entity, CASE WHEN p_brand = context THEN 1 ELSE 0 END AS ok FROM m JOIN part ON p_name = term)
    SELECT mention, entity FROM (SELECT *, max(ok) OVER (PARTITION BY mention) AS best FROM c) WHERE ok = best""")
def contextual_narrowing(t: Tables) -> DataFrame:
    """Every part name in the context of every brand, two unknown ones included."""
    names = t.part.select(F.col("p_name").alias("term"), F.col("p_brand").alias("context"), F.col("p_partkey").alias("entity"))
    brands = F.transform(F.sequence(F.lit(1), F.lit(27)), lambda b: F.concat(F.lit("Brand#"), b))
    mentions = names.select("term").distinct().select("term", F.explode(brands).alias("context")).withColumn("mention", F.concat("term", F.lit("@"), "context"))
    return idn.narrowed_match(mentions, names, "mention", "term", "context", "entity")


_COMPONENTS = """RECURSIVE edges AS (SELECT a.doc_id AS x, b.doc_id AS y FROM ids a JOIN ids b ON a.scheme = b.scheme AND a.value = b.value),
    reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)"""


@query(f"""WITH RECURSIVE ids AS (SELECT doc_id, 'text' AS scheme, md5(text) AS value FROM documents UNION ALL SELECT doc_id, 'key', source || '-' || n_chars FROM documents),
    {_COMPONENTS.removeprefix('RECURSIVE ')} SELECT x AS occurrence_id, min(y) AS component FROM reach GROUP BY 1""")
def merge_components(t: Tables) -> DataFrame:
    docs = t.documents
    ids = docs.select(F.col("doc_id").alias("occurrence_id"), F.lit("text").alias("scheme"), F.md5("text").alias("value"))
    ids = ids.unionByName(docs.select(F.col("doc_id").alias("occurrence_id"), F.lit("key").alias("scheme"), F.concat_ws("-", "source", "n_chars").alias("value")))
    return idn.merged_occurrences(docs.select(F.col("doc_id").alias("occurrence_id")), ids)


@query(f"""WITH RECURSIVE ids AS (SELECT doc_id, 'text' AS scheme, md5(text) AS value FROM documents UNION ALL SELECT doc_id, 'key', source || '-' || n_chars FROM documents),
    {_COMPONENTS.removeprefix('RECURSIVE ')}, c AS (SELECT x, min(y) AS component FROM reach GROUP BY 1) SELECT x AS vertex, component FROM c QUALIFY count(*) OVER (PARTITION BY component) > 1""")
def incremental_components(t: Tables) -> DataFrame:
    """Components of shared identifiers, whose links come in three batches, one of them twice."""
    docs = t.documents.select("doc_id", F.md5("text").alias("text"), F.concat_ws("-", "source", "n_chars").alias("key"))
    ids = docs.select("doc_id", F.explode(F.array("text", "key")).alias("value"))
    links = ids.join(ids.groupBy("value").agg(F.min("doc_id").alias("root")), "value").select(F.col("doc_id").alias("src"), F.col("root").alias("dst"))
    folder, batch = folder_for(t, "components"), F.pmod(F.xxhash64("src", "dst"), F.lit(3))
    for number in (0, 1, 1, 2):
        merging.add_links(links.where(batch == number), folder, number)
    return merging.component_labels(t.spark, folder)


@query("""WITH RECURSIVE ids AS (SELECT DISTINCT c_custkey AS doc_id, 'bal' AS scheme, CAST(floor(c_acctbal / 2) AS VARCHAR) AS value FROM customer),
    """ + _COMPONENTS.removeprefix("RECURSIVE ") + """, c AS (SELECT x, min(y) AS component FROM reach GROUP BY 1),
    v AS (SELECT component, count(DISTINCT c_mktsegment) AS n FROM c JOIN customer ON c_custkey = x GROUP BY 1)
    SELECT component, n AS most_values, n > 1 AS needs_review FROM v""")
def merge_conflicts(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("occurrence_id"), F.lit("bal").alias("scheme"), F.floor(F.col("c_acctbal") / 2).cast("string").alias("value"), "c_mktsegment")
    members = idn.merged_occurrences(people, people.select("occurrence_id", "scheme", "value"))
    return idn.merge_review(members, people.select("occurrence_id", F.lit("segment").alias("scheme"), F.col("c_mktsegment").alias("value")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def resolution_summary_grouping_sets(t: Tables) -> DataFrame:
    return idn.resolution_summary(t.orders, "o_orderstatus", "o_orderpriority")


_PRED = "pred AS (SELECT l.doc_id, CASE WHEN n_chars % 10 < 8 THEN 1 ELSE 0 END AS predicted, quality AS label, (n_chars % 100) / 100.0::DOUBLE AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _predictions(t: Tables) -> DataFrame:
    joined = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    predicted = F.when(F.col("n_chars") % 10 < 8, 1).otherwise(0)
    return joined.select("doc_id", predicted.alias("predicted"), F.col("quality").alias("label"), (F.col("n_chars") % 100 / 100).alias("confidence"), (predicted == F.col("quality")).alias("right"))


@query(f"""WITH {_PRED}, c AS (SELECT count(*) AS n_cases, count(*) FILTER (predicted = 1) AS n_predicted, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (predicted = 1 AND label = 1) AS n_hit, count(*) FILTER (predicted = label) AS n_right FROM pred)
    SELECT *, CASE WHEN n_predicted >= 30 THEN n_hit / n_predicted::DOUBLE END AS precision, CASE WHEN n_positive >= 30 THEN n_hit / n_positive::DOUBLE END AS recall, CASE WHEN n_cases >= 30 THEN n_right / n_cases::DOUBLE END AS accuracy FROM c""")
def identity_precision_recall(t: Tables) -> DataFrame:
    return idn.precision_recall(_predictions(t))


@query(f"""WITH {_PRED} SELECT CAST(least(floor(confidence * 5), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS share_right,
    round(abs(avg(confidence) - avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END)), 6) AS gap FROM pred GROUP BY 1""")
def calibration_bins(t: Tables) -> DataFrame:
    found = idn.calibration(_predictions(t))
    return found.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_confidence", "share_right", "gap")])


@query(f"""WITH {_PRED}, b AS (SELECT least(floor(confidence * 5), 4) AS bin, count(*) AS n, sum(confidence) AS c, sum(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END) AS r, sum((confidence - CASE WHEN predicted = label THEN 1 ELSE 0 END) ** 2) AS b FROM pred GROUP BY 1)
    SELECT round(sum(abs(c - r)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM b""")
def calibration_ece(t: Tables) -> DataFrame:
    return idn.calibration_error(_predictions(t)).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("""WITH s AS (SELECT c_custkey, c_mktsegment, sha256('v1:' || c_custkey) AS k FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY k, c_custkey) AS turn FROM s)
    SELECT c_custkey, c_mktsegment, turn FROM r WHERE turn <= 20 ORDER BY turn, c_mktsegment, k LIMIT 60""")
def stratified_sample(t: Tables) -> DataFrame:
    return idn.stratified_sample(t.customer, "c_custkey", "c_mktsegment", "v1", 20, 60).select("c_custkey", "c_mktsegment", "turn")


# --- identifiers and dates --------------------------------------------------------

_RAW_IDS = """ids AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'doi' WHEN 1 THEN 'orcid' WHEN 2 THEN 'ror' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'inspire' ELSE 'doi' END AS scheme,
    CASE c_custkey % 6 WHEN 0 THEN 'https://doi.org/10.1000/ABC.' || c_custkey WHEN 1 THEN 'https://orcid.org/0000-0002-1825-009' || (c_custkey % 10) WHEN 2 THEN 'https://ror.org/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
    WHEN 3 THEN 'arXiv:2101.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || 'v2' WHEN 4 THEN 'https://inspirehep.net/literature/' || c_custkey ELSE 'not a doi' END AS value FROM customer)"""


@query(f"""WITH {_RAW_IDS} SELECT id, scheme, CASE scheme WHEN 'doi' THEN CASE WHEN value LIKE 'https%' THEN lower(replace(value, 'https://doi.org/', '')) END
    WHEN 'orcid' THEN CASE WHEN right(value, 1) = '7' THEN replace(value, 'https://orcid.org/', '') END WHEN 'ror' THEN replace(value, 'https://ror.org/', '')
    WHEN 'arxiv' THEN substr(value, 7, 10) ELSE replace(value, 'https://inspirehep.net/literature/', '') END AS identifier FROM ids""")
def identifier_normalise(t: Tables) -> DataFrame:
    k, number = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    scheme = F.element_at(F.array(*map(F.lit, ("doi", "orcid", "ror", "arxiv", "inspire", "doi"))), (k + 1).cast("int"))
    value = (
        F.when(k == 0, F.concat(F.lit("https://doi.org/10.1000/ABC."), number))
        .when(k == 1, F.concat(F.lit("https://orcid.org/0000-0002-1825-009"), F.col("c_custkey") % 10))
        .when(k == 2, F.concat(F.lit("https://ror.org/"), F.lpad(number, 9, "0")))
        .when(k == 3, F.concat(F.lit("arXiv:2101."), F.lpad(number, 5, "0"), F.lit("v2")))
        .when(k == 4, F.concat(F.lit("https://inspirehep.net/literature/"), number))
        .otherwise("not a doi")
    )
    return t.customer.select(F.col("c_custkey").alias("id"), scheme.alias("scheme"), identifiers.normalised(scheme, value).alias("identifier"))


@query("""WITH d AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 7919 % 1000000000000000 AS VARCHAR), 15, '0') AS s FROM customer),
    x AS (SELECT id, s, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: CAST(c AS BIGINT))), lambda a, c: (a + c) * 2) AS tot FROM d),
    y AS (SELECT id, s, (12 - tot % 11) % 11 AS c FROM x)
    SELECT id, substr(s, 1, 4) || '-' || substr(s, 5, 4) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 3) || CASE WHEN id % 2 = 0 THEN CASE WHEN c = 10 THEN 'X' ELSE CAST(c AS VARCHAR) END ELSE '0' END AS orcid,
    id % 2 = 0 OR c = 0 AS valid FROM y""")
def orcid_checkdigit(t: Tables) -> DataFrame:
    s = F.lpad((F.col("c_custkey") * 7919 % 1000000000000000).cast("string"), 15, "0")
    total = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: (a + c.cast("long")) * 2)
    check = F.pmod(12 - F.pmod(total, F.lit(11)), F.lit(11))
    last = F.when(F.col("c_custkey") % 2 == 0, F.when(check == 10, "X").otherwise(check.cast("string"))).otherwise("0")
    whole = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 4), F.lit("-"), F.substring(s, 9, 4), F.lit("-"), F.substring(s, 13, 3), last)
    return t.customer.select(F.col("c_custkey").alias("id"), whole.alias("orcid"), identifiers.orcid_is_valid(whole).alias("valid"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s, o_orderkey % 3 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, s AS partial, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision, CAST(CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) ELSE d END AS DATE) AS earliest,
    CAST(CASE k WHEN 0 THEN make_date(year(d), 12, 31) WHEN 1 THEN last_day(d) ELSE d END AS DATE) AS latest FROM d""")
def partial_dates(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = t.orders.select("o_orderkey", s.alias("partial"))
    p = F.col("partial")
    return rows.select("o_orderkey", "partial", dates.precision(p).alias("precision"), dates.first_day(p).alias("earliest"), dates.last_day(p).alias("latest"))


@query("""SELECT o_orderkey, CAST((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) - CASE WHEN 15 < day(o_orderdate) THEN 1 ELSE 0 END AS INTEGER) AS months FROM orders""")
def whole_months(t: Tables) -> DataFrame:
    from scholarframe.operators.indicators import months_elapsed

    return t.orders.select("o_orderkey", months_elapsed(F.to_date("o_orderdate"), F.lit("2001-08-15").cast("date")).alias("months"))


@query("""WITH s AS (SELECT s_suppkey, CAST((ARRAY[200, 204, 301, 302, 307, 308, 404, 410, 429, 500, 418])[s_suppkey % 11 + 1] AS INTEGER) AS status FROM supplier)
    SELECT s_suppkey, status, CASE WHEN status BETWEEN 200 AND 299 THEN 'reachable' WHEN status IN (302, 303, 307) THEN 'redirect' WHEN status IN (301, 308) THEN 'permanent-redirect' WHEN status IN (404, 410) THEN 'broken' ELSE 'unknown' END AS health FROM s""")
def resource_health(t: Tables) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 204, 301, 302, 307, 308, 404, 410, 429, 500, 418)]), (F.col("s_suppkey") % 11 + 1).cast("int"))
    return t.supplier.select("s_suppkey", status.alias("status"), identifiers.health_class(status).alias("health"))


@query("""SELECT page_id, regexp_matches(url, '^https?://[^/@\\s]+([/?#]|$)') AND contains(regexp_extract(url, '://([^/:?#]+)', 1), '.') AS is_public, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages""")
def url_validation(t: Tables) -> DataFrame:
    return t.pages.select("page_id", identifiers.public_url(F.col("url")).alias("is_public"), F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"))


# --- search -----------------------------------------------------------------------


def _entities(t: Tables) -> DataFrame:
    return search.candidates(("nation", t.nation, "n_nationkey", "n_name"), ("region", t.region, "r_regionkey", "r_name"), ("supplier", t.supplier, "s_suppkey", "s_name"), ("part", t.part, "p_partkey", "p_name"))


_ENTITIES = """ents AS (SELECT 'nation' AS entity_type, CAST(n_nationkey AS VARCHAR) AS entity_id, n_name AS label FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region
    UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part)"""
_TERMS = f"""{_ENTITIES}, n AS (SELECT *, {_NORM.format('label')} AS whole FROM ents), terms AS (SELECT entity_type, entity_id, label, unnest(list_distinct(list_concat([whole], list_filter(string_split(whole, ' '), lambda x: length(x) >= 2)))) AS term FROM n WHERE whole <> '')"""


@query(f"WITH {_TERMS} SELECT entity_type, entity_id, label, term FROM terms")
def term_index(t: Tables) -> DataFrame:
    return search.term_index(_entities(t))


@query(f"""WITH {_TERMS} SELECT entity_type, entity_id, label, CAST(max(CASE WHEN term = 'nation' THEN 1.0 ELSE 0.96 END) AS DOUBLE) AS score FROM terms WHERE starts_with(term, 'nation') GROUP BY 1, 2, 3 ORDER BY score DESC, label, entity_type, entity_id LIMIT 20""")
def search_prefix(t: Tables) -> DataFrame:
    return search.prefix_search(search.term_index(_entities(t)), "nation", 20)


_QUERY = "supplier 00000012"


@query(f"""WITH {_ENTITIES}, n AS (SELECT *, {_NORM.format('label')} AS x, {_NORM.format(repr('Supplier#00000012'))} AS q FROM ents),
    s AS (SELECT *, 0.68 * (1 - levenshtein(q, x)::DOUBLE / greatest(length(q), length(x))) + 0.32 * (2.0::DOUBLE * len(list_intersect(list_distinct(string_split(q, ' ')), list_distinct(string_split(x, ' ')))) / (len(list_distinct(string_split(q, ' '))) + len(list_distinct(string_split(x, ' '))))) AS mixed FROM n),
    z AS (SELECT entity_type, entity_id, label, CASE WHEN q = x THEN 1.0 WHEN starts_with(x, q) THEN 0.91 WHEN mixed >= 0.58 THEN least(1.0, 0.48 + 0.48 * mixed) END AS score FROM s)
    SELECT entity_type, entity_id, label, CAST(round(score, 6) AS DOUBLE) AS score FROM z WHERE score >= 0.62 ORDER BY z.score DESC, label, entity_type, entity_id LIMIT 15""")
def search_fuzzy(t: Tables) -> DataFrame:
    return search.fuzzy_search(_entities(t), "Supplier#00000012", limit=15).select("entity_type", "entity_id", "label", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits, round(2.0::DOUBLE * len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) / (len(list_distinct(string_split(p_name, ' '))) + len(list_distinct(string_split(p_type, ' ')))), 6) AS dice FROM part")
def string_distances(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits"), F.round(text.token_dice(F.col("p_name"), F.col("p_type")), 6).alias("dice"))
