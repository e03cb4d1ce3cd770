"""The queries of this subpackage over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarframe.llm import audit, contamination, packing, pii, pivots, quality, secretscan, sharding, simhash, suffixdedup, tokenfiles, toxicity, whitening
from scholarframe.llm.learning import split_of
from scholarframe.session import shared_dir


#: Shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(rows: DataFrame, held_out: F.Column, bar: float) -> DataFrame:
    """``held_out`` is false for a row without an id, which no label can name."""
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of whole documents, learnt from the labels outside fold 1 of 3."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scorer = quality.quality_scorer(docs, labels.where(split_of("doc_id", 3) != 1))
    return _scored(quality.score_quality(docs.select("doc_id", "text"), scorer), split_of("doc_id", 3) == 1, 0.5)


def op2_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of whole documents that earlier documents hold, removed."""
    found = suffixdedup.repeated_passages(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors by cosine."""
    return pivots.vector_groups(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in whole documents."""
    found = contamination.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents packed into sequences of 2048 tokens."""
    found = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048, end_id=0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole documents, learnt from the labels outside fold 2 of 4."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = toxicity.toxicity_lexicon(docs, labels.where(split_of("doc_id", 4) != 2))
    return _scored(toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon), split_of("doc_id", 4) == 2, 0.3)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS).select("doc_id", "source", "slot", "shard")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.span_classifier(docs)).drop("text")

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.BASE_KINDS), F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of whole documents by SimHash."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as token files and read back."""
    folder = tokenfiles.new_folder(shared_dir(spark))
    manifest = tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=1)
    return tokenfiles.read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters of whole documents in all orders, by language."""
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole documents."""
    found = secretscan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secretscan.BASE_KINDS), F.sha2(secretscan.listed(base), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the four components of largest deviation."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffixdedup": op2_suffixdedup,
    "op3_pivots": op3_pivots,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_tokenfiles": op10_tokenfiles,
    "op11_filteraudit": op11_filteraudit,
    "op12_secretscan": op12_secretscan,
    "op13_whitening": op13_whitening,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        place AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM place),
        sizes AS (SELECT DISTINCT n FROM win),
        runs AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, sizes WHERE len(w) >= n),
        hit AS (SELECT doc_id, n, p, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM runs) JOIN win USING (n, k)),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hit)) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_sharding": f"""
        WITH slots AS (SELECT unnest(generate_series(0, {sharding.SLOTS - 1})) AS slot, CAST(unnest(string_split('{",".join(map(str, sharding.fill_table(SHARDS)))}', ',')) AS INTEGER) AS place),
        rows AS (SELECT doc_id, source, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, source, CAST(slot AS INTEGER) AS slot, printf('shard-%03d', place) AS shard FROM rows JOIN slots USING (slot)
    """,
    # every order is run step by step over the documents that each set of filters catches
    "op11_filteraudit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
        f AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
                  WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
                  WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)
                  WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE doc_id > least END) AS fails,
                  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good,
                  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
        cells AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY 1, 2),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
        played AS (SELECT part, o, step, o[step] AS x, fails, n, good, toxic, list_contains(fails, o[step]) AS hit,
                   len(list_filter(fails, lambda y: instr(o[1:step - 1], y) > 0)) > 0 AS gone FROM steps, cells),
        sums AS (SELECT part, o AS filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
                 coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (hit AND len(fails) = 1), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM played GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM sums
    """,
}
