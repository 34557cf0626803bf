"""Queries of counts, rates and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import duration_ms
from ..operators import stats as O
from ..schemas import memories, oracle, read
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

PART_WORDS = "string_split(lower(ocr_text), ' ')"


@book.add("a1_category_counts", oracle("SELECT coalesce(nullif(trim(category), ''), 'unclassified') AS category, count(*) AS n FROM mem GROUP BY 1"))
def a1(spark, d):
    return O.category_counts(memories(spark, d), "unclassified")


STATS = """WITH s AS (SELECT count(*) AS total, count(*) FILTER (status LIKE '%fail%') AS failed, count(*) FILTER (status IN ('processing', 'queued', 'pending')) AS processing,
    count(*) FILTER (indexed_s IS NOT NULL OR status IN ('indexed', 'ready', 'completed')) AS indexed FROM mem), p AS (SELECT *, greatest(0, total - failed - processing) AS processed FROM s) """


@book.add("a2_memory_stats", oracle(STATS + "SELECT * FROM p"))
def a2(spark, d):
    return O.memory_stats(memories(spark, d)).drop("success_rate", "indexing_rate")


@book.add("a3_rates", oracle(STATS + "SELECT round(processed / (processed + failed) * 100, 6) AS success_rate, round(indexed / total * 100, 6) AS indexing_rate FROM p"))
def a3(spark, d):
    return O.memory_stats(memories(spark, d)).select("success_rate", "indexing_rate")


@book.add("a4_distribution", oracle("SELECT coalesce(nullif(trim(category), ''), 'other') AS category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM mem), 6)::DOUBLE AS percent FROM mem GROUP BY 1 ORDER BY n DESC, category LIMIT 5"))
def a4(spark, d):
    return O.distribution(memories(spark, d), "category", 5)


def _collections_sql() -> str:
    t = "lower(concat_ws(' ', filename, category, summary, ocr_text))"
    hits = {n: "(" + " OR ".join(f"contains(t, '{x}')" for x in terms) + ")" for n, terms in O.COLLECTIONS.items()}
    parts = [f"SELECT '{n}' AS collection, count(*) AS n FROM x WHERE {h} HAVING count(*) > 0" for n, h in hits.items()]
    parts.append("SELECT 'Other', count(*) FROM x WHERE NOT (" + " OR ".join(hits.values()) + ") HAVING count(*) > 0")
    return oracle(f"WITH x AS (SELECT {t} AS t FROM mem) " + " UNION ALL ".join(parts))


@book.add("a5_collections", _collections_sql())
def a5(spark, d):
    return O.collections(memories(spark, d), F.concat_ws(" ", "filename", "category", "summary", "ocr_text"))


@book.add("a6_suggest", oracle(f"WITH v AS (SELECT unnest(list_distinct({PART_WORDS})) AS value FROM mem) SELECT value, count(*) AS n FROM v WHERE starts_with(trim(regexp_replace(value, '\\s+', ' ', 'g')), 'th') GROUP BY value ORDER BY n DESC, lower(value), value LIMIT 8"))
def a6(spark, d):
    return O.suggest(memories(spark, d), "Th", F.array_distinct(F.split(F.lower(F.col("ocr_text")), " ")))


@book.add("a7_suggest_first", oracle("""
    WITH v AS (SELECT doc_id, unnest(string_split(ocr_text, ' ')) AS value, generate_subscripts(string_split(ocr_text, ' '), 1) AS pos FROM mem WHERE status IN ('ready', 'partial')),
    f AS (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY doc_id DESC, pos, value) AS n FROM v WHERE contains(lower(value), 'an'))
    SELECT value FROM f WHERE n = 1 ORDER BY doc_id DESC, pos, value LIMIT 10"""))
def a7(spark, d):
    m = memories(spark, d).where(F.col("status").isin("ready", "partial"))
    return O.suggest_first(m, "AN", F.split(F.col("ocr_text"), " "), 10, -F.col("doc_id"))


@book.add("a8_search_stats", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (user_id % 5 = 0) AS empty, round(avg(value), 6) AS average_ms, round(avg(user_id % 5), 6) AS average_results FROM events")
def a8(spark, d):
    return O.search_stats(read(spark, d, "events").select((F.col("event_type") != "error").alias("success"), (F.col("user_id") % 5).alias("result_count"), F.col("value").alias("duration_ms")))


@book.add("a9_storage_stats", oracle("SELECT user_id AS area, sum(file_size)::BIGINT AS bytes FROM mem GROUP BY 1 UNION ALL SELECT 'total', sum(file_size)::BIGINT FROM mem"))
def a9(spark, d):
    return O.storage_stats(memories(spark, d).select(F.col("user_id").alias("area"), F.col("file_size").alias("length")))


@book.add("a10_batch_summary", oracle("""
    SELECT user_id AS batch, count(*) FILTER (status IN ('ready', 'indexed')) AS successful, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (is_deleted) AS duplicates, count(*) FILTER (status = 'indexed') AS indexed,
        count(*) FILTER (status = 'failed') = 0 OR count(*) FILTER (status IN ('ready', 'indexed')) > 0 AS success FROM mem GROUP BY 1"""))
def a10(spark, d):
    m = memories(spark, d)
    state = F.when(F.col("status").isin("ready", "indexed"), "ok").when(F.col("status") == "failed", "failed").otherwise("open")
    return O.batch_summary(m.select(F.col("user_id").alias("batch"), state.alias("status"), F.col("is_deleted").alias("duplicate"), (F.col("status") == "indexed").alias("indexed")))


@book.add("a11_run_rollup", """
    WITH s AS (SELECT o_orderkey AS run_id, 4 AS total, count(*) FILTER (l_linestatus = 'O') AS successful, count(*) FILTER (l_linestatus <> 'O') AS failed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT *, successful + failed AS processed, greatest(0, 4 - successful - failed) AS remaining, least(100.0, round((successful + failed) / 4 * 100, 2))::DOUBLE AS progress,
        CASE WHEN successful + failed < 4 THEN 'running' WHEN failed = 0 THEN 'completed' WHEN successful = 0 THEN 'failed' ELSE 'partial' END AS state FROM s""")
def a11(spark, d):
    items = read(spark, d, "lineitem").join(read(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return O.run_rollup(items.select(F.col("o_orderkey").alias("run_id"), F.lit(4).alias("total"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("failed").alias("status")))


@book.add("a12_run_duration", oracle("SELECT memory_id, greatest(0, (coalesce(indexed_s, 0) - created_s) * 1000)::BIGINT AS ms FROM mem"))
def a12(spark, d):
    at = lambda c: F.timestamp_seconds(F.coalesce(F.col(c), F.lit(0)))
    return memories(spark, d).select("memory_id", duration_ms(at("created_s"), at("indexed_s")).alias("ms"))


@book.add("a13_system_stats", oracle("SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(*) FROM mem WHERE indexed_s IS NOT NULL) AS indexed, (SELECT count(*) FROM mem) AS images, (SELECT count(*) - count(DISTINCT sha256(ocr_text)) FROM mem) AS duplicates, (SELECT count(*) FROM events) AS entities"))
def a13(spark, d):
    m = memories(spark, d)
    return O.system_stats(m, m.select(F.sha2("ocr_text", 256).alias("file_hash")), read(spark, d, "events"))


@book.add("a14_ocr_confidence", "SELECT l_orderkey AS memory_id, coalesce(round(avg(l_quantity - 10) FILTER (l_quantity >= 10), 2), 0.0) AS ocr_confidence FROM lineitem GROUP BY 1")
def a14(spark, d):
    return O.ocr_confidence(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), (F.col("l_quantity") - 10).alias("confidence")))


@book.add("a16_memory_confidence", oracle("""
    SELECT memory_id, round((CASE WHEN doc_id % 3 = 0 THEN 0 ELSE confidence * 0.2 END + confidence * 0.2 + 0.5 * 0.2 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (1 - confidence) * 0.25 END)
        / (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0.2 END + 0.4 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 0.25 END), 6) AS confidence FROM mem"""))
def a16(spark, d):
    c = F.col("confidence")
    signals = {"classification": (F.when(F.col("doc_id") % 3 != 0, c), 0.2), "intent": (c, 0.2), "entities": (F.lit(0.5), 0.2), "vision": (F.when(F.col("doc_id") % 4 != 0, 1 - c), 0.25), "ocr": (F.lit(None).cast("double"), 0.15)}
    return memories(spark, d).select("memory_id", F.round(O.weighted_confidence(signals), 6).alias("confidence"))


@book.add("a17_completeness", oracle("""
    SELECT memory_id, round(CASE WHEN status = 'indexed' THEN 0.35 ELSE 0 END + 0.15 + CASE WHEN trim(title) <> '' THEN 0.1 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 0.1 ELSE 0 END
        + CASE WHEN trim(category) <> '' THEN 0.1 ELSE 0 END + 0.1, 4)::DOUBLE AS confidence FROM mem"""))
def a17(spark, d):
    flags = {"vision": F.col("status") == "indexed", "ocr": F.trim("ocr_text") != "", "title": F.trim("title") != "", "summary": F.col("summary").isNotNull(), "category": F.trim("category") != "", "search_text": F.lit(True)}
    return memories(spark, d).select("memory_id", O.completeness(flags).alias("confidence"))


@book.add("a18_entities_by_type", "SELECT user_id AS memory_id, event_type AS type, string_agg(CAST(event_id AS STRING), ',' ORDER BY event_id) AS texts FROM events GROUP BY ALL")
def a18(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("type"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("text"))
    return O.entities_by_type(e).withColumn("texts", F.array_join("texts", ","))


@book.add("a19_user_stats", oracle("SELECT user_id, count(*) AS total, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status IN ('processing', 'queued')) AS processing FROM mem GROUP BY 1"))
def a19(spark, d):
    return O.user_stats(memories(spark, d))


@book.add("a20_scan_stats", "SELECT count(*) AS files, count(DISTINCT sha256(text)) AS unique_hashes, count(*) FILTER (n_chars < 100) AS invalid, count(*) FILTER (sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 9 = 0)) AS indexed_before, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents")
def a20(spark, d):
    scan = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), (F.col("n_chars") >= 100).alias("valid"))
    return O.scan_stats(scan, scan.where("doc_id % 9 = 0"))


@book.add("a21_ingest_progress", "SELECT event_type AS phase, count(*) AS n FROM events GROUP BY 1")
def a21(spark, d):
    return O.phase_counts(read(spark, d, "events").select(F.col("event_type").alias("phase")))


@book.add("a22_vector_store_stats", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS mapped, max(len(embedding))::INT AS dimension, max(vec_id) + 1 AS next_id FROM embeddings")
def a22(spark, d):
    return O.vector_store_stats(read(spark, d, "embeddings"))


@book.add("a23_result_set_stats", oracle("SELECT user_id AS query_id, count(*) AS result_count, arg_max(memory_id, confidence * 1000000000 + doc_id) AS top_id, max(confidence) AS top_score, round(avg(confidence), 6) AS average_score FROM mem GROUP BY 1"))
def a23(spark, d):
    m = memories(spark, d).select(F.col("user_id").alias("query_id"), F.col("doc_id").alias("memory_id"), F.col("confidence").alias("score"))
    return O.result_set_stats(m).withColumn("top_id", F.concat(F.lit("m"), "top_id"))


@book.add("a24_suggest_recent", """
    WITH h AS (SELECT user_id, lower(q) AS k, arg_max(q, ts) AS value, max(ts) AS ts FROM (SELECT user_id, ts, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' ' || CAST(event_id % 4 AS STRING) AS q FROM events) GROUP BY ALL),
    a AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'Er' WHEN 1 THEN '' ELSE 'i' END AS text FROM events),
    d AS (SELECT unnest(range(6)) AS i, unnest(['the shoes I wanted to buy', 'my Python study notes', 'receipt from my online order', 'travel information I saved', 'the address from my screenshot', 'that coding error I saved']) AS value),
    u AS (SELECT a.user_id, text, value, 0 AS o, 0 AS i, ts FROM a JOIN h USING (user_id) WHERE contains(k, lower(text)) UNION ALL SELECT user_id, text, value, 1, i, NULL FROM a, d WHERE contains(lower(value), lower(text)))
    SELECT user_id, text, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY o, ts DESC, i, value) AS rank FROM u) WHERE rank <= 8""")
def a24_recent(spark, d):
    e = read(spark, d, "events")
    name = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), (F.col("event_id") % 4).cast("string"))
    asked = e.select("user_id").distinct().withColumn("text", F.when(F.col("user_id") % 3 == 0, "Er").when(F.col("user_id") % 3 == 1, "").otherwise("i"))
    return O.suggest_recent(asked, e.select("user_id", name.alias("query"), "ts"))


@book.add("a24_starter_suggestions", oracle("""
    WITH v AS (SELECT doc_id, unnest(list_prepend(trim(category), string_split(ocr_text, ' '))) AS value, unnest(range(len(string_split(ocr_text, ' ')) + 1)) AS pos FROM mem WHERE trim(category) <> '')
    SELECT value FROM v GROUP BY value ORDER BY min(doc_id * 1000000 + pos) LIMIT 8"""))
def a24(spark, d):
    return O.starter_suggestions(memories(spark, d))


@book.add("a25_processing_summary", "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS indexed, count(*) FILTER (value > 10) AS ocr_ok, count(*) FILTER (value > 20) AS vision_ok, count(*) FILTER (value > 50) AS embedding_ok, round(sum(value), 2) AS total_ms, round(avg(value), 2) AS average_ms FROM events")
def a25(spark, d):
    v = F.col("value")
    return O.processing_summary(read(spark, d, "events").select((F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("indexed"), (v > 10).alias("ocr"), (v > 20).alias("vision"), (v > 50).alias("embedding"), v.alias("duration_ms")))
