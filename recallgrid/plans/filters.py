"""Queries of filters, projections and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import filters as O
from ..schemas import memories, oracle, read
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

@book.add("f1_structured", oracle("SELECT memory_id, category, intent FROM mem WHERE lower(category) = 'document' AND lower(intent) = 'learning' AND instr('the german de text', lower(subcategory)) > 0"))
def f1(spark, d):
    m = memories(spark, d).withColumn("entities", F.array("subcategory"))
    return O.filter_structured(m, "DOCUMENT", "learning", "The German de text").select("memory_id", "category", "intent")


@book.add("f2_date_window", oracle("SELECT memory_id FROM mem WHERE (captured_s >= 1704153600 AND captured_s < 1704240000) OR (created_s >= 1704153600 AND created_s < 1704240000) OR (indexed_s >= 1704153600 AND indexed_s < 1704240000)"))
def f2(spark, d):
    when = O.in_date_window([F.col("captured_s"), F.col("created_s"), F.col("indexed_s")], F.lit(1704153600), F.lit(1704240000))
    return memories(spark, d).where(when).select("memory_id")


@book.add("f3_memories", oracle("SELECT memory_id, confidence FROM mem WHERE status = 'indexed' AND category = 'food' AND created_s >= 1704067200 AND confidence >= 0.2 AND confidence <= 0.9"))
def f3(spark, d):
    return O.filter_memories(memories(spark, d), category="food", status="indexed", created_from=1704067200, confidence_from=0.2, confidence_to=0.9).select("memory_id", "confidence")


@book.add("f4_owner", oracle("SELECT user_id, memory_id FROM mem WHERE user_id = 'src3'"))
def f4(spark, d):
    return O.filter_owner(memories(spark, d), "src3").select("user_id", "memory_id")


@book.add("f5_ilike", oracle("SELECT memory_id FROM mem WHERE status IN ('ready', 'partial') AND (ocr_text ILIKE '%th_nt%' OR filename ILIKE '%th_nt%')"))
def f5(spark, d):
    return O.filter_ilike(memories(spark, d), "th_nt").select("memory_id")


@book.add("f6_json_path", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') = (SELECT min(json_extract_string(props, '$.k')) FROM events)")
def f6(spark, d):
    e = read(spark, d, "events")
    least = e.agg(F.min(F.get_json_object("props", "$.k")).alias("least"))
    return e.join(F.broadcast(least), F.get_json_object("props", "$.k") == F.col("least")).select("event_id", "event_type")


@book.add("f9_drop_rejected", """
    WITH fb AS (SELECT 'm' || CAST(doc_id AS STRING) AS memory_id FROM labels WHERE quality = 0)
    SELECT 'm' || CAST(doc_id AS STRING) AS memory_id, 'q' AS query_norm FROM documents WHERE 'm' || CAST(doc_id AS STRING) NOT IN (SELECT memory_id FROM fb)""")
def f9(spark, d):
    pairs = memories(spark, d).select("memory_id", F.lit("q").alias("query_norm"))
    feedback = read(spark, d, "labels").select(F.concat(F.lit("m"), "doc_id").alias("memory_id"), F.lit("q").alias("query_norm"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("signal"))
    return O.drop_rejected(pairs, feedback).select("memory_id", "query_norm")


@book.add("f10_quality_floor", oracle("""
    WITH s AS (SELECT user_id AS query_id, memory_id, confidence * 60 AS score FROM mem),
    b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s)
    SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM b WHERE score >= greatest(24.0, best - 16.0)) WHERE rank <= 6"""))
def f10(spark, d):
    s = memories(spark, d).select(F.col("user_id").alias("query_id"), "memory_id", (F.col("confidence") * 60).alias("score"))
    return O.quality_floor(s).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


@book.add("f11_meaningful", oracle(r"SELECT memory_id, length(trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g'))) >= 3 AND length(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9]', '', 'g')) >= 2 AS meaningful FROM mem"))
def f11(spark, d):
    return memories(spark, d).select("memory_id", text.is_meaningful(F.col("title")).alias("meaningful"))


@book.add("f12_structured_query", r"SELECT item_id, regexp_matches(text, '[0-9?$@.]') OR regexp_matches(text, '(?i)\b[A-Z]{2,}\d{2,}\b') AS structured FROM benchmark")
def f12(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.is_structured_query(F.col("text")).alias("structured"))


@book.add("f13_high_value_entities", oracle("SELECT memory_id, CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END + CASE WHEN 1 - confidence >= 0.8 THEN 1 ELSE 0 END AS n FROM mem"))
def f13(spark, d):
    e = F.array(*[F.struct(F.lit(n).alias("text"), c.alias("confidence")) for n, c in (("a", F.col("confidence")), ("b", 1 - F.col("confidence")))])
    return memories(spark, d).select("memory_id", F.size(O.high_value_entities(e)).alias("n"))


@book.add("f14_validate_upload", oracle("""
    SELECT memory_id, concat_ws(',', CASE WHEN file_size <= 0 THEN 'empty' END, CASE WHEN file_size > 33554432 THEN 'too_large' END,
        CASE WHEN lower(regexp_extract(filename, '\\.[A-Za-z0-9]+$', 0)) NOT IN ('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.gif', '.tif', '.tiff') THEN 'bad_type' END,
        CASE WHEN least(width, height) < 16 THEN 'too_small' END, CASE WHEN greatest(width, height) > 16000 THEN 'side_too_long' END) AS problems FROM mem""".replace("\\\\", "\\")))
def f14(spark, d):
    found = O.upload_problems(F.col("file_size"), ids.extension(F.col("filename")), F.col("width"), F.col("height"))
    return memories(spark, d).select("memory_id", F.array_join(found, ",").alias("problems"))


@book.add("f15_memory_flags", oracle("""
    SELECT memory_id, status IN ('indexed', 'ready', 'completed') AS is_processed, status IN ('processing', 'queued', 'pending') AS is_processing, status LIKE '%fail%' AS has_error,
        indexed_s IS NOT NULL AS has_embedding, status IN ('indexed', 'ready', 'completed') AND indexed_s IS NOT NULL AND NOT is_deleted AS is_searchable FROM mem"""))
def f15(spark, d):
    return O.memory_flags(memories(spark, d)).select("memory_id", "is_processed", "is_processing", "has_error", "has_embedding", "is_searchable")


@book.add("f16_image_flags", oracle("SELECT memory_id, round(width / height, 6) AS aspect_ratio, width > height AS is_landscape, height > width AS is_portrait, width = height AS is_square, trim(ocr_text) <> '' AS has_ocr, round(width * height / 1e6, 6) AS megapixels FROM mem"))
def f16(spark, d):
    return O.image_flags(memories(spark, d)).select("memory_id", "aspect_ratio", "is_landscape", "is_portrait", "is_square", "has_ocr", "megapixels")


@book.add("f17_project_result", oracle("SELECT memory_id, coalesce(title, 'Untitled Memory') AS title, path AS image_url, substr(ocr_text, 1, 2000) AS ocr_text, round(confidence, 2) AS score, least(30, len(string_split(ocr_text, ' '))) AS n_keywords FROM mem"))
def f17(spark, d):
    return O.project_result(memories(spark, d)).select("memory_id", "title", "image_url", "ocr_text", "score", F.size("keywords").cast("long").alias("n_keywords"))


@book.add("f18_project_detail", oracle("SELECT memory_id, coalesce(nullif(trim(filename), ''), nullif(trim(path), '')) AS filename, nullif(trim(path), '') AS original_image_url, nullif(trim(title), '') AS title, nullif(trim(summary), '') AS summary, nullif(trim(category), '') AS category, sha256(ocr_text) AS image_hash FROM mem"))
def f18_detail(spark, d):
    given = memories(spark, d).select(F.col("memory_id").alias("id"), F.col("filename").alias("original_filename"), F.col("path").alias("image_url"), F.col("title").alias("name"), F.col("summary").alias("description"), "category", F.sha2("ocr_text", 256).alias("sha256"))
    return O.project_detail(given)


@book.add("f18_project_summary", oracle("SELECT memory_id, coalesce(nullif(trim(title), ''), nullif(trim(filename), '')) AS title, coalesce(nullif(trim(summary), ''), nullif(trim(substr(ocr_text, 1, 80)), '')) AS summary, coalesce(nullif(trim(category), ''), 'other') AS category FROM mem"))
def f18(spark, d):
    return O.project_summary(memories(spark, d))


@book.add("f19_image_urls", oracle("""
    SELECT memory_id, path AS image_url, CASE WHEN width > 1000 THEN path || '/preview' ELSE path END AS preview_url,
        CASE WHEN height > 500 THEN path || '/thumb' WHEN width > 1000 THEN path || '/preview' ELSE path END AS thumbnail_url, coalesce(nullif(trim(title), ''), path) AS original_url FROM mem"""))
def f19(spark, d):
    return O.image_urls(memories(spark, d))


@book.add("f20_clean_concepts", oracle("""
    WITH w AS (SELECT memory_id, unnest(string_split(ocr_text, ' ')) AS v, generate_subscripts(string_split(ocr_text, ' '), 1) AS i FROM mem),
    k AS (SELECT memory_id, i, trim(v) AS v, trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) AS k FROM w),
    f AS (SELECT *, row_number() OVER (PARTITION BY memory_id, k ORDER BY i) AS n FROM k WHERE length(k) >= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY i) AS o FROM f WHERE n = 1)
    SELECT m.memory_id, coalesce(string_agg(v, '|' ORDER BY i) FILTER (o <= 5), '') AS concepts FROM mem m LEFT JOIN r USING (memory_id) GROUP BY m.memory_id""".replace("\\\\", "\\").replace("length(k) >= 3", "length(k) >= 3 AND k NOT IN ('" + "', '".join(O.GENERIC_TERMS) + "')")))
def f20(spark, d):
    return memories(spark, d).select("memory_id", F.array_join(O.clean_concepts(F.split(F.col("ocr_text"), " ")), "|").alias("concepts"))


JOBS = """SELECT doc_id AS job_id, 'm' || CAST(doc_id AS STRING) AS memory_id, CASE doc_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'retrying' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
    CAST(doc_id % 6 AS INT) AS attempts, CAST(n_chars * 7 % 5000 AS BIGINT) AS next_attempt_s, CAST(n_chars * 3 % 4000 AS BIGINT) AS created_s FROM {documents}"""


@book.add("f21_due_jobs", f"SELECT job_id, status FROM ({JOBS.format(documents='documents')}) WHERE status = 'queued' OR (status = 'retrying' AND next_attempt_s <= 2500) ORDER BY created_s, job_id LIMIT 10")
def f21(spark, d):
    return O.due_jobs(spark.sql(JOBS, documents=read(spark, d, "documents")), F.lit(2500)).select("job_id", "status")


@book.add("q1_constraints", oracle("""
    SELECT 'confidence_range' AS rule, count(*) FILTER (NOT coalesce(confidence BETWEEN 0 AND 0.9, false)) AS violations FROM mem
    UNION ALL SELECT 'title_not_empty', count(*) FILTER (NOT coalesce(trim(title) <> '', false)) FROM mem
    UNION ALL SELECT 'status_known', count(*) FILTER (NOT coalesce(status IN ('indexed', 'ready', 'partial', 'failed'), false)) FROM mem
    UNION ALL SELECT 'unique_user_id_title', count(*) FROM (SELECT user_id, title FROM mem GROUP BY ALL HAVING count(*) > 1)"""))
def q1(spark, d):
    rules = {"confidence_range": F.col("confidence").between(0, 0.9), "title_not_empty": F.trim("title") != "", "status_known": F.col("status").isin("indexed", "ready", "partial", "failed")}
    return O.check_constraints(memories(spark, d), rules, ["user_id", "title"])


@book.add("q2_validate_mapping", """
    SELECT count(a) AS vectors, count(b) AS mapped, count(*) FILTER (a IS NULL) AS without_vector, count(*) FILTER (b IS NULL) AS unmapped, count(DISTINCT b) = count(b) AND count(DISTINCT vector_id) = count(b) AS one_to_one
    FROM (SELECT vec_id AS a FROM embeddings) FULL OUTER JOIN (SELECT doc_id AS b, doc_id // 2 AS vector_id FROM documents) ON a = b""")
def q2(spark, d):
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"))
    return O.validate_mapping(vectors, read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.floor(F.col("doc_id") / 2).alias("vector_id")))
