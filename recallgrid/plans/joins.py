"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_intersection
from ..operators import joins as O
from ..schemas import memories, oracle, read
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

# Candidates by arithmetic on the documents, as both engines read it.
SEMANTIC = "SELECT doc_id % 20 AS query_id, 'm' || CAST(doc_id AS STRING) AS memory_id, CAST(n_chars % 100 AS DOUBLE) / 100 AS score FROM {documents} WHERE doc_id % 3 <> 0"
KEYWORD = "SELECT doc_id % 20 AS query_id, 'm' || CAST(doc_id AS STRING) AS memory_id, CAST(n_chars % 37 AS DOUBLE) / 37 AS score FROM {documents} WHERE doc_id % 2 = 0"


def candidates(spark, d, sql):
    return spark.sql(sql, documents=read(spark, d, "documents"))


@book.add("j1_merge_candidates", f"""
    SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.memory_id, k.memory_id) AS memory_id, round(coalesce(s.score, 0), 9) AS semantic_score, round(coalesce(k.score, 0), 9) AS keyword_score
    FROM ({SEMANTIC.format(documents='documents')}) s FULL OUTER JOIN ({KEYWORD.format(documents='documents')}) k ON s.query_id = k.query_id AND s.memory_id = k.memory_id""")
def j1(spark, d):
    found = O.merge_candidates(candidates(spark, d, SEMANTIC), candidates(spark, d, KEYWORD))
    return found.withColumns({c: F.round(c, 9) for c in ("semantic_score", "keyword_score")})


@book.add("j2_attach_memory", oracle(f"""
    SELECT query_id, c.memory_id, coalesce(title, 'Untitled Memory') AS title, coalesce(category, 'other') AS category, coalesce(intent, 'unknown') AS intent
    FROM ({SEMANTIC.format(documents='documents')}) c LEFT JOIN (SELECT * FROM mem WHERE doc_id % 7 <> 0) m ON c.memory_id = m.memory_id"""))
def j2(spark, d):
    return O.attach_memory(candidates(spark, d, SEMANTIC).drop("score"), memories(spark, d).where("doc_id % 7 <> 0"))


@book.add("j3_attach_scores", f"""
    SELECT 'm' || CAST(d.doc_id AS STRING) AS memory_id, round(coalesce(s.score, 0), 9) AS semantic, round(coalesce(k.score, 0), 9) AS keyword
    FROM documents d LEFT JOIN ({SEMANTIC.format(documents='documents')}) s ON 'm' || CAST(d.doc_id AS STRING) = s.memory_id LEFT JOIN ({KEYWORD.format(documents='documents')}) k ON 'm' || CAST(d.doc_id AS STRING) = k.memory_id""")
def j3(spark, d):
    found = O.attach_scores(memories(spark, d).select("memory_id"), {"semantic": candidates(spark, d, SEMANTIC), "keyword": candidates(spark, d, KEYWORD)})
    return found.select("memory_id", F.round("semantic", 9).alias("semantic"), F.round("keyword", 9).alias("keyword"))


@book.add("j4_attach_feedback", "SELECT 'm' || CAST(d.doc_id AS STRING) AS memory_id, CASE WHEN quality = 1 THEN 14.0 WHEN quality = 0 THEN -60.0 ELSE 0.0 END::DOUBLE AS adjustment FROM documents d LEFT JOIN labels USING (doc_id)")
def j4(spark, d):
    pairs = memories(spark, d).select("memory_id", F.lit("q").alias("query_norm"))
    fb = read(spark, d, "labels").select(F.concat(F.lit("m"), "doc_id").alias("memory_id"), F.lit("q").alias("query_norm"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("signal"))
    return O.attach_feedback(pairs, fb).select("memory_id", "adjustment")


@book.add("j5_union_candidates", "SELECT 'm' || CAST(doc_id AS STRING) AS memory_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0 ELSE 2.0 END AS distance FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def j5(spark, d):
    docs = read(spark, d, "documents").withColumn("memory_id", F.concat(F.lit("m"), "doc_id"))
    return O.union_candidates(docs.where("doc_id % 2 = 0").select("memory_id"), docs.where("doc_id % 3 = 0").select("memory_id", (F.col("doc_id") % 10 / 10.0).alias("distance")))


@book.add("j8_new_content", "SELECT doc_id, text_hash FROM (SELECT doc_id, sha256(text) AS text_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND text_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def j8(spark, d):
    scan = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return O.new_content(scan, scan.where("doc_id % 10 = 0"), "text_hash", "doc_id")


@book.add("j9_find_duplicates", "SELECT a.doc_id, b.duplicate_of FROM documents a JOIN (SELECT source, sha256(text) AS h, min(doc_id) AS duplicate_of FROM documents GROUP BY ALL) b ON a.source = b.source AND sha256(a.text) = b.h WHERE b.duplicate_of <> a.doc_id")
def j9(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return O.duplicates_of(docs, docs.withColumnRenamed("doc_id", "memory_id"), ["source", "h"]).where("duplicate_of <> doc_id").select("doc_id", "duplicate_of")


RULES = [("law", "license"), ("law", "public license"), ("small", "the"), ("small", "and"), ("phrase", "of the"), ("phrase", "que la")]


@book.add("j11_dictionary_match", """
    WITH r(label, term) AS (VALUES ('law', 'license'), ('law', 'public license'), ('small', 'the'), ('small', 'and'), ('phrase', 'of the'), ('phrase', 'que la')),
    t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS token FROM documents)
    SELECT doc_id, label, term FROM t JOIN r ON token = term WHERE NOT contains(term, ' ')
    UNION ALL SELECT doc_id, label, term FROM documents, r WHERE contains(term, ' ') AND contains(lower(text), term)""".replace("\\\\", "\\"))
def j11(spark, d):
    return O.dictionary_hits(read(spark, d, "documents").select("doc_id", "text"), spark.createDataFrame(RULES, "label string, term string"), "doc_id")


WEIGHTS = [("view", "INFORMATION", 0.3), ("purchase", "BUY", 0.9), ("purchase", "PAYMENT", 0.7), ("signup", "SOCIAL", 0.5)]


@book.add("j12_weigh_entities", """
    SELECT user_id AS memory_id, intent, round(sum(weight * value), 6) AS score FROM events JOIN (VALUES ('view', 'INFORMATION', 0.3), ('purchase', 'BUY', 0.9), ('purchase', 'PAYMENT', 0.7), ('signup', 'SOCIAL', 0.5)) w(type, intent, weight) ON event_type = type GROUP BY ALL""")
def j12(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("type"), F.col("value").alias("confidence"))
    return O.weigh_entities(e, spark.createDataFrame(WEIGHTS, "type string, intent string, weight double")).withColumn("score", F.round("score", 6))


@book.add("j13_primary_image", "SELECT l_orderkey AS memory_id, arg_min(l_linenumber, (CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) * 1000 + l_linenumber) AS image_id FROM lineitem GROUP BY l_orderkey")
def j13(spark, d):
    images = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").alias("image_id"), F.col("l_linenumber").alias("sequence"), (F.col("l_linestatus") == "O").alias("is_primary"))
    return O.primary_image(images)


@book.add("j14_attach_by_position", "SELECT doc_id, i AS pos, a AS file, b AS meta FROM (SELECT doc_id, unnest(range(3)) AS i, unnest(string_split(text, ' ')[1:3]) AS a, unnest(list_resize(string_split(substr(text, 20), ' ')[1:2], 3)) AS b FROM documents WHERE len(string_split(text, ' ')) >= 3 AND len(string_split(substr(text, 20), ' ')) >= 2)")
def j14(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.split(F.col("text"), " ").alias("f"), F.split(F.substring("text", 20, 1 << 30), " ").alias("m")).where("size(f) >= 3 and size(m) >= 2")
    return O.attach_by_position(docs.select("doc_id", F.slice("f", 1, 3).alias("f")), docs.select("doc_id", F.slice("m", 1, 2).alias("m")), "f", "m", "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "file", "meta")


@book.add("x1_merge_keywords", """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents
        UNION ALL SELECT doc_id, unnest(string_split(substr(text, 40), ' ')), 1000000 + generate_subscripts(string_split(substr(text, 40), ' '), 1) FROM documents),
    f AS (SELECT doc_id, i, trim(v) AS v, row_number() OVER (PARTITION BY doc_id, lower(trim(v)) ORDER BY i) AS n FROM w WHERE trim(v) <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM f WHERE n = 1)
    SELECT doc_id, string_agg(v, '|' ORDER BY i) AS words FROM r WHERE o <= 30 GROUP BY doc_id""")
def x1(spark, d):
    words = O.merge_words(F.split(F.col("text"), " "), F.split(F.substring("text", 40, 1 << 30), " "), 30)
    return read(spark, d, "documents").select("doc_id", F.array_join(words, "|").alias("words"))


@book.add("x2_token_intersection", "SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower('The license of that and the event is public'), '[a-z0-9]+'))) AS n FROM documents")
def x2(spark, d):
    common = token_intersection(F.lit("The license of that and the event is public"), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(common).cast("long").alias("n"))


@book.add("x3_merge_pages", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 0 ELSE 1 END AS page FROM documents WHERE lang IN ('en', 'de') OR n_chars % 2 = 0")
def x3(spark, d):
    docs = read(spark, d, "documents")
    pages = [docs.where("lang in ('en', 'de')"), docs.where("n_chars % 2 = 0")]
    return O.merge_pages([p.select("doc_id", F.lit(i).alias("page")) for i, p in enumerate(pages)], "doc_id")


@book.add("x4_except_seen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def x4(spark, d):
    return O.except_ids(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@book.add("x5_dedup_list", """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS v, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    f AS (SELECT doc_id, i, trim(v) AS v, row_number() OVER (PARTITION BY doc_id, trim(v) ORDER BY i) AS n FROM w WHERE trim(v) <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM f WHERE n = 1)
    SELECT doc_id, string_agg(v, '|' ORDER BY i) AS words FROM r WHERE o <= 12 GROUP BY doc_id""")
def x5(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(O.dedup_words(F.split("text", " "), 12), "|").alias("words"))
