"""Queries of ranks, windows, pages and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as O
from ..schemas import memories, oracle, read
from .book import Book
from .joins import KEYWORD, SEMANTIC, candidates

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
S, K = SEMANTIC.format(documents="documents"), KEYWORD.format(documents="documents")


@book.add("w1_rank_results", f"SELECT query_id, memory_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM ({S})) WHERE rank <= 5")
def w1(spark, d):
    return O.rank_results(candidates(spark, d, SEMANTIC), 5).select("query_id", "memory_id", "rank")


@book.add("w2_rerank_order", oracle("SELECT user_id AS query_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, confidence DESC, memory_id) AS rank FROM mem"))
def w2(spark, d):
    return O.rerank_order(memories(spark, d).select(F.col("user_id").alias("query_id"), "memory_id", F.col("importance").alias("score"), "confidence")).select("query_id", "memory_id", "rank")


@book.add("w3_query_floors", f"""
    SELECT query_id, round(greatest(0.255, max(score) - 0.035), 6)::DOUBLE AS visual_floor, coalesce(round(greatest(0.56, max(CASE WHEN query_id < 10 THEN score END) - 0.07), 6), 999.0)::DOUBLE AS semantic_floor FROM ({S}) GROUP BY 1""")
def w3(spark, d):
    c = candidates(spark, d, SEMANTIC).select("query_id", F.col("score").alias("visual"), F.when(F.col("query_id") < 10, F.col("score")).alias("semantic"))
    return O.query_floors(c).withColumns({n: F.round(n, 6) for n in ("visual_floor", "semantic_floor")})


@book.add("w4_mark_duplicates", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) > 1 AS duplicate FROM documents")
def w4(spark, d):
    scan = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat(F.rpad("source", 8, " "), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"))
    return O.mark_duplicates(scan).select("doc_id", "duplicate")


@book.add("w5_best_entity", "SELECT user_id AS memory_id, event_type AS type, n AS normalized, text, confidence FROM (SELECT *, event_id % 3 AS n, CAST(event_id AS STRING) AS text, round(value) AS confidence, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY round(value) DESC, event_id) AS k FROM events) WHERE k = 1")
def w5(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("type"), (F.col("event_id") % 3).alias("normalized"), F.col("event_id").cast("string").alias("text"), F.round("value").alias("confidence"), F.col("event_id").alias("pos"))
    return O.best_entity(e)


@book.add("w6_winner_and_margin", """
    WITH s AS (SELECT user_id, event_type, count(*)::DOUBLE AS score, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS o FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, o) AS n FROM s)
    SELECT user_id AS memory_id, max(event_type) FILTER (n = 1) AS category, max(score) FILTER (n = 1) AS score, coalesce(max(score) FILTER (n = 2), 0) AS second, max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) AS margin,
        coalesce(string_agg(event_type, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 4), '') AS alternatives FROM r GROUP BY 1""")
def w6(spark, d):
    order = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup"])), F.col("event_type"))
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("memory_id"), F.col("event_type").alias("category")).agg(F.count(F.lit(1)).cast("double").alias("score"), F.first(F.when(order > 0, order - 1).otherwise(4)).alias("o"))
    return O.winner_and_margin(s, "category").withColumn("alternatives", F.array_join("alternatives", ","))


@book.add("w7_top_intents", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC, value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def w7(spark, d):
    return O.top_per_key(read(spark, d, "events"), "user_id", 5, F.desc(F.round("value")), F.desc("value"), F.col("event_id")).select("user_id", "event_id", "rank")


@book.add("w8_best_ocr", """
    WITH s AS (SELECT l_orderkey AS memory_id, l_returnflag AS strategy, l_linenumber * 1000000 + l_partkey AS ord, round(0.6 * l_quantity / 100 + 0.2 * least(l_suppkey % 60 / 30, 1.0) + 0.2 * least(l_partkey % 700 / 300, 1.0), 9)::DOUBLE AS score FROM lineitem)
    SELECT memory_id, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, ord) AS n FROM s) WHERE n = 1""")
def w8(spark, d):
    r = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_returnflag").alias("strategy"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_quantity").cast("double").alias("confidence"), (F.col("l_suppkey") % 60).alias("words"), (F.col("l_partkey") % 700).alias("chars"))
    return O.best_ocr(r)


@book.add("w9_offered_load", "SELECT event_id, count(*) OVER (PARTITION BY user_id % 3, event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS load FROM events")
def w9(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("client"), F.col("event_type").alias("area"), F.unix_timestamp("ts").alias("at"))
    return O.offered_load(e, 3600).select("event_id", "load")


@book.add("w10_assign_ids", "SELECT count(*) AS n, min(vector_id) AS low, max(vector_id) AS high, count(DISTINCT vector_id) AS ids FROM (SELECT 500 + row_number() OVER (ORDER BY doc_id) - 1 AS vector_id FROM documents)")
def w10(spark, d):
    return O.assign_ids(read(spark, d, "documents").select("doc_id"), 500, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("vector_id").alias("low"), F.max("vector_id").alias("high"), F.countDistinct("vector_id").alias("ids"))


@book.add("w11_last_turns", "SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def w11(spark, d):
    return O.last_turns(read(spark, d, "conversations"), 3)


@book.add("w12_recent_queries", "SELECT user_id, query, rank FROM (SELECT user_id, lower(event_type) AS query, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, lower(event_type)) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3")
def w12(spark, d):
    return O.recent_queries(read(spark, d, "events").select("user_id", F.col("event_type").alias("query"), F.col("ts").alias("at")), 3).select("user_id", "query", "rank")


@book.add("k5_page", oracle("SELECT memory_id, (SELECT count(*) FROM mem) AS total, (SELECT ceil(count(*) / 20)::BIGINT FROM mem) AS pages, (SELECT count(*) > 60 FROM mem) AS has_next FROM mem ORDER BY created_s DESC, memory_id LIMIT 20 OFFSET 40"))
def k5(spark, d):
    return O.page(memories(spark, d).select("memory_id", "created_s"), 3, 20, F.desc("created_s"), F.col("memory_id")).drop("created_s")


@book.add("k5_page_after", oracle("SELECT memory_id FROM mem WHERE (created_s, memory_id) > (1704240000, 'm48') ORDER BY created_s, memory_id LIMIT 20"))
def k5b(spark, d):
    return O.page_after(memories(spark, d).select("created_s", "memory_id"), (1704240000, "m48"), 20, "created_s", "memory_id").select("memory_id")


@book.add("k6_order_hybrid", oracle("SELECT memory_id, distance FROM (SELECT memory_id, created_s, coalesce(CASE WHEN doc_id % 4 = 0 THEN confidence END, 2.0) AS distance FROM mem) ORDER BY distance, created_s DESC, memory_id LIMIT 15"))
def k6(spark, d):
    m = memories(spark, d).select("memory_id", "created_s", F.when(F.col("doc_id") % 4 == 0, F.col("confidence")).alias("distance"))
    return O.order_hybrid(m, 15).select("memory_id", "distance")


@book.add("k8_sort_entities", "SELECT user_id, string_agg(event_type || round(value)::BIGINT, ',' ORDER BY round(value)::BIGINT DESC, event_type, CAST(event_id AS STRING)) AS entities FROM events GROUP BY 1")
def k8(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.round("value").cast("long").alias("confidence"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("normalized"))).alias("e"))
    return e.select("user_id", F.array_join(F.transform(O.sort_entities(F.col("e")), lambda x: F.concat(x["t"], (-x["c"]).cast("string"))), ",").alias("entities"))


@book.add("k9_top_signals", "SELECT user_id, round(sum(value), 6) AS total, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS k FROM events) WHERE k <= 10 GROUP BY 1")
def k9(spark, d):
    e = O.top_signals(read(spark, d, "events").select("user_id", "value"), "user_id", "value", 10)
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n"))
