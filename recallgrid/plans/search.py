"""Queries of retrieval, scores and whole searches.

Queries are the benchmark's passages, whole; documents are the memories, embeddings the vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as R
from ..operators import search as S
from ..operators import vectors as V
from ..schemas import memories, oracle, read
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
DOC_TOKENS = r"regexp_extract_all(" + NORM + r", '[a-zA-Z0-9₹$@._-]+')"
TOKENS = "regexp_extract_all({}, '[a-zA-Z0-9₹$@._-]+')"
Q = f"(SELECT item_id AS query_id, list_filter({DOC_TOKENS.format('text')}, lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t)) AS t, text FROM benchmark)"
HITS = f"""
    WITH q AS (SELECT query_id, list_distinct(t) AS t FROM {Q}), qt AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q),
    d AS (SELECT doc_id, unnest(list_distinct({DOC_TOKENS.format('text')})) AS token FROM documents),
    s AS (SELECT query_id, 'm' || CAST(doc_id AS STRING) AS memory_id, count(*) / any_value(n) AS score FROM qt JOIN d USING (token) GROUP BY ALL)"""


def queries_of(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.meaningful_tokens(F.col("text")).alias("q_tokens"), F.col("text").alias("query_text"))


@book.add("flagship_lexical_top5", HITS + " SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 5")
def flagship(spark, d):
    from ..operators.windows import rank_results

    found = S.lexical_scores(queries_of(spark, d), S.token_index(memories(spark, d)))
    return rank_results(found, 5).withColumn("score", F.round("score", 6))


@book.add("r6_keyword_score", HITS + " SELECT query_id, memory_id, round(score, 6) AS score FROM s WHERE score >= 0.5")
def r6(spark, d):
    return S.lexical_scores(queries_of(spark, d), S.token_index(memories(spark, d))).withColumn("score", F.round("score", 6))


VEC = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def unit_vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def knn_sql(k: int, where: str, more: str = "") -> str:
    return f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS rank FROM {VEC} a, {VEC} b WHERE {where}) WHERE rank <= {k} {more}"


@book.add("k1_knn", knn_sql(5, "a.vec_id % 50 = 0"))
def k1(spark, d):
    v = unit_vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, 5).withColumn("score", F.round("score", 6))


@book.add("k1_knn_floor", knn_sql(50, "a.vec_id % 50 = 0", "AND score >= 0.15"))
def k1b(spark, d):
    v = unit_vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, 50, min_score=0.15).withColumn("score", F.round("score", 6))


@book.add("k2_knn_distance", f"""
    SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS score FROM {VEC} a, {VEC} b WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""")
def k2(spark, d):
    v = unit_vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, 5, distance=True)


@book.add("k3_approx_knn")
def k3(spark, d):
    v = unit_vectors(spark, d)
    return V.approx_knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@book.add("k4_retrieval_depth", knn_sql(15, "a.vec_id % 50 = 0"))
def k4(spark, d):
    v = unit_vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), v, V.retrieval_k(5)).withColumn("score", F.round("score", 6))


@book.add("w13_vector_rank", knn_sql(3, "a.vec_id % 50 = 1"))
def w13(spark, d):
    v = unit_vectors(spark, d)
    return V.knn(v.where("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), "vec"), v, 3).withColumn("score", F.round("score", 6))


@book.add("j6_related", knn_sql(4, "a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"))
def j6(spark, d):
    v = unit_vectors(spark, d)
    return S.related(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("memory_id")), 4).withColumn("score", F.round("score", 6))


@book.add("j7_related_text", f"""
    WITH q AS (SELECT doc_id AS query_id, list_distinct(list_filter({DOC_TOKENS.format('text')}, lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))) AS t FROM documents WHERE doc_id % 50 = 0),
    qt AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q), d AS (SELECT doc_id, unnest(list_distinct({DOC_TOKENS.format('text')})) AS token FROM documents),
    s AS (SELECT query_id, 'm' || CAST(doc_id AS STRING) AS memory_id, count(*) / any_value(n) AS score FROM qt JOIN d USING (token) WHERE query_id <> doc_id GROUP BY query_id, doc_id)
    SELECT query_id, memory_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 5""")
def j7(spark, d):
    m = memories(spark, d)
    q = m.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("memory_id").alias("own"), T.meaningful_tokens(F.col("ocr_text")).alias("q_tokens"))
    from ..operators.scans import overlaps
    from ..operators.windows import rank_results

    return rank_results(overlaps(q, m), 5)


@book.add("r5_hybrid_score", oracle("SELECT memory_id, round(least(greatest(confidence, 0), 1) * 0.65 + least(greatest(importance / 5, 0), 1) * 0.35, 6) AS score FROM mem"))
def r5(spark, d):
    return memories(spark, d).select("memory_id", R.hybrid_score(F.col("confidence"), F.col("importance") / 5).alias("score"))


@book.add("r7_exact_match", "SELECT doc_id, CASE WHEN contains(lower(text), 'of the') THEN 1.0 WHEN contains(lower(text), 'of') THEN 0.85 ELSE 0.0 END::DOUBLE AS score FROM documents")
def r7(spark, d):
    return read(spark, d, "documents").select("doc_id", R.exact_match(F.lit("of the"), F.lower("text"), F.array(F.lit("of"))).alias("score"))


@book.add("r8_entity_score", oracle("SELECT memory_id, round((CASE WHEN contains('pay for food in de', subcategory) THEN 1 ELSE 0 END + CASE WHEN trim(category) <> '' AND contains('pay for food in de', lower(category)) THEN 1 ELSE 0 END) / (1 + CASE WHEN trim(category) <> '' THEN 1 ELSE 0 END), 6) AS score FROM mem"))
def r8(spark, d):
    return memories(spark, d).select("memory_id", F.round(R.entity_share(F.lit("pay for food in de"), F.array_compact(F.array("subcategory", "category"))), 6).alias("score"))


@book.add("r9_metadata_score", oracle("SELECT memory_id, round((CASE WHEN lower(category) = 'food' THEN 1 ELSE 0 END + CASE WHEN subcategory = 'en' THEN 1 ELSE 0 END + CASE WHEN lower(intent) = 'travel' OR lower(category) = 'travel' THEN 1 ELSE 0 END) / 3, 6) AS score FROM mem"))
def r9(spark, d):
    meta = T.tokenize_rerank(F.concat_ws(" ", "category", "subcategory", "intent"))
    return memories(spark, d).select("memory_id", F.round(R.overlap(F.array(F.lit("food"), F.lit("en"), F.lit("travel")), meta), 6).alias("score"))


@book.add("r10_recency", oracle("SELECT memory_id, round(exp(-greatest((1711929600 - coalesce(captured_s, created_s)) / 86400, 0) / 120), 6) AS score FROM mem"))
def r10(spark, d):
    return memories(spark, d).select("memory_id", F.round(R.recency(F.lit(1711929600), F.col("captured_s"), F.col("created_s")), 6).alias("score"))


@book.add("r11_agreement", oracle("SELECT memory_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM mem"))
def r11(spark, d):
    k = F.col("doc_id") % 3
    return memories(spark, d).select("memory_id", R.agreement(F.array(F.when(k > 0, "Vector ").otherwise(""), F.when(k == 2, "keyword").when(k == 1, "vector").otherwise(""))).alias("score"))


@book.add("r12_final_score", oracle("""
    WITH p AS (SELECT memory_id, confidence AS a, importance / 5 AS b, (doc_id % 7) / 6 AS c FROM mem), s AS (SELECT *, round(0.40 * a + 0.18 * b + 0.12 * c + 0.10 * a + 0.08 * b + 0.05 * c + 0.07 * a, 6) AS score FROM p)
    SELECT memory_id, score, round(least(1, score + 0.08 * a + 0.07 * b), 4) AS confidence FROM s"""))
def r12(spark, d):
    a, b, c = F.col("confidence"), F.col("importance") / 5, F.col("doc_id") % 7 / 6
    m = memories(spark, d).withColumn("score", R.final_score({"semantic": a, "keyword": b, "entity": c, "metadata": a, "exact": b, "recency": c, "agreement": a}))
    return m.select("memory_id", "score", R.confidence(F.col("score"), a, b).alias("confidence"))


@book.add("r13_rerank")
def r13(spark, d):
    q = queries_of(spark, d)
    c = S.lexical_scores(q, S.token_index(memories(spark, d))).select("query_id", "memory_id", F.col("score").alias("semantic"), F.array(F.lit("keyword")).alias("sources"))
    return S.rerank(q, c, memories(spark, d), F.lit(1711929600))


@book.add("r16_explain_hybrid", oracle("""SELECT memory_id, 'Matched because of ' || coalesce(nullif(concat_ws(', ', CASE WHEN confidence >= 0.8 THEN 'strong semantic similarity' WHEN confidence >= 0.6 THEN 'good semantic similarity' END,
    CASE WHEN contains(lower(ocr_text), 'the') THEN 'keyword match: the' END, CASE WHEN importance >= 4 THEN 'metadata strongly matches' END), ''), 'the memory is relevant based on the combined search signals') || '.' AS reason FROM mem"""))
def r16(spark, d):
    terms = F.filter(F.array(F.lit("the")), lambda t: F.contains(F.lower("ocr_text"), t))
    return memories(spark, d).select("memory_id", R.explain_hybrid(F.col("confidence"), F.col("importance") / 5, terms, F.array().cast("array<string>")).alias("reason"))


@book.add("r17_explain_rerank", oracle("""SELECT memory_id, coalesce(nullif(concat_ws('; ', CASE WHEN confidence >= 0.8 THEN 'strong semantic similarity' WHEN confidence >= 0.6 THEN 'good semantic similarity' END, CASE WHEN importance >= 4 THEN 'multiple keyword matches' WHEN importance >= 2 THEN 'keyword overlap' END,
    CASE WHEN is_deleted THEN 'exact phrase match' END), ''), 'combined retrieval signals indicate relevance') AS reasons FROM mem"""))
def r17(spark, d):
    zero = F.lit(0.0)
    parts = {"semantic": F.col("confidence"), "keyword": F.col("importance") / 5, "exact": F.when(F.col("is_deleted"), 1.0).otherwise(0.0), "metadata": zero, "agreement": zero, "recency": zero}
    return memories(spark, d).select("memory_id", F.array_join(R.explain_rerank(parts), "; ").alias("reasons"))


@book.add("r18_explain_semantic", oracle("SELECT memory_id, concat_ws('; ', CASE WHEN contains(lower(ocr_text), 'und') THEN 'contains: und' END, CASE WHEN coalesce(category, 'other') <> 'other' THEN 'category: ' || category END, CASE WHEN confidence >= 0.75 THEN 'very similar meaning' WHEN confidence >= 0.55 THEN 'similar meaning' END) AS why FROM mem"))
def r18(spark, d):
    terms = F.filter(F.array(F.lit("und")), lambda t: F.contains(F.lower("ocr_text"), t))
    return memories(spark, d).select("memory_id", R.explain_semantic(F.col("confidence"), terms, F.col("category")).alias("why"))


@book.add("r19_why_matched", oracle("SELECT memory_id, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'Semantic' END, CASE WHEN contains(ocr_text, 'the') THEN 'OCR' END, CASE WHEN category = 'food' THEN 'Concept' END, CASE WHEN contains(filename, '7') THEN 'Filename' END) AS why FROM mem"))
def r19(spark, d):
    why = R.why_matched(F.when(F.col("confidence") < 0.5, F.col("confidence")).otherwise(2.0), F.contains("ocr_text", F.lit("the")), F.col("category") == "food", F.contains("filename", F.lit("7")))
    return memories(spark, d).select("memory_id", F.array_join(why, ",").alias("why"))


@book.add("c48_match_kinds", oracle("SELECT memory_id, CASE doc_id % 3 WHEN 0 THEN 'Visual,OCR' WHEN 1 THEN 'Semantic,Filename' ELSE 'Concept' END AS kinds FROM mem"))
def c48(spark, d):
    k = F.col("doc_id") % 3
    reasons = F.when(k == 0, F.array(F.lit("Matched visually using image content"), F.lit("Matched by text: a"), F.lit("visual"))).when(k == 1, F.array(F.lit("Matched by semantic meaning"), F.lit("Filename matched"))).otherwise(F.array(F.lit("Category matched")))
    return memories(spark, d).select("memory_id", F.array_join(R.match_kinds(reasons), ",").alias("kinds"))


@book.add("c43_date_window", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\byesterday\\b') THEN '2024-03-09' WHEN regexp_matches(lower(text), '\\btoday\\b') THEN '2024-03-10' END AS day, length(CASE WHEN rest = '' THEN 'photo' ELSE rest END) AS n FROM (SELECT *, trim(regexp_replace(regexp_replace(text, '(?i)\\b(?:today|yesterday)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS rest FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'today ' || text WHEN 1 THEN 'Yesterday' ELSE text END AS text FROM conversations))".replace("\\\\", "\\"))
def c43(spark, d):
    k = F.col("turn") % 3
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(k == 0, F.concat(F.lit("today "), F.col("text"))).when(k == 1, "Yesterday").otherwise(F.col("text")).alias("text"))
    return S.date_window(c, "text", F.lit("2024-03-10").cast("date")).select("conv_id", "turn", F.col("date_from").cast("string").alias("day"), F.length("search_text").cast("long").alias("n"))


@book.add("c44_understand_query")
def c44(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("gestern Rechnung "), "text").alias("query_text"))
    return S.understand_queries(q, F.lit("2024-03-10").cast("date")).select("query_id", "search_text", "q_norm", F.array_join("q_tokens", " ").alias("tokens"), F.col("date_from").cast("string").alias("day"))


@book.add("k7_fast_lookup", oracle(f"""
    WITH q AS {Q}, p AS (SELECT query_id, memory_id, t, lower(concat_ws(' ', filename, category, summary, ocr_text)) AS x FROM mem, q WHERE len(t) > 0),
    h AS (SELECT *, list_filter(t, lambda w: contains(x, w)) AS h FROM p), s AS (SELECT query_id, memory_id, len(h) / len(t) AS ratio, len(t) AS n,
        len(h) / len(t) * 6 + list_sum(list_transform(h, lambda w: CASE WHEN length(w) >= 5 THEN 3 ELSE 2 END)) + CASE WHEN contains(x, array_to_string(t, ' ')) THEN 8 ELSE 0 END AS score FROM h WHERE len(h) > 0)
    SELECT query_id, memory_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id DESC) AS rank FROM s WHERE ratio >= 0.5 OR n = 1) WHERE rank <= 4"""))
def k7(spark, d):
    return S.fast_lookup(queries_of(spark, d), memories(spark, d))


#: Depth and floor of the semantic and of the visual search.
SEMANTIC_K, SEMANTIC_FLOOR, VISUAL_K = 50, 0.15, 80


def pairs_of(spark, d):
    """Visual and semantic candidates: a query's vector is the embedding numbered 50 times its id; its first half stands for the visual space."""
    v = unit_vectors(spark, d)
    q = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), "vec").join(queries_of(spark, d).select("query_id"), "query_id", "left_semi")
    half = lambda df: df.withColumn("vec", F.slice("vec", 1, 32))
    named = lambda df: df.select("query_id", F.concat(F.lit("m"), "vec_id").alias("memory_id"), F.round("score", 6).alias("score"))
    return named(V.knn(half(q), half(v), VISUAL_K)), named(V.knn(q, v, SEMANTIC_K, min_score=SEMANTIC_FLOOR))


def near_sql(name: str, v: str, k: int, floor: float | None = None) -> str:
    return f"""{name} AS (SELECT query_id, memory_id, round(score, 6) AS score FROM (
        SELECT a.vec_id // 50 AS query_id, 'm' || CAST(b.vec_id AS STRING) AS memory_id, list_inner_product(a.{v}, b.{v}) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.{v}, b.{v}) DESC, b.vec_id) AS r
        FROM {VEC2} a, {VEC2} b WHERE a.vec_id % 50 = 0 AND a.vec_id // 50 IN (SELECT item_id FROM benchmark)) WHERE r <= {k} {"" if floor is None else f"AND score >= {floor}"})"""


VEC2 = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS h FROM embeddings)"
SEM, VIS = near_sql("sem", "v", SEMANTIC_K, SEMANTIC_FLOOR), near_sql("vis", "h", VISUAL_K)


#: The day on which queries are asked; every fourth passage is asked for yesterday's memories, in German or English.
TODAY = "2024-03-10"
ASKED_SQL = S.translated_sql("CASE item_id % 4 WHEN 1 THEN 'gestern ' WHEN 3 THEN 'Yesterday ' ELSE '' END || text")


P1 = oracle(f"""
    WITH q0 AS (SELECT item_id AS query_id, {ASKED_SQL} AS tr FROM benchmark),
    q1 AS (SELECT query_id, CASE WHEN regexp_matches(lower(tr), '\\byesterday\\b') THEN 1710028800 - 86400 WHEN regexp_matches(lower(tr), '\\btoday\\b') THEN 1710028800 END AS df,
        trim(regexp_replace(regexp_replace(tr, '(?i)\\b(?:today|yesterday)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS st FROM q0),
    q AS (SELECT query_id, df, tl, list_distinct(tl) AS t, {NORM.format("st")} AS qn FROM (SELECT *, list_filter({DOC_TOKENS.format("st")}, lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w)) AS tl FROM q1)),
    {SEM}, {VIS},
    near AS (SELECT query_id, memory_id, any_value(v) AS v, any_value(s) AS s FROM (SELECT query_id, memory_id, score AS v, NULL AS s FROM vis UNION ALL SELECT query_id, memory_id, NULL, score FROM sem) GROUP BY ALL),
    fl AS (SELECT query_id, greatest(0.255, max(v) - 0.035) AS vf, greatest(0.56, max(s) - 0.07) AS sf FROM near GROUP BY 1),
    fb AS (SELECT 'm' || CAST(doc_id AS STRING) AS memory_id, doc_id // 50 AS query_id, quality FROM labels),
    m0 AS MATERIALIZED (SELECT *, {NORM.format("ocr_text")} AS ocr, {NORM.format("concat_ws(' ', filename, category, title)")} AS con, {NORM.format("concat_ws(chr(10), title, summary, ocr_text)")} AS doc FROM mem),
    m AS MATERIALIZED (SELECT *, {TOKENS.format("ocr")} AS ot, {TOKENS.format("con")} AS ct, {DOC_TOKENS.format("coalesce(summary, '')")} AS smt, {DOC_TOKENS.format("filename")} AS ft, {DOC_TOKENS.format("coalesce(category, '')")} AS cat FROM m0),
    x AS (SELECT q.query_id, q.df, q.t, q.tl, q.qn, m.*, coalesce(n.v, 0) AS v, coalesce(n.s, 0) AS s, coalesce(vf, 999) AS vf, coalesce(sf, 999) AS sf, len(q.t) AS nt,
        len(list_intersect(q.t, ot)) AS oh, len(list_intersect(q.t, ct)) AS ch, length(qn) >= 3 AND contains(con, qn) AS ec, length(qn) >= 3 AND contains(ocr, qn) AS eo,
        regexp_matches(qn, '[0-9?$@.]') OR regexp_matches(qn, '(?i)\\b[A-Z]{{2,}}\\d{{2,}}\\b') AS st,
        len(list_intersect(q.t, smt)) AS sh, len(list_intersect(q.t, ft)) AS fh, len(list_intersect(q.t, cat)) AS cah
        FROM q CROSS JOIN m LEFT JOIN near n ON n.query_id = q.query_id AND n.memory_id = m.memory_id LEFT JOIN fl ON fl.query_id = q.query_id WHERE len(q.t) > 0),
    e AS (SELECT *, v >= vf AS ev, ch > 0 OR ec AS ecn, s >= sf AND (nt >= 2 OR ch > 0 OR v >= vf) AS es,
        CASE WHEN nt >= 2 THEN oh / nt >= 0.5 OR eo ELSE (regexp_matches(qn, '[0-9?$@]') OR contains(tl[1], '.') OR length(tl[1]) >= 10) AND oh > 0 END AS eoc FROM x),
    g AS (SELECT *, CASE WHEN nt = 1 THEN ecn OR v >= greatest(0.265, vf + 0.005) OR (st AND eo)
        ELSE ec OR (st AND eo) OR (nt <= 2 AND v >= greatest(0.265, vf + 0.005)) OR (CASE WHEN ev AND v >= greatest(0.265, vf + 0.005) THEN 1 ELSE 0 END + CASE WHEN ecn THEN 1 ELSE 0 END + CASE WHEN es AND s >= greatest(0.61, sf + 0.015) THEN 1 ELSE 0 END + CASE WHEN eoc AND (eo OR oh / nt >= 0.6) THEN 1 ELSE 0 END) >= 2 END AS ok FROM e WHERE ev OR ecn OR es OR eoc),
    sc AS (SELECT g.*, coalesce(CASE WHEN quality = 1 THEN 14.0 WHEN quality = 0 THEN -60.0 END, 0) AS adj FROM g LEFT JOIN fb USING (query_id, memory_id) WHERE ok AND coalesce(quality, 1) <> 0 AND (df IS NULL OR list_bool_or([t >= df AND t < df + 86400 for t in [captured_s, created_s, indexed_s] if t IS NOT NULL]))),
    p AS (SELECT query_id, df, memory_id, ev, ecn, es, eoc, adj, least(100.0, greatest(0.0, CASE WHEN v >= vf THEN v ELSE 0 END * 70 + CASE WHEN s >= sf THEN s ELSE 0 END * 45 + oh / nt * 30 + sh / nt * 24 + fh / nt * 12 + cah / nt * 18
        + CASE WHEN length(qn) >= 4 AND contains(doc, qn) THEN 40 ELSE 0 END + adj)) AS b FROM sc),
    f AS (SELECT *, round(least(100.0, greatest(0.0, b + CASE WHEN ev THEN 12 ELSE 0 END + CASE WHEN ecn THEN 14 ELSE 0 END + CASE WHEN es THEN 8 ELSE 0 END + CASE WHEN eoc THEN 12 ELSE 0 END + greatest(adj, 0))) , 6) AS s0 FROM p), f2 AS (SELECT *, round(least(100.0, s0 + CASE WHEN df IS NULL THEN 0 ELSE 20 END), 6) AS score FROM f),
    z AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM f2 WHERE score > 0)
    SELECT query_id, memory_id, score::DOUBLE AS score, rank, concat_ws(',', CASE WHEN ev THEN 'visual' END, CASE WHEN ecn THEN 'concept' END, CASE WHEN es THEN 'semantic' END, CASE WHEN eoc THEN 'ocr' END) AS evidence FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM z WHERE score >= greatest(24.0, best - 16.0)) WHERE rank <= 6""".replace("\\\\", "\\"))


@book.add("p1_search", P1)
def p1(spark, d):
    today = F.lit(TODAY).cast("date")
    word = F.when(F.col("item_id") % 4 == 1, "gestern ").when(F.col("item_id") % 4 == 3, "Yesterday ").otherwise("")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(word, F.col("text")).alias("query_text"))
    q = S.understand_queries(asked, today).withColumn("query_text", F.col("search_text"))
    q = q.select("query_id", "query_text", "q_norm", "q_tokens", *[F.unix_date(n).cast("long").__mul__(86400).alias(f"{n}_s") for n in ("date_from", "date_to")])
    m = memories(spark, d).withColumn("concept_text", F.concat_ws(" ", "filename", "category", "title"))
    visual, semantic = pairs_of(spark, d)
    votes = read(spark, d, "labels").select(F.floor(F.col("doc_id") / 50).alias("query_id"), F.concat(F.lit("m"), "doc_id").alias("memory_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("signal"))
    feedback = votes.join(q.select("query_id", F.col("q_norm").alias("query_norm")), "query_id").drop("query_id")
    return S.search(q, m, visual, semantic, feedback)


@book.add("p2_search_service", oracle(f"""
    WITH q AS (SELECT query_id, list_distinct(t) AS t FROM {Q}), {SEM},
    kw AS (SELECT query_id, memory_id, score FROM ({HITS.strip()[5:].join(['WITH ', ''])} SELECT * FROM s WHERE score >= 0.5)),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM sem) WHERE r <= 15), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM kw) WHERE r <= 15),
    m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.memory_id, b.memory_id) AS memory_id, round(coalesce(a.score, 0) * 0.65 + coalesce(b.score, 0) * 0.35, 6) AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.memory_id = b.memory_id)
    SELECT query_id, m.memory_id, coalesce(title, 'Untitled Memory') AS title, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM m) m LEFT JOIN mem USING (memory_id) WHERE rank <= 5"""))
def p2(spark, d):
    q = queries_of(spark, d)
    keyword = S.lexical_scores(q, S.token_index(memories(spark, d)))
    return S.search_hybrid(q, memories(spark, d), pairs_of(spark, d)[1], keyword).drop("reason")


OWNED = "(SELECT vec_id, 'src' || CAST(vec_id % 20 AS STRING) AS user_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@book.add("p3_search_owner", oracle(f"""
    WITH q AS (SELECT o.vec_id AS query_id, o.user_id, v, coalesce(nullif(regexp_extract(ocr_text, '[A-Za-z]{{3,}}'), ''), 'th') AS term FROM {OWNED} o JOIN mem ON doc_id = o.vec_id WHERE o.vec_id % 50 = 0),
    n AS (SELECT query_id, vec_id, d FROM (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (SELECT q.query_id, b.vec_id, round(1 - list_inner_product(q.v, b.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS d FROM q JOIN {OWNED} b USING (user_id))) WHERE r <= 20),
    l AS (SELECT query_id, doc_id AS vec_id, NULL::DOUBLE AS d FROM mem JOIN q USING (user_id) WHERE status IN ('ready', 'partial') AND (ocr_text ILIKE '%' || term || '%' OR filename ILIKE '%' || term || '%')),
    u AS (SELECT query_id, vec_id, coalesce(min(d), 2.0) AS distance FROM (SELECT * FROM n UNION ALL SELECT * FROM l) GROUP BY ALL),
    r AS (SELECT query_id, vec_id AS memory_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, created_s DESC, vec_id) AS rank, ocr_text, filename, term FROM u JOIN mem ON doc_id = vec_id JOIN (SELECT query_id, term FROM q) USING (query_id))
    SELECT query_id, memory_id, distance, rank, concat_ws(',', CASE WHEN distance < 2.0 THEN 'Semantic' END, CASE WHEN contains(lower(ocr_text), lower(term)) THEN 'OCR' END, CASE WHEN contains(lower(filename), lower(term)) THEN 'Filename' END) AS why FROM r WHERE rank <= 20"""))
def p3(spark, d):
    v = unit_vectors(spark, d).withColumn("user_id", F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")))
    m = memories(spark, d).withColumn("memory_id", F.col("doc_id"))
    term = F.coalesce(F.nullif(F.regexp_extract("ocr_text", "[A-Za-z]{3,}", 0), F.lit("")), F.lit("th")).alias("term")
    q = v.where("vec_id % 50 = 0").join(m.select(F.col("doc_id").alias("vec_id"), term), "vec_id").select(F.col("vec_id").alias("query_id"), "user_id", "vec", "term")
    return S.search_owner(q, m, v)


@book.add("p5_retrieve_context")
def p5(spark, d):
    return S.retrieve_context(queries_of(spark, d), memories(spark, d), read(spark, d, "conversations"))
