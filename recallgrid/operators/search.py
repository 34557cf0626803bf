"""Retrieval and whole searches: many queries against many memories.

Queries are the small side; memories are met through token equi-joins, never in an unbounded product.  No side is marked for
broadcast: Spark sends one out if it is below its threshold, as planned or as measured when its stage has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import meaningful_tokens, normalize, tokenize_doc, tokenize_query
from ..sources.staging import staged
from . import filters, joins, scans, scoring, windows
from .vectors import knn, retrieval_k

# Characters of the read text that an assistant is given.
OCR_CHARS = 2200

# Words that queries use in other languages and scripts, and what they stand for.
TRANSLATIONS = {
    "நேற்று": "yesterday", "நேத்து": "yesterday", "நேற்றைய": "yesterday", "இன்று": "today", "இன்னைக்கு": "today", "வெளியே": "outside", "வெளிய": "outside", "சாப்பாடு": "food", "உணவு": "food",
    "பைக்": "bike", "வண்டி": "vehicle", "பில்": "bill", "ரசீது": "receipt", "படம்": "photo", "போட்டோ": "photo", "புகைப்படம்": "photo", "புகைப்படங்கள்": "photos", "எடுத்த": "taken",
    "எடுத்தது": "taken", "விளக்கு": "light", "லைட்": "light", "nethu": "yesterday", "netru": "yesterday", "innaiku": "today", "inniku": "today", "velila": "outside", "veliye": "outside",
    "saapadu": "food", "sapadu": "food", "vandi": "vehicle", "edutha": "taken", "eduthathu": "taken", "rasidhu": "receipt", "naan": "", "nan": "", "enoda": "", "आज": "today", "बाहर": "outside",
    "खाना": "food", "तस्वीर": "photo", "फ़ोटो": "photo", "फोटो": "photo", "बाइक": "bike", "रसीद": "receipt", "నిన్న": "yesterday", "ఈరోజు": "today", "బయట": "outside", "ఆహారం": "food", "బైక్": "bike",
    "ఫోటో": "photo", "బిల్లు": "bill", "రసీదు": "receipt", "ഇന്നലെ": "yesterday", "ഇന്ന്": "today", "പുറത്ത്": "outside", "ഭക്ഷണം": "food", "ബൈക്ക്": "bike", "ഫോട്ടോ": "photo", "ബിൽ": "bill",
    "രസീത്": "receipt", "ನಿನ್ನೆ": "yesterday", "ಇಂದು": "today", "ಹೊರಗೆ": "outside", "ಊಟ": "food", "ಬೈಕ್": "bike", "ಫೋಟೋ": "photo", "ಬಿಲ್": "bill", "ರಸೀದಿ": "receipt", "গতকাল": "yesterday",
    "আজ": "today", "বাইরে": "outside", "খাবার": "food", "বাইক": "bike", "ছবি": "photo", "বিল": "bill", "রসিদ": "receipt", "बाहेर": "outside", "जेवण": "food", "बाईक": "bike", "पावती": "receipt",
    "ગઈકાલે": "yesterday", "આજે": "today", "બહાર": "outside", "ખોરાક": "food", "બાઈક": "bike", "ફોટો": "photo", "બિલ": "bill", "રસીદ": "receipt", "ਅੱਜ": "today", "ਬਾਹਰ": "outside", "ਖਾਣਾ": "food",
    "ਬਾਈਕ": "bike", "ਫੋਟੋ": "photo", "ਬਿੱਲ": "bill", "ਰਸੀਦ": "receipt", "آج": "today", "باہر": "outside", "کھانا": "food", "بائیک": "bike", "تصویر": "photo", "بل": "bill", "رسید": "receipt",
    "ayer": "yesterday", "hoy": "today", "afuera": "outside", "comida": "food", "bicicleta": "bike", "moto": "bike", "foto": "photo", "factura": "bill", "recibo": "receipt", "hier": "yesterday",
    "aujourd'hui": "today", "dehors": "outside", "nourriture": "food", "vélo": "bike", "photo": "photo", "facture": "bill", "reçu": "receipt", "gestern": "yesterday", "heute": "today",
    "draußen": "outside", "essen": "food", "fahrrad": "bike", "motorrad": "bike", "rechnung": "bill", "beleg": "receipt", "ontem": "yesterday", "hoje": "today", "fora": "outside", "fatura": "bill",
    "أمس": "yesterday", "اليوم": "today", "خارج": "outside", "طعام": "food", "دراجة": "bike", "صورة": "photo", "فاتورة": "bill", "إيصال": "receipt", "昨日": "yesterday", "今日": "today", "外": "outside",
    "食べ物": "food", "バイク": "bike", "自転車": "bike", "写真": "photo", "請求書": "bill", "レシート": "receipt", "어제": "yesterday", "오늘": "today", "밖": "outside", "음식": "food", "오토바이": "bike", "자전거": "bike",
    "사진": "photo", "청구서": "bill", "영수증": "receipt", "昨天": "yesterday", "今天": "today", "外面": "outside", "食物": "food", "摩托车": "bike", "自行车": "bike", "照片": "photo", "发票": "bill", "收据": "receipt",
    "aaj": "today", "bahar": "outside", "tasveer": "photo", "rasid": "receipt", "ninna": "yesterday", "ivala": "today", "bayata": "outside", "tindi": "food", "billu": "bill", "raseedu": "receipt",
    "innale": "yesterday", "innu": "today", "purathu": "outside", "bhakshanam": "food", "ninne": "yesterday", "horage": "outside", "oota": "food", "rasidi": "receipt", "gotokal": "yesterday",
    "ajke": "today", "baire": "outside", "baher": "outside", "jevan": "food", "pavati": "receipt", "gaikale": "yesterday", "aaje": "today",
}


def translate_query(c: Column, words: dict[str, str] = TRANSLATIONS) -> Column:
    """Known foreign words in English wherever they stand, the longest first and equals in order; white space collapsed."""
    table = F.array(*[F.struct(F.lit(rf"(?iu)\Q{w}\E").alias("w"), F.lit(words[w]).alias("to")) for w in sorted(words, key=len, reverse=True)])
    return F.trim(F.regexp_replace(F.aggregate(table, c, lambda acc, x: F.regexp_replace(acc, x["w"], x["to"])), r"\s+", " "))


def translated_sql(value: str, words: dict[str, str] = TRANSLATIONS) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    for word in sorted(words, key=len, reverse=True):
        value = f"regexp_replace({value}, {quoted(word)}, '{words[word]}', 'gi')"
    return f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))"


def date_window(df: DataFrame, text: str, today: Column) -> DataFrame:
    """Add date_from, date_to and search_text: "today" and "yesterday" name a day and leave the text; nothing left: photo."""
    low = F.lower(text)
    day = F.when(F.rlike(low, F.lit(r"\byesterday\b")), F.date_sub(today, 1)).when(F.rlike(low, F.lit(r"\btoday\b")), today)
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), r"(?i)\b(?:today|yesterday)\b", " "), r"\s+", " "))
    return df.withColumns({"date_from": day, "date_to": F.date_add(day, 1), "search_text": F.when(rest == "", F.lit("photo")).otherwise(rest)})


def understand_queries(queries: DataFrame, today: Column) -> DataFrame:
    """query_id, query_text -> with search_text, the date window, q_norm and q_tokens."""
    q = date_window(queries.withColumn("__t", translate_query(F.col("query_text"))), "__t", today).drop("__t")
    return q.withColumns({"q_norm": normalize(F.col("search_text")), "q_tokens": meaningful_tokens(F.col("search_text"))})


def token_index(memories: DataFrame, text: str = "ocr_text") -> DataFrame:
    """(token, memory_id), each pair once: write it bucketed by token to use it again."""
    return memories.select(F.explode(F.array_distinct(tokenize_doc(F.col(text)))).alias("token"), "memory_id")


def postings(memories: DataFrame, fields: dict[str, Column], wanted: DataFrame | None = None, tokens: Callable[[Column], Column] = tokenize_doc) -> DataFrame:
    """(token, memory_id, field, positions): where each token stands in each field, from 0.

    With ``wanted`` (token), other tokens leave before anything shuffles.  Written bucketed by token, the table serves every later search.
    """
    lists = F.array(*[F.struct(F.lit(n).alias("field"), tokens(c).alias("tokens")) for n, c in fields.items()])
    rows = memories.select("memory_id", F.explode(lists).alias("x")).select("memory_id", "x.field", F.posexplode("x.tokens").alias("pos", "token"))
    if wanted is not None:
        rows = rows.join(joins.bounded(wanted.select("token").distinct()), "token")
    return rows.groupBy("token", "memory_id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def anchors(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, t1, i1, t2, i2): the two rarest tokens inside each phrase (query_id, q_norm, q_tokens), with their places; t2 is null for phrases of three.

    The first and the last token may end inside a word of a text, so they are no anchors.  Stop words are anchors only where nothing else is inside.
    """
    inside = _inside(queries)
    frequency = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = inside.join(frequency, "token", "left").withColumn("e", F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("i"), F.col("token")))
    two = ranked.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("e")), 1, 2).alias("e"))
    return two.select("query_id", F.get("e", F.lit(0))["token"].alias("t1"), F.get("e", F.lit(0))["i"].alias("i1"), F.get("e", F.lit(1))["token"].alias("t2"), F.get("e", F.lit(1))["i"].alias("i2"))


def _inside(queries: DataFrame) -> DataFrame:
    """(query_id, token, i) of the tokens that stand inside each phrase; meaningful ones if there are any."""
    tokens = queries.select("query_id", "q_tokens", tokenize_doc(F.col("q_norm")).alias("t"))
    within = F.filter(F.transform("t", lambda w, i: F.struct(w.alias("token"), i.alias("i"))), lambda e: (e["i"] > 0) & (e["i"] < F.size("t") - 1))
    told = F.filter("w", lambda e: F.array_contains("q_tokens", e["token"]))
    return tokens.select("query_id", "q_tokens", within.alias("w")).select("query_id", F.explode(F.when(F.size(told) > 0, told).otherwise(F.col("w"))).alias("e")).select("query_id", "e.token", "e.i")


def phrase_candidates(queries: DataFrame, index: DataFrame, memories: DataFrame, fields: dict[str, Column], found: DataFrame | None = None) -> DataFrame:
    """(query_id, memory_id): all memories of which a field may hold the whole phrase of a query (query_id, q_norm, q_tokens), and few others.

    Two tokens inside the phrase must stand in one field, as far apart as in the phrase: an equi-join on the rarest token, then on the other
    and the memory, and a look at the positions in ``index``.  Phrases of one or two tokens have nothing inside; their longest token must stand inside a word.
    ``found``: the phrases' anchors, if they are there already; then the index needs no other tokens.
    """
    found = anchors(queries, index) if found is None else found
    first = index.join(joins.bounded(found), index["token"] == found["t1"]).select("query_id", "memory_id", "field", "positions", "t2", (F.col("i2") - F.col("i1")).alias("apart"))
    other = index.select(F.col("token").alias("t2"), "memory_id", "field", F.col("positions").alias("p2"))
    both = first.where("t2 is not null").join(other, ["t2", "memory_id", "field"])
    met = both.where(F.arrays_overlap(F.transform("positions", lambda p: p + F.col("apart")), "p2")).select("query_id", "memory_id")
    met = met.unionByName(first.where("t2 is null").select("query_id", "memory_id"))
    short = queries.select("query_id", tokenize_doc(F.col("q_norm")).alias("t")).where(F.size("t").between(1, 2))
    short = short.select("query_id", F.reduce("t", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a)).alias("token")).where(F.length("token") >= 2)
    if not short.isEmpty():
        words = memories.select("memory_id", F.explode(F.array_distinct(F.flatten(F.array(*[tokenize_doc(c) for c in fields.values()])))).alias("word"))
        hits = words.join(substring_words(short.select("token").distinct(), words.select("word").distinct()), "word").join(short, "token")
        met = met.unionByName(hits.select("query_id", "memory_id"))
    return met.distinct()


def lexical_scores(queries: DataFrame, index: DataFrame, least: float = 0.5, written: bool = False) -> DataFrame:
    """(query_id, memory_id, score): share of the query's tokens, at least ``least``.

    An index made on the fly is read once and counted.  One that is written may be read again, so a prefix filter
    comes first, exact too: of n tokens with a share of at least ``least``, one of the n - ceil(least n) + 1 rarest must be
    there, so only those probe the index; the candidates are then counted over all tokens.
    """
    tokens = queries.select("query_id", F.array_distinct("q_tokens").alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    if not written:
        counted = index.join(joins.bounded(tokens), "token").groupBy("query_id", "memory_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
        return counted.select("query_id", "memory_id", (F.col("hits") / F.col("n")).alias("score")).where(F.col("score") >= least)
    frequency = index.join(tokens.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(frequency, "token", "left").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "token")))
    probes = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    met = index.join(tokens, "token")
    candidates = index.join(probes.select("query_id", "token"), "token").select("query_id", "memory_id").distinct()
    counted = met.join(candidates, ["query_id", "memory_id"], "left_semi").groupBy("query_id", "memory_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
    return counted.select("query_id", "memory_id", (F.col("hits") / F.col("n")).alias("score")).where(F.col("score") >= least)


def whole_phrases(queries: DataFrame, memories: DataFrame, texts: dict[str, Column], tokens: DataFrame) -> DataFrame:
    """(query_id, memory_id, exact_<text>...): pairs of which a text holds the whole query (query_id, q_norm, q_tokens) of three or more characters.

    One pass over ``tokens`` (memory_id, a list for each text) counts those inside the queries, the next keeps the places of each query's two rarest only.
    """
    inside = joins.bounded(_inside(queries).select("token").distinct())
    found = staged(anchors(queries, tokens.select(F.explode(F.array_distinct(F.concat(*texts))).alias("token")).join(inside, "token")))
    rarest = found.select(F.explode(F.array("t1", "t2")).alias("token")).where("token is not null")
    index = staged(postings(tokens, {n: F.col(n) for n in texts}, rarest, lambda c: c))
    phrases = staged(phrase_candidates(queries, index, memories, texts, found))
    met = joins.bounded(phrases.join(queries.where(F.length("q_norm") >= 3).select("query_id", "q_norm"), "query_id")).join(memories.select("memory_id", *[c.alias(n) for n, c in texts.items()]), "memory_id")
    exact = met.select("query_id", "memory_id", *[F.contains(normalize(F.col(n)), F.col("q_norm")).alias(f"exact_{n}") for n in texts])
    return exact.where(" or ".join(f"exact_{n}" for n in texts))


def search(queries: DataFrame, memories: DataFrame, visual: DataFrame, semantic: DataFrame, feedback: DataFrame, limit: int = 10) -> DataFrame:
    """The whole local search: (query_id, memory_id, score, rank, evidence).

    queries: query_id, query_text, q_norm, q_tokens, date_from_s, date_to_s.  memories: memory_id, ocr_text, summary, title, filename,
    category, concept_text, and epochs.  visual, semantic: (query_id, memory_id, score).

    Pairs that only share words are never rows.  A pair that passes the gate has a similarity, the whole query in a text, or the least share of the query's
    tokens in what was read; a query of one token may have it in its concepts instead.  Those pairs are met first, and counted in full from their texts.
    """
    sims = joins.merge_candidates(visual, semantic).withColumnsRenamed({"semantic_score": "visual", "keyword_score": "semantic"})
    sims = staged(sims)
    floors = windows.query_floors(sims)  # a similarity that is not there counts as 0, below any floor
    queries = staged(queries.where(F.size("q_tokens") > 0))
    texts = {"ocr": F.col("ocr_text"), "concept": F.col("concept_text")}
    fields = texts | {n: F.col(n) for n in ("summary", "filename", "category")}
    tokens = staged(memories.select("memory_id", *[tokenize_doc(c).alias(n) for n, c in fields.items()]))  # each text is split once
    exact = whole_phrases(queries, memories, texts, tokens)
    key, one = ["query_id", "memory_id"], F.size(F.array_distinct("q_tokens")) == 1
    lexical = scans.overlaps(queries.where(~one).withColumn("own", F.lit(None).cast("string")), tokens, scoring.OCR_SHARE, tokens="ocr").select(*key, F.lit(True).alias("lexical"))
    single = queries.where(one).select("query_id", F.get("q_tokens", F.lit(0)).alias("token"))
    concept = tokens.select("memory_id", F.explode(F.array_distinct("concept")).alias("token")).join(joins.bounded(single), "token").select(*key, F.lit(True).alias("single"))
    pairs = staged(sims.join(exact, key, "full_outer").join(lexical, key, "full_outer").join(concept, key, "full_outer").drop("lexical", "single"))
    read = joins.bounded(pairs).join(tokens, "memory_id").join(joins.bounded(queries.select("query_id", "q_tokens")), "query_id")
    hits = [F.size(F.array_intersect("q_tokens", n)).alias(f"hits_{n}") for n in fields]
    counted = staged(read.select(*pairs.columns, *hits))  # what follows names the counts several times, and would make them as often
    pairs = counted.join(joins.bounded(queries), "query_id").join(joins.bounded(floors), "query_id", "left")
    pairs = pairs.na.fill(0.0, ["visual", "semantic"]).na.fill(999.0, ["visual_floor", "semantic_floor"]).na.fill(False, [f"exact_{n}" for n in texts])
    gated = scoring.evidence(pairs).where(F.size("evidence") > 0).where(scoring.relevance_gate())
    gated = gated.join(memories.drop("query_id"), "memory_id")
    dated = F.col("date_from_s").isNotNull()
    inside = filters.in_date_window([F.col("captured_s"), F.col("created_s"), F.col("indexed_s")], F.col("date_from_s"), F.col("date_to_s"))
    gated = gated.where(~dated | inside).withColumn("query_norm", F.col("q_norm"))
    gated = joins.attach_feedback(filters.drop_rejected(gated, feedback), feedback)
    scored = gated.withColumn("search_document", normalize(F.concat_ws("\n", "title", "summary", "ocr_text")))
    scored = scored.withColumn("score", scoring.pipeline_score(scoring.memory_score(["ocr", "summary", "filename", "category"]))).withColumn("score", F.round(F.least(F.lit(100.0), F.col("score") + F.when(dated, 20).otherwise(0)), 6))
    return filters.quality_floor(scored.where("score > 0"), limit).select("query_id", "memory_id", "score", "rank", F.array_join("evidence", ",").alias("evidence"))


def search_hybrid(queries: DataFrame, memories: DataFrame, semantic: DataFrame, keyword: DataFrame, top_k: int = 5) -> DataFrame:
    """Hybrid retrieval: both candidate sets, the weighted score, the first top_k of each query with their reasons."""
    depth = retrieval_k(top_k)
    near, lexical = windows.rank_results(semantic, depth), windows.rank_results(keyword, depth)
    merged = joins.attach_memory(joins.merge_candidates(near, lexical), memories)
    scored = windows.rank_results(merged.withColumn("score", scoring.hybrid_score(F.col("semantic_score"), F.col("keyword_score"))), top_k)
    text = F.lower(F.concat_ws(" ", "title", "category", "intent", "ocr_text"))
    known = scored.join(queries.select("query_id", tokenize_query(F.col("query_text")).alias("terms")), "query_id").join(memories.select("memory_id", "ocr_text"), "memory_id", "left")
    terms = F.filter("terms", lambda t: F.contains(text, t))
    reason = scoring.explain_hybrid(F.col("semantic_score"), F.lit(0.0), terms, F.array().cast("array<string>"))
    return known.select("query_id", "memory_id", "title", "score", "rank", reason.alias("reason"))


def rerank(queries: DataFrame, candidates: DataFrame, memories: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """Candidates (query_id, memory_id, semantic, sources) by the weighted sum of seven signals: (query_id, memory_id, score, confidence, rank, reasons)."""
    from ..functions.text import tokenize_rerank

    few = windows.top_per_key(candidates, "query_id", most, F.desc("semantic"), F.col("memory_id")).drop("rank")
    pairs = few.join(queries.select("query_id", normalize(F.col("query_text")).alias("q"), tokenize_rerank(F.col("query_text")).alias("t")), "query_id").join(memories, "memory_id")
    text = normalize(F.concat_ws(" ", "title", "summary", "ocr_text", "category", "subcategory", "intent"))
    meta = F.concat_ws(" ", "category", "subcategory", "intent")
    parts = {
        "semantic": F.col("semantic"), "keyword": scoring.overlap(F.col("t"), tokenize_rerank(text)), "entity": scoring.entity_share(F.col("q"), F.array("subcategory")),
        "metadata": scoring.overlap(F.col("t"), tokenize_rerank(meta)), "exact": scoring.exact_match(F.col("q"), text, F.col("t")), "recency": scoring.recency(now, F.col("created_s"), F.col("captured_s")),
        "agreement": scoring.agreement(F.col("sources")),
    }
    pairs = pairs.select("query_id", "memory_id", *[c.alias(n) for n, c in parts.items()])
    cols = {n: F.col(n) for n in parts}
    scored = pairs.withColumn("score", scoring.final_score(cols)).withColumn("confidence", scoring.confidence(F.col("score"), F.col("agreement"), F.col("exact")))
    return windows.rerank_order(scored).select("query_id", "memory_id", "score", "confidence", "rank", F.array_join(scoring.explain_rerank(cols), "; ").alias("reasons"))


def owner_hits(queries: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """(query_id, memory_id): of the owner's ready memories whose text or name has the term, the ``most`` newest ones, equals by id.

    Terms of ASCII letters stand inside runs of such letters, so an owner's terms meet the runs of the texts that hold them, and each run
    keeps its newest memories only; terms with other characters are looked for in the owner's texts.
    """
    ready = memories.where(F.col("status").isin("ready", "partial"))
    newest = (F.desc("created_s"), F.col("memory_id"))
    asked = queries.select("query_id", "user_id", "term", F.lower("term").alias("token"))
    plain = F.rlike("term", F.lit("^[A-Za-z]{2,}$"))
    terms = staged(asked.where(plain).select("user_id", "token").distinct())
    runs = F.regexp_extract_all(F.lower(F.concat_ws("\n", "ocr_text", "filename")), F.lit("[a-z]{2,}"), F.lit(0))
    words = ready.select("user_id", "memory_id", "created_s", F.explode(F.array_distinct(runs)).alias("word"))
    held = staged(substring_words(terms.select("token").distinct(), words.select("word").distinct()))
    wanted = joins.bounded(held.join(terms, "token").select("user_id", "word").distinct())
    few = words.join(wanted, ["user_id", "word"])
    few = few.withColumn("__r", F.row_number().over(Window.partitionBy("user_id", "word").orderBy(*newest))).where(F.col("__r") <= most).drop("__r")
    hits = few.join(joins.bounded(held), "word").join(joins.bounded(terms), ["user_id", "token"]).select("user_id", "token", "memory_id", "created_s").distinct()
    hits = hits.withColumn("__r", F.row_number().over(Window.partitionBy("user_id", "token").orderBy(*newest))).where(F.col("__r") <= most)
    found = asked.where(plain).join(hits, ["user_id", "token"]).select("query_id", "memory_id")
    other = asked.where(~plain)
    if other.isEmpty():
        return found
    like = F.concat(F.lit("%"), F.col("term"), F.lit("%"))
    return found.unionByName(ready.join(other, "user_id").where(F.ilike(F.col("ocr_text"), like) | F.ilike(F.col("filename"), like)).select("query_id", "memory_id"))


def search_owner(queries: DataFrame, memories: DataFrame, vectors: DataFrame, most: int = 20) -> DataFrame:
    """Owner-scoped search: rows whose text or name has the term, and the nearest vectors, closest first.

    queries: query_id, user_id, term, vec.  The owner is an equi-join key, so each owner's rows meet its queries only.  Rows with the term only are
    all as far, the newest first, and at most ``most`` of the others are nearer: so twice ``most`` of them are enough.
    """
    near = knn(queries.select("query_id", "user_id", "vec"), vectors, most, distance=True, by=["user_id"]).select("query_id", F.col("vec_id").alias("memory_id"), F.col("score").alias("distance"))
    q = queries.select("query_id", "user_id", "term")
    lexical = owner_hits(q, memories, 2 * most).select("query_id", "memory_id", F.lit(None).cast("double").alias("distance"))
    both = near.unionByName(lexical).groupBy("query_id", "memory_id").agg(F.coalesce(F.min("distance"), F.lit(2.0)).alias("distance"))
    rows = both.join(memories.select("memory_id", "created_s", "filename", "ocr_text"), "memory_id").join(q.select("query_id", "term"), "query_id")
    top = windows.top_per_key(rows, "query_id", most, F.col("distance"), F.desc("created_s"), F.col("memory_id"))
    why = scoring.why_matched(F.col("distance"), F.contains(F.lower("ocr_text"), F.lower("term")), F.lit(False), F.contains(F.lower("filename"), F.lower("term")))
    return top.select("query_id", "memory_id", F.round("distance", 6).alias("distance"), "rank", F.array_join(why, ",").alias("why"))


def substring_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word): the words that contain each token of two or more characters.

    A word that contains a token has the token's head at some place, so both meet by heads of two and of three characters.
    """
    two = lambda i: F.concat(F.get("c", i), F.get("c", i + 1))
    heads = F.flatten(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.array(two(i), F.concat(two(i), F.get("c", i + 2)))))
    placed = words.where(F.length("word") >= 2).select("word", F.split("word", "").alias("c")).select("word", F.explode(F.array_distinct(heads)).alias("head"))
    return tokens.select("token", F.substring("token", 1, 3).alias("head")).join(placed, "head").where(F.contains("word", F.col("token"))).select("token", "word")


def fast_lookup(queries: DataFrame, memories: DataFrame, most: int = 4) -> DataFrame:
    """Substring hits of a message's tokens: (query_id, memory_id, score, rank), from one pass over the texts (``scans.substring_hits``)."""
    text = F.lower(F.concat_ws(" ", "filename", "category", "summary", "ocr_text"))
    pairs = scans.substring_hits(queries.select("query_id", meaningful_tokens(F.col("query_text")).alias("tokens")), memories, text)
    score = F.col("h") / F.col("n") * 6 + F.col("points") + F.col("bonus")
    return windows.top_per_key(pairs.select("query_id", "memory_id", F.round(score, 6).alias("score")), "query_id", most, F.desc("score"), F.desc("memory_id"))


def context_block(**parts: Column) -> Column:
    """The lines of one memory that an assistant reads: each part that is there, with its name."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), c) for name, c in parts.items()])


def retrieve_context(queries: DataFrame, memories: DataFrame, turns: DataFrame | None = None, most: int = 4) -> DataFrame:
    """What an assistant reads for each message: the blocks of its memories, best first, and the last turns."""
    found = fast_lookup(queries, memories, most)
    block = context_block(title=F.col("title"), category=F.nullif(F.trim("category"), F.lit("")), summary=F.col("summary"), ocr=F.substring("ocr_text", 1, OCR_CHARS))
    blocks = found.join(memories.select("memory_id", block.alias("block")), "memory_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    context = queries.join(blocks, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("")).alias("context"))
    if turns is None:
        return context
    return context.join(windows.last_turns(turns).withColumnRenamed("conv_id", "query_id"), "query_id", "left")


def related(vectors: DataFrame, ids: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k nearest other memories of each of ``ids``."""
    q = vectors.join(ids.select(F.col("memory_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "vec")
    near = knn(q, vectors, k + 1).where("query_id <> vec_id")
    return windows.top_per_key(near.drop("rank"), "query_id", k, F.desc("score"), F.col("vec_id"))
