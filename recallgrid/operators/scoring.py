"""Scores, gates and explanations of search results, as columns.

Columns of a pair: q_tokens (the query's tokens), q_norm (the normalised query), and texts or tokens of the memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.text import is_structured_query
from .joins import bounded

# Weights of the final score.
WEIGHTS = {"semantic": 0.40, "keyword": 0.18, "entity": 0.12, "metadata": 0.10, "exact": 0.08, "recency": 0.05, "agreement": 0.07}
# Points of overlap with each field.
FIELD_POINTS = {"ocr": 30, "summary": 24, "visual": 32, "entities": 20, "keywords": 26, "filename": 12, "category": 18}
# Share of a query's tokens that read text must have to count in the second test.
OCR_SHARE = 0.60
# Points of each kind of evidence.
EVIDENCE_POINTS = {"visual": 12, "concept": 14, "semantic": 8, "ocr": 12}


def hybrid_score(semantic: Column, keyword: Column, semantic_weight: float = 0.65, keyword_weight: float = 0.35) -> Column:
    total = semantic_weight + keyword_weight
    if semantic_weight < 0 or keyword_weight < 0 or total <= 0:
        raise ValueError("weights must not be negative, and not both 0")
    return F.round(clamp(semantic) * (semantic_weight / total) + clamp(keyword) * (keyword_weight / total), 6)


def overlap(query: Column, tokens: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(0.0)


def exact_match(query: Column, text: Column, query_tokens: Column) -> Column:
    return F.when((query != "") & F.contains(text, query), 1.0).when((F.size(query_tokens) > 0) & F.contains(text, F.array_join(query_tokens, " ")), 0.85).otherwise(0.0)


def entity_share(query: Column, entities: Column) -> Column:
    """Share of the memory's entities that stand in the query."""
    named = F.filter(entities, lambda e: F.trim(e) != "")
    return F.when(F.size(named) > 0, F.size(F.filter(named, lambda e: F.contains(query, F.lower(e)))) / F.size(named)).otherwise(0.0)


def recency(now: Column, *moments: Column) -> Column:
    """exp(-days / 120) since the first moment that is there; epoch seconds."""
    age = F.greatest((now - F.coalesce(*moments)) / 86400, F.lit(0.0))
    return F.coalesce(F.exp(-age / 120), F.lit(0.0))


def agreement(sources: Column) -> Column:
    n = F.size(F.array_distinct(F.filter(F.transform(sources, lambda s: F.lower(F.trim(s))), lambda s: s != "")))
    return F.when(n >= 2, 1.0).when(n == 1, 0.5).otherwise(0.0)


def final_score(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(weights.values())
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + clamp(parts[name]) * (weight / total)
    return F.round(score, 6)


def confidence(score: Column, agree: Column, exact: Column) -> Column:
    return F.round(F.least(F.lit(1.0), clamp(score) + 0.08 * clamp(agree) + 0.07 * clamp(exact)), 4)


def evidence(df: DataFrame) -> DataFrame:
    """Add ``evidence``, the kinds of proof that a pair matches, and what they rest on.

    Needs q_tokens, query_text, visual, semantic and their floors, from ``field_hits`` how many of the query's tokens the texts have, and in
    exact_ocr and exact_concept whether they have the whole query.
    """
    df = df.withColumns({"n_tokens": F.size(F.array_distinct("q_tokens")), "ocr_hits": F.col("hits_ocr"), "concept_hits": F.col("hits_concept")})
    n, token = F.col("n_tokens"), F.get("q_tokens", F.lit(0))
    visual = F.col("visual") >= F.col("visual_floor")
    concept = (F.col("concept_hits") > 0) | F.col("exact_concept")
    semantic = (F.col("semantic") >= F.col("semantic_floor")) & ((n >= 2) | (F.col("concept_hits") > 0) | visual)
    single = F.rlike("query_text", F.lit("[0-9?$@]")) | F.contains(token, F.lit(".")) | (F.length(token) >= 10)
    ocr = F.when(n >= 2, (F.col("ocr_hits") / F.greatest(n, F.lit(1)) >= 0.5) | F.col("exact_ocr")).otherwise(single & (F.col("ocr_hits") > 0))
    kinds = F.array_compact(F.array(F.when(visual, "visual"), F.when(concept, "concept"), F.when(semantic, "semantic"), F.when(ocr, "ocr")))
    return df.withColumn("evidence", F.when(n > 0, kinds).otherwise(F.array().cast("array<string>")))


def relevance_gate() -> Column:
    """Second test of a pair that has evidence."""
    n, concept = F.col("n_tokens"), F.col("exact_concept") | (F.col("concept_hits") > 0)
    strong_visual = F.col("visual") >= F.greatest(F.lit(0.265), F.col("visual_floor") + 0.005)
    strong_semantic = F.col("semantic") >= F.greatest(F.lit(0.61), F.col("semantic_floor") + 0.015)
    structured_ocr = is_structured_query(F.col("query_text")) & F.col("exact_ocr")
    has = lambda k: F.array_contains("evidence", k)
    independent = (has("visual") & strong_visual).cast("int") + (has("concept") & concept).cast("int") + (has("semantic") & strong_semantic).cast("int")
    independent = independent + (has("ocr") & (F.col("exact_ocr") | (F.col("ocr_hits") / F.greatest(n, F.lit(1)) >= OCR_SHARE))).cast("int")
    many = F.col("exact_concept") | structured_ocr | (independent >= 2) | ((n <= 2) & strong_visual)
    return F.when(n == 0, F.lit(False)).when(n == 1, concept | strong_visual | structured_ocr).otherwise(many)


def field_hits(queries: DataFrame, index: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, memory_id, hits_<field>...): how many of a query's tokens stand in each field of ``index`` (token, memory_id, field, ...), for pairs that share any.

    No pair is scored by reading its texts.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("q_tokens")).alias("token"))
    met = index.select("token", "memory_id", "field").join(bounded(wanted), "token")
    return met.groupBy("query_id", "memory_id").agg(*[F.count_if(F.col("field") == n).alias(f"hits_{n}") for n in fields])


def memory_score(fields: list[str]) -> Column:
    """Points of a pair, 0 to 100: similarities, overlap of each field, the exact phrase, and feedback (column adjustment)."""
    strong = lambda s: F.when(F.col(s) >= F.col(f"{s}_floor"), F.col(s)).otherwise(0.0)
    score = strong("visual") * 70 + strong("semantic") * 45
    for name in fields:
        score = score + F.col(f"hits_{name}") / F.col("n_tokens") * FIELD_POINTS[name]
    score = score + F.when((F.length("q_norm") >= 4) & F.contains("search_document", "q_norm"), 40).otherwise(0) + F.col("adjustment")
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def pipeline_score(score: Column, dated: bool = False) -> Column:
    """The points with those of evidence, feedback again, and a date window."""
    for kind, points in EVIDENCE_POINTS.items():
        score = score + F.when(F.array_contains("evidence", kind), points).otherwise(0)
    score = score + F.greatest(F.col("adjustment"), F.lit(0.0)) + (20 if dated else 0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def _sentence(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def explain_hybrid(semantic: Column, metadata: Column, terms: Column, entities: Column) -> Column:
    reasons = _sentence(
        F.when(semantic >= 0.80, "strong semantic similarity").when(semantic >= 0.60, "good semantic similarity"),
        F.when(F.size(terms) > 0, F.concat(F.lit("keyword match: "), F.array_join(F.slice(terms, 1, 5), ", "))), F.when(F.size(entities) > 0, F.concat(F.lit("entity match: "), F.array_join(F.slice(entities, 1, 5), ", "))),
        F.when(metadata >= 0.80, "metadata strongly matches"),
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("the memory is relevant based on the combined search signals")))
    return F.concat(F.lit("Matched because of "), F.array_join(reasons, ", "), F.lit("."))


def explain_rerank(p: dict[str, Column]) -> Column:
    reasons = _sentence(
        F.when(p["semantic"] >= 0.80, "strong semantic similarity").when(p["semantic"] >= 0.60, "good semantic similarity"), F.when(p["keyword"] >= 0.70, "multiple keyword matches").when(p["keyword"] >= 0.30, "keyword overlap"),
        F.when(p["exact"] >= 0.80, "exact phrase match"), F.when(p["metadata"] >= 0.70, "metadata supports the query"), F.when(p["agreement"] >= 1.0, "multiple retrieval methods found this memory"), F.when(p["recency"] >= 0.70, "recent memory"),
    )
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("combined retrieval signals indicate relevance")))


def explain_semantic(similarity: Column, terms: Column, category: Column) -> Column:
    return F.concat_ws("; ", F.when(F.size(terms) > 0, F.concat(F.lit("contains: "), F.array_join(F.slice(terms, 1, 5), ", "))), F.when(category != "other", F.concat(F.lit("category: "), category)), F.when(similarity >= 0.75, "very similar meaning").when(similarity >= 0.55, "similar meaning"))


def why_matched(distance: Column, in_text: Column, in_concepts: Column, in_name: Column) -> Column:
    return _sentence(F.when(distance < 2.0, "Semantic"), F.when(in_text, "OCR"), F.when(in_concepts, "Concept"), F.when(in_name, "Filename"))


def match_kinds(reasons: Column) -> Column:
    """Reasons as Visual, Semantic, OCR, Concept and Filename, each once."""
    kind = lambda r: F.when(F.rlike(r, F.lit("(?i)visual|image")), "Visual").when(F.rlike(r, F.lit("(?i)semantic|meaning")), "Semantic").when(F.rlike(r, F.lit("(?i)ocr|text")), "OCR").when(F.rlike(r, F.lit("(?i)filename")), "Filename").otherwise("Concept")
    return F.array_distinct(F.transform(reasons, kind))
