"""Joins of candidates, memories, feedback, images and content hashes.

Sides that grow with the corpus are never marked for broadcast; rule tables, whose size is fixed in code, are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import first_spelled


def merge_candidates(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row for each (query_id, memory_id) of either side: the side's highest score, or 0.

    Not a union: one of two sides that are partitioned alike counts as partitioned so too (Spark 4.1), even where adaptive
    execution has merged the partitions of one side in another way, and an aggregation over it may then split a group.
    """
    best = lambda df, name: df.groupBy("query_id", "memory_id").agg(F.max("score").alias(name))
    both = best(semantic, "s").join(best(keyword, "k"), ["query_id", "memory_id"], "full_outer")
    return both.select("query_id", "memory_id", F.coalesce("s", F.lit(0.0)).alias("semantic_score"), F.coalesce("k", F.lit(0.0)).alias("keyword_score"))


def attach_memory(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """Left lookup; a memory that is not there gets defaults."""
    m = memories.select("memory_id", "title", "category", "intent", F.lit(True).alias("__known"))
    joined = candidates.join(m, "memory_id", "left")
    return joined.withColumns({"title": F.coalesce("title", F.lit("Untitled Memory")), "category": F.coalesce("category", F.lit("other")), "intent": F.coalesce("intent", F.lit("unknown"))}).drop("__known")


def attach_scores(memories: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Left lookup of each score (memory_id, score); missing is 0."""
    for name, s in scores.items():
        memories = memories.join(s.select("memory_id", F.col("score").alias(name)), "memory_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return memories


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``most`` rows of a few words each; else Spark picks the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def attach_feedback(pairs: DataFrame, feedback: DataFrame, plus: float = 14.0, minus: float = -60.0) -> DataFrame:
    """Adjustment of each (query_norm, memory_id)."""
    joined = pairs.join(feedback.select("query_norm", "memory_id", "signal"), ["query_norm", "memory_id"], "left")
    return joined.withColumn("adjustment", F.when(F.col("signal") > 0, plus).when(F.col("signal") < 0, minus).otherwise(0.0)).drop("signal")


def union_candidates(lexical: DataFrame, vector: DataFrame, far: float = 2.0) -> DataFrame:
    """One row for each id of either side with its least distance, or ``far``."""
    near = vector.groupBy("memory_id").agg(F.min("distance").alias("distance"))
    both = lexical.select("memory_id").distinct().join(near, "memory_id", "full_outer")
    return both.select("memory_id", F.coalesce("distance", F.lit(far)).alias("distance"))


def new_content(scan: DataFrame, seen: DataFrame, key: str = "sha256", order: str = "path") -> DataFrame:
    """Rows whose hash was never seen, the first of each hash."""
    fresh = scan.join(seen.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*scan.columns), order).alias("__r")).select("__r.*")


def duplicates_of(uploads: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uploads that are there already, with the id of the record they repeat (the smallest)."""
    ids = known.groupBy(*keys).agg(F.min("memory_id").alias("duplicate_of"))
    return uploads.join(ids, list(keys))


def dictionary_hits(texts: DataFrame, rules: DataFrame, key: str = "memory_id", text: str = "text") -> DataFrame:
    """(key, label, term) where a term of ``rules`` (label, term) stands in the text.

    Single words meet exploded tokens in a broadcast join; phrases are looked for in one pass over each text, as literals.
    ``rules`` is a table fixed in code.
    """
    terms = [tuple(r) for r in rules.select("label", "term").collect()]
    words = rules.where(~F.col("term").contains(" ")).select("label", "term")
    tokens = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"(?U)[^\w]+"))).alias("token"))
    hits = tokens.join(F.broadcast(words), F.col("token") == F.col("term")).select(key, "label", "term")
    phrases = [(label, term) for label, term in terms if " " in term]
    if not phrases:
        return hits
    low = F.lower(text)
    pairs = F.array_compact(F.array(*[F.when(low.contains(t), F.struct(F.lit(label).alias("label"), F.lit(t).alias("term"))) for label, t in phrases]))
    return hits.unionByName(texts.select(key, F.explode(pairs).alias("x")).select(key, "x.label", "x.term"))


def weigh_entities(entities: DataFrame, weights: DataFrame) -> DataFrame:
    """(memory_id, intent, score): weights (type, intent, weight), fixed in code, times confidence, summed."""
    return entities.join(F.broadcast(weights), "type").groupBy("memory_id", "intent").agg(F.sum(F.col("weight") * F.col("confidence")).alias("score"))


def primary_image(images: DataFrame) -> DataFrame:
    """(memory_id, image_id): the primary image, else the first."""
    return images.groupBy("memory_id").agg(F.min_by("image_id", F.struct(~F.col("is_primary"), F.col("sequence"), F.col("image_id"))).alias("image_id"))


def attach_by_position(files: DataFrame, meta: DataFrame, files_list: str, meta_list: str, key: str) -> DataFrame:
    """Elements of two lists of one key side by side, by position."""
    a = files.select(key, F.posexplode(files_list).alias("pos", "file"))
    b = meta.select(key, F.posexplode(meta_list).alias("pos", "meta"))
    return a.join(b, [key, "pos"], "left")


def except_ids(df: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def merge_pages(pages: Sequence[DataFrame], key: str = "memory_id") -> DataFrame:
    """Rows of all pages, the first of each id."""
    rows, columns = None, pages[0].columns
    for i, page in enumerate(pages):
        page = page.select(key, F.lit(i).alias("__page"), F.struct(*columns).alias("__r"))
        rows = page if rows is None else rows.unionByName(page)
    return rows.groupBy(key).agg(F.min_by("__r", "__page").alias("__r")).select("__r.*")


def merge_words(a: Column, b: Column, most: int) -> Column:
    """Both lists in order, each word once whatever its case, as first spelled."""
    return first_spelled(F.concat(a, b), lambda w: F.lower(F.trim(w)), lambda k: k != "", most)


def dedup_words(values: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda w: F.trim(w)), lambda w: w != "")), 1, most)
