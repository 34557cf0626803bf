"""Ranks, floors, firsts and running counts.  No window runs over a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .joins import bounded


def rank_results(df: DataFrame, top_k: int | None = None) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")))
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def rerank_order(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("confidence"), "memory_id")))


def query_floors(df: DataFrame) -> DataFrame:
    """Floors of each query's visual and semantic scores; 999 where there are none."""
    best = df.groupBy("query_id").agg(F.max("visual").alias("v"), F.max("semantic").alias("s"))
    return best.select("query_id", F.coalesce(F.greatest(F.lit(0.255), F.col("v") - 0.035), F.lit(999.0)).alias("visual_floor"), F.coalesce(F.greatest(F.lit(0.56), F.col("s") - 0.07), F.lit(999.0)).alias("semantic_floor")).withColumns({
        "visual_floor": F.when(F.col("visual_floor").isNull(), 999.0).otherwise(F.col("visual_floor")),
    })


def mark_duplicates(scan: DataFrame) -> DataFrame:
    """The first file of each hash in path order is the original; a path is one file.

    Firsts are found by an aggregate that combines before the shuffle, and only hashes that several files share are looked up.
    """
    place = F.struct(F.lower("path").alias("low"), F.col("path"))
    shared = scan.groupBy("sha256").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    marked = scan.join(bounded(staged(shared)), "sha256", "left")
    return marked.withColumn("duplicate", F.coalesce(place > F.col("__first"), F.lit(False))).drop("__first")


def best_entity(entities: DataFrame) -> DataFrame:
    """The most confident entity of each (memory_id, type, normalized), the first of equals."""
    best = F.max_by(F.struct("text", "confidence", "pos"), F.struct(F.col("confidence"), -F.col("pos"))).alias("best")
    return entities.groupBy("memory_id", "type", "normalized").agg(best).select("memory_id", "type", "normalized", "best.text", "best.confidence")


def winner_and_margin(scores: DataFrame, name: str, key: str = "memory_id") -> DataFrame:
    """Top value, its score, the second score, the margin and three alternatives; ties by the order column ``o``."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("o"), F.col(name).alias("v"))))
    g = scores.groupBy(key).agg(entries.alias("e"))
    second = F.coalesce(-F.get("e", F.lit(1))["neg"], F.lit(0.0))
    return g.select(key, F.get("e", F.lit(0))["v"].alias(name), (-F.get("e", F.lit(0))["neg"]).alias("score"), second.alias("second"), (-F.get("e", F.lit(0))["neg"] - second).alias("margin"), F.transform(F.slice("e", 2, 3), lambda x: x["v"]).alias("alternatives"))


def top_per_key(df: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def best_ocr(results: DataFrame) -> DataFrame:
    """The best strategy of each memory by confidence, words and characters; the first of equals."""
    score = 0.6 * F.col("confidence") / 100 + 0.2 * F.least(F.col("words") / 30, F.lit(1.0)) + 0.2 * F.least(F.col("chars") / 300, F.lit(1.0))
    scored = results.withColumn("score", F.round(score, 9))
    return scored.groupBy("memory_id").agg(F.max_by(F.struct("strategy", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b")).select("memory_id", "b.strategy", "b.score")


def offered_load(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same client and area in the trailing window, this one included; ``at`` in seconds."""
    w = Window.partitionBy("client", "area").orderBy("at").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("load", F.count(F.lit(1)).over(w))


def assign_ids(batch: DataFrame, start: Column | int, key: str, shards: int = 64) -> DataFrame:
    """Consecutive ids from ``start`` in order of hash shard and key: counts of shards, then ranks within."""
    s = F.pmod(F.xxhash64(key), F.lit(shards))
    rows = batch.withColumn("__s", s)
    sizes = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("__s", F.coalesce(F.sum("n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))  # one row a shard
    rank = F.row_number().over(Window.partitionBy("__s").orderBy(key)) - 1
    return rows.withColumn("__n", rank).join(F.broadcast(first), "__s").withColumn("vector_id", (F.lit(start) + F.col("__first") + F.col("__n")).cast("long")).drop("__s", "__n", "__first")


def last_turns(turns: DataFrame, most: int = 8) -> DataFrame:
    """The last turns of each conversation, "ROLE: text" each."""
    late = top_per_key(turns, "conv_id", most, F.desc("turn"))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return late.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def recent_queries(history: DataFrame, most: int = 6) -> DataFrame:
    """Each user's latest distinct queries, whatever their case."""
    latest = history.groupBy("user_id", F.lower("query").alias("query")).agg(F.max("at").alias("at"))
    return top_per_key(latest, "user_id", most, F.desc("at"), F.col("query"))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page, with the total, pages and whether there is a next one."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    info = total.withColumns({"pages": F.ceil(F.col("total") / size), "has_next": F.col("total") > number * size})
    return rows.join(F.broadcast(info))


def page_after(df: DataFrame, last: tuple, size: int, first: str, second: str) -> DataFrame:
    """The next page after the row with keys ``last``: no offset to count through."""
    return df.where((F.col(first) > last[0]) | (F.col(first) == last[0]) & (F.col(second) > last[1])).orderBy(first, second).limit(size)


def sort_entities(entities: Column) -> Column:
    """By confidence, highest first, then type and normalized form."""
    keyed = F.transform(entities, lambda e: F.struct((-e["confidence"]).alias("c"), e["type"].alias("t"), e["normalized"].alias("n")))
    return F.array_sort(keyed)


def order_hybrid(candidates: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates: nearest first, those without a distance at 2.0, then the newest."""
    return candidates.withColumn("distance", F.coalesce("distance", F.lit(2.0))).orderBy("distance", F.desc("created_s"), "memory_id").limit(most)


def top_signals(signals: DataFrame, key: str, value: str, most: int = 50) -> DataFrame:
    """Each key's ``most`` strongest signals."""
    return top_per_key(signals, key, most, F.desc(value))
