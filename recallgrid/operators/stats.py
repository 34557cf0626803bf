"""Counts, rates and rollups.  Each report is one aggregation with partial sums; nothing but the report reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keywords import constant_list, keywords_in
from ..functions.text import normalize

# Collections and their terms.
COLLECTIONS = {
    "Receipts & Bills": ["receipt", "invoice", "bill", "total", "gst", "payment"],
    "Food": ["food", "dosa", "restaurant", "meal", "breakfast", "lunch", "dinner"],
    "Code & Errors": ["python", "error", "exception", "traceback", "gradle", "android", "code"],
    "College": ["college", "class", "timetable", "exam", "assignment", "kiot", "student"],
    "Travel": ["train", "bus", "ticket", "hotel", "booking", "travel", "flight"],
    "Documents": ["document", "identity", "certificate", "card", "aadhaar", "pan"],
    "Shopping": ["shopping", "product", "price", "order", "amazon", "flipkart"],
    "People": ["person", "people", "portrait", "face"],
}


def category_counts(df: DataFrame, blank: str = "other") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(blank)).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100.0), F.round(part / whole * 100, 6))).otherwise(0.0)


def memory_stats(df: DataFrame) -> DataFrame:
    """total, failed, processing, indexed, processed and the two rates, in one pass."""
    status = F.lower("status")
    sums = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.contains("fail")).alias("failed"), F.count_if(status.isin("processing", "queued", "pending")).alias("processing"),
        F.count_if(F.col("indexed_s").isNotNull() | status.isin("indexed", "ready", "completed")).alias("indexed"),
    )
    sums = sums.withColumn("processed", F.greatest(F.lit(0), F.col("total") - F.col("failed") - F.col("processing")))
    return sums.withColumns({"success_rate": _share(F.col("processed"), F.col("processed") + F.col("failed")), "indexing_rate": _share(F.col("indexed"), F.col("total"))})


def distribution(df: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Most frequent values with their share in percent."""
    counts = df.groupBy(F.substring(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("other")), 1, 100).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    shared = counts.withColumn("percent", F.round(F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar(), 6))
    return shared.orderBy(F.desc("n"), name).limit(most)


def collections(df: DataFrame, text: Column) -> DataFrame:
    """Memories of each collection; one may be in several, or in Other."""
    known = [t for terms in COLLECTIONS.values() for t in terms]
    df = df.select(keywords_in(F.lower(text), known).alias("__hits"))  # a text is read once for all terms

    def any_of(terms: list[str]) -> Column:
        return F.arrays_overlap("__hits", constant_list(terms))

    names = F.array_compact(F.array(*[F.when(any_of(terms), name) for name, terms in COLLECTIONS.items()]))
    return df.select(F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("Other")))).alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def suggest(df: DataFrame, prefix: str, values: Column, most: int = 8) -> DataFrame:
    """Values that begin with the prefix: the most frequent first, then in order of the value."""
    v = df.select(F.explode(values).alias("value")).where(F.col("value").isNotNull() & normalize(F.col("value")).startswith(prefix.lower().strip()))
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("value"), "value").limit(most)


def suggest_first(df: DataFrame, term: str, values: Column, most: int, *newest: Column) -> DataFrame:
    """Values that contain the term, each once whatever its case, those of the newest rows first."""
    v = df.select(F.struct(*newest).alias("age"), F.posexplode(values).alias("pos", "value")).where(F.lower("value").contains(term.lower()))
    first = v.groupBy(F.lower("value").alias("key")).agg(F.min_by("value", F.struct("age", "pos", "value")).alias("value"), F.min(F.struct("age", "pos", "value")).alias("place"))
    return first.orderBy("place", "key").limit(most).select("value")


def search_stats(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(F.col("result_count") == 0).alias("empty"),
        F.round(F.avg("duration_ms"), 6).alias("average_ms"), F.round(F.avg("result_count"), 6).alias("average_results"),
    )


def storage_stats(listing: DataFrame) -> DataFrame:
    """Bytes of each area, and of all."""
    return listing.rollup("area").agg(F.sum("length").alias("bytes")).select(F.coalesce("area", F.lit("total")).alias("area"), "bytes")


def batch_summary(items: DataFrame, partial_allowed: bool = True) -> DataFrame:
    """Counts of each batch; it succeeded without failures, or with some if that is allowed and one item is well."""
    sums = items.groupBy("batch").agg(F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("duplicate").alias("duplicates"), F.count_if("indexed").alias("indexed"))
    return sums.withColumn("success", (F.col("failed") == 0) | (F.lit(partial_allowed) & (F.col("successful") > 0)))


def run_rollup(items: DataFrame) -> DataFrame:
    """Progress and terminal status of each run from (run_id, total, status)."""
    sums = items.groupBy("run_id").agg(F.max("total").alias("total"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))
    done = F.col("successful") + F.col("failed")
    state = F.when(done < F.col("total"), "running").when(F.col("failed") == 0, "completed").when(F.col("successful") == 0, "failed").otherwise("partial")
    return sums.withColumns({"processed": done, "remaining": F.greatest(F.lit(0), F.col("total") - done), "progress": F.when(F.col("total") > 0, F.least(F.lit(100.0), F.round(done / F.col("total") * 100, 2))).otherwise(0.0), "state": state})


def ocr_confidence(words: DataFrame) -> DataFrame:
    """Mean of each memory's word confidences that are not negative; none: 0."""
    return words.groupBy("memory_id").agg(F.coalesce(F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 2), F.lit(0.0)).alias("ocr_confidence"))


def weighted_confidence(signals: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the signals that are there, by their weights."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in signals.values():
        there = value.isNotNull() & (value >= 0)
        top = top + F.when(there, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * weight).otherwise(0.0)
        bottom = bottom + F.when(there, weight).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def completeness(flags: dict[str, Column]) -> Column:
    """Sum of the weights of what a memory has: vision .35, ocr .15, the rest .10."""
    total = F.lit(0.0)
    for name, flag in flags.items():
        total = total + F.when(flag, {"vision": 0.35, "ocr": 0.15}.get(name, 0.10)).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 4)


def entities_by_type(entities: DataFrame) -> DataFrame:
    """(memory_id, type, texts): texts in order of position."""
    return entities.groupBy("memory_id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))


def user_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status").isin("processing", "queued")).alias("processing"))


def scan_stats(scan: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files, hashes, repeats, invalid files and files indexed before."""
    joined = scan.join(indexed.select("sha256").distinct().withColumn("__known", F.lit(True)), "sha256", "left")
    sums = joined.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("sha256").alias("unique_hashes"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("__known")).alias("indexed_before"))
    return sums.withColumn("duplicates", F.col("files") - F.col("unique_hashes"))


def phase_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def vector_store_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("vec_id").alias("mapped"), F.max(F.size("embedding")).alias("dimension"), (F.max("vec_id") + 1).alias("next_id"))


def result_set_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"), F.max_by("memory_id", F.struct(F.col("score"), F.col("memory_id"))).alias("top_id"), F.max("score").alias("top_score"), F.round(F.avg("score"), 6).alias("average_score"))


def processing_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed"), F.count_if("indexed").alias("indexed"), F.count_if("ocr").alias("ocr_ok"), F.count_if("vision").alias("vision_ok"), F.count_if("embedding").alias("embedding_ok"),
        F.round(F.sum("duration_ms"), 2).alias("total_ms"), F.round(F.avg("duration_ms"), 2).alias("average_ms"),
    )


def system_stats(memories: DataFrame, images: DataFrame, entities: DataFrame) -> DataFrame:
    """One row of totals."""
    m = memories.agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("indexed_s").isNotNull()).alias("indexed"))
    i = images.agg(F.count(F.lit(1)).alias("images"), (F.count(F.lit(1)) - F.countDistinct("file_hash")).alias("duplicates"))
    e = entities.agg(F.count(F.lit(1)).alias("entities"))
    return m.join(i).join(e)  # three rows of one


# What is suggested to everybody.
SUGGESTIONS = ["the shoes I wanted to buy", "my Python study notes", "receipt from my online order", "travel information I saved", "the address from my screenshot", "that coding error I saved"]


def suggest_recent(asked: DataFrame, history: DataFrame, defaults: list[str] = SUGGESTIONS, most: int = 8) -> DataFrame:
    """(user_id, text, value, rank) for each of ``asked`` (user_id, text): the user's queries (user_id, query, ts) that contain the text, newest first, then the defaults that do.

    Case does not matter; of queries that differ in case only, the newest stays.  A user's history is combined before it is ranked.
    """
    mine = history.groupBy("user_id", F.lower("query").alias("k")).agg(F.max_by("query", "ts").alias("value"), F.max("ts").alias("ts"))
    low = F.lower(F.trim("text"))
    recent = asked.join(mine, "user_id").where(F.contains("k", low)).select("user_id", "text", "k", "value", F.lit(0).alias("o"), F.lit(0).alias("i"), "ts")
    known = F.array(*[F.struct(F.lit(v.lower()).alias("k"), F.lit(v).alias("value")) for v in defaults])
    common = asked.select("user_id", "text", F.posexplode(F.filter(known, lambda e: F.contains(e["k"], low))).alias("i", "e"))
    common = common.select("user_id", "text", "e.k", "e.value", F.lit(1).alias("o"), "i", F.lit(None).cast(dict(mine.dtypes)["ts"]).alias("ts"))
    both = recent.unionByName(common).groupBy("user_id", "text", "k").agg(F.min_by(F.struct("value", "o", "i", "ts"), "o").alias("r")).select("user_id", "text", "r.*")
    order = Window.partitionBy("user_id", "text").orderBy("o", F.desc("ts"), "i", "value")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("user_id", "text", "value", "rank")


def starter_suggestions(memories: DataFrame, most: int = 8) -> DataFrame:
    """(value): the first distinct suggestions, by doc_id, then the category before the words of the text."""
    values = memories.where("trim(category) <> ''").select("doc_id", F.posexplode(F.concat(F.array(F.trim("category")), F.split("ocr_text", " "))).alias("pos", "value"))
    return values.groupBy("value").agg(F.min(F.struct("doc_id", "pos")).alias("first")).orderBy("first").limit(most).select("value")
