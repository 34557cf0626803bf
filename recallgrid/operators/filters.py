"""Filters, projections and checks over memories and their images, jobs and uploads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import first_non_empty
from ..functions.text import normalize

# Terms too general to describe an image.
GENERIC_TERMS = [
    "image", "photo", "picture", "screenshot", "screen", "text", "object", "thing", "content", "person", "people", "background", "foreground",
    "rectangle", "display", "interface", "ui", "document", "unknown", "indoor", "outdoor", "scene", "photograph",
]


def filter_structured(df: DataFrame, category: str | None = None, intent: str | None = None, entity: str | None = None) -> DataFrame:
    """Category and intent whatever their case; an entity of the memory is part of ``entity``."""
    if category:
        df = df.where(F.lower("category") == category.lower())
    if intent:
        df = df.where(F.lower("intent") == intent.lower())
    if entity:
        df = df.where(F.exists("entities", lambda e: F.instr(F.lit(entity.lower()), F.lower(e)) > 0))
    return df


def in_date_window(moments: Sequence[Column], start: Column | None, end: Column | None) -> Column:
    """True without a window, else if any of ``moments`` is in [start, end)."""
    if start is None or end is None:
        return F.lit(True)
    return F.coalesce(F.exists(F.array(*moments), lambda t: (t >= start) & (t < end)), F.lit(False))


def filter_memories(df: DataFrame, *, category=None, intent=None, status=None, created_from=None, created_to=None, confidence_from=None, confidence_to=None) -> DataFrame:
    """Conjunction of the conditions that are given; created_* are epoch seconds."""
    rules = [("category", "eq", category), ("intent", "eq", intent), ("status", "eq", status), ("created_s", "ge", created_from), ("created_s", "le", created_to), ("confidence", "ge", confidence_from), ("confidence", "le", confidence_to)]
    for name, how, value in rules:
        if value is not None:
            c = F.col(name)
            df = df.where(c == value if how == "eq" else c >= value if how == "ge" else c <= value)
    return df


def filter_owner(df: DataFrame, user_id: str) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def filter_ilike(df: DataFrame, term: str, columns: Sequence[str] = ("ocr_text", "filename"), statuses: Sequence[str] = ("ready", "partial")) -> DataFrame:
    """%term% in any column; percent sign and underscore in the term are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.ilike(F.col(c), F.lit(f"%{term}%"))
    return df.where(F.col("status").isin(*statuses) & hit)


def filter_json_path(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return df.where(F.get_json_object(column, path) == value)


def drop_rejected(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Pairs (query_norm, memory_id) without those that were marked not relevant."""
    return pairs.join(feedback.where("signal < 0").select("query_norm", "memory_id"), ["query_norm", "memory_id"], "left_anti")


def quality_floor(df: DataFrame, limit: int = 10, lowest: float = 24.0, behind: float = 16.0, most: int = 6) -> DataFrame:
    """Per query: scores of at least max(lowest, best - behind), at most min(limit, most) of them."""
    by = Window.partitionBy("query_id")
    best = df.withColumn("__best", F.max("score").over(by)).where(F.col("score") >= F.greatest(F.lit(lowest), F.col("__best") - behind))
    return best.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "memory_id"))).where(F.col("rank") <= min(limit, most)).drop("__best")


def high_value_entities(entities: Column, least: float = 0.8) -> Column:
    return F.filter(entities, lambda e: e["confidence"] >= least)


def upload_problems(size: Column, extension: Column, width: Column, height: Column, *, most_bytes=32 << 20, allowed=(".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".tif", ".tiff"), side=(16, 16_000), pixels=80_000_000) -> Column:
    """Reason codes, none for a good upload."""
    return F.array_compact(F.array(
        F.when(size <= 0, "empty"), F.when(size > most_bytes, "too_large"), F.when(~extension.isin(*allowed), "bad_type"),
        F.when(F.least(width, height) < side[0], "too_small"), F.when(F.greatest(width, height) > side[1], "side_too_long"),
        F.when(width.cast("long") * height > pixels, "too_many_pixels"),
    ))


def memory_flags(df: DataFrame) -> DataFrame:
    status = F.lower("status")
    return df.withColumns({
        "is_processed": status.isin("indexed", "ready", "completed"), "is_processing": status.isin("processing", "queued", "pending"),
        "has_error": status.contains("fail"), "has_embedding": F.col("indexed_s").isNotNull(),
        "is_searchable": status.isin("indexed", "ready", "completed") & F.col("indexed_s").isNotNull() & ~F.col("is_deleted"),
    })


def image_flags(df: DataFrame) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return df.withColumns({
        "aspect_ratio": F.when(h > 0, F.round(w / h, 6)), "is_landscape": w > h, "is_portrait": h > w, "is_square": w == h,
        "has_ocr": F.coalesce(F.trim("ocr_text") != "", F.lit(False)), "megapixels": F.round(w * h / 1e6, 6),
    })


def project_result(df: DataFrame) -> DataFrame:
    """What a search returns of a memory."""
    url = first_non_empty(F.col("path"), F.col("filename"))
    return df.select("memory_id", F.coalesce("title", F.lit("Untitled Memory")).alias("title"), url.alias("image_url"), F.substring("ocr_text", 1, 2000).alias("ocr_text"), F.round("confidence", 2).alias("score"), F.slice(F.split(F.lower("ocr_text"), " "), 1, 30).alias("keywords"))


def project_summary(df: DataFrame) -> DataFrame:
    """Title and summary from the first field that has one."""
    return df.select("memory_id", first_non_empty(F.col("title"), F.col("filename")).alias("title"), first_non_empty(F.col("summary"), F.substring("ocr_text", 1, 80)).alias("summary"), F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("other")).alias("category"))


# The names under which a field of a memory may come, the first that is not empty wins.
DETAIL_NAMES = {
    "memory_id": ["memory_id", "id"], "filename": ["filename", "original_filename", "source_name"], "original_image_url": ["original_image_url", "image_url"], "image_hash": ["image_hash", "sha256", "file_hash"],
    "title": ["title", "name"], "summary": ["summary", "description"], "category": ["category"],
}


def project_detail(df: DataFrame, names: dict[str, list[str]] = DETAIL_NAMES) -> DataFrame:
    """A memory under its own names of fields, whatever names the source has; rows without an id go."""

    def first(field: str) -> Column:
        there = [F.col(n).cast("string") for n in names[field] if n in df.columns]
        return first_non_empty(*there) if there else F.lit(None).cast("string")

    return df.select(*[first(field).alias(field) for field in names]).where("memory_id is not null")


def image_urls(df: DataFrame) -> DataFrame:
    """Image, preview, thumbnail and original, each the first of several places that is not empty."""
    preview, image = F.when(F.col("width") > 1000, F.concat("path", F.lit("/preview"))), F.col("path")
    thumb = F.when(F.col("height") > 500, F.concat("path", F.lit("/thumb")))
    return df.select("memory_id", first_non_empty(image, preview, thumb).alias("image_url"), first_non_empty(preview, image).alias("preview_url"), first_non_empty(thumb, preview, image).alias("thumbnail_url"), first_non_empty(F.col("title"), image).alias("original_url"))


def clean_concepts(values: Column, most: int = 5) -> Column:
    """Terms of three or more characters that say something, each once whatever its case, in order."""
    generic = F.array(*map(F.lit, GENERIC_TERMS))
    useful = lambda k: (F.length(k) >= 3) & ~F.array_contains(generic, k)
    return first_spelled(values, normalize, useful, most)


def first_spelled(values: Column, key: Callable[[Column], Column], useful: Callable[[Column], Column], most: int) -> Column:
    """The first ``most`` distinct useful keys of ``values``, as first spelled.  Keys are made once, and only those kept are looked up."""

    def kept(x: Column) -> Column:
        keys = F.slice(F.array_distinct(F.filter(x["k"], useful)), 1, most)
        return F.transform(keys, lambda k: F.trim(x["v"][F.array_position(x["k"], k).cast("int") - 1]))

    both = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), F.transform(v, key).alias("k")))
    return F.transform(both, kept)[0]


def due_jobs(jobs: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """Queued jobs, and those to try again by now, oldest first."""
    due = (F.col("status") == "queued") | ((F.col("status") == "retrying") & (F.col("next_attempt_s") <= now))
    return jobs.where(due).orderBy("created_s", "job_id").limit(most)


def check_constraints(df: DataFrame, rules: dict[str, Column], unique: Sequence[str]) -> DataFrame:
    """(rule, violations): rows that break each rule, in one pass, and keys that occur again."""
    sums = df.agg(*[F.sum(F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)).alias(n) for n, c in rules.items()])
    broken = sums.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))
    again = df.groupBy(*unique).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations"))
    return broken.unionByName(again.select(F.lit("unique_" + "_".join(unique)).alias("rule"), "violations"))


def validate_mapping(vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: numbers of vectors and mapped ids, ids without the other, and whether the mapping is one to one."""
    both = vectors.select(F.col("memory_id").alias("a")).join(mapping.select(F.col("memory_id").alias("b"), "vector_id"), F.col("a") == F.col("b"), "full_outer")
    return both.agg(
        F.count("a").alias("vectors"), F.count("b").alias("mapped"), F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("without_vector"), F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).alias("unmapped"),
        ((F.countDistinct("b") == F.count("b")) & (F.countDistinct("vector_id") == F.count("b"))).alias("one_to_one"),
    )
