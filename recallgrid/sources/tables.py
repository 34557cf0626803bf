"""Sources and sinks: JSON indexes, record folders, image listings, relational tables, keyed upserts and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MEMORY

# Extensions of images, and keys that hold a path.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff"]
PATH_KEYS = ["path", "file_path", "image_path", "original_path", "stored_path", "source_path", "absolute_path", "url", "filename"]


def read_memory_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each memory of a JSON object keyed by id; text that is no such object has no rows."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string,{MEMORY.simpleString()}>")
    return text.select(F.explode(entries).alias("key", "m")).select(F.coalesce("m.memory_id", "key").alias("memory_id"), *[f"m.{f.name}" for f in MEMORY.fields[1:]])


def read_record_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file that holds an object; the others are left out."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    names = [f for f in rows.columns if f != "_corrupt_record"]
    return rows.where("_corrupt_record is null").where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()).select(*names)


def read_record_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of files with one object a line, which Spark splits."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def scan_images(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS, hashed: bool = False) -> DataFrame:
    """(path, name, extension, modified, size[, sha256, duplicate]) of all images under a folder; contents are read only for hashes.

    A file is a duplicate if one with an earlier path has its hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("extension"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))
    if not hashed:
        return listed
    first = listed.groupBy("sha256").agg(F.min("path").alias("__first"))
    return listed.join(first, "sha256").withColumn("duplicate", F.col("path") > F.col("__first")).drop("__first")


def read_table(spark: SparkSession, where: str, owner: str | None = None, **jdbc: str) -> DataFrame:
    """A relational table, by JDBC if a url is given, else Parquet; the owner's rows only, by a pushed filter."""
    df = spark.read.format("jdbc").options(dbtable=where, **jdbc).load() if "url" in jdbc else spark.read.parquet(where)
    return df.where(F.col("user_id") == owner) if owner else df


def upsert(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Keyed replace: the updates' columns win where they are not null, columns that they lack stay, new keys are added."""
    u = updates.select(*[F.col(c).alias(f"__{c}") for c in updates.columns])
    joined = table.join(u, F.col(key) == F.col(f"__{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in updates.columns else F.col(c) for c in table.columns])


def write_swapped(df: DataFrame, path: str, staging: str) -> None:
    """Write beside the table, set the old rows aside by a rename, and rename the new ones into place.

    A crash leaves the rows of before whole, at ``path`` or at ``path`` with ``.before`` added; the next call puts them back first.
    """
    context = df.sparkSession.sparkContext
    new, old, before = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, path, path.rstrip("/") + ".before"))
    files = old.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(before) and not files.exists(old):
        files.rename(before, old)
    df.write.mode("overwrite").parquet(staging)
    files.delete(before, True)
    if files.exists(old) and not files.rename(old, before) or not files.rename(new, old):
        raise OSError(f"{path} was not replaced")
    files.delete(before, True)


def ocr_records(df: DataFrame) -> DataFrame:
    """(memory_id, ocr_text, text_hash): the hash filled in where it is missing."""
    text = F.trim(F.regexp_replace(F.coalesce("ocr_text", F.lit("")), r"\s+", " "))
    return df.select("memory_id", text.alias("ocr_text"), F.coalesce("text_hash", F.sha2(text, 256)).alias("text_hash"))


def delete_records(table: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def existing(table: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    return ids.join(table.select(key), key, "left_semi")


def latest_feedback(log: DataFrame) -> DataFrame:
    """The last signal of each (query_norm, memory_id)."""
    return log.groupBy("query_norm", "memory_id").agg(F.max_by("signal", F.struct("ts", "o")).alias("signal"))


def find_paths(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, name, value) of all values under known path keys anywhere in a JSON document, at any depth: a level a pass, until one is empty."""
    level = df.select(key, F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    found, depth = None, 0
    while found is None or depth % 8 or not level.isEmpty():  # emptiness is asked every eighth level
        pairs = df.sparkSession.sql(f"SELECT {key}, x.key AS name, x.value AS v FROM {{level}}, LATERAL variant_explode_outer(v) AS x", level=level).where("v is not null")
        hits = pairs.where(F.col("name").isin(*PATH_KEYS)).select(key, "name", F.try_variant_get("v", "$", "string").alias("value"))
        found = hits if found is None else found.unionAll(hits)
        level, depth = pairs.select(key, "v"), depth + 1
    return found.where("value is not null")


def search_history(results: DataFrame) -> DataFrame:
    """One row a search, ready to append: query normalised, times that are negative set to 0."""
    norm = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    return results.select("query", norm.alias("normalized_query"), "search_mode", F.greatest(F.col("duration_ms"), F.lit(0)).alias("duration_ms"), "result_count", "success")


def run_log(runs: DataFrame) -> DataFrame:
    """One row a processing run, ready to append: counts and durations that are negative set to 0, and whether all items went well."""
    count = lambda n: F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    names = ("total_items", "successful_items", "partial_items", "failed_items")
    duration = F.when(F.col("completed_at").isNotNull(), F.greatest(F.col("completed_at") - F.col("started_at"), F.lit(0)) * 1000)
    success = (F.col("status") == "completed") & (count("failed_items") == 0)
    return runs.select("run_id", "run_type", "status", *[count(n).cast("long").alias(n) for n in names], "attempt_number", "max_attempts", "started_at", "completed_at", duration.alias("duration_ms"), success.alias("success"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def backoff_s(attempts: Column) -> Column:
    return F.least(F.lit(3600), F.pow(F.lit(2.0), attempts).cast("long"))
