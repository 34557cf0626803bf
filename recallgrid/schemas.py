"""The memory table, and the adapter that makes it from the driver's tables.

``documents`` play the memories: text is what was read from the image, source the owner, lang the subcategory.  Fields that no
table has come from the id by plain arithmetic, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Canonical record of one memory.
MEMORY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("memory_id", "user_id", "filename", "path", "title", "summary", "description", "ocr_text", "visual_description", "category", "subcategory", "intent")]
    + [T.StructField("importance", T.IntegerType())]
    + [T.StructField("entities", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("text", T.StringType()), ("type", T.StringType()), ("normalized", T.StringType()), ("confidence", T.DoubleType()), ("source", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()))])))]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("people", "organizations", "locations", "products", "dates", "prices", "emails", "phone_numbers", "urls", "keywords", "tags", "actionable_items")]
    + [T.StructField(n, T.StringType()) for n in ("scene", "environment", "search_document", "content_hash", "status")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.TimestampType()) for n in ("captured_at", "created_at", "indexed_at", "updated_at")]
    + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("file_size", T.LongType()), T.StructField("is_deleted", T.BooleanType()), T.StructField("version", T.IntegerType())]
)

# Fields by arithmetic on doc_id; epochs are whole seconds.
MEMORIES = """
    SELECT doc_id, 'm' || CAST(doc_id AS STRING) AS memory_id, source AS user_id, lang AS subcategory, text AS ocr_text,
        'Shot ' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.txt' END AS filename,
        'images/' || CAST(doc_id AS STRING) AS path,
        CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN ' ' ELSE 'Memory ' || lang || ' ' || CAST(doc_id % 50 AS STRING) END AS title,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(text, 1, 120) END AS summary,
        CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'receipt' WHEN 3 THEN 'Document' WHEN 4 THEN 'code' WHEN 5 THEN 'travel' WHEN 6 THEN 'food' WHEN 7 THEN 'shopping' ELSE 'chat' END AS category,
        CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PAYMENT' WHEN 2 THEN 'Learning' WHEN 3 THEN 'TRAVEL' ELSE 'OTHER' END AS intent,
        CASE doc_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'queued' WHEN 3 THEN 'partial' WHEN 4 THEN 'ready' WHEN 5 THEN 'ocr_failed' ELSE 'indexed' END AS status,
        CAST(1704067200 + doc_id * 3600 AS BIGINT) AS created_s,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1704067200 + doc_id * 1800 AS BIGINT) END AS captured_s,
        CASE WHEN doc_id % 4 = 1 THEN NULL ELSE CAST(1704067200 + doc_id * 3600 + 60 AS BIGINT) END AS indexed_s,
        CAST(doc_id % 6 AS INT) AS importance, CAST((doc_id % 101) / 100.0 AS DOUBLE) AS confidence,
        CAST(100 + doc_id % 4000 AS INT) AS width, CAST(80 + doc_id % 3000 AS INT) AS height,
        CAST(doc_id % 997 * 40000 AS BIGINT) AS file_size, doc_id % 17 = 0 AS is_deleted, CAST(1 + doc_id % 3 AS INT) AS version
    FROM {documents}
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, dealt out so that work on its texts uses all cores; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEMORIES, documents=spread(read(spark, sf_dir, "documents")))


def oracle(sql: str) -> str:
    """DuckDB SQL over ``mem``, the memories."""
    sql = sql.strip()
    mem = f"WITH mem AS ({MEMORIES.format(documents='documents')})"
    return f"{mem}, {sql[5:]}" if sql.startswith("WITH ") else f"{mem} {sql}"
