"""Queries of sources, sinks, writes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..schemas import memories, oracle, read
from ..sources import tables as S
from ..sources.staging import scratch
from ..streaming import stateful
from ..streaming import streams as M
from .book import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def shared(spark, name: str) -> str:
    """A new folder that all executors share, gone with the session."""
    return f"{scratch(spark)}/{name}"


#: Memories in one JSON object of an index.
OBJECT_ROWS = 5_000


@book.add("s1_read_memory_index", oracle("SELECT memory_id, title, importance FROM mem"))
def s1(spark, d):
    # one JSON object a file, as many files as tasks: an object keyed by id, written by an aggregation of each shard
    path = shared(spark, "index")
    shards = -(-memories(spark, d).count() // OBJECT_ROWS)
    m = memories(spark, d).select("memory_id", F.struct("title", "importance").alias("m"), F.pmod(F.col("doc_id"), F.lit(max(1, shards))).alias("shard"))
    objects = m.groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("memory_id", "m")))).alias("value"))
    objects.write.partitionBy("shard").text(path)
    return S.read_memory_index(spark, path).select("memory_id", "title", "importance")


@book.add("s2_read_record_dir", oracle("SELECT memory_id, title FROM mem"))
def s2(spark, d):
    path = shared(spark, "records")
    memories(spark, d).select("memory_id", "title").write.json(path)
    return S.read_record_lines(spark, path, "memory_id string, title string")


@book.add("s3_scan_files")
def s3(spark, d):
    """Listing of a folder of files that Spark has written, as of images."""
    path = shared(spark, "files")
    read(spark, d, "pages").select("html").repartition(8).write.text(path)
    return S.scan_images(spark, path, ["txt"], hashed=True).select("name", "extension", "size", "sha256", "duplicate")


@book.add("s4_upsert", oracle("SELECT memory_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE title END AS title, status FROM mem UNION ALL SELECT 'x' || memory_id, 'new', NULL FROM mem WHERE doc_id % 50 = 0"))
def s4(spark, d):
    m = memories(spark, d).select("doc_id", "memory_id", "title", "status")
    changes = m.where("doc_id % 5 = 0").select("memory_id", F.lit("new").alias("title")).unionByName(m.where("doc_id % 50 = 0").select(F.concat(F.lit("x"), "memory_id").alias("memory_id"), F.lit("new").alias("title")))
    return S.upsert(m.drop("doc_id"), changes, "memory_id")


@book.add("s5_ocr_records", oracle(r"SELECT memory_id, sha256(trim(regexp_replace(ocr_text, '\s+', ' ', 'g'))) AS text_hash FROM mem WHERE doc_id % 7 <> 0"))
def s5(spark, d):
    m = memories(spark, d).withColumn("text_hash", F.lit(None).cast("string"))
    return S.delete_records(S.ocr_records(m), m.where("doc_id % 7 = 0")).select("memory_id", "text_hash")


def vec(spark, d, where="true", shift=0):
    return read(spark, d, "embeddings").where(where).select((F.col("vec_id") + shift).alias("memory_id"), F.col("embedding").alias("vec"))


@book.add("s6_upsert_vectors", "SELECT vec_id AS memory_id, round(CASE WHEN vec_id % 4 = 0 THEN embedding[1]::DOUBLE * 2 ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings")
def s6(spark, d):
    batch = vec(spark, d, "vec_id % 4 = 0").withColumn("o", F.lit(1)).unionByName(vec(spark, d, "vec_id % 4 = 0").withColumns({"vec": F.transform("vec", lambda x: x * 2), "o": F.lit(2)}))
    return V.upsert_vectors(vec(spark, d), batch).select("memory_id", F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"))


@book.add("s7_append_problems", "SELECT vec_id AS memory_id, 'exists' AS problem FROM embeddings WHERE vec_id % 9 = 0 UNION ALL SELECT vec_id, 'invalid' FROM embeddings WHERE vec_id % 18 = 0")
def s7(spark, d):
    batch = vec(spark, d, "vec_id % 9 = 0").withColumn("vec", F.when(F.col("memory_id") % 18 == 0, F.slice("vec", 1, 3)).otherwise(F.col("vec")))
    return V.append_problems(vec(spark, d), batch, 64)


@book.add("s8_remove_vectors", "SELECT vec_id AS memory_id FROM embeddings WHERE vec_id % 6 <> 0")
def s8(spark, d):
    return V.remove_vectors(vec(spark, d), vec(spark, d, "vec_id % 6 = 0", 0))[0].select("memory_id")


@book.add("s9_backfill", "SELECT doc_id AS memory_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id LIMIT 100")
def s9(spark, d):
    state = read(spark, d, "labels").select(F.col("doc_id").alias("memory_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return V.pending_backfill(read(spark, d, "documents").select(F.col("doc_id").alias("memory_id")), state, limit=100)


@book.add("s10_feedback", "SELECT user_id::VARCHAR AS query_norm, event_type AS memory_id, arg_max(CASE WHEN value > 30 THEN 1 ELSE -1 END, epoch_us(ts)) AS signal FROM events GROUP BY ALL")
def s10(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("query_norm"), F.col("event_type").alias("memory_id"), F.when(F.col("value") > 30, 1).otherwise(-1).alias("signal"), "ts", F.col("event_id").alias("o"))
    return S.latest_feedback(e)


@book.add("s11_contains", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def s11(spark, d):
    return S.existing(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), read(spark, d, "documents").select("doc_id"), "doc_id")


@book.add("s12_find_paths", "SELECT doc_id, 'path' AS name, 'p' || CAST(doc_id AS STRING) AS value FROM documents UNION ALL SELECT doc_id, 'url', source FROM documents")
def s12(spark, d):
    json = F.to_json(F.struct(F.struct(F.concat(F.lit("p"), "doc_id").alias("path"), F.array(F.struct(F.col("source").alias("url"))).alias("list")).alias("meta"), F.col("lang")))
    return S.find_paths(read(spark, d, "documents").select("doc_id", json.alias("j")), "doc_id", "j")


@book.add("s13_read_table", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def s13(spark, d):
    orders = S.read_table(spark, f"{d}/orders.parquet")
    least = orders.agg(F.min("o_custkey").alias("k"))
    return orders.join(F.broadcast(least), F.col("o_custkey") == F.col("k")).select("o_orderkey", "o_custkey")


@book.add("s14_search_history", "SELECT event_type AS normalized_query, count(*) AS n, round(sum(greatest(value - 20, 0)), 4) AS ms FROM events GROUP BY 1")
def s14(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("  "), F.upper("event_type")).alias("query"), F.lit("hybrid").alias("search_mode"), (F.col("value") - 20).alias("duration_ms"), F.lit(1).alias("result_count"), F.lit(True).alias("success"))
    return S.search_history(e).groupBy("normalized_query").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 4).alias("ms"))


@book.add("s14_run_log", """SELECT user_id AS run_id, count(*) AS total_items, greatest(count(*) FILTER (event_type = 'purchase') - 3, 0) AS successful_items, count(*) FILTER (event_type = 'error') AS failed_items,
    greatest(max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT), 0) * 1000 AS duration_ms, count(*) FILTER (event_type = 'error') = 0 AS success FROM events GROUP BY 1""")
def s14_runs(spark, d):
    e = read(spark, d, "events").withColumn("at", F.unix_timestamp("ts"))
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(
        F.lit("index").alias("run_type"), F.lit("completed").alias("status"), F.count(F.lit(1)).alias("total_items"), (F.count_if(F.col("event_type") == "purchase") - 3).alias("successful_items"),
        F.lit(None).cast("long").alias("partial_items"), F.count_if(F.col("event_type") == "error").alias("failed_items"), F.lit(1).alias("attempt_number"), F.lit(3).alias("max_attempts"), F.min("at").alias("started_at"), F.max("at").alias("completed_at"),
    )
    return S.run_log(runs).select("run_id", "total_items", "successful_items", "failed_items", "duration_ms", "success")


@book.add("s15_json_rows")
def s15(spark, d):
    return S.json_rows(memories(spark, d).select("memory_id", "title", "status", "created_s"))


@book.add("u1_embed_texts")
def u1(spark, d):
    return V.embed_texts(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.size("vec").alias("n"))


@book.add("m1_watch", "SELECT doc_id, lang FROM documents")
def m1(spark, d):
    out, state = shared(spark, "watched"), shared(spark, "state")
    docs = read(spark, d, "documents").select("doc_id", "lang")
    source = shared(spark, "incoming")
    docs.repartition(4).write.parquet(source)
    M.watch(spark, source, docs.schema, state, lambda df, _: df.write.mode("append").parquet(out)).awaitTermination()
    return spark.read.parquet(out)


@book.add("m2_dedup_stream", "SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def m2(spark, d):
    source = shared(spark, "incoming")
    read(spark, d, "documents").select(F.sha2("text", 256).alias("sha256")).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("sha256 string").parquet(source)
    out = shared(spark, "unique")
    M.dedup_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@book.add("m3_two_phase", "SELECT doc_id, doc_id % 3 = 0 AS processed FROM documents WHERE doc_id % 3 <> 0")
def m3(spark, d):
    table = M.fast_phase(read(spark, d, "documents").select("doc_id")).withColumn("processed", F.col("doc_id") % 3 == 0)
    return M.pending_enrichment(table).select("doc_id", "processed")


@book.add("m4_job_state", """
    WITH e AS (SELECT user_id % 50 AS job_id, epoch(ts)::BIGINT AS t, event_id, CASE event_type WHEN 'click' THEN 'claim' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' ELSE 'queue' END AS kind FROM events),
    l AS (SELECT job_id, arg_max(kind, t * 1000000 + event_id) AS last, max(t) AS t, count(*) FILTER (kind = 'fail') AS attempts FROM e GROUP BY 1)
    SELECT job_id, attempts, CASE WHEN last = 'done' THEN 'completed' WHEN last = 'fail' AND attempts >= 5000 THEN 'failed' WHEN last = 'fail' THEN 'retrying' WHEN last = 'claim' AND 1800000000 - t > 900 THEN 'retrying' WHEN last = 'claim' THEN 'processing' ELSE 'queued' END AS status FROM l""".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def m4(spark, d):
    return M.job_state(job_events(spark, d), 1_800_000_000, most_attempts=5000).drop("next_attempt")


def job_events(spark, d):
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").otherwise("queue")
    return read(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("o"), kind.alias("kind"))


@book.add("m4_job_stream", ORACLES["m4_job_state"].replace("1800000000 - t > 900", "TRUE"))  # all leases are over by now
def m4_stream(spark, d):
    source = shared(spark, "incoming")
    e = job_events(spark, d)
    e.repartition(4, "o").write.parquet(source)
    stream = stateful.job_stream(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source), most_attempts=5000)
    return M.run_to_table(stream, shared(spark, "jobs"), shared(spark, "state"), "job_id").select("job_id", "attempts", "status")


@book.add("m5_rate_limit")
def m5(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("client"), F.col("event_type").alias("area"), F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("at"))
    return M.rate_limit_batch(e, 3, 3600)


@book.add("m5_rate_limit_stream")
def m5_stream(spark, d):
    source = shared(spark, "incoming")
    e = read(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("client"), F.col("event_type").alias("area"), F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("at"))
    e.repartitionByRange(4, "at", "request_id").write.parquet(source)
    stream = stateful.rate_limit(spark.readStream.schema(e.schema).parquet(source), 3, 3600)
    return M.run_to_table(stream, shared(spark, "limited"), shared(spark, "state"), "request_id", mode="append")


@book.add("m6_progress_stream", "SELECT event_type AS phase, count(*) AS n FROM events GROUP BY 1")
def m6(spark, d):
    source = shared(spark, "incoming")
    read(spark, d, "events").select(F.col("event_type").alias("phase")).repartition(4).write.parquet(source)
    stream = M.progress_stream(spark.readStream.schema("phase string").parquet(source))
    return M.run_to_table(stream, shared(spark, "progress"), shared(spark, "state"), "phase")


@book.add("m7_heartbeat", "SELECT user_id AS worker, max(floor(epoch(ts))::BIGINT) AS at, 1800000000 - max(floor(epoch(ts))::BIGINT) <= 100000000 AS healthy FROM events GROUP BY 1")
def m7(spark, d):
    return M.heartbeat_health(read(spark, d, "events").select(F.col("user_id").alias("worker"), F.unix_timestamp("ts").alias("at")), 1_800_000_000, 100_000_000)


@book.add("m8_feedback_stream", "SELECT user_id::VARCHAR AS query_norm, event_type AS memory_id, arg_max(CASE WHEN value > 30 THEN 1 ELSE -1 END, epoch_us(ts)) AS signal FROM events GROUP BY ALL")
def m8(spark, d):
    source = shared(spark, "incoming")
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("query_norm"), F.col("event_type").alias("memory_id"), F.when(F.col("value") > 30, 1).otherwise(-1).alias("signal"), "ts")
    e.repartition(4).write.parquet(source)
    stream = M.latest_signal(spark.readStream.schema(e.schema).parquet(source))
    return M.run_to_table(stream, shared(spark, "feedback"), shared(spark, "state"), "query_norm", "memory_id")
