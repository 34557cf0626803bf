"""Incremental forms: watching a folder, dropping seen content, jobs, rate limits, progress, heartbeats and feedback.

Each is a Structured Streaming query whose ``availableNow`` result equals the batch operator's.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import backoff_s


def watch(spark: SparkSession, path: str, schema: StructType, checkpoint: str, each: Callable[[DataFrame, int], None], interval: str | None = None):
    """Hand every batch of new files to ``each``, once; with an interval for ever, else what is there now."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dedup_stream(stream: DataFrame, key: str = "sha256", event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Content seen before goes, across restarts; with an event time the state is bounded by the delay."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def fast_phase(df: DataFrame) -> DataFrame:
    return df.withColumns({"visual_indexed": F.lit(True), "processed": F.lit(False), "phase": F.lit("visual_ready")})


def pending_enrichment(table: DataFrame) -> DataFrame:
    return table.where(F.col("visual_indexed") & ~F.col("processed"))


def progress_stream(stream: DataFrame) -> DataFrame:
    return stream.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


def job_state(events: DataFrame, now: int, most_attempts: int = 5, lease_s: int = 900) -> DataFrame:
    """State of each job from its events (job_id, at, kind of claim, fail or done): retries back off, lost leases are tried again."""
    last = events.groupBy("job_id").agg(F.max_by("kind", F.struct("at", "o")).alias("last"), F.max("at").alias("at"), F.count_if(F.col("kind") == "fail").alias("attempts"))
    wait = F.col("at") + backoff_s(F.col("attempts"))
    status = F.when(F.col("last") == "done", "completed").when((F.col("last") == "fail") & (F.col("attempts") >= most_attempts), "failed").when(F.col("last") == "fail", "retrying").when((F.col("last") == "claim") & (F.lit(now) - F.col("at") > lease_s), "retrying").when(F.col("last") == "claim", "processing").otherwise("queued")
    return last.withColumn("status", status).select("job_id", "attempts", "status", F.when(F.col("status") == "retrying", F.when(F.col("last") == "fail", wait).otherwise(F.lit(now))).alias("next_attempt"))


def rate_limit_batch(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """As ``stateful.rate_limit``, for a table: Spark sorts each key's requests by time, spilling, and a task reads them a batch at a time.

    Whether a request is accepted depends on all before it, so a key is one task's; what the task holds is one batch and the
    accepted times of one window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        for batch in batches:
            out = []
            for client, area, at in zip(batch["client"], batch["area"], batch["at"]):
                if (client, area) != key:
                    key, times = (client, area), deque()
                while times and times[0] <= at - seconds:
                    times.popleft()
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(int(at))
            yield batch[["client", "area", "request_id"]].assign(accepted=out)

    rows = requests.select("client", "area", "request_id", "at").repartition("client", "area").sortWithinPartitions("client", "area", "at", "request_id")
    return rows.mapInPandas(run, "client string, area string, request_id long, accepted boolean")


def heartbeat_health(beats: DataFrame, now: int, stale_s: int) -> DataFrame:
    """The latest beat of each worker, and whether it is too old."""
    return beats.groupBy("worker").agg(F.max("at").alias("at")).withColumn("healthy", F.lit(now) - F.col("at") <= stale_s)


def latest_signal(stream: DataFrame) -> DataFrame:
    """The last signal of each (query_norm, memory_id), for update mode."""
    return stream.groupBy("query_norm", "memory_id").agg(F.max_by("signal", "ts").alias("signal"))


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


class LatestTable:
    """A table of the last row of each key, kept by a stream in update or append mode.

    A micro-batch writes its rows to a folder of its own number, over what a failed try of the same batch has left, so running a batch again changes
    nothing.  Reading takes the row of the greatest batch for each key; a key has one row a batch.  Nothing passes the driver.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, *keys: str):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str, mode: str = "update", interval: str | None = None):
        """With an interval for ever, else over what is there now: without batches for the clock alone, which timers would ask for without end."""
        writer = stream.writeStream.foreachBatch(self.put).outputMode(mode).option("checkpointLocation", checkpoint)
        if interval:
            return writer.trigger(processingTime=interval).start()
        conf, name = self.spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name)
        conf.set(name, "false")
        try:
            return writer.trigger(availableNow=True).start()
        finally:
            conf.set(name, before)

    def _rows(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("batch", LongType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        last = self._rows().groupBy(*self.keys).agg(F.max_by(F.struct(*self.schema.names), "batch").alias("r"))
        return last.select("r.*")

    def compact(self, path: str) -> LatestTable:
        """The same table at ``path``, in one batch of the greatest number; the stream goes on there, with its checkpoint."""
        other = LatestTable(self.spark, path, self.schema, *self.keys)
        other.put(self.read(), self._rows().agg(F.max("batch")).first()[0])
        return other


def run_to_table(stream: DataFrame, path: str, checkpoint: str, *keys: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now, into a table of the last row of each key."""
    table = LatestTable(stream.sparkSession, path, stream.schema, *keys)
    table.start(stream, checkpoint, mode).awaitTermination()
    return table.read()
