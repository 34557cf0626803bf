"""Streams with state against their batch forms: several micro-batches, a restart, late rows, timers, batches that run again."""

import time

import pandas as pd
from pyspark.sql import functions as F

from recallgrid.streaming import stateful, streams

JOBS = "job_id long, at long, o long, kind string"


def told(df):
    return {r.job_id: (r.attempts, r.status) for r in df.collect()}


def test_jobs_over_batches_and_a_restart(spark, tmp_path):
    now = int(time.time())
    events = [(j, now - 5000 + (j * 37 + k * 911) % 4000, j * 100 + k, kind) for j in range(30) for k, kind in enumerate(["queue", "claim", "fail", "claim", "fail", "claim", "done"][: 1 + j % 7])]
    events += [(100, now + 5000, 1, "claim"), (101, now - 100, 1, "claim"), (102, now - 2000, 2, "claim"), (103, now, 1, "fail"), (103, now, 0, "claim")] + [(104, now - 9000 + k, k, "fail") for k in range(5)]
    source, checkpoint, table = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "jobs")
    halves = [events[::2], events[1::2]]
    for n, part in enumerate(halves):
        spark.createDataFrame(part, JOBS).repartition(3).write.mode("append").parquet(source)
        stream = stateful.job_stream(spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(source))
        got = streams.run_to_table(stream, table, checkpoint, "job_id")
        sofar = spark.createDataFrame([e for p in halves[: n + 1] for e in p], JOBS)
        assert told(got) == told(streams.job_state(sofar, int(time.time())))
    rows = {r.job_id: r for r in got.collect()}
    assert rows[104].status == "failed" and rows[102].due and not rows[100].due and rows[103].next_attempt == now + 2


def test_a_lease_runs_out_and_a_failure_becomes_due(spark, tmp_path):
    source, now = str(tmp_path / "in"), int(time.time())
    spark.createDataFrame([(1, now, 0, "claim"), (2, now + 1, 0, "fail"), (3, now, 0, "done")], JOBS).coalesce(1).write.parquet(source)
    stream = stateful.job_stream(spark.readStream.schema(JOBS).parquet(source), lease_s=4)
    table = streams.LatestTable(spark, str(tmp_path / "jobs"), stream.schema, "job_id")
    query = table.start(stream, str(tmp_path / "state"), interval="1 second")
    seen = {}
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                for r in table.read().collect():
                    seen.setdefault(r.job_id, []).append((r.status, r.due))
            except Exception:  # no batch is written yet
                continue
            if all(seen.get(j, [(None, False)])[-1] == ("retrying", True) for j in (1, 2)):
                break
    finally:
        query.stop()
    assert seen[1][-1] == ("retrying", True) and seen[2][-1] == ("retrying", True) and set(seen[3]) == {("completed", False)}


def test_rate_limit_over_batches(spark, tmp_path):
    rows = [(f"c{i % 3}", "s", i, (i * 7) // 5) for i in range(400)]
    schema = "client string, area string, request_id long, at long"
    df = spark.createDataFrame(rows, schema)
    want = {(r.client, r.request_id, r.accepted) for r in streams.rate_limit_batch(df, limit=4, seconds=20).collect()}
    source = str(tmp_path / "in")
    for n in range(4):  # in order of time; a batch a file, and a restart in between
        spark.createDataFrame(rows[n * 100 : (n + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.rate_limit(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), limit=4, seconds=20)
        got = streams.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"), "request_id", mode="append")
    assert {(r.client, r.request_id, r.accepted) for r in got.collect()} == want
    assert 0 < sum(a for *_, a in want) < 400


def test_a_late_request_is_judged_at_the_last_ones_time(spark):
    class Times:
        kept = [(100,), (110,)]

        def get(self):
            return iter(self.kept)

        def put(self, rows):
            self.kept = rows

    p = stateful.LimitProcessor(3, 20, 60)
    p.times = Times()
    frame = pd.DataFrame({"at": [90, 125, 95], "request_id": [1, 2, 3]})
    out = pd.concat(list(p.handleInputRows(("c", "a"), iter([frame]), None)))
    assert dict(zip(out["request_id"], out["accepted"])) == {1: True, 3: False, 2: True} and p.times.kept == [(110,), (110,), (125,)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long").schema
    table = streams.LatestTable(spark, str(tmp_path / "t"), schema, "k")
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    table.put(batch(("a", 1), ("b", 1)), 0)
    table.put(batch(("a", 5)), 1)
    before = sorted(tuple(r) for r in table.read().collect())
    table.put(batch(("a", 5)), 1)
    table.put(batch(("a", 1), ("b", 1)), 0)
    assert before == sorted(tuple(r) for r in table.read().collect()) == [("a", 5), ("b", 1)]
    small = table.compact(str(tmp_path / "u"))
    assert sorted(tuple(r) for r in small.read().collect()) == before and small._rows().select("batch").distinct().count() == 1
    table.put(batch(), 2)
    assert table.read().where(F.col("k") == "b").count() == 1
