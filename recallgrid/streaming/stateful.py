"""Operators with state of their own: jobs with leases and back-off, and rate limits.  They need the RocksDB state store, which they set for the session.

Both are the streams of batch operators, and give the same result over the same rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_ROW = "job_id long, attempts long, status string, next_attempt long, due boolean"
LIMIT_ROW = "client string, area string, request_id long, accepted boolean"
#: Rows of one frame of results.
FRAME = 10_000


class JobProcessor(StatefulProcessor):
    """One job: its last event and its failures.  A claim sets a timer for its lease, a failure one for its back-off; a later event takes the timer back."""

    def __init__(self, most_attempts: int, lease_s: int):
        self.most_attempts, self.lease_s = most_attempts, lease_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "last string, at long, o long, attempts long, timer long")

    def _told(self, key: tuple, last: str, at: int, attempts: int, now: int) -> tuple[pd.DataFrame, int]:
        """The job's row at ``now``, and when it changes by itself, or 0."""
        wait = at + min(3600, 2 ** min(attempts, 12))
        status, after, due, timer = "queued", None, False, 0
        if last == "done":
            status = "completed"
        elif last == "fail" and attempts >= self.most_attempts:
            status = "failed"
        elif last == "fail":
            status, after, due, timer = "retrying", wait, wait <= now, wait
        elif last == "claim" and now - at > self.lease_s:
            status, after, due = "retrying", now, True
        elif last == "claim":
            status, timer = "processing", at + self.lease_s + 1
        row = pd.DataFrame({"job_id": [key[0]], "attempts": [attempts], "status": [status], "next_attempt": pd.array([after], "Int64"), "due": [due]})
        return row, 0 if due else timer

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, at, o, attempts, timer = self.job.get() if self.job.exists() else (None, -(1 << 62), -(1 << 62), 0, 0)
        for frame in rows:
            attempts += int((frame["kind"] == "fail").sum())
            newest = frame.iloc[np.lexsort((frame["o"], frame["at"]))[-1]]
            if (newest["at"], newest["o"]) >= (at, o):
                last, at, o = str(newest["kind"]), int(newest["at"]), int(newest["o"])
        if timer:
            self.handle.deleteTimer(timer * 1000)
        row, timer = self._told(key, last, at, attempts, timerValues.getCurrentProcessingTimeInMs() // 1000)
        if timer:
            self.handle.registerTimer(timer * 1000)
        self.job.update((last, at, o, attempts, timer))
        yield row

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, at, o, attempts, _ = self.job.get()
        row, _ = self._told(key, last, at, attempts, max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()) // 1000)
        self.job.update((last, at, o, attempts, 0))
        yield row

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, most_attempts: int = 5, lease_s: int = 900) -> DataFrame:
    """(job_id, attempts, status, next_attempt, due) of a stream of events (job_id, at, o, kind), in update mode: a row a job and batch, and one when a timer fires.

    The clock is that of the cluster.  Events may come in any order; the last by (at, o) tells the state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.selectExpr("cast(job_id as long) job_id", "cast(at as long) at", "cast(o as long) o", "kind")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobProcessor(most_attempts, lease_s), outputStructType=JOB_ROW, outputMode="Update", timeMode="ProcessingTime")


class LimitProcessor(StatefulProcessor):
    """One client in one area: the accepted times of a window, at most ``limit`` numbers, which leave the state some time after their last use."""

    def __init__(self, limit: int, seconds: int, keep_s: int):
        self.limit, self.seconds, self.keep_s = limit, seconds, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long", ttlDurationMs=self.keep_s * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = deque(t[0] for t in self.times.get())
        parts = [(f["at"].to_numpy(np.int64), f["request_id"].to_numpy(np.int64)) for f in rows]  # two numbers a request
        at, ids = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((ids, at))
        at, ids, accepted = at[order], ids[order], np.zeros(len(order), bool)
        for k, t in enumerate(at.tolist()):
            t = max(t, kept[-1]) if kept else t  # time does not run back
            while kept and kept[0] <= t - self.seconds:
                kept.popleft()
            if len(kept) < self.limit:
                accepted[k] = True
                kept.append(t)
        self.times.put([(t,) for t in kept]) if kept else self.times.clear()
        for lo in range(0, len(ids), FRAME):
            yield pd.DataFrame({"client": key[0], "area": key[1], "request_id": ids[lo : lo + FRAME], "accepted": accepted[lo : lo + FRAME]})

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int = 60, seconds: int = 60, keep_s: int = 86_400) -> DataFrame:
    """(client, area, request_id, accepted) of a stream of requests (client string, area string, request_id, at in seconds), in append mode.

    A request is accepted while fewer than ``limit`` were for its key in the trailing window.  A micro-batch takes its requests in order of time; one
    that comes late, with a later one accepted in an earlier batch, is judged at that one's time.  The state of a key that is silent for ``keep_s``
    seconds of the cluster's clock goes: let it be longer than the window and than any delay of the source.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = requests.selectExpr("client", "area", "cast(request_id as long) request_id", "cast(at as long) at")
    return rows.groupBy("client", "area").transformWithStateInPandas(statefulProcessor=LimitProcessor(limit, seconds, keep_s), outputStructType=LIMIT_ROW, outputMode="Append", timeMode="ProcessingTime")
