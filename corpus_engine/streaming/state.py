"""Streams with state that expires: rows once per key, and jobs that time out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpus_engine.streaming.progress import JOB_EVENTS

#: The state store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once_per_key(events: DataFrame, keys: list[str], time: str = "ts", within: str = "1 day") -> DataFrame:
    """The first row of each key; later ones within the delay go.

    State of a key is kept until the watermark has passed its row by the delay, so it
    does not grow with the stream; rows older than the watermark are dropped.
    """
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


_STATE = "status string, status_at timestamp, status_id long, started timestamp, completed timestamp, pages long, pages_at timestamp, pages_id long, last timestamp"
JOB_STATES = "job_id long, status string, started_at timestamp, completed_at timestamp, total_urls_crawled long, last_event_at timestamp"


class JobTracker(StatefulProcessor):
    """Folds the events of a job, in whatever order they come, and lets a silent one time out.

    Each field is set by its last event in the order of (ts, event_id), so the state does
    not depend on batches; it is one row per job.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _row(self, key, state: dict, status: str | None = None) -> pd.DataFrame:
        columns = {
            "job_id": [key[0]],
            "status": [status or state["status"]],
            "started_at": [state["started"]],
            "completed_at": [state["completed"]],
            "total_urls_crawled": pd.Series([state["pages"]], dtype="Int64"),
            "last_event_at": [state["last"]],
        }
        frame = pd.DataFrame(columns)
        for c in ("started_at", "completed_at", "last_event_at"):
            frame[c] = pd.to_datetime(frame[c])
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _STATE.split(", ")]
        held = self.job.get() if self.job.exists() else (None,) * len(names)
        s = dict(zip(names, held))
        new = {"crawl.started": "running", "crawl.completed": "completed", "crawl.failed": "failed"}

        def later(name: str, order: tuple) -> bool:
            return s[f"{name}_at"] is None or order >= (s[f"{name}_at"], s[f"{name}_id"])

        for frame in rows:
            for ts, event_id, event, pages in zip(frame["ts"], frame["event_id"], frame["event"], frame["pages_crawled"]):
                ts, order = ts.to_pydatetime(), (ts.to_pydatetime(), int(event_id))
                if event in new and later("status", order):
                    s["status"], (s["status_at"], s["status_id"]) = new[event], order
                if event == "crawl.started":
                    s["started"] = max(filter(None, (s["started"], ts)))
                if event in ("crawl.completed", "crawl.failed"):
                    s["completed"] = max(filter(None, (s["completed"], ts)))
                if event in ("crawl.progress", "crawl.completed") and later("pages", order):
                    s["pages"], (s["pages_at"], s["pages_id"]) = (0 if pd.isna(pages) else int(pages)), order
                s["last"] = max(filter(None, (s["last"], ts)))
        self.job.update(tuple(s[n] for n in names))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if s["status"] == "running":
            self.handle.registerTimer(int(pd.Timestamp(s["last"], tz="UTC").timestamp() * 1000) + self.timeout_ms)
        yield self._row(key, s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _STATE.split(", ")]
        s = dict(zip(names, self.job.get()))
        self.job.clear()
        yield self._row(key, s, "timed_out")

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, timeout_ms: int, late: str = "1 day", time: str = "ts") -> DataFrame:
    """States of jobs as they change; a running job without events for the timeout is ``timed_out``.

    ``events`` has ``job_id, event_id, event, ts, pages_crawled``. The last row of a job
    is its state; unknown events and null jobs are dropped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = events.filter(F.col("event").isin(*JOB_EVENTS) & F.col("job_id").isNotNull())
    known = known.select("job_id", "event_id", "event", F.col(time).alias("ts"), "pages_crawled")
    return known.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(
        JobTracker(timeout_ms), outputStructType=JOB_STATES, outputMode="Update", timeMode="EventTime"
    )
