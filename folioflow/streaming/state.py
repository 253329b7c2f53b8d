"""The render queue as a stateful stream: events in the order of their times, whatever order they come in.

``transformWithState`` keeps two states an item: where it stands, with the times at which it
got there, and the events that wait. An event waits until the watermark has passed its
time; then a timer takes all that are due, in the order of time, id, status and agent,
through the same steps as the batch form. So a stream whose events come shuffled, inside the lateness that is
allowed, ends in the batch form's states. Events later than that are left out and counted
as late by Spark. With ``keep`` an item that nothing happened to for so long is forgotten
(state TTL, by processing time).

Memory an item: its state and the events of the allowed lateness; they are read one by one
from the state store, which is RocksDB (``STORE``), on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import fold

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOW = "status string, version int, agent string, claims int, rejected int, claimed_at timestamp, preview_ready_at timestamp, completed_at timestamp, changed_at timestamp"
EMPTY = ("none", 1, None, 0, 0, None, None, None, None)
#: Which time a status stamps.
STAMPS = {"claimed": 5, "preview_ready": 6, "ready": 7}


def stamped(now: tuple, ts, status: str, agent: str | None) -> tuple:
    """``fold`` with the times at which an item was claimed, previewed and completed; what isn't allowed stamps nothing."""
    after = fold(now[:5], status, agent)
    if after[4] != now[4]:  # refused
        return (*after, *now[5:])
    times = list(now[5:8])
    if status in STAMPS:
        times[STAMPS[status] - 5] = ts
    return (*after, *times, ts)


class Queue(StatefulProcessor):
    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW, self.keep_ms)
        self.waiting = handle.getMapState("waiting", "ts timestamp, event_id long, nth int", "status string, agent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for ts, event_id, status, agent in zip(frame["ts"], frame["event_id"], frame["status"], frame["agent"]):
                nth = 0
                while self.waiting.containsKey((ts, event_id, nth)):  # the same id at the same time
                    nth += 1
                self.waiting.updateValue((ts, event_id, nth), (status, agent))
                self.handle.registerTimer(int(pd.Timestamp(ts).timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        due = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator() if pd.Timestamp(k[0]).timestamp() * 1000 < until]  # of the allowed lateness
        if not due:  # an earlier timer of the same batch took them
            return
        now = tuple(self.now.get()) if self.now.exists() else EMPTY
        for k, (status, agent) in sorted(due, key=lambda e: (e[0][0], e[0][1], e[1][0] or "", e[1][1] or "")):
            now = stamped(now, k[0], status, agent)
            self.waiting.removeKey(k)
        self.now.update(now)
        row = pd.DataFrame([(key[0], *now)], columns=["item", *[f.strip().split()[0] for f in NOW.split(",")]])
        for c in ("claimed_at", "preview_ready_at", "completed_at", "changed_at"):
            row[c] = pd.to_datetime(row[c])
        yield row

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that this module's streams need."""
    spark.conf.set(STORE, ROCKSDB)
    return spark


def queue_states(events: DataFrame, late: str = "1 day", keep_ms: int | None = None) -> DataFrame:
    """States (item, status, version, agent, claims, rejected and times) of a stream of (item, ts, event_id, status, agent): a row an item whenever events of its have become due, to be written in update mode."""
    with_store(events.sparkSession)
    x = events.select("item", events["ts"].cast("timestamp").alias("ts"), "event_id", "status", "agent").withWatermark("ts", late)
    return x.groupBy("item").transformWithStateInPandas(Queue(keep_ms), f"item long, {NOW}", "Update", "EventTime")


class Progress(StatefulProcessor):
    """The progress of background tasks: done and total, the share in percent, and whether it has stalled."""

    def __init__(self, stall_ms: int, keep_ms: int | None):
        self.stall_ms, self.keep_ms = stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "done long, total long, at timestamp", self.keep_ms)

    def _row(self, key, now: tuple, stalled: bool) -> pd.DataFrame:
        done, total, at = now
        percent = int(100 * min(done, total) // total) if total else 0
        return pd.DataFrame({"task": [key[0]], "done": [done], "total": [total], "percent": [percent], "stalled": [stalled], "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.now.get()) if self.now.exists() else None
        for frame in rows:
            for ts, done, total in zip(frame["ts"], frame["done"], frame["total"]):
                if now is None or (pd.Timestamp(ts), done) > (pd.Timestamp(now[2]), now[0]):  # what comes late changes nothing
                    now = (int(done), int(total), ts)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now[0] < now[1]:
            self.handle.registerTimer(int(pd.Timestamp(now[2]).timestamp() * 1000) + self.stall_ms)
        self.now.update(now)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            yield self._row(key, tuple(self.now.get()), True)

    def close(self) -> None:
        pass


def task_progress(reports: DataFrame, late: str = "1 minute", stall_ms: int = 300_000, keep_ms: int | None = None) -> DataFrame:
    """(task, done, total, percent, stalled, at) of a stream of reports (task, ts, done, total): the latest report by time; ``stalled`` once the watermark is ``stall_ms`` past an unfinished task's last report."""
    with_store(reports.sparkSession)
    x = reports.select("task", reports["ts"].cast("timestamp").alias("ts"), "done", "total").withWatermark("ts", late)
    return x.groupBy("task").transformWithStateInPandas(Progress(stall_ms, keep_ms), "task long, done long, total long, percent int, stalled boolean, at timestamp", "Update", "EventTime")
