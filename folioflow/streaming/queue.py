"""Streams: queue states, folder ingest, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import fold

STATE = "status string, version int, agent string, claims int, rejected int"


def queue_states(events: DataFrame) -> DataFrame:
    """The state machine over a stream of (item, ts, event_id, status, agent): a row per item and micro-batch, to be written in update mode. Events of a batch are put in order first."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("none", 1, None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for status, agent in zip(rows["status"], rows["agent"]):
            now = fold(now, status, agent)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["item", "status", "version", "agent", "claims", "rejected"])

    return events.groupBy("item").applyInPandasWithState(run, f"item long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def watch_folder(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}", recursive: bool = True) -> DataFrame:
    """New files under ``path`` as a stream of (path, modificationTime, length); a checkpoint makes each file count once."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).drop("content")


def _late(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs a time with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on a stream and on a table."""
    x = _late(events, late)
    return x.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: first and last event and their number."""
    x = _late(events, late)
    return x.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "first_ts", "last_ts", "n")
