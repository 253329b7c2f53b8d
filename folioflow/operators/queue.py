"""The render queue: events reduced to states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# States that an agent may report.
AGENT_STATES = ["rendering", "preview_ready", "preview_rejected", "finalizing", "ready", "failed"]


def states(events: DataFrame) -> DataFrame:
    """(item, status, version, agent, claims, rejected) out of (item, ts, event_id, status, agent): an item's events in order.

    Queueing is always allowed; claiming only what is queued; a rejected preview is a new
    version without an agent; other states only from an agent's list. What isn't allowed
    changes nothing and is counted. A claim is allowed if it is the first one after a
    queueing with no other state between; so windows tell what is allowed, and the rest are
    sums and last values, added up before their shuffle. No item's events are gathered.
    """
    s, order = F.col("status"), ["ts", "event_id", "status", "agent"]
    in_order = Window.partitionBy("item").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sets = F.coalesce(s.isin("queued", *AGENT_STATES), F.lit(False))
    x = events.select("item", *order).withColumn("sets", sets).withColumn("claim", F.coalesce(s == "claimed", F.lit(False)))
    x = x.withColumn("since", F.sum(F.col("sets").cast("long")).over(in_order)).withColumn("state", F.last(F.when(F.col("sets"), s), ignorenulls=True).over(in_order))
    nth = F.sum(F.col("claim").cast("long")).over(Window.partitionBy("item", "since").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("claimed", F.col("claim") & F.coalesce(F.col("state") == "queued", F.lit(False)) & (nth == 1))
    ok, at = F.col("sets") | F.col("claimed"), F.struct(*order)
    names = F.col("claimed") | F.col("sets") & s.isin("queued", "preview_rejected")  # what says who works on it
    out = x.groupBy("item").agg(
        F.coalesce(F.max_by(F.when(ok, s), F.when(ok, at)), F.lit("none")).alias("status"),
        (F.lit(1) + F.count_if(F.col("sets") & (s == "preview_rejected")).cast("int")).alias("version"),
        F.max_by(F.when(F.col("claimed"), F.struct(F.col("agent"))), F.when(names, at)).alias("who"),
        F.count_if(F.col("claimed")).cast("int").alias("claims"),
        F.count_if(~ok).cast("int").alias("rejected"),
    )
    return out.select("item", "status", "version", F.col("who.agent").alias("agent"), "claims", "rejected")


def fold(state: tuple, status: str, agent: str | None) -> tuple:
    """What one event does to a state (status, version, agent, claims, rejected), for the streams."""
    now, version, who, claims, rejected = state
    if status == "queued":
        return status, version, None, claims, rejected
    if status == "claimed":
        return ("claimed", version, agent, claims + 1, rejected) if now == "queued" else (now, version, who, claims, rejected + 1)
    if status not in AGENT_STATES:
        return now, version, who, claims, rejected + 1
    if status == "preview_rejected":
        return status, version + 1, None, claims, rejected
    return status, version, who, claims, rejected
