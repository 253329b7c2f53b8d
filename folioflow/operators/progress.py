"""Progress, elapsed times and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elapsed(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Seconds summed up and on average."""
    return df.groupBy(*keys).agg(F.round(F.sum(seconds), 1).alias("elapsed"), F.round(F.avg(seconds), 3).alias("mean"))


def age(at: Column, now: Column) -> Column:
    """Whole seconds from ``at`` to ``now``."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.call_function("div", micros(now) - micros(at), F.lit(1_000_000))


def tasks(steps: DataFrame, task: str, order: Column, fine: Column) -> DataFrame:
    """Of every task its steps, how many went well, the percentage and the state: failed if the last step did."""
    x = steps.groupBy(task).agg(F.count("*").alias("total"), F.count_if(fine).alias("done"), F.max_by(fine, order).alias("last_"))
    state = F.when(~F.col("last_"), "failed").when(F.col("done") == F.col("total"), "done").otherwise("running")
    return x.select(task, "total", "done", F.round(100.0 * F.col("done") / F.col("total"), 1).cast("double").alias("percent"), state.alias("state"))


def below(address: Column, root: str) -> Column:
    """What comes after ``root``, as an absolute path; null for an address that is not under it."""
    return F.when(F.startswith(address, F.lit(root)), F.concat(F.lit("/"), F.substr(address, F.lit(len(root) + 1))))
