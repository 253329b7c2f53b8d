"""Writing step by step: rows with new ids, checkpoints of batches, and what is left to do after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh


def sequential_ids(rows: DataFrame, key: str, last: Column, width: int = 100_000) -> DataFrame:
    """``rows`` with ``id`` = ``last`` + 1, 2, ... by the integer ``key``, which is unique.

    Rows are numbered inside ranges of ``width`` keys; only the ranges' counts, a row each,
    go through one window over all.
    """
    part, n, first, rn = fresh(["part_", "n_", "before_", "rn_"], rows)
    place = F.floor(F.col(key) / width)
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(place.alias(part)).agg(F.count("*").alias(n)).select(part, before.alias(first))
    x = rows.withColumn(part, place).withColumn(rn, F.row_number().over(Window.partitionBy(part).orderBy(key)))
    return x.join(starts, part).withColumn("id", last + F.col(first) + F.col(rn)).drop(part, first, rn)


def append_rows(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` (id, ...) and after it ``rows``, which get the next ids in the order of ``key``."""
    last = base.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return base.unionByName(sequential_ids(rows, key, last).select(*base.columns))


def checkpoint(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch: every batch has a folder of its own and is written whole, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def left_to_do(todo: DataFrame, done: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """What of ``todo`` has no result without an error in ``done`` yet."""
    return todo.join(done.where(F.col(error).isNull()).select(*keys), keys, "left_anti")


def latest_results(done: DataFrame, keys: list[str], batch: str = "batch", error: str = "error") -> DataFrame:
    """One result for each key: one without an error before one with, then that of the latest batch."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(error).isNotNull(), F.desc(batch)))
    (rn,) = fresh(["rn_"], done)
    return done.withColumn(rn, rank).where(F.col(rn) == 1).drop(rn)


def batches(pages: DataFrame, keys: list[str], order: str, size: int = 3) -> DataFrame:
    """``pages`` with the number of their ``batch``: ``size`` at a time in order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return pages.withColumn("batch", F.floor(rank / size).cast("long"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` in ``most`` partitions at most: so many calls of a service run at a time in the stage that follows."""
    return df.coalesce(most)
