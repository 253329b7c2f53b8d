"""Votes, first-wins choices and cascades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..functions.text import title_normalize


def vote(df: DataFrame, group: list[str], key: str, spelling: str, order: str, prefer: str = "longest") -> DataFrame:
    """The key that most rows of a group have, as ``spelling`` (its first longest form) and ``n``; ties go to the longer key or to the first seen."""
    first, rn = fresh(["first_", "rn_"], df)
    counts = df.groupBy(*group, key).agg(F.count("*").alias("n"), F.min(order).alias(first), F.max_by(spelling, F.struct(F.length(spelling), -F.col(order))).alias(spelling))
    ties = [F.desc(F.length(key)), F.col(key)] if prefer == "longest" else [F.col(first)]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), *ties))
    return counts.withColumn(rn, rank).where(F.col(rn) == 1).select(*group, spelling, "n")


def header_winner(pages: DataFrame, group: list[str], header: str, order: str, share: int = 4, least: int = 2) -> DataFrame:
    """(group, name, n): the header that most pages of a group print, case and spaces aside, as its first longest spelling.

    It has to be on ``least`` pages and on one in ``share`` of all, those without a header
    counted too; ties go to the one seen first. Headers under four characters are none.
    """
    name, norm, total = fresh(["name", "norm", "total"], pages)
    x = pages.withColumn(name, F.rtrim(F.regexp_replace(header, r"^\s+|\s+$", ""), F.lit(":;, ")))
    counts = pages.groupBy(*group).agg(F.count("*").alias(total))
    won = vote(x.where(F.length(name) >= 4).withColumn(norm, title_normalize(F.col(name))), group, norm, name, order, prefer="first")
    return won.join(counts, group).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col(total) / share))).select(*group, F.col(name).alias("name"), "n")


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    (rn,) = fresh(["rn_"], df)
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col(rn) == 1).drop(rn)


def cascade(strategies: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, method) of the first strategy that gives a value."""
    return F.coalesce(*[c for _, c in strategies]), F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in strategies])


def cheap_first(df: DataFrame, cheap: Column, sound: Column, dear: Callable[[Column], Column]) -> DataFrame:
    """``text`` by the cheap way where it is sound, else by the dear one, which is given null on all other rows."""
    (ok,) = fresh(["ok_"], df)
    x = df.withColumn("text", cheap).withColumn(ok, sound)
    again = dear(F.when(~F.col(ok), F.col("text")))  # null, so nothing to do, for the others
    return x.withColumn("text", F.when(F.col(ok), F.col("text")).otherwise(again)).withColumn("method", F.when(F.col(ok), "text").otherwise("ocr")).drop(ok)
