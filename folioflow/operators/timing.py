"""Timing of segments and words: running offsets, proportional shares, clips, interval joins, sequence alignment."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions.names import fresh


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_offset(df: DataFrame, keys: list[str], order: str, duration: str, total: float) -> DataFrame:
    """``start``: the sum of the durations before; a missing one counts total / n."""
    dur = F.coalesce(F.col(duration), F.lit(total) / F.count("*").over(Window.partitionBy(*keys)))
    (d,) = fresh(["d_"], df)
    return df.withColumn(d, dur).withColumn("start", F.coalesce(F.sum(d).over(_before(keys, order)), F.lit(0.0))).drop(d)


def proportional(df: DataFrame, keys: list[str], order: str, length: str, full: float, target: float) -> DataFrame:
    """``start`` and ``duration`` = full * length / total; rows that start at ``target`` or later go, empty ones count for nothing."""
    x = df.where(F.col(length) > 0).withColumn("duration", F.lit(full) * F.col(length) / F.sum(length).over(Window.partitionBy(*keys)))
    return x.withColumn("start", F.coalesce(F.sum("duration").over(_before(keys, order)), F.lit(0.0))).where(F.col("start") < target)


def clip_lengths(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``clip``: up to the next start; for the last its duration and half a second."""
    return df.withColumn("clip", F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy(order)) - F.col("start"), F.col("duration") + 0.5))


def bridge(df: DataFrame, keys: list[str], order: str, text: str, title: str) -> DataFrame:
    (following,) = fresh(["next_"], df)
    nxt = F.lead(title).over(Window.partitionBy(*keys).orderBy(order))
    teaser = F.concat(F.rtrim(F.col(text), F.lit(".!?")), F.lit(" — but that's just the beginning. Let's see what happens when we "), F.lower(F.left(following, F.lit(40))), F.lit("..."))
    return df.withColumn(following, nxt).withColumn(text, F.when((F.coalesce(following, F.lit("")) != "") & ~F.contains(F.lower(text), F.lit("next")), teaser).otherwise(F.col(text))).drop(following)


def join_interval(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: Column, bucket: float) -> DataFrame:
    """points ⋈ spans on ``keys`` where low <= at < high: spans are listed under each bucket that they touch, so the join has an equality on time too."""
    top, b = fresh(["high_", "bucket_"], points, spans)
    s = spans.withColumn(top, high).withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(top) / bucket))))
    p = points.withColumn(b, F.floor(F.col(at) / bucket))
    return p.join(s, [*keys, b]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(top))).drop(b, top)


def normal_token(c: Column) -> Column:
    """A word as alignment compares it: lower case, only a-z and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def fill_gaps(words: DataFrame, keys: list[str], order: str, start: str, end: str, first: Column, step: float = 0.4) -> DataFrame:
    """``words`` whose missing times (both null) are filled: words of a gap follow on each other ``step`` seconds long from the end before it, or from ``first``; the last one reaches to the next word that has a time."""
    at, nth, since, upto = fresh(["at_", "nth_", "since_", "upto_"], words)
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = words.withColumn(at, F.row_number().over(w))
    x = x.withColumn(nth, F.col(at) - F.coalesce(F.last(F.when(F.col(start).isNotNull(), F.col(at)), ignorenulls=True).over(before), F.lit(0)))
    x = x.withColumn(since, F.coalesce(F.last(end, ignorenulls=True).over(before), first)).withColumn(upto, F.lead(start).over(w))
    missing = F.col(start).isNull()
    low, high = F.col(since) + step * (F.col(nth) - 1), F.coalesce(F.col(upto), F.col(since) + step * F.col(nth))
    return x.withColumn(end, F.when(missing, high).otherwise(F.col(end))).withColumn(start, F.when(missing, low).otherwise(F.col(start))).drop(at, nth, since, upto)


def align_words(script: list[str], heard: list[tuple[str, float, float]], step: float = 0.4) -> list[tuple[float, float]]:
    """Times of a script's words, out of heard words (word, start, end).

    Words that are equal but for case and punctuation take theirs. Where other words were
    heard between two equal ones, each word there spans all of those. Where none were, words
    follow on each other ``step`` seconds long, the last reaching to the next word that has a time.
    """
    if not script or not heard:
        return []
    mine, theirs = ([re.sub("[^a-z0-9]", "", w.lower()) for w in x] for x in (script, (h[0] for h in heard)))
    blocks = difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks()
    opens, closes = np.array([h[1] for h in heard]), np.array([h[2] for h in heard])
    t0, t1 = np.full(len(mine), np.nan), np.full(len(mine), np.nan)
    for here in blocks:
        t0[here.a : here.a + here.size], t1[here.a : here.a + here.size] = opens[here.b : here.b + here.size], closes[here.b : here.b + here.size]
    low = [(0, 0), *((x.a + x.size, x.b + x.size) for x in blocks[:-1])]
    for (a, b), here in zip(low, blocks):
        if b < here.b:
            t0[a : here.a], t1[a : here.a] = opens[b], closes[here.b - 1]
    gone, known = np.flatnonzero(np.isnan(t0)), np.flatnonzero(~np.isnan(t0))
    last = np.searchsorted(known, gone) - 1  # the known word before each
    since = np.where(last < 0, opens[0], t1[known[last]])
    nth = gone - np.where(last < 0, -1, known[last]) - 1
    nearly = gone[np.isin(gone + 1, known)]  # just before a known word
    t0[gone], t1[gone] = since + step * nth, since + step * (nth + 1)
    t1[nearly] = t0[nearly + 1]
    return list(zip(t0.tolist(), t1.tolist()))


@F.pandas_udf(types.ArrayType(types.StructType([types.StructField("t0", types.DoubleType()), types.StructField("t1", types.DoubleType())])))
def _aligned(script: pd.Series, heard: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> list[dict]:
        words = [(w, 0.5 * i, 0.5 * i + 0.5) for i, w in enumerate((b or "").split())]
        return [{"t0": x, "t1": y} for x, y in align_words((a or "").split(), words)]

    return pd.Series([one(a, b) for a, b in zip(script, heard)])


def align(versions: DataFrame) -> DataFrame:
    """(video_id, version_no, word_no, t0, t1) of each turn's words against those of the turn after it."""
    after = F.lead("text").over(Window.partitionBy("video_id").orderBy("version_no", "text"))
    two = versions.select("video_id", "version_no", F.col("text").alias("a"), after.alias("b")).where("a is not null and b is not null")
    return two.select("video_id", "version_no", F.posexplode(_aligned("a", "b")).alias("word_no", "t")).select("video_id", "version_no", "word_no", "t.t0", "t.t1")
