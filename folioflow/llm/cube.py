"""Cube-method balanced sampling: mixing sources to target weights.

A document of source s is wanted ``rate`` = target_s / size_s times on average. Its whole
part is taken for sure; the fraction is an inclusion probability. The flight phase moves
those probabilities through the null space of the balancing constraints (documents and
tokens): three undecided documents leave one direction that keeps both totals, a step
along it decides at least one of them, and the next document takes its place. Flights run
in blocks of a source side by side; what is undecided at a block's end (two documents at
most) flies again with that of other blocks, and each round leaves a ``BLOCK``-th, so only
a small landing problem per source remains, solved by trying both values of each. A hot
source is as many blocks as it needs.

All chance comes from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._store import fresh, parts, stored

BLOCK = 4096
LANDING = 12
MOST = 3
EPS = 1e-9
NULL_ID = -(1 << 63)
SMALL = 100_000  # rows of the table of sources up to which it is broadcast; beyond that the same join shuffles, with the same result
ROW = "source string, doc long, salt long, size long, p double, taken long"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3 by code point (null last) share the whole of all sizes; a target stops at ``MOST`` times its source's size and the excess goes to the others by weight.

    Sharing until none is above is filling to one level: in order of cap per weight, a
    source is full if the level that the sources from it on would reach is above its cap.
    There is one row per source here, not per document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    ordered = by.withColumn("weight", F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).withColumn("cap", MOST * F.col("source_size"))
    before = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ordered = ordered.withColumn("level", F.when(F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights"), F.col("left") / F.col("weights")))
    ordered = ordered.withColumn("level", F.min(F.when(F.col("level").isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("o"), "source", "level"))).over(whole)["level"])
    return ordered.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _uniform(key: int) -> Iterator[float]:
    x = key & 0xFFFFFFFFFFFFFFFF
    while True:
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        yield ((z ^ (z >> 31)) >> 11) / (1 << 53)


def flight(p: list[float], size: list[int], seed: int) -> list[float]:
    """Probabilities after the flight phase: all but two at most are 0 or 1, and the sums of p and of p * size are kept."""
    chance = _uniform(seed)
    out = list(p)
    active: list[int] = []
    for i, x in enumerate(out):
        if EPS < x < 1 - EPS:
            active.append(i)
        else:
            out[i] = float(x > 0.5)
            continue
        while len(active) == 3:
            a, b, c = active
            x1, x2, x3 = size[a], size[b], size[c]
            u = (x2 - x3, x3 - x1, x1 - x2)
            if not any(u):
                u = (1, -1, 0)
            up = down = float("inf")
            for k, v in zip(active, u):
                if v > 0:
                    up, down = min(up, (1 - out[k]) / v), min(down, out[k] / v)
                elif v < 0:
                    up, down = min(up, out[k] / -v), min(down, (1 - out[k]) / -v)
            step = up if next(chance) * (up + down) < down else -down
            left = []
            for k, v in zip(active, u):
                y = out[k] + step * v
                out[k] = 0.0 if y < EPS else 1.0 if y > 1 - EPS else y
                if 0 < out[k] < 1:
                    left.append(k)
            active = left
    return out


def landing(p: list[float], size: list[int], left: float) -> list[int]:
    """0 or 1 for the last undecided documents: of all choices the one whose size comes nearest ``left``, and whose number the probabilities' sum."""
    bits = (np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1
    cost = np.abs(bits @ np.array(size, dtype=np.float64) - left) + np.abs(bits.sum(1) - sum(p))
    return bits[int(np.argmin(cost))].tolist()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole (source, block) groups out of sorted batches."""
    have: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("source").to_pylist(), batch.column("block").to_pylist()))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    have.append(batch.slice(start, i - start))
                if have:
                    yield pa.Table.from_batches(have)
                have, start, last = [], i, key
        have.append(batch.slice(start))
    if have:
        yield pa.Table.from_batches(have)


def _fly(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            p, size = table.column("p").to_pylist(), table.column("size").to_pylist()
            source, block = table.column("source")[0].as_py(), table.column("block")[0].as_py()
            seed = zlib.crc32(f"{source}/{block}/{len(p)}/{sum(size)}".encode())
            if not last:
                now = flight(p, size, seed)
            else:
                kept = set(np.linspace(0, len(p) - 1, LANDING).astype(int).tolist())  # of all sizes; they land
                fly = [i for i in range(len(p)) if i not in kept]
                now = list(p)
                for i, x in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], seed)):
                    now[i] = x
                now = [0.0 if x < EPS else 1.0 if x > 1 - EPS else x for x in now]
                open_ = [i for i, x in enumerate(now) if 0 < x < 1]
                for i, x in zip(open_, landing([now[i] for i in open_], [size[i] for i in open_], sum(now[i] * size[i] for i in open_))):
                    now[i] = float(x)
            taken = np.array(table.column("taken").to_pylist(), dtype=np.int64) + np.array([s if x == 1 else 0 for s, x in zip(size, now)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [table.column("source").combine_chunks(), table.column("doc").combine_chunks(), table.column("salt").combine_chunks(), table.column("size").combine_chunks(), pa.array(now, pa.float64()), pa.array(taken)],
                ["source", "doc", "salt", "size", "p", "taken"],
            )

    return run


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and salt (a hash of the text) of every document.

    ``size`` counts words; null and empty texts have none and nothing is taken of them; a
    null source is a source of its own, the last one; a null doc_id is kept. Rows equal in
    doc_id, source and text are drawn one by one, their order being of no consequence. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("source").cast("string").alias("source"), n_words.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("salt")), "cube-sizes"
    )
    targets = stored(source_targets(sizes), "cube-targets")
    few = targets.count() <= SMALL

    def by_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "s")
        return left.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    rows = by_source(sizes, targets.select("source", F.try_divide("target", "source_size").alias("rate")))
    rate = F.when(F.col("size") > 0, F.col("rate")).otherwise(0.0)
    whole = F.floor(rate + EPS)
    rows = rows.select("source", "doc", "salt", "size", F.greatest(F.lit(0.0), rate - whole).alias("p"), (whole * F.col("size")).cast("long").alias("taken"))

    done = []
    while True:
        counts = rows.groupBy("source").count().agg(F.max("count"), F.sum("count")).first()
        most, total = counts[0] or 0, counts[1] or 0
        last = most <= block
        blocks = rows.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
        dealt = by_source(rows, blocks).withColumn("block", F.pmod(F.xxhash64("doc", "salt", F.lit(len(done))), F.col("blocks")).cast("long")).drop("blocks")
        spread = max(1, min(4 * parts(spark), -(-total // block)))
        flown = stored(dealt.repartition(spread, "source", "block").sortWithinPartitions("source", "block", "size", "doc", "salt").mapInArrow(W.tidy(_fly(last)), ROW), "cube-flight")
        done.append(flown if last else flown.where("p <= 0 or p >= 1"))
        if last:
            break
        rows = flown.where("p > 0 and p < 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return by_source(out, targets).select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "source", "size", "source_size", "target", "taken", "salt")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; rows without words stay once.

    Rows equal in doc_id, source and text share what is taken of them evenly. Those that are
    equal in all columns are counted first, so such a group is no one task's; the columns of
    rows that share a doc_id, source and text have to be of types that Spark can group by.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.coalesce("source", F.lit("\0")), F.xxhash64(F.coalesce("text", F.lit("")))
    doc, source, salt, copies, alike, n, before = names = fresh(docs, "mix_doc", "mix_source", "mix_salt", "mix_copies", "mix_rows", "mix_n", "mix_before")
    drawn = mix(docs, block).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(doc), F.coalesce("source", F.lit("\0")).alias(source), F.col("salt").alias(salt), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("long").alias(copies))
    drawn = stored(drawn.groupBy(doc, source, salt).agg(F.sum(copies).alias(copies), F.count("*").alias(alike)), "cube-drawn")
    same = (key[0] == F.col(doc)) & (key[1] == F.col(source)) & (key[2] == F.col(salt))
    rows = docs.join(drawn.where(F.col(copies) > 0), same)
    out = rows.where(F.col(alike) == 1).withColumn(n, F.col(copies))
    if drawn.where(F.col(alike) > 1).head(1):
        own = [f"`{c}`" for c in docs.columns]
        kinds = rows.where(F.col(alike) > 1).groupBy(*own, *names[:5]).agg(F.count("*").alias(n))
        kinds = kinds.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(doc, source, salt).orderBy(F.xxhash64(*own)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # The first (copies mod rows) rows get one copy more than the others.
        even, more = F.call_function("div", F.col(copies), F.col(alike)), F.col(copies) % F.col(alike)
        kinds = kinds.withColumn(n, F.col(n) * even + F.least(F.col(n), F.greatest(F.lit(0), more - F.col(before)))).drop(before)
        out = out.unionByName(kinds.where(F.col(n) > 0))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
