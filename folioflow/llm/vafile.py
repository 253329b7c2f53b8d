"""Exact top-k inner products by a vector-approximation file.

The file is written once: blocks of vectors, and of each block two columns. One holds the
cells: per dimension the block's range is cut into ``1 << BITS`` cells of equal width and a
vector is its cells' numbers, one byte a dimension. The other holds the exact components.

A search reads the file twice. The first reading takes the column of cells only: a
vector's score lies within the query's product with the cells' middles plus or minus a term
that depends on the query and the block, which gives bounds for all vectors of a block from
one matrix product. The k-th best lower bound over the whole file is each query's threshold.
The second reading has the exact column beside the cells: from a block in memory those
vectors are scored whose upper bound is at a query's threshold or above, in order of their
bounds, a slice at a time, until the task's k-th result is certain. A block holds thousands
of vectors and a search thousands of queries, so nearly every block holds a vector that some
query needs, and its exact column is read from the file with it; what bounds save is the
scoring, not that reading.
Ties go to the smaller id.

Queries come in blocks of ``QUERIES``: each is sent to all tasks (its size is bounded by that
number) and released when its results are stored; k rows per query and task are merged by a
window after a partial cut. A hundred times the queries is a hundred times the blocks, one
after another, never a larger one.

Vectors that are null, empty or hold null or non-finite components take no part; scores are
only taken between vectors of one length; rows that share a query's id are its own. Scores
beyond the range of a long are cut off to it (components count up to 1e150).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop_paths, stored

BITS = 8
QUERIES = 8192
SLICE = 64
SAFE = 1 << 52
LARGEST = 1e150
FILE = "d int, n int, kind string, ids binary, low binary, width binary, cells binary, exact binary"


def integers(batch: pa.RecordBatch, column: str = "embedding") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: ids and vectors with components floor(256 * x), of the vectors that take part."""
    vectors = batch.column(column)
    ids = batch.column("vec_id")
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    edge = np.concatenate(([0], np.cumsum(sizes)))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (bad[edge[1:]] == bad[edge[:-1]]) & (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    key = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        x = np.clip(values[(edge[rows][:, None] + np.arange(d)).ravel()], -LARGEST, LARGEST)
        out[d] = (key[rows], np.floor(256.0 * x).reshape(-1, d))
    return out


class Approximation:
    """The cells of a block of vectors: ``low`` and ``width`` by dimension, ``cells`` by vector and dimension."""

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @classmethod
    def of(cls, vectors: np.ndarray, bits: int = BITS) -> Approximation:
        low = vectors.min(0)
        width = np.maximum(1.0, np.ceil((vectors.max(0) - low + 1) / (1 << bits)))
        return cls(low, width, np.minimum((vectors - low) // width, (1 << bits) - 1).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middle, reach): a score lies within middle - reach and middle + reach; reach is one number a query."""
        kind = np.float32 if max(np.abs(queries).max(), np.abs(self.low).max(), self.width.max()) < 1e12 else np.float64
        middle = (self.low + self.cells * self.width + (self.width - 1) / 2).astype(kind)
        size = np.abs(queries)
        # What rounding can do to a sum of products, and to large cells' numbers.
        slack = np.finfo(kind).eps * (len(self.low) + 8) * (size @ (np.abs(self.low) + 256 * self.width)) + 1e-6
        return (queries.astype(kind) @ middle.T).astype(np.float64), size @ ((self.width - 1) / 2) + slack


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, cut off to the range of a long."""
    vectors = vectors.astype(np.float64)
    if np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) * len(query) < SAFE:
        return (vectors @ query).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(v, query)))) for v in vectors], dtype=np.int64)


def write_file(vectors: DataFrame, block: int = 4096) -> DataFrame:
    """The approximation file of ``vectors`` (vec_id, embedding), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                for d, (ids, data) in integers(batch.slice(a, block)).items():
                    file = Approximation.of(data)
                    most = np.abs(data).max()
                    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
                    raw = [ids.astype("<i8"), file.low, file.width, file.cells, data.astype(kind)]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([kind]), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["d", "n", "kind", "ids", "low", "width", "cells", "exact"])

    return stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, FILE), "vafile")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, Approximation, np.ndarray | None]]:
    """(length, ids, cells, exact vectors if they were read) of the file's blocks."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            d, n = batch.column("d")[i].as_py(), batch.column("n")[i].as_py()
            part = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)  # noqa: B023, E731  no copy
            data = part("exact", batch.column("kind")[i].as_py()).reshape(n, d) if "exact" in names else None
            yield d, part("ids", "<i8"), Approximation(part("low", "<f8"), part("width", "<f8"), part("cells", np.uint8).reshape(n, d)), data


def _scored(batch_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, file: Approximation) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries' rows, middles, reaches) of a block, 256 queries at a time; a query's own rows are out of reach."""
    for a in range(0, len(queries), 256):
        s = slice(a, min(a + 256, len(queries)))
        middle, reach = file.bounds(queries[s])
        middle[batch_ids[s][:, None] == ids[None, :]] = -np.inf
        yield s, middle, reach


def thresholds(file: DataFrame, sets, k: int) -> dict[int, float]:
    """The k-th best lower bound of each query over the whole file, by its cells; absent where fewer than k vectors are there. ``sets`` is a broadcast of queries by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: np.full((len(ids), k), -np.inf) for d, (ids, _) in sets.value.items()}
        for d, ids, cells, _ in _blocks(batches):
            if d not in best:
                continue
            for s, middle, reach in _scored(*sets.value[d], ids, cells):
                lower = np.concatenate((best[d][s], middle - reach[:, None]), 1)
                best[d][s] = np.partition(lower, lower.shape[1] - k, 1)[:, -k:]
        for d, found in best.items():
            row, at = np.nonzero(np.isfinite(found))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(sets.value[d][0][row]), pa.array(found[row, at])], ["query_id", "low"])

    found = file.select("d", "n", "ids", "low", "width", "cells").mapInArrow(run, "query_id long, low double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    return {r["query_id"]: r["low"] for r in found.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "low").collect()}  # a row for each of the block's queries


def search(file: DataFrame, sets, least, k: int) -> DataFrame:
    """(query_id, vec_id, score): of every task its k best by exact scores, out of what its cells let through. ``least`` is a broadcast of the thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floor = {d: np.array([least.value.get(q, -np.inf) for q in ids.tolist()]) for d, (ids, _) in sets.value.items()}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d, ids, cells, data in _blocks(batches):
            if d not in floor:
                continue
            query_ids, queries = sets.value[d]
            for s, middle, reach in _scored(query_ids, queries, ids, cells):
                upper = middle + reach[:, None]
                maybe = upper >= floor[d][s, None]
                maybe &= np.isfinite(middle)
                for i in np.flatnonzero(maybe.any(1)).tolist():
                    row = np.flatnonzero(maybe[i])
                    row = row[np.argsort(-upper[i, row], kind="stable")]
                    q = int(query_ids[s.start + i])
                    got_ids, got = best.get(q, none)
                    for a in range(0, len(row), SLICE):
                        if len(got) == k and upper[i, row[a]] < got[-1]:
                            break
                        some = row[a : a + SLICE]
                        got_ids, got = np.concatenate((got_ids, ids[some])), np.concatenate((got, exact(queries[s.start + i], data[some])))
                        keep = np.lexsort((got_ids, ~got))[:k]  # ~x falls as x rises, and can't overflow
                        got_ids, got = got_ids[keep], got[keep]
                    best[q] = got_ids, got
        n = [len(x[0]) for x in best.values()]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), dtype=np.int64), n)), *(pa.array(np.concatenate([x[j] for x in best.values()])) for j in (0, 1))], ["query_id", "vec_id", "score"])

    return file.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best; both frames have (vec_id, embedding)."""
    spark = vectors.sparkSession
    file = write_file(vectors, block)
    table = stored(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").distinct(), "vafile-queries")
    blocks = max(1, -(-table.count() // QUERIES))
    wanted = table.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = None
    for part in range(blocks):
        chosen = wanted.where(F.col("part") == part).select("vec_id", "embedding").toArrow()  # about QUERIES rows
        sets = spark.sparkContext.broadcast({d: x for batch in chosen.combine_chunks().to_batches() for d, x in integers(batch).items()})
        least = spark.sparkContext.broadcast(thresholds(file, sets, k))
        found = search(file, sets, least, k).withColumn("rank", rank).where(F.col("rank") <= k)
        found = stored(found.select("query_id", "rank", "vec_id", "score"), "vafile-found")
        out = found if out is None else out.unionByName(found)
        sets.unpersist()
        least.unpersist()
    drop_paths(spark, file, table)
    return out
