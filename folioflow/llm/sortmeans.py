"""Centroid clustering by sort-means, exact in whole numbers.

Vectors are stored in blocks, each with its vectors' assignments. A round sends the
centroids to all tasks (as large as their number and length, whatever the rows). For every
centroid the others are put in order of their distance from it; a vector is measured
against the centroid that it was assigned to before, then against the others in that order,
up to the first that is strictly more than twice as far from that centroid as the vector is:
by the triangle inequality neither it nor any later one can be nearer, or as near. Vectors
of a block that share their last assignment go through the order together. Each block is
stored again with its new assignments and with the sums of its vectors by centroid; these
sums, not the vectors, are added up in Spark and make the next centroids. The block tables
of earlier rounds are deleted.

All arithmetic is exact: in doubles where no sum can pass 2**53, in 64-bit integers up to
components of 2**26, in Python's integers beyond. Components count up to 2**62 and distances
and inertias that pass a long are cut off to it.

Vectors take part that have exactly ``length`` components, none null or not finite. A null
vec_id takes part and has no hash, so it is a first centroid last of all; vectors that share
a vec_id share its hash and come in the order of their components. With fewer vectors than
centroids there are as many centroids as vectors; repeated vectors are rows like others, and
centroids that are equal leave the larger number empty. No vectors, no rows. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_paths, scratch, stored

ROWS = 4096
LARGEST = 1 << 62
LONG = (1 << 63) - 1
FILE = "n int, kind string, ids binary, known binary, data binary, assigned binary, sums array<string>, counts array<long>, spread array<string>"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) within plus and minus ``LARGEST``, as 64-bit integers; exact, ``scale`` being a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    out = np.clip(scaled, -(2.0**62), 2.0**62).astype(np.int64)
    return out


def squared(rows: np.ndarray, centre: np.ndarray, large: int) -> np.ndarray:
    """Squared distances of integer rows from one centroid; ``large`` bounds all components."""
    if large <= 1 << 22:
        d = rows.astype(np.float64) - centre.astype(np.float64)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    if large <= 1 << 26:
        d = rows.astype(np.int64) - centre.astype(np.int64)
        return np.einsum("ij,ij->i", d, d)
    d = rows.astype(object) - centre.astype(object)
    return (d * d).sum(1)


def assign(rows: np.ndarray, before: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances taken) of integer rows, from their assignments ``before``; ties go to the smaller number."""
    k = len(centres)
    large = max((int(max(-x.min(), x.max())) for x in (rows, centres) if x.size), default=0)
    apart = np.stack([squared(centres, c, large) for c in centres])
    order = [sorted((j for j in range(k) if j != a), key=lambda j: (apart[a][j], j)) for a in range(k)]
    best, far, taken = before.copy(), np.zeros(len(rows), dtype=apart.dtype), 0
    for a in np.unique(before).tolist():
        mine = np.flatnonzero(before == a)
        own = squared(rows[mine], centres[a], large)
        taken += len(mine)
        at, least = np.full(len(mine), a), own.copy()
        left = np.arange(len(mine))
        for j in order[a]:
            left = left[apart[a][j] <= 4 * own[left]]  # in squares: not strictly beyond twice
            if not len(left):
                break
            d = squared(rows[mine[left]], centres[j], large)
            taken += len(left)
            nearer = (d < least[left]) | (d == least[left]) & (j < at[left])
            least[left[nearer]], at[left[nearer]] = d[nearer], j
        best[mine], far[mine] = at, least
    return best, far, taken


def _sums(rows: np.ndarray, at: np.ndarray, k: int) -> list[str]:
    """Exact sums of rows by centroid, flattened."""
    out = np.zeros((k, rows.shape[1]), dtype=object)
    small = rows.size and max(-int(rows.min()), int(rows.max())) < LONG // max(1, len(rows))
    for j in np.unique(at).tolist():
        some = rows[at == j]
        out[j] = some.astype(np.int64).sum(0) if small else some.astype(object).sum(0)
    return [str(int(x)) for x in out.ravel()]


def write_blocks(vectors: DataFrame, length: int, scale: int, rows: int = ROWS) -> DataFrame:
    """The blocks of the vectors that take part, stored; assigned to centroid 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            edge = np.concatenate(([0], np.cumsum(size)))
            right = np.flatnonzero(size == length)
            data = flat[edge[right][:, None] + np.arange(length)].reshape(len(right), length)
            fine = np.isfinite(data).all(1)
            data, right = whole(data[fine], scale), right[fine]
            known = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)[right]
            ids = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)[right]
            for a in range(0, len(right), rows):
                s = slice(a, a + rows)
                most = int(np.abs(data[s]).max()) if data[s].size else 0
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                n = len(ids[s])
                yield _block(n, kind, ids[s].astype("<i8").tobytes(), np.packbits(known[s]).tobytes(), data[s].astype(kind).tobytes(), np.zeros(n, "<i4").tobytes(), [], [], [])

    return stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, FILE), "sortmeans-0")


def _block(n: int, kind: str, ids: bytes, known: bytes, data: bytes, assigned: bytes, sums: list, counts: list, spread: list) -> pa.RecordBatch:
    columns = [pa.array([n], pa.int32()), pa.array([kind]), *(pa.array([x], pa.binary()) for x in (ids, known, data, assigned)), pa.array([sums], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([spread], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["n", "kind", "ids", "known", "data", "assigned", "sums", "counts", "spread"])


def _read(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in ("n", "kind", "ids", "known", "data", "assigned")}
            yield r, np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["n"], length), np.frombuffer(r["assigned"], dtype="<i4").astype(np.int64)


def one_round(blocks: DataFrame, centres: np.ndarray, length: int, name: str) -> DataFrame:
    """The blocks, assigned to ``centres``, with the sums, counts and distances of each block by centroid; stored."""
    shared = blocks.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value)
        for r, data, before in _read(batches, length):
            at, far, _ = assign(data, before, shared.value)
            spread = [str(sum(min(LONG, int(x)) for x in far[at == j].tolist())) for j in range(k)]
            yield _block(r["n"], r["kind"], r["ids"], r["known"], r["data"], at.astype("<i4").tobytes(), _sums(data, at, k), np.bincount(at, minlength=k).tolist(), spread)

    return stored(blocks.mapInArrow(run, FILE), name)


def added(blocks: DataFrame, column: str) -> list[int]:
    """The sums over all blocks of an array column, place by place: as many rows reach the driver as a block has places."""
    rows = blocks.select(F.posexplode(column).alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [int(r["v"]) for r in sorted(rows.collect(), key=lambda r: r["place"])]


def first_centres(vectors: DataFrame, length: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest hashes of ``seed:vec_id``."""
    e = F.col("embedding")
    fine = (F.size(e) == length) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(e.isNotNull()).where(fine)
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    found = hashed.orderBy(F.col("h").asc_nulls_last(), "embedding").limit(k).select("embedding").collect()  # k rows
    return np.stack([whole(np.array(r["embedding"]), scale) for r in found]) if found else np.zeros((0, length), np.int64)


def cluster(vectors: DataFrame, k: int = 8, length: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, rows: int = ROWS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of ``vectors`` (vec_id, embedding) that takes part."""
    spark = vectors.sparkSession
    with scratch(spark):
        blocks = write_blocks(vectors, length, scale, rows)
        centres = first_centres(vectors, length, scale, k, seed)
        k = len(centres)
        for i in range(rounds if k else 0):
            after = one_round(blocks, centres, length, f"sortmeans-{i + 1}")
            sums, counts = added(after, "sums"), added(after, "counts")
            centres = np.array([[x // counts[j] for x in sums[j * length : (j + 1) * length]] if counts[j] else centres[j].tolist() for j in range(k)], dtype=np.int64)
            drop_paths(spark, blocks)
            blocks = after
        last = one_round(blocks, centres, length, "sortmeans-last") if k else blocks
        spread = added(last, "spread") if k else []
        digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, data, at in _read(batches, length):
                n = r["n"]
                large = max(int(max(-x.min(), x.max())) for x in (data, centres)) if n else 0
                far = np.zeros(n, dtype=np.int64)
                for j in np.unique(at).tolist():
                    far[at == j] = np.array([min(LONG, int(x)) for x in squared(data[at == j], centres[j], large).tolist()], dtype=np.int64)
                known = np.unpackbits(np.frombuffer(r["known"], np.uint8))[:n].astype(bool)
                own = np.array([min(LONG, x) for x in spread], dtype=np.int64)[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["ids"], "<i8"), mask=~known), pa.array(at.astype(np.int32)), pa.array(far), pa.array(own), pa.array(np.full(n, min(LONG, sum(spread)))), pa.array([digests[j] for j in at.tolist()], pa.string())], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

        return stored(last.select("n", "kind", "ids", "known", "data", "assigned").mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), "sortmeans-out", keep=True)
