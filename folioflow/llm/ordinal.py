"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 (clean) to 3. P(grade <= k) = sigmoid(threshold_k - w.x): one
weight vector is shared by the three ordered thresholds, and the expected severity is the
sum of P(grade >= k). x is sparse: the presence of hashed words and of their first 4, 5 and
6 bytes (A-Z lower-cased, cut at white space and ASCII punctuation), kept only where labels
show that they go with toxicity. Labels say toxic or not; a toxic document's grade is the
third that it falls in by how many such features it has.

``fit`` looks at about ``FIT_ROWS`` labelled documents at most (a hash of doc_id chooses them, and of rows that share an
id it takes one); scoring
reads every whole text, and what it broadcasts is the weights, of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import scratch, stored

FIT_ROWS = 20_000
BUCKETS = 1 << 20
FEATURES = 4096
GRADES = 3
CHANCES = 1_000
SURE, UNSURE = 0.06, 1e-3
BREAKS = np.frombuffer(bytes(b if not (0x20 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E or 9 <= b <= 13) else 0x20 for b in range(256)), dtype=np.uint8)
PREFIXES = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and prefix of a block, repeats included."""
    texts = W.Texts(BREAKS[W.LOWER[data]], offsets)
    start, end = texts.start, texts.end
    row = np.searchsorted(offsets, start, side="right") - 1
    rows, keys = [row], [texts.hashes()]
    for n in PREFIXES:
        long = end - start > n
        s = start[long]
        head = np.zeros(len(s), dtype=np.uint64)
        for k in range(n):
            head = (head << np.uint64(8)) | texts.data[s + k].astype(np.uint64)
        rows.append(row[long])
        keys.append(W.mix(head + np.uint64(n << 56)))
    return np.concatenate(rows), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sparse(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, bucket) with each bucket once a row."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        row, bucket = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        key = np.unique(row * BUCKETS + bucket)
        yield i, j, key // BUCKETS, key % BUCKETS


@dataclass(frozen=True)
class Model:
    """``buckets`` in rising order with their ``weights``; P(grade >= k) = sigmoid(w.x - thresholds[k - 1])."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def train(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, decay: float | np.ndarray = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient descent (Adam) on the cumulative-link likelihood of sparse presence features; ``decay`` may be one number a feature."""
    n = len(grades)
    w = np.zeros(width)
    raw = np.array([2.0, 0.5, 0.5])[:GRADES]  # the first threshold and the logs' gaps, so that order holds
    m, v = np.zeros(width + GRADES), np.zeros(width + GRADES)
    one_hot = np.arange(1, GRADES + 1)[None, :]
    for t in range(1, steps + 1):
        theta = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        score = np.bincount(rows, w[columns], n)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -50, 50)))  # P(grade >= k)
        full = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), 1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = s * (1 - s)
        sign = (one_hot == grades[:, None]).astype(float) - (one_hot == grades[:, None] + 1)
        each = -(sign * slope) / p[:, None] / n  # of the loss, by each threshold's margin
        by_score = each.sum(1)
        grad_theta = -each.sum(0)
        tail = np.cumsum(grad_theta[::-1])[::-1]
        grad = np.concatenate((np.bincount(columns, by_score[rows], width) + decay * w, [tail[0]], tail[1:] * np.exp(raw[1:])))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - move[:width], raw - move[width:]
    return w, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from ``labels`` (doc_id, toxic), looking at about ``rows`` labelled documents at most. Without toxic labels it finds nothing toxic."""
    with scratch(docs.sparkSession):
        return _fitted(docs, labels, rows)


def _fitted(docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, rows / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000))
    known = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # ``chosen`` is about as many ids as ``rows`` says
    if known.select("doc_id").count() > chosen.count():  # ids that repeat: of each the row with the least hash
        known = known.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for i, j, row, bucket in _sparse(batch.column("text")):
                edge = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i:j], pa.int32()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(bucket, pa.int32()))], ["toxic", "found"])

    fitted = stored(known.select("toxic", "text").mapInArrow(W.tidy(sparse), "toxic int, found array<int>"), "ordinal-fit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            found = batch.column("found")
            sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            which = np.repeat(batch.column("toxic").to_numpy(), sizes)
            for t in (0, 1):
                got[t] += np.bincount(found.flatten().to_numpy()[which == t], minlength=BUCKETS)
        at = np.flatnonzero(got[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[0][at]), pa.array(got[1][at])], ["bucket", "clean", "toxic"])
        rest = np.flatnonzero((got[1] == 0) & (got[0] > 0))
        yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(got[0][rest]), pa.array(np.zeros(len(rest), np.int64))], ["bucket", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in fitted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), max(1, totals.get(0, 0))
    if not n_toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([2.0, 3.0, 4.0]))
    sums = fitted.coalesce(8).mapInArrow(W.tidy(count), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    best = sums.where((F.col("toxic") >= 2) & (lift >= 20)).orderBy(F.desc("toxic"), "bucket").limit(FEATURES).collect()
    best = sorted((r["bucket"], r["toxic"]) for r in best)
    buckets = np.array([b for b, _ in best], dtype=np.int64)
    # Sure features are in so many toxic documents that chance alone would give fewer than one of CHANCES features as many.
    # Their prior fades as rows grow in number; that of the others does not, since chance has more such features the more rows there are.
    least = max(3, int(np.ceil(np.log(CHANCES) / np.log(1 + n_clean / n_toxic))))
    decay = np.array([SURE / (n_clean + n_toxic) if n >= least else UNSURE for _, n in best])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            values = found.flatten().to_numpy()
            at = np.minimum(np.searchsorted(buckets, values), max(0, len(buckets) - 1))
            keep = buckets[at] == values if len(buckets) else np.zeros(len(values), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            edge = np.searchsorted(row, np.arange(len(sizes) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(at[keep], pa.int32()))], ["toxic", "found"])

    sample = fitted.mapInArrow(W.tidy(select), "toxic int, found array<int>").toPandas()  # as many rows as ``rows`` says, a few features each
    order = sorted(range(len(sample)), key=lambda i: (int(sample.toxic[i]), sorted(sample.found[i])))  # whatever order rows came in
    toxic, found = sample.toxic.to_numpy()[order], [sample.found[i] for i in order]
    sizes = np.array([len(x) for x in found])
    limits = np.quantile(sizes[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (sizes > limits[0]) + (sizes > limits[1]), 0)
    w, theta = train(np.repeat(np.arange(len(found)), sizes), np.concatenate([np.asarray(x, dtype=np.int64) for x in found]) if len(found) else np.zeros(0, np.int64), grades, len(buckets), decay=decay)
    return Model(buckets, w, theta)


def _chances(column: pa.Array, weights: np.ndarray, model: Model) -> np.ndarray:
    """P(grade >= k) of every text."""
    total = np.zeros(len(column))
    for i, j, row, bucket in _weighed(column, weights):
        total[i:j] = np.bincount(row, weights[bucket], j - i)
    return model.at_least(total)


def _shared(docs: DataFrame, model: Model):
    dense = np.zeros(BUCKETS, dtype=np.float32)
    dense[model.buckets] = model.weights
    return docs.sparkSession.sparkContext.broadcast((dense, model))  # BUCKETS floats


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to 3), grade, p_toxic and toxic (p_toxic >= 0.5) of every document. Null and empty texts have no features and so the least severity."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chances(batch.column("text"), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1), pa.int32()), pa.array(p[:, 0])], ["doc_id", "expected_severity", "grade", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(W.tidy(run), "doc_id long, expected_severity double, grade int, p_toxic double").withColumn("toxic", F.col("p_toxic") >= 0.5)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows that ``score`` calls toxic."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_chances(batch.column("text"), *shared.value)[:, 0] < 0.5))

    return docs.mapInArrow(W.tidy(run), docs.schema)


def _weighed(column: pa.Array, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``_sparse``, but only of buckets with a weight."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        row, bucket = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        keep = weights[bucket] != 0
        key = np.unique(row[keep] * BUCKETS + bucket[keep])
        yield i, j, key // BUCKETS, key % BUCKETS


def severity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic and toxic of every document, by a model fitted on ``labels``."""
    return score(docs, fit(docs, labels, rows))
