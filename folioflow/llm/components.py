"""Connected components of an edge table by alternating large and small stars, each round begun by contraction inside partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import stored

MOST = 100_000  # edges that one task contracts; 16 bytes each


def labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes is connected with by edges (x, y): roots are hung under lesser ones and paths cut short until no edge is left between two trees."""
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return label
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((next_ := label[label]) != label).any():
            label = next_


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's edges (u, v) connect, as edges from each node to the least one."""
    have = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
    if have:
        u, v = (np.concatenate(c) for c in zip(*have))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = nodes[labels(len(nodes), at[: len(u)], at[len(u) :])]
        some = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some])], ["u", "v"])


def components(edges: DataFrame, name: str = "components", rounds: int = 60, most: int = MOST) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): label is the least node reachable.

    Edges are dealt to tasks of about ``most``, and each task keeps only a forest of what its
    own connect; where one task holds all, that is the result. Else each round hangs every node
    under the least node that it or its neighbours see, so the number of rounds follows the
    logarithm of a component's width. A node with very many neighbours is a join key with
    many rows, which Spark splits, all least nodes being stored before they are joined; no
    neighbourhood is collected.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-0")
    count, seen = now.count(), None
    for k in range(1, rounds + 1):
        tasks = -(-count // most)
        forest = (now.coalesce(1) if tasks <= 1 else now.repartition(tasks, "v")).mapInArrow(W.tidy(_forest), "u long, v long")
        if tasks <= 1:
            now = forest
            break
        forest = stored(forest, f"{name}-forest")
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # u > v again
        large = stored(large, f"{name}-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        small = large.join(least.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), f"{name}-{k}")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        count, seen = mark[0], mark
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
