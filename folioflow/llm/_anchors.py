"""Anchors: the one shuffle of small keys that tells which stretches of text can repeat.

Every window of ``length`` units (bytes or words) chooses the least hash among its
k-unit grams as its anchor; equal windows choose equal anchors at equal distances. So a
window can repeat only where its anchor's hash does, and everything further looks at the
stretch of ``2 * length - k`` units around a repeated anchor and at nothing else. About
``2 / (length - k + 2)`` of all places are anchors.

Rows with equal texts are one class and go through all this once (`collapse`), however
many they are. A class is told by ``doc``, the least doc_id of its rows (a null one as the
least long), and ``tag``, 64 bits of a hash of its text, so rows that share an id but not a
text stay apart; in the order of the corpus they go by doc_id, then by tag. ``at`` is a
place in a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import drop_paths, parts, stored

NULL_ID = -(1 << 63)
U = np.uint64


@dataclass(frozen=True)
class Unit:
    """``length`` units make a window, ``k`` of them a gram."""

    words: bool
    length: int
    k: int

    @property
    def flank(self) -> int:
        return self.length - self.k


def unit_keys(texts: W.Texts, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Hashed units and the rows' offsets among them."""
    if unit.words:
        return texts.hashes(), texts.rows
    return W.BYTE[texts.data], texts.offsets


def find(keys: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, anchor hash, hash of the stretch around it) of all anchors of a block."""
    length, k, n = unit.length, unit.k, len(keys)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(keys * W.powers(W.BASE, n), out=sums[1:])
    back = W.powers(W.INVERSE, n + 1)
    grams = W.mix((sums[k:] - sums[:-k]) * back[: n - k + 1])
    window = length - k + 1
    best, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while 2 * width <= window:
        best, at = W._least(best[:-width], at[:-width], best[width:], at[width:])
        width *= 2
    if width < window:
        best, at = W._least(best[: width - window], at[: width - window], best[window - width :], at[window - width :])
    inside = np.ones(len(at), dtype=bool)  # windows that cross rows don't count
    for end in offsets[1:-1]:
        inside[max(0, int(end) - length + 1) : int(end)] = False
    at = at[inside].astype(np.int64)
    if not len(at):
        return empty, empty, empty, empty
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = at[1:] != at[:-1]
    at = at[keep]
    row = np.searchsorted(offsets, at, side="right") - 1
    low, high = np.maximum(at - unit.flank, offsets[row]), np.minimum(at + k + unit.flank, offsets[row + 1])
    around = W.mix(W.range_hash(sums, low, high, back) + (at - low).astype(U) * U(W.BASE) + (high - low).astype(U))
    return row, at - offsets[row], grams[at].view(np.int64), around.view(np.int64)


def anchors(texts: DataFrame, unit: Unit) -> DataFrame:
    """(h, seg, doc, tag, at) of every anchor of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for i, j, data, offs in unpack(batch.column("z")):
                keys, offsets = unit_keys(W.Texts(data, offs), unit) if unit.words else (W.BYTE[data], offs)
                row, place, h, seg = find(keys, offsets, unit)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(seg), pa.array(ids[i:j][row]), pa.array(tag[i:j][row]), pa.array(place)], ["h", "seg", "doc", "tag", "at"])

    return texts.select("doc", "tag", "z").mapInArrow(run, "h long, seg long, doc long, tag long, at long")


def repeated(texts: DataFrame, unit: Unit, name: str) -> DataFrame:
    """The anchors whose hash occurs more than once, stored. Counting combines before its shuffle and a join with few hot keys is split by Spark, so no hash meets in one task."""
    found = stored(anchors(texts, unit), f"{name}-anchors")
    twice = stored(found.groupBy("h").count().where("count > 1").select("h"), f"{name}-twice")  # stored, so that the join has shuffles of its own, which Spark can split
    out = stored(found.join(twice.hint("merge"), "h"), f"{name}-repeated")
    drop_paths(texts.sparkSession, found, twice)  # at once; they are the largest tables here
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("tag"), F.xxhash64(F.lit(1), "text").alias("more"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc, tag, more, z): texts compressed once for shuffles; null ones are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            for i, j in W.slices(offsets, 4 << 20):
                raw = data[offsets[i] : offsets[j]].tobytes()
                at = offsets[i : j + 1] - offsets[i]
                each = [press.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tag"), part.column("more"), pa.array(each, pa.binary())], ["doc", "tag", "more", "z"])

    return keyed(docs).select("doc", "tag", "more", "text").mapInArrow(run, "doc long, tag long, more long, z binary")


def collapse(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, tag, more, doc_id) of all documents, and their classes (doc, tag, more, n, z), both stored.

    Equal texts are told by two hashes of 64 bits (tag, more). Rows are counted before any
    text is shuffled, and a class with very many rows is a hot key of a join, which Spark
    splits; only the text of its least doc_id goes on.
    """
    rows = stored(keyed(docs).drop("text"), f"{name}-rows")
    counts = rows.groupBy("tag", "more", "doc").agg(F.count("*").alias("m")).groupBy("tag", "more").agg(F.min(F.struct("doc", "m")).alias("head"), F.sum("m").alias("n"))
    several = stored(counts.where("n > 1").select("tag", "more", F.col("head.doc").alias("head"), F.col("head.m").alias("m"), "n"), f"{name}-several")
    texts = packed(docs).join(several.hint("merge"), ["tag", "more"], "left").where("head is null or doc = head")
    if several.where("m > 1").head(1):  # rows equal in doc_id and text
        texts = texts.where("m is null or m = 1").unionByName(texts.where("m > 1").dropDuplicates(["tag", "more"]))
    return rows, stored(texts.select("doc", "tag", "more", F.coalesce("n", F.lit(1)).alias("n"), "z"), f"{name}-texts")


def unpack(z: pa.Array, most: int = W.BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in blocks of about ``most`` bytes."""
    open_ = zstandard.ZstdDecompressor()
    first, have, size = 0, [], 0
    n = len(z)
    for i in range(n):
        have.append(open_.decompress(z[i].as_py()))
        size += len(have[-1])
        if size >= most or i == n - 1:
            yield first, i + 1, np.frombuffer(b"".join(have), np.uint8), np.cumsum([0, *map(len, have)])
            first, have, size = i + 1, [], 0


def by_document(rows: DataFrame, texts: DataFrame, how: str, *fields: str) -> DataFrame:
    """Classes with what ``rows`` (doc, tag, fields) hold of each as a list ``found``; such a list is no longer than the text."""
    lists = rows.groupBy("doc", "tag").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return texts.join(lists.hint("merge"), ["doc", "tag"], how)


def stretches(chosen: DataFrame, texts: DataFrame, unit: Unit) -> DataFrame:
    """The stretches around the anchors (h, doc, tag, at): (h, doc, tag, at, low, left, body), body being bytes or 8-byte word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tag, found = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("found")
            for i, j, data, offs in unpack(batch.column("z")):
                if unit.words:
                    keys, offsets = unit_keys(W.Texts(data, offs), unit)
                else:
                    keys, offsets = data, offs
                part = found.slice(i, j - i)
                lists = part.flatten()
                row = np.repeat(np.arange(j - i), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                h, place = lists.field(0).to_numpy(), lists.field(1).to_numpy()
                at = offsets[row] + place
                low, high = np.maximum(at - unit.flank, offsets[row]), np.minimum(at + unit.k + unit.flank, offsets[row + 1])
                for a in range(0, len(at), 20_000):
                    s = slice(a, a + 20_000)
                    body = [keys[x:y].tobytes() for x, y in zip(low[s], high[s])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[s]), pa.array(ids[i:j][row[s]]), pa.array(tag[i:j][row[s]]), pa.array(place[s]), pa.array(low[s] - offsets[row[s]]), pa.array((at - low)[s]), pa.array(body, pa.binary())],
                        ["h", "doc", "tag", "at", "low", "left", "body"],
                    )

    return by_document(chosen, texts, "inner", "h", "at").select("doc", "tag", "z", "found").mapInArrow(run, "h long, doc long, tag long, at long, low long, left long, body binary")


def sharded(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``rows`` with (h, salt) such that about ``most`` rows at most share one, dealt out and sorted by it; ``groups`` has the size n_seg of each h. ``several`` tells the groups that needed more than one salt."""
    salted = rows.join(groups.select("h", "n_seg").hint("merge"), "h")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc", "tag", "at"), F.ceil(F.col("n_seg") / F.lit(most))).cast("int")).withColumn("several", F.col("n_seg") > most).drop("n_seg")
    return salted.repartition(4 * parts(rows.sparkSession), "h", "salt").sortWithinPartitions("h", "salt", "doc", "tag", "at")


def runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Whole (h, salt) groups out of sorted batches, several together until ``least`` rows are reached; no more than that and one group is held."""
    have: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h, salt = batch.column("h").to_numpy(), batch.column("salt").to_numpy()
        edge = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
        if have:
            last = have[-1]
            if (last.column("h")[-1].as_py(), last.column("salt")[-1].as_py()) != (int(h[0]), int(salt[0])):
                edge = np.concatenate(([0], edge))
        start = 0
        for e in edge:
            if size + e - start >= least:
                if e > start:
                    have.append(batch.slice(start, e - start))
                if have:
                    yield pa.Table.from_batches(have)
                have, size, start = [], 0, int(e)
        have.append(batch.slice(start))
        size += batch.num_rows - start
    if have:
        yield pa.Table.from_batches(have)


ROW = "h long, doc long, tag long, at long, low long, left long, body binary"
FIELDS = ["doc", "tag", "low", "high", "h", "seg", "at", "left", "body"]
MARK = "doc long, tag long, low long, high long, h long, seg long, at long, left long, body binary"


def _spilled(table: pa.Table, unit: Unit) -> Iterator[pa.RecordBatch]:
    """The anchors of the next, longer gram in the stretches of those groups that other salts share."""
    several = table.filter(table.column("several"))
    for a in range(0, several.num_rows, 2000):
        part = several.slice(a, 2000)
        data, offsets = W.buffers(part.column("body").combine_chunks())
        if unit.words:
            units, keys, offsets = data.view(np.int64), data.view(U), offsets // 8
        else:
            units, keys = data, W.BYTE[data]
        row, place, h, seg = find(keys, offsets, unit)
        if not len(row):
            continue
        doc, tag, low = (part.column(c).to_numpy() for c in ("doc", "tag", "low"))
        start = np.maximum(place - unit.flank, 0)
        end = np.minimum(place + unit.k + unit.flank, (offsets[1:] - offsets[:-1])[row])
        body = [units[x:y].tobytes() for x, y in zip(offsets[row] + start, offsets[row] + end)]
        none = pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[row]), pa.array(tag[row]), pa.array(low[row] + start), none, pa.array(h), pa.array(seg), pa.array(low[row] + place), pa.array(place - start), pa.array(body, pa.binary())], FIELDS
        )


def _marked(marks: np.ndarray) -> pa.RecordBatch:
    """Rows (doc, tag, from, to) as a batch, joined where they touch."""
    marks = marks[np.lexsort((marks[:, 2], marks[:, 1], marks[:, 0]))]
    group = np.ones(len(marks), dtype=bool)
    group[1:] = (marks[1:, 0] != marks[:-1, 0]) | (marks[1:, 1] != marks[:-1, 1])
    which = np.cumsum(group)
    reach = np.maximum.accumulate(marks[:, 3] + which * (1 << 40)) - which * (1 << 40)
    new = group.copy()
    new[1:] |= marks[1:, 2] > reach[:-1]
    head = np.flatnonzero(new)
    out = marks[head]
    out[:, 3] = np.maximum.reduceat(marks[:, 3], head)
    n = len(out)
    return pa.RecordBatch.from_arrays([*(pa.array(out[:, c]) for c in range(4)), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary())], FIELDS)


def cascade(texts: DataFrame, words: bool, length: int, grams: tuple[int, ...], shard: int, batch_rows: int, name: str, once: bool, inside: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """(doc, tag, low, high): what windows that repeat cover.

    ``inside`` finds the windows that repeat inside a shard of stretches. ``once``: the
    first of equal stretches stays unmarked for its own sake. A group of more than
    ``shard`` different stretches around one anchor is salted over several shards; windows
    that repeat only across its shards are found by the next of ``grams``, a longer anchor
    in the same stretches, the last being the whole window, so no group meets in one task.
    """
    unit = Unit(words, length, grams[0])
    found = repeated(texts, unit, name)
    kinds = stored(found.groupBy("h", "seg").agg(F.min(F.struct("doc", "tag", "at")).alias("head"), F.count("*").alias("n")), f"{name}-kinds")
    again = F.struct("doc", "tag", "at") > F.col("head") if once else F.col("n") > 1
    same = found.join(kinds.where("n > 1").hint("merge"), ["h", "seg"]).where(again)
    marks = same.select("doc", "tag", (F.col("at") - unit.flank).alias("low"), (F.col("at") + unit.k + unit.flank).alias("high"))
    groups = stored(kinds.groupBy("h").agg(F.count("*").alias("n_seg")).where("n_seg > 1"), f"{name}-groups")
    heads = kinds.join(groups.hint("merge"), "h", "left_semi").select("h", "head.doc", "head.tag", "head.at")
    rows = stretches(heads, texts, unit)
    for gram in grams[1:]:
        unit = Unit(words, length, gram)
        large = bool(groups.where(F.col("n_seg") > shard).head(1))

        def run(batches: Iterator[pa.RecordBatch], unit: Unit = unit, large: bool = large) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, batch_rows):
                got = inside(table)
                if got:
                    yield _marked(np.concatenate(got))
                if large:
                    yield from _spilled(table, unit)

        out = stored(sharded(rows, groups, shard).mapInArrow(run, MARK), f"{name}-marks")
        marks = marks.unionByName(out.where("h is null").select("doc", "tag", "low", "high"))
        if not large:
            break
        spilled = out.where("h is not null").select("h", "seg", "doc", "tag", "at", "low", "left", "body")
        kinds = spilled.groupBy("h", "seg").agg(F.min(F.struct("doc", "tag", "at")).alias("head"), F.count_distinct("doc", "tag", "at").alias("n"), F.first("left").alias("left"), F.first("body").alias("body"))
        kinds = stored(kinds, f"{name}-kinds")
        again = F.struct("doc", "tag", "at") > F.col("head") if once else F.col("n") > 1
        size = F.octet_length("body") / (8 if words else 1)
        same = spilled.select("h", "seg", "doc", "tag", "at", "low").join(kinds.where("n > 1").select("h", "seg", "head", "n", size.cast("long").alias("size")).hint("merge"), ["h", "seg"]).where(again)
        marks = marks.unionByName(same.select("doc", "tag", "low", (F.col("low") + F.col("size")).alias("high")))
        groups = stored(kinds.groupBy("h").agg(F.count("*").alias("n_seg")).where("n_seg > 1"), f"{name}-groups")
        # Only groups of several go on; the one join with them is in ``sharded``, since Spark splits no key of a join above a join on it.
        rows = kinds.select("h", "head.doc", "head.tag", "head.at", (F.col("head.at") - F.col("left")).alias("low"), "left", "body")
    return marks
