"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words, cut at white space and ASCII punctuation. A fixed
mask selects some of ``SPAN`` consecutive tokens and ignores the others, so that a
substituted token spoils only the seeds whose mask selects it. Hashes of benchmark items
under each mask are joined with those of the documents; around every hit the two texts are
laid side by side without gaps and every best-scoring stretch (a match counts ``MATCH``, a
substitution ``-SUBSTITUTION``, so four fifths have to agree) is verified: ``MATCHES`` equal
tokens. An item that agrees in nine tenths of all its tokens is accepted whole.

No step holds the benchmark: one reading of the documents leaves those seeds that a bitmap
of ``BITS`` bits knows (of fixed size, however large the benchmark is), they are joined with
the items' seeds as tables, and only documents and items that share a seed are read again
to be verified. An item's seeds that repeat within ``NEAR`` places are kept at the two ends
of such a run, so that periodic texts do not meet at every place.

No mask ignores its first place, so items of just ``SPAN`` tokens also have seeds of all but
their first or last. Items of 5 to ``SPAN`` - 1 tokens have seeds of 5 tokens in a row;
shorter ones are too common to tell anything and never match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import fresh, parts, scratch, stored
from .ordinal import BREAKS

SPAN = 10
MASKS = ("1101100111", "1110010111", "1011101101", "1111011010")
SHORT = "11111"
ENDS = "1" * (SPAN - 1)
ALL = (*MASKS, ENDS, SHORT)
MATCH, SUBSTITUTION = 10, 39
MATCHES = 12
BITS = 1 << 25
NEAR = 32
NULL_ID = -(1 << 63)
U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block and the rows' offsets among them."""
    texts = W.Texts(BREAKS[data], offsets)
    return texts.hashes(), texts.rows


def tokenized(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, rows' offsets) over a column of texts."""
    data, offsets = W.buffers(pc.utf8_lower(column))
    for i, j in W.slices(offsets):
        yield i, j, *tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def seeds(words: np.ndarray, which: int) -> np.ndarray:
    """The hash under the mask ``ALL[which]`` of the tokens from every place."""
    mask = ALL[which]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(n, W.BYTE[which], dtype=U)
    for i, c in enumerate(mask):
        if c == "1":
            out *= U(W.BASE)
            out += words[i : i + n]
    return W.mix(out)


def masks_of(n: int) -> range:
    """Which masks an item of ``n`` tokens has seeds of."""
    return range(0) if n < 5 else range(5, 6) if n < SPAN else range(5) if n == SPAN else range(4)


def ends_of_runs(keys: np.ndarray) -> np.ndarray:
    """Places without those whose key occurs both within NEAR places before and within NEAR after."""
    order = np.argsort(keys, kind="stable")
    near = (keys[order][1:] == keys[order][:-1]) & (np.diff(order) <= NEAR)
    inner = np.zeros(len(keys), dtype=bool)
    inner[order[1:-1]] = near[1:] & near[:-1]
    return np.flatnonzero(~inner)


def best_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(low, high, matches) of the best-scoring stretch of an overlap."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, MATCH, -SUBSTITUTION))))
    least = np.minimum.accumulate(sums)
    high = int(np.argmax(sums - least))
    low = int(np.flatnonzero(sums[: high + 1] == least[high])[-1])
    return low, high, int(equal[low:high].sum())


def stretches(equal: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(low, high, matches) of all stretches of an overlap with an item of ``length`` tokens that count: all of it, or those with matches enough, the best-scoring one and those of what is left on both sides of it."""
    if (n := int(equal.sum())) >= -(-9 * length // 10):
        at = np.flatnonzero(equal)
        return [(int(at[0]), int(at[-1]) + 1, n)]
    least = min(MATCHES, -(-9 * length // 10))
    out, open_ = [], [(0, len(equal))]
    while open_:
        a, b = open_.pop()
        if b - a < least:
            continue
        low, high, n = best_overlap(equal[a:b])
        if n >= least:
            out.append((a + low, a + high, n))
            open_ += [(a, a + low), (a + high, b)]
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, itag, words) of every different item, words being token hashes; null ids and texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, rows in tokenized(batch.column("text")):
                each = [words[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), batch.column("itag").slice(i, j - i), pa.array(each, pa.binary())], ["item_id", "itag", "words"])

    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("itag"), "text").where("item_id is not null and text is not null")
    return stored(known.mapInArrow(W.tidy(run), "item_id long, itag long, words binary").dropDuplicates(["item_id", "itag"]), "seeds-items")


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to (h, mask, item_id, itag, place) of their seeds."""
    for batch in batches:
        for i, w in enumerate(batch.column("words").to_pylist()):
            words = np.frombuffer(w, dtype=U)
            for mask in masks_of(len(words)):
                keys = seeds(words, mask)
                place = ends_of_runs(keys)
                n = len(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[place].view(np.int64)), pa.array(np.full(n, mask, np.int32)), *(pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in ("item_id", "itag")), pa.array(place)],
                    ["h", "mask", "item_id", "itag", "place"],
                )


def _bitmap(found: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits of the seeds ``h``, made by the executors in pieces of 4,096 bytes."""
    at = F.pmod("h", F.lit(BITS)) + 1
    pieces = found.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in pieces:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _named(docs: DataFrame) -> tuple:
    """How documents are told: by doc_id (a null one as the least long) and 64 bits of a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64("text")


def _verified(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, doc_id, n_tokens) of all documents and (doc, tag, item_id, low, high, matches) of all verified overlaps, both stored."""
    spark = docs.sparkSession
    doc, tag = _named(docs)
    items = _items(benchmark)
    found = stored(items.mapInArrow(W.tidy(_item_seeds), "h long, mask int, item_id long, itag long, place long"), "seeds-seeds")
    masks = sorted(r["mask"] for r in found.select("mask").distinct().collect())  # six at most
    known = spark.sparkContext.broadcast(_bitmap(found))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            for i, j, words, rows in tokenized(batch.column("text")):
                row, at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
                for mask in masks:
                    own = seeds(words, mask)
                    if not len(own):
                        continue
                    b = (own & U(BITS - 1)).astype(np.int64)
                    p = np.flatnonzero((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
                    r = np.searchsorted(rows, p, side="right") - 1
                    inside = p + len(ALL[mask]) <= rows[r + 1]
                    row.append(r[inside])
                    at.append((p - rows[r])[inside])
                    h.append(own[p[inside]])
                row, at, h = np.concatenate(row), np.concatenate(at), np.concatenate(h)
                order = np.argsort(row, kind="stable")
                edge = pa.array(np.searchsorted(row[order], np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc", "tag", "doc_id")), pa.array(np.diff(rows)), pa.ListArray.from_arrays(edge, pa.array(h[order].view(np.int64))), pa.ListArray.from_arrays(edge, pa.array(at[order]))],
                    ["doc", "tag", "doc_id", "n_tokens", "h", "at"],
                )

    rows = docs.select(doc.alias("doc"), tag.alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(rows.mapInArrow(W.tidy(scan), "doc long, tag long, doc_id long, n_tokens long, h array<long>, at array<long>"), "seeds-scanned", keep=True)
    hits = scanned.where(F.size("h") > 0).select("doc", "tag", F.explode(F.arrays_zip("h", "at")).alias("x")).select("doc", "tag", "x.h", "x.at")
    hits = hits.join(found.select("h", "item_id", "itag", "place").hint("merge"), "h").select("doc", "tag", "item_id", "itag", (F.col("at") - F.col("place")).alias("shift"))
    pairs = stored(hits.groupBy("doc", "tag", "item_id", "itag").agg(F.collect_set("shift").alias("shifts")), "seeds-pairs")  # no more shifts than the two have tokens

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, None  # a document's text comes once, before its pairs
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key = batch.column("doc")[i].as_py(), batch.column("tag")[i].as_py()
                if batch.column("text")[i].is_valid:
                    if key != last:  # rows equal in doc_id and text
                        raw, offsets = W.buffers(pc.utf8_lower(batch.column("text").slice(i, 1)))
                        last, text = key, tokens(raw, offsets)[0]
                    continue
                item = np.frombuffer(batch.column("words")[i].as_py(), dtype=U)
                for shift in batch.column("shifts")[i].as_py():
                    a, b = max(0, shift), min(len(text), shift + len(item))
                    out += [(*key, batch.column("item_id")[i].as_py(), a + low, a + high, n) for low, high, n in stretches(text[a:b] == item[a - shift : b - shift], len(item))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc", "tag", "item_id", "low", "high", "matches"])

    texts = rows.join(pairs.select("doc", "tag").distinct(), ["doc", "tag"], "left_semi").select("doc", "tag", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<long>").alias("shifts"), F.lit(None).cast("binary").alias("words"), "text")
    met = pairs.join(items, ["item_id", "itag"]).select("doc", "tag", "item_id", "shifts", "words", F.lit(None).cast("string").alias("text"))
    checked = texts.unionByName(met).repartition(parts(spark), "doc", "tag").sortWithinPartitions("doc", "tag", F.col("text").isNull())
    return scanned.select("doc", "tag", "doc_id", "n_tokens"), stored(checked.mapInArrow(W.tidy(verify), "doc long, tag long, item_id long, low long, high long, matches long"), "seeds-verified", keep=True)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_tokens, contaminated, n_items, item_ids (rising), n_covered (tokens in verified overlaps) and overlaps (item_id, low, high, matches) of every document.

    Null and empty texts are clean; null items, and items of fewer than 5 tokens, match
    nothing; items of one id are one item; repeated rows are judged each; empty tables give
    no rows or no matches.
    """
    with scratch(docs.sparkSession):
        scanned, verified = _verified(docs, benchmark)
    by = verified.groupBy("doc", "tag").agg(F.array_sort(F.collect_set(F.struct("item_id", "low", "high", "matches"))).alias("overlaps"))
    out = scanned.join(by, ["doc", "tag"], "left").withColumn("overlaps", F.coalesce("overlaps", F.expr("cast(array() as array<struct<item_id: long, low: long, high: long, matches: long>>)")))
    zero = F.lit(0).cast("long")
    spans = F.array_sort(F.transform("overlaps", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))))
    covered = F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(zero, x["high"] - F.greatest(x["low"], a["end"]))).alias("n"), F.greatest(a["end"], x["high"]).alias("end")))
    ids = F.array_distinct(F.transform("overlaps", lambda x: x["item_id"]))
    return out.select("doc_id", "n_tokens", (F.size("overlaps") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), covered["n"].alias("n_covered"), "overlaps")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``contamination`` finds an item in."""
    with scratch(docs.sparkSession):
        _, verified = _verified(docs, benchmark)
    a, b = fresh(docs, "doc", "tag")
    doc, tag = _named(docs)
    gone = verified.select(F.col("doc").alias(a), F.col("tag").alias(b)).distinct()
    return docs.join(gone, (doc == F.col(a)) & (tag == F.col(b)), "left_anti")
