"""Token-ID files in patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of ``BLOCK`` ids. Of each block the
least id is subtracted; the differences are packed at the width that ``PERCENTILE`` of them
need, and those that need more are exceptions: their places and whole differences follow
the packed bits. An index holds the start of every block and the end of every document, so
any range of ids is read from its own blocks alone.

Layout, little endian: segments, each a header (magic, ids a block, documents, ids,
partition, number), document ids, which of them are null, document ends, block starts,
blocks (least id, width, number of exceptions, packed bits, places, differences), a CRC-32
of all that and a line end, which is Spark's text sink's, which commits the files.

Documents are dealt to partitions by ranges of doc_id and sorted inside them; a partition
is written as segments of about ``IDS`` ids, ``SEGMENTS`` a file, so a task holds one segment
and one block of texts, or one file when it reads. Partition and number give the segments'
order, from which, with one row a partition in one place, follows how many ids come before
each segment.

Encoding. The library encodes whole texts at about 1 MB a second, several times the time
that all else takes, and texts repeat their words. White space and the end of a run of
ASCII letters before another ASCII character always end a pre-token of the vocabularies
that ``Encoder`` takes, and neither normalisation nor merges reach across them. So texts are
cut there, and the library encodes every different piece, once a worker until ``KNOWN``
pieces are held.

Null texts are empty; a document without tokens still has its end id. A null doc_id comes
first. Rows that share a doc_id follow each other by their text's hash and then their text;
wholly equal rows follow each other. An empty table gives no files and no rows. Other
columns of the table are not looked at.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._store import stored

BLOCK = 128
PERCENTILE = 0.9
IDS = 1 << 20
SEGMENTS = 8
KNOWN = 1 << 21
STEP = 512  # blocks that are packed or unpacked at once
HEADER = struct.Struct("<4sIQQqq")
MAGIC = b"PFR1"
HEAD = 6  # bytes before a block's packed bits: least id, width, number of exceptions
ROWS = "part long, number long, place long, doc_id long, first long, ids binary"


def _alike(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of one width, at most ``STEP`` at once."""
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        for a in range(0, len(some), STEP):
            yield w, some[a : a + STEP]


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of ``ids`` (unsigned 32 bits) one after another, and the starts of all and the end of the last."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    grid = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    least = grid.min(1)
    delta = grid - least[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.frexp(np.partition(delta, at, 1)[:, at].astype(np.float64))[1].astype(np.int64)  # bits that the value needs
    odd = delta.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    row, place = np.nonzero(odd)
    extra = np.bincount(row, minlength=n)
    starts = np.concatenate(([0], np.cumsum(HEAD + BLOCK // 8 * width + 5 * extra)))
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    head = np.concatenate((least.astype("<u4").view(np.uint8).reshape(n, 4), width.astype(np.uint8)[:, None], extra.astype(np.uint8)[:, None]), 1)
    out[starts[:-1, None] + np.arange(HEAD)] = head
    low = np.where(odd, 0, delta)
    for w, some in _alike(width):
        bits = np.empty((len(some), BLOCK, w), dtype=np.uint8)
        for i in range(w):
            bits[:, :, i] = low[some] >> np.uint32(i) & np.uint32(1)
        out[starts[some, None] + HEAD + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(extra)))[row]
    tail = starts[row] + HEAD + BLOCK // 8 * width[row]
    out[tail + nth] = place
    out[(tail + extra[row] + 4 * nth)[:, None] + np.arange(4)] = delta[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``, padded to whole blocks."""
    n = len(starts)
    head = data[starts[:, None] + np.arange(HEAD)]
    least = head[:, :4].copy().view("<u4")[:, 0]
    width, extra = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    delta = np.zeros((n, BLOCK), dtype=np.uint32)
    for w, some in _alike(width):
        bits = np.unpackbits(data[starts[some, None] + HEAD + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(-1, w)
        kind = np.float32 if w <= 24 else np.float64  # both hold such sums exactly
        delta[some] = (bits.astype(kind) @ (2.0 ** np.arange(w)).astype(kind)).astype(np.uint32).reshape(-1, BLOCK)
    row = np.repeat(np.arange(n), extra)
    nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(extra)))[row]
    tail = starts[row] + HEAD + BLOCK // 8 * width[row]
    delta[row, data[tail + nth]] = data[(tail + extra[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (delta + least[:, None]).ravel()


def to_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, part: int = 0, number: int = 0, percentile: float = PERCENTILE) -> bytes:
    """One segment: ``ends`` are the documents' ends among ``ids``."""
    blocks, starts = pack(ids, percentile)
    null = np.packbits(np.array([d is None for d in doc_ids], dtype=bool), bitorder="little")
    body = [HEADER.pack(MAGIC, BLOCK, len(doc_ids), len(ids), part, number), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes(), ends.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), blocks.tobytes()]
    raw = b"".join(body)
    return raw + struct.pack("<I", zlib.crc32(raw))


class Segment:
    """A segment that was read: its documents, and any range of its ids. Raises ValueError where the bytes are damaged."""

    def __init__(self, raw: bytes | memoryview):
        if len(raw) < HEADER.size or raw[:4] != MAGIC:
            raise ValueError("not a token file")
        _, block, docs, self.n_ids, self.part, self.number = HEADER.unpack_from(raw)
        at, out = HEADER.size, []
        data = np.frombuffer(raw, dtype=np.uint8)
        for size in (8 * docs, -(-docs // 8), 8 * docs, 8 * (-(-self.n_ids // BLOCK) + 1)):
            out.append(data[at : at + size])
            at += size
        if block != BLOCK or at > len(data):
            raise ValueError("not a token file of this layout")
        self.doc_ids = out[0].copy().view("<i8")
        self.null = np.unpackbits(out[1], bitorder="little")[:docs].astype(bool)
        self.ends, self.starts = (x.copy().view("<u8").astype(np.int64) for x in out[2:])
        stop = at + int(self.starts[-1])
        if stop + 4 > len(data) or zlib.crc32(data[:stop]) != struct.unpack_from("<I", raw, stop)[0]:
            raise ValueError("a damaged token file")
        self.blocks, self.size = data[at:stop], stop + 4

    @classmethod
    def all(cls, raw: bytes) -> Iterator[Segment]:
        """The segments of a file."""
        at = 0
        while at < len(raw):
            found = cls(memoryview(raw)[at:])
            yield found
            at += found.size + 1

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids first to end, from their own blocks."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if first >= end:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        return unpack(self.blocks, self.starts[a:b])[first - a * BLOCK : end - a * BLOCK]


LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PLAIN = np.zeros(256, dtype=bool)
PLAIN[:128] = ~LETTER[:128]


class Encoder:
    """Ids of many texts by a vocabulary of the `tokenizers` library whose pre-tokens are contractions, runs of letters, single numbers and runs of other characters, without white space."""

    #: The pattern of such vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Put between pieces that are encoded in one call; a token that no piece without it can give.
    MARK = "~"

    def __init__(self, spec: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.library, self.known = Tokenizer.from_str(spec), known
        self.special = [t["content"].encode() for t in json.loads(spec)["added_tokens"]]
        mark = self.library.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    @classmethod
    def checked(cls, spec: str) -> str:
        """``spec``, if pieces of its texts can be encoded apart."""
        parsed = json.loads(spec)
        steps = (parsed["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = {s["type"] for s in (parsed["normalizer"] or {}).get("normalizers", [])}
        if not steps or steps[0].get("pattern", {}).get("Regex") != cls.PATTERN or not steps[0].get("invert") or not kinds <= {"NFC", "Replace", "Lowercase"} or any(t["lstrip"] or t["rstrip"] or b" " in t["content"].encode() for t in parsed["added_tokens"]):
            raise ValueError("this vocabulary's texts can't be encoded in pieces")
        return spec

    def clear(self) -> None:
        self.keys, self.at, self.n, self.flat = np.zeros(0, W.U), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Has new pieces encoded; ``keys`` are theirs."""
        plain = np.array([self.mark is not None and self.MARK not in p for p in pieces])
        keys, pieces = np.concatenate((keys[plain], keys[~plain])), [p for p, x in zip(pieces, plain) if x] + [p for p, x in zip(pieces, plain) if not x]
        parts, counts, split = [], [], int(plain.sum())
        for i in range(0, split, 256):
            some = pieces[i : min(i + 256, split)]
            ids = np.array(self.library.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(ids == self.mark)
            counts.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
            parts.append(np.delete(ids, at))
        for i in range(split, len(pieces), 4096):
            some = pieces[i : i + 4096]
            got = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(got.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(some)) if got.ids else np.zeros(len(some), np.int64))
        n = np.concatenate(counts)
        at = len(self.flat) + np.cumsum(n) - n
        order = np.argsort(keys)
        keys, at, n = keys[order], at[order], n[order]
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.n, where, n)
        self.flat = np.concatenate((self.flat, *parts))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece of the rows of ``data``."""
        solid = ~W.SPACE[data]
        first = np.zeros(len(data), dtype=bool)
        first[1:] = LETTER[data[:-1]] & PLAIN[data[1:]]
        raw = data.tobytes()
        for text in self.special:
            i = raw.find(text)
            while i >= 0:
                first[i + 1 : i + len(text)] = False
                i = raw.find(text, i + 1)
        first[1:] |= ~solid[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        first &= solid
        last = solid.copy()
        last[:-1] &= first[1:] | ~solid[1:]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        start, end = self.pieces(data, offsets)
        if not len(start):  # nothing but white space
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, back = np.unique(W.word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > self.known:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            raw = data.tobytes()
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        n = self.n[at][back].astype(np.int64)
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[at][back] - stop + n, n) + np.arange(int(stop[-1]))]
        sums = np.concatenate(([0], stop))
        row = np.searchsorted(start, offsets)
        return ids, sums[row[1:]] - sums[row[:-1]]

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; long texts in stretches that end at white space."""
        data, offsets = W.buffers(column)
        for i, j in W.slices(offsets, W.BLOCK):
            a, b = int(offsets[i]), int(offsets[j])
            if j - i > 1 or b - a <= W.BLOCK:
                ids, n = self.encode(data[a:b], offsets[i : j + 1] - a)
                yield from np.split(ids, np.cumsum(n)[:-1])
                continue
            out = []  # one text
            while a < b:
                stop = min(a + W.BLOCK, b)
                while stop < b and not (space := W.SPACE[data[stop : stop + W.BLOCK]]).any():
                    stop += min(W.BLOCK, b - stop)
                if stop < b:
                    stop += int(space.argmax())
                out.append(self.encode(data[a:stop], np.array([0, stop - a]))[0])
                a = stop
            yield np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, ids: int = IDS, percentile: float = PERCENTILE) -> None:
    """Writes the token files of ``docs`` (doc_id, text) into the folder ``path``, which must not be there; ``vocabulary`` is a `tokenizers` file on the driver."""
    spec = Encoder.checked(open(vocabulary, encoding="utf-8").read())
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # as large as the vocabulary, whatever the corpus
    key = f"{vocabulary}:{zlib.crc32(spec.encode())}"
    # A frame of its own with names of its own: what other columns are called doesn't matter.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        names: list[int | None] = []
        have: list[np.ndarray] = []
        part, number, held = None, 0, 0
        end = np.array([end_id], dtype=np.uint32)

        def segment() -> pa.RecordBatch:
            raw = to_file(names, np.cumsum([len(x) for x in have]), np.concatenate(have), part, number, percentile)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder.rows(batch.column("text"))):
                names.append(doc_id)
                have.append(np.concatenate((got, end)))
                held += len(have[-1])
                if held >= ids:
                    yield segment()
                    names, have, number, held = [], [], number + 1, 0
        if names:
            yield segment()

    segments = rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "segment binary")
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, number and place (a document's order), doc_id, first (its start in its file) and ids (little endian, 32 bits each, with the end id) of every document in the folder."""

    def rows(part: Segment) -> Iterator[pa.RecordBatch]:
        a, n = 0, len(part.doc_ids)
        while a < n:
            low = int(part.ends[a - 1]) if a else 0
            b = min(n, max(a + 1, int(np.searchsorted(part.ends, low + IDS // 8))))
            edge = np.concatenate(([low], part.ends[a:b]))
            raw = part.ids(low, int(edge[-1])).astype("<u4").tobytes()
            ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * (edge - low)), pa.py_buffer(raw)]).cast(pa.binary())
            order = [pa.array(np.full(b - a, part.part)), pa.array(np.full(b - a, part.number)), pa.array(np.arange(a, b))]
            yield pa.RecordBatch.from_arrays([*order, pa.array(part.doc_ids[a:b], mask=part.null[a:b]), pa.array(edge[:-1]), ids], ["part", "number", "place", "doc_id", "first", "ids"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for part in Segment.all(batch.column("content")[i].as_py()):  # none in the empty file of an empty table
                    yield from rows(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` (part, number, first, n_tokens and more; stored, as they are read twice) with ``start``: the ids before each document. Sums of files are added up inside partitions, then those of partitions: in one place there is a row a partition."""
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    files = files.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("inside"))
    files = files.join(parts, "part").select("part", "number", (F.col("base") + F.col("inside")).alias("before"))
    return rows.join(files, ["part", "number"]).withColumn("start", F.col("before") + F.col("first")).drop("before")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    rows = read_tokens(spark, path).select("part", "number", "doc_id", "first", F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return with_starts(stored(rows, "pfor-digest")).select("doc_id", "start", "n_tokens", "ids_crc32")
