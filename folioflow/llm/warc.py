"""WARC archives: writing pages as records, and reassembling segmented records on reading.

Writing: one HTTP response record per page, its body in chunked transfer framing. Of pages
with equal payloads the one with the largest id is the response; the others are revisit
records that refer to it and have no body. A block of more than ``SEGMENT`` bytes is
segmented: the first record carries ``WARC-Segment-Number: 1``, the rest follow as
``continuation`` records that name it in ``WARC-Segment-Origin-ID``, the last with
``WARC-Segment-Total-Length``. The archives are gzipped files in the shared folder, written
by Spark's text sink (a file is one gzip member) with the two line breaks that close a
record as its separator. Every record has an id of its own: revisits, and responses whose
page_id and payload other rows share, are told by their place among the writer's tasks.

Reading: files of one or many gzip members, or of none, are unpacked piece by piece and
parsed by ``Content-Length``. Whole records are decoded at once; only segments are grouped
by origin, ordered by number, checked against the total length and for gaps, joined, and
freed from chunked framing. A group is one page's segments, never more. What is damaged
(a file cut off, no or a wrong length, a header that is none, a missing segment, another
digest) makes a row that says so in ``problem`` and has no payload; reading goes on at the
next record that can be found.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, stored

SEGMENT = 16 << 10
CHUNK = 4096
FILE_RECORDS = 2000
DATE = "2020-01-01T00:00:00Z"
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, sha: str, part: int = 1) -> str:
    h = hashlib.md5(f"{page_id}/{sha}/{part}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    out = []
    for i in range(0, len(body), size):
        piece = body[i : i + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(framed: bytes) -> bytes:
    """The body out of chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if size < 0 or at + size + 2 > len(framed) or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block  # END follows when it is written


def _line(value: str | None) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def records(page_id: int | None, url: str | None, payload: bytes, sha: str, keeper: int | None, keepers: int | None, place: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit if ``keeper`` is another page, else a response with its continuations. ``keepers`` rows are the keeper's (null: this one alone), ``place`` tells this row from others like it."""
    again = keeper is not None and keeper != page_id
    alone = (keepers or 1) == 1
    own = page_id if alone and not again else f"{page_id}/{place}"
    fields = [("WARC-Record-ID", record_id(own, sha)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-ID", "" if page_id is None else page_id)]
    if again:
        refers = [("WARC-Refers-To", record_id(keeper, sha))] if alone else []
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *refers, ("X-Refers-To-Page-ID", keeper), ("Content-Type", "application/http;msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], block[:segment])]
    count = -(-len(block) // segment)
    for k in range(2, count + 1):
        total = [("WARC-Segment-Total-Length", len(block))] if k == count else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own, sha, k)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Segment-Origin-ID", record_id(own, sha)), ("WARC-Segment-Number", k), *total], block[(k - 1) * segment : k * segment]))
    return out


def inflated(content: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file of any number of gzip members, or of none; EOFError where the last one is cut off."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(content):
                raise EOFError
            some = content[at : at + piece]
            at += len(some)
            yield member.decompress(some)
        at -= len(member.unused_data)
        if not content[at:].strip(b"\0"):  # padding
            return


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, problem) of every record; header names in lower case. What is no sound record has a problem and no block."""
    have, fault = bytearray(), None

    def more() -> bool:
        nonlocal fault
        try:
            have.extend(next(pieces))
        except StopIteration:
            return False
        except EOFError:
            fault = "the file is cut off"
            return False
        except zlib.error:
            fault = "the file is damaged"
            return False
        return True

    def skip() -> None:
        """To the next thing that looks like a record."""
        at = 1
        while (found := have.find(b"\r\n\r\nWARC/", at)) < 0:
            at = max(1, len(have) - 8)
            if not more():
                have.clear()
                return
        del have[: found + 4]

    while True:
        while (end := have.find(END)) < 0 and more():
            pass
        if end < 0:
            if have.strip() or fault:
                yield {}, b"", fault or "a header is cut off"
            return
        lines = have[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = head.get("content-length", "")
        if not lines[0].startswith("WARC/") or not (length.isascii() and length.isdigit()):
            yield head if lines[0].startswith("WARC/") else {}, b"", "no length" if lines[0].startswith("WARC/") else "no record"
            skip()
            continue
        start = end + 4
        stop = start + int(length)
        while len(have) < stop + 4 and more():
            pass
        if have[stop : stop + 4] != END:
            yield head, b"", "the record is cut off" if len(have) < stop + 4 else "the length is wrong"
            skip()
            continue
        yield head, bytes(have[start:stop]), None
        del have[: stop + 4]


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(END)
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:.*chunked", head) else body


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> str:
    """Writes ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    Null html is an empty payload. Payloads of ``least`` bytes or more are stored once.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.sha1(raw).alias("sha"))
    # One row per different payload; counting combines before its shuffle and Spark splits the join's hot keys.
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(raw).alias("sha"), F.octet_length(raw).alias("n")).where(F.col("n") >= least)
    counts = keys.groupBy("sha", "page_id").agg(F.count("*").alias("m")).groupBy("sha").agg(F.max(F.struct("page_id", "m")).alias("k"), F.sum("m").alias("copies"))  # a null page_id is the least
    keepers = stored(counts.where("copies > 1").select("sha", F.col("k.page_id").alias("keeper"), F.col("k.m").alias("keepers")), "warc-keepers")
    rows = rows.join(keepers.hint("merge"), "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page_id, url, payload, sha, keeper, keepers_ in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "keeper", "keepers"))):
                n += 1
                made = records(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), keeper, keepers_, f"{task}/{n}", segment)
                out += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    text = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).option("lineSep", END.decode()).text(path)
    return path


def _join(parts_: list[tuple[int, int | None, bytes]]) -> tuple[bytes, str | None, int]:
    """(block, problem, copies) of one origin's segments; repeated segments have to be equal."""
    by: dict[int, list[tuple[int | None, bytes]]] = {}
    for number, total, block in parts_:
        by.setdefault(number, []).append((total, block))
    if any(x != v[0] for v in by.values() for x in v):
        return b"", "segments with one number differ", 1
    if sorted(by) != list(range(1, len(by) + 1)):
        return b"", "a segment is missing", 1
    total = by[len(by)][0][0]
    block = b"".join(by[k][0][1] for k in range(1, len(by) + 1))
    if total is None or total != len(block):
        return b"", "the total length is wrong", 1
    return block, None, min(map(len, by.values()))


FIELDS = ["page_id", "record_type", "refers_to", "stated_digest", "n", "origin", "number", "total", "block", "problem"]
PARSED = "page_id long, record_type string, refers_to long, stated_digest string, n long, origin string, number long, total long, block binary, problem string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string, n_segments long, payload binary"


def _int(text: str | None) -> int | None:
    """A number of at most 18 digits, null for anything else."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem, n_segments and payload of every page in the archives under ``path``.

    Bytes and digest are those of the payload read back, for revisits those that the record
    states. ``problem`` is null where the record is sound and its digest agrees; a damaged
    record or file is a row with a problem, its other columns null where they can't be read.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for head, block, problem in parse(inflated(content.as_py())):
                    sha = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    kind = head.get("warc-type")
                    number = _int(head.get("warc-segment-number"))
                    origin = head.get("warc-segment-origin-id", head.get("warc-record-id"))
                    if number and origin is None:
                        problem = problem or "a segment without an origin"
                    if problem:
                        number = None
                    n = None
                    if kind == "revisit":
                        found = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", block)
                        n, block = int(found[1]) if found else None, b""
                    rows.append((_int(head.get("x-page-id")), kind, _int(head.get("x-refers-to-page-id")), sha, n, origin if number else None, number, _int(head.get("warc-segment-total-length")), block, problem))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    parsed = files.mapInArrow(split, PARSED)
    # Whole records go on as they are; only segments are shuffled.
    whole = parsed.where("number is null").select("page_id", "record_type", "refers_to", "stated_digest", "n", F.array(F.struct(F.lit(1).cast("long").alias("number"), F.octet_length("block").cast("long").alias("total"), "block")).alias("parts"), "problem")
    several = parsed.where("number is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"), F.max("stated_digest").alias("stated_digest"), F.max("n").alias("n"), F.collect_list(F.struct("number", "total", "block")).alias("parts"), F.lit(None).cast("string").alias("problem")
    ).drop("origin")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                page_id, kind, refers, stated, n, parts_, fault = (batch.column(c)[i].as_py() for c in range(7))
                if fault:
                    out.append((page_id, None, None, kind, refers, fault, 0, None))
                    continue
                if kind == "revisit":
                    out.append((page_id, n, stated, kind, refers, None, 0, None))
                    continue
                block, problem, copies = _join([(x["number"], x["total"], x["block"]) for x in parts_])
                payload, sha = None, None
                if problem is None:
                    try:
                        payload = http_payload(block)
                        sha = digest(payload)
                        if stated and sha != stated:
                            problem = "the digest differs"
                    except ValueError as e:
                        problem = str(e)
                length = None if payload is None else len(payload)
                size += length or 0
                out += [(page_id, length, sha, kind, refers, problem, len(parts_) // copies, payload if with_payload else None)] * copies
                if size > 4 << 20:
                    yield _decoded(out)
                    out, size = [], 0
            if out:
                yield _decoded(out)

    return whole.unionByName(several).mapInArrow(decode, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], FIELDS)


def _decoded(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", "n_segments", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame, least: int = 0, segment: int = SEGMENT, with_payload: bool = False) -> DataFrame:
    """Archives written from ``pages`` and read back; see ``write_archives`` and ``read_archives``.

    Null html counts as empty; a null page_id stays null and is never the response that
    others refer to unless all are null; rows equal in page_id and payload are all responses;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, new_path(spark, "warc"), least, segment), with_payload)
