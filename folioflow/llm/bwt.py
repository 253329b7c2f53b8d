"""Suffix-array dedup over bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Repeated anchors (`_anchors`) cut the corpus into shards of stretches that can hold an
equal window, so no suffix array grows with the corpus. The stretches of a shard, each
closed by an end mark, are sorted into a suffix array, by as many symbols as the threshold
has, and its transform. From
the empty string's interval, breadth-first backward extension by every preceding
symbol gives the intervals of longer and longer strings; the right end of an interval of
strings of n+1 symbols has a common prefix of n with what follows, so common prefixes come
out by increasing value and each is settled once. The expansion stops at the threshold:
what is unsettled then has a common prefix of at least that many bytes, and those suffixes
start a repeated string. A group of more than ``SHARD`` stretches is salted over several
shards; strings that repeat only across them are found with longer anchors
(`_anchors.cascade`).

Documents with equal texts go through this once and stand for a repeat of each other:
where there are several, every string of the threshold's length is elsewhere too.

Cases: null and empty texts and those shorter than the threshold keep all bytes; rows with
equal doc_id and text are as many documents and repeat each other; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._anchors import by_document, cascade, collapse, unpack
from ._store import scratch, stored

GRAMS = (100, 160, 190)
SHARD = 8192
BATCH = 2000


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols, by prefix doubling; only those that still tie are sorted again, and ties beyond that depth are in no order."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    many = 62 // bits
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(many, np.int64)))
    key = padded[:n].copy()
    for i in range(1, many):
        key <<= bits
        key |= padded[i : i + n]
    order = np.argsort(key)
    sorted_ = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(head)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.repeat(starts, np.diff(starts, append=n))
    width = many
    while len(starts) < n and width < depth:
        open_ = ~head
        open_[:-1] |= ~head[1:]
        at = np.flatnonzero(open_)
        who = order[at]
        both = rank[who] * (n + 1) + rank[np.minimum(who + width, n)] + 1
        by = np.argsort(both)
        order[at] = who[by]
        both = both[by]
        new = np.ones(len(at), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        head[at] = new
        first = np.flatnonzero(new)
        rank[order[at]] = np.repeat(at[first], np.diff(first, append=len(at)))
        starts = np.flatnonzero(head)
        width *= 2
    return order


def repeated_starts(symbols: np.ndarray, least: int) -> np.ndarray:
    """Places where a string of ``least`` symbols starts that also starts at another place. The last symbol is the least and unique."""
    n = len(symbols)
    order = suffix_array(symbols, least)
    before = symbols[order - 1].astype(np.uint16)  # the transform; 16 bits sort by radix
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)  # from a row to that of the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    first = symbols[order]
    known = np.zeros(n + 1, dtype=bool)
    known[n] = True
    edge = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True])))
    low, high = edge[:-1], edge[1:]
    known[high] = True
    known[0] = True
    for _ in range(1, least):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
        which = np.repeat(np.arange(len(low)), size)
        symbol = before[rows]
        by = np.argsort(symbol, kind="stable")  # rows rise, so this is the order of the rows that they step to
        to, which, symbol = step[rows[by]], which[by], symbol[by]
        cut = np.ones(total, dtype=bool)
        cut[1:] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        head = np.flatnonzero(cut)
        new_low = to[head]
        new_high = np.concatenate((to[head[1:] - 1], to[-1:])) + 1
        fresh = ~known[new_high]
        known[new_high[fresh]] = True
        low, high = new_low[fresh], new_high[fresh]
    tied = np.flatnonzero(~known[:n])
    return np.unique(np.concatenate((order[tied], order[tied - 1])))


def _shard(table: pa.Table, length: int) -> list[np.ndarray]:
    """Marks (doc, tag, from, to) of the strings that repeat in a shard. Overlapping stretches of one document are joined first."""
    doc, tag, low = (table.column(c).to_numpy() for c in ("doc", "tag", "low"))
    body = table.column("body")
    pieces: list[list] = []
    for i in np.lexsort((low, tag, doc)).tolist():
        raw, a = body[i].as_py(), int(low[i])
        last = pieces[-1] if pieces else None
        if last and last[0] == doc[i] and last[1] == tag[i] and a <= last[2] + last[4]:
            if (more := a + len(raw) - last[2] - last[4]) > 0:
                last[3].append(raw[-more:])
                last[4] += more
        else:
            pieces.append([doc[i], tag[i], a, [raw], len(raw)])
    if not pieces:
        return []
    sizes = np.array([p[4] + 1 for p in pieces])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    text = np.frombuffer(b"\0".join(b"".join(p[3]) for p in pieces) + b"\0", dtype=np.uint8)
    used = np.bincount(text, minlength=256) > 0
    symbols = np.cumsum(used)[text] + 1  # few small numbers
    symbols[ends - 1] = 1
    symbols[-1] = 0
    starts = repeated_starts(symbols, length)  # a string that holds an end mark is no whole one
    piece = np.searchsorted(ends, starts, side="right")
    place = starts - (ends - sizes)[piece]
    whole = place + length <= sizes[piece] - 1
    piece, place = piece[whole], place[whole]
    if not len(piece):
        return []
    ids, tags, lows = (np.array([p[c] for p in pieces], dtype=np.int64) for c in range(3))
    return [np.stack([ids[piece], tags[piece], lows[piece] + place, lows[piece] + place + length], 1)]


def duplicate_marks(texts: DataFrame, length: int = 200, grams: tuple[int, ...] = GRAMS, shard: int = SHARD) -> DataFrame:
    """(doc, tag, low, high): byte intervals of the classes ``texts`` that strings of ``length`` bytes cover which also start elsewhere."""
    return cascade(texts, False, length, (*grams, length), shard, BATCH, "bytes", False, lambda table: _shard(table, length))


def dedup_bytes(docs: DataFrame, length: int = 200, grams: tuple[int, ...] = GRAMS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and removed_spans of every document.

    A byte goes if a ``length``-byte string covers it that also starts anywhere else, in the
    same document or another; strings are judged on the input. See the module's docstring
    for nulls, empty texts and repeated rows.
    """
    rows, texts = collapse(docs, "bytes")
    with scratch(docs.sparkSession):
        marks = stored(duplicate_marks(texts, length, grams, shard), "bytes-covered", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, copies = batch.column("found"), batch.column("n").to_numpy()
            for i, j, data, offsets in unpack(batch.column("z")):
                raw = data.tobytes()
                n, gone, spans, digest, kept, cut = [], [], [], [], [], []
                for r in range(i, j):
                    text = raw[offsets[r - i] : offsets[r - i + 1]]
                    runs: list[list[int]] = []
                    if copies[r] > 1 and len(text) >= length:
                        runs = [[0, len(text)]]
                    else:
                        for a, b in sorted((max(0, x["low"]), min(len(text), x["high"])) for x in found[r].as_py() or ()):
                            if runs and a <= runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], b)
                            else:
                                runs.append([a, b])
                    edges = [0, *(x for run_ in runs for x in run_), len(text)]
                    left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    n.append(len(text))
                    gone.append(len(text) - len(left))
                    spans.append(len(runs))
                    digest.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
                    cut.append(edges[1:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("tag").slice(i, j - i), batch.column("more").slice(i, j - i), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.int64()))],
                    ["tag", "more", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed_spans"],
                )

    whole = by_document(marks, texts, "left", "low", "high").select("tag", "more", "n", "z", "found")
    done = whole.mapInArrow(run, "tag long, more long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed_spans array<long>")
    return rows.select("doc_id", "tag", "more").join(done.hint("merge"), ["tag", "more"]).drop("tag", "more")
