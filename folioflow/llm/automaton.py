"""Substring dedup over words: suffix automata of reference shards and matching statistics.

The corpus is its own reference. Repeated anchors (`_anchors`) cut it into shards: all
stretches that can hold an equal window meet in the shard of their anchor, so a document
is streamed to those automata that can match it and not to all of them, and no automaton
grows with the corpus. (Broadcasting every shard's automaton to every document would cost
documents times shards.) In a shard one generalised suffix automaton is built over the
word hashes of its stretches; each state keeps the first place at which its strings end.
Streaming a stretch through it gives matching statistics cut off at the window length,
and a window is removable where its state's first place lies before the window itself.
A group of more than ``SHARD`` stretches is salted over several automata; windows that
repeat only across them are found with longer anchors (`_anchors.cascade`).

Documents with equal texts go through this once, for the earliest of them; the others
begin every window later and lose all their words.

Cases: null and empty texts and those shorter than a window keep all their words (none);
a null doc_id orders first; rows that share a doc_id but not a text are documents of their
own, in the order of a 64-bit hash of their texts; rows with equal doc_id and text are the
same place in the order and remove nothing of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._anchors import by_document, cascade, collapse, unpack
from ._store import scratch, stored

GRAMS = (8, 14, 18)
SHARD = 8192
FAR = (1 << 63) - 1


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences; ``first`` is the least end place of each state's strings.

    Nearly all states have one transition, kept in two arrays; only the others have a
    dictionary, so a state takes some 50 bytes.
    """

    def __init__(self) -> None:
        self.symbol = array("q", [-1])
        self.to = array("q", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link = array("q", [-1])
        self.length = array("q", [0])
        self.first = array("q", [FAR])

    def _state(self, length: int, link: int, first: int, symbol: int = -1, to: int = -1) -> int:
        self.symbol.append(symbol)
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _set(self, state: int, c: int, to: int) -> None:
        more = self.more.get(state)
        if more is not None:
            more[c] = to
        elif self.symbol[state] in (-1, c):
            self.symbol[state], self.to[state] = c, to
        else:
            self.more[state] = {self.symbol[state]: self.to[state], c: to}
            self.symbol[state] = -2

    def after(self, state: int, c: int) -> int:
        """The state after ``c``, -1 if there is none."""
        if self.symbol[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def add(self, sequence: list[int], place: int) -> None:
        """One more sequence of non-negative integers; its i-th item ends at ``place`` + i. Sequences come in rising order of places."""
        link, length, first, after, set_ = self.link, self.length, self.first, self.after, self._set
        last = 0
        for i, c in enumerate(sequence):
            end = place + i
            q = after(last, c)
            if q >= 0 and length[q] == length[last] + 1:
                last = q
                if end < first[q]:
                    first[q] = end
                continue
            cur, p = -1, last
            if q < 0:
                cur = self._state(length[last] + 1, 0, end)
                while p != -1 and (q := after(p, c)) < 0:
                    set_(p, c, cur)
                    p = link[p]
                last = cur
                if p == -1:
                    continue
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            clone = self._state(length[p] + 1, link[q], first[q], self.symbol[q], self.to[q])
            if q in self.more:
                self.more[clone] = dict(self.more[q])
            while p != -1 and after(p, c) == q:
                set_(p, c, clone)
                p = link[p]
            link[q] = clone
            if cur >= 0:
                link[cur] = clone
            else:
                last = clone
                if end < first[clone]:
                    first[clone] = end

    def close(self) -> None:
        """Hands first places up the suffix links, longest strings first."""
        link, first = self.link, self.first
        for v in np.argsort(-np.frombuffer(self.length, dtype=np.int64), kind="stable").tolist():
            p = link[v]
            if p > 0 and first[v] < first[p]:
                first[p] = first[v]

    def firsts(self, sequence: list[int], least: int) -> list[int]:
        """For each item, the first end place of the ``least`` items that end there, or FAR if they are fewer or unknown."""
        link, length, first, after = self.link, self.length, self.first, self.after
        state = have = 0
        out = []
        for c in sequence:
            while (q := after(state, c)) < 0 and state:
                state = link[state]
                have = length[state]
            if q < 0:
                have = 0
            else:
                state, have = q, min(have + 1, least)
                while state and length[link[state]] >= have:
                    state = link[state]
            out.append(first[state] if have >= least else FAR)
        return out


def _shard(table: pa.Table, length: int) -> list[np.ndarray]:
    """Marks (doc, tag, from, to) of the windows in a shard that also start earlier in it."""
    doc, tag, low = (table.column(c).to_numpy() for c in ("doc", "tag", "low"))
    raw = [np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("body")]
    sizes = [len(x) for x in raw]
    body = np.split(np.unique(np.concatenate(raw), return_inverse=True)[1], np.cumsum(sizes)[:-1])  # words as small numbers
    order = np.lexsort((low, tag, doc)).tolist()
    machine = SuffixAutomaton()
    base, place, zero, key = np.zeros(len(body), np.int64), 0, 0, None
    for i in order:  # places rise in the corpus's order; overlapping stretches of one document share them
        if key != (key := (int(doc[i]), int(tag[i]))):
            zero = place - int(low[i])
        base[i] = zero + int(low[i])
        machine.add(body[i].tolist(), int(base[i]))
        place = max(place, int(base[i]) + len(body[i]))
    machine.close()
    marks = []
    for i in order:
        got = np.array(machine.firsts(body[i].tolist(), length), dtype=np.int64)
        later = np.flatnonzero(got < np.arange(len(got)) + base[i])
        if len(later):
            marks.append(np.stack([np.full(len(later), doc[i]), np.full(len(later), tag[i]), low[i] + later - length + 1, low[i] + later + 1], 1))
    return marks


def duplicate_marks(texts: DataFrame, length: int = 20, grams: tuple[int, ...] = GRAMS, shard: int = SHARD) -> DataFrame:
    """(doc, tag, low, high): word intervals of the classes ``texts`` that windows cover which also start earlier."""
    return cascade(texts, True, length, (*grams, length), shard, 1000, "words", True, lambda table: _shard(table, length))


def dedup_words(docs: DataFrame, length: int = 20, grams: tuple[int, ...] = GRAMS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256, kept_text and removed_spans (word intervals) of every document.

    A word goes if a window of ``length`` words covers it whose word sequence also starts
    earlier: at a smaller doc_id, or in the same document before. Windows are judged on the
    input. See the module's docstring for nulls, empty texts and repeated rows.
    """
    rows, texts = collapse(docs, "words")
    with scratch(docs.sparkSession):
        marks = stored(duplicate_marks(texts, length, grams, shard), "words-covered", keep=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            for i, j, data, offsets in unpack(batch.column("z")):
                block = W.Texts(data, offsets)
                raw = data.tobytes()
                n, gone, spans, digest, kept, cut = [], [], [], [], [], []
                for r in range(i, j):
                    a, b = int(block.rows[r - i]), int(block.rows[r - i + 1])
                    start, end = block.start[a:b].tolist(), block.end[a:b].tolist()
                    drop = np.zeros(b - a + 1, dtype=np.int64)
                    for x in found[r].as_py() or ():
                        drop[max(0, x["low"])] += 1
                        drop[min(b - a, x["high"])] -= 1
                    out = np.cumsum(drop[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                    text = b" ".join(raw[s:e] for s, e, o in zip(start, end, out.tolist()) if not o)
                    n.append(b - a)
                    gone.append(int(out.sum()))
                    spans.append(len(edge) // 2)
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode())
                    cut.append(edge.tolist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc", "tag", "more")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()), pa.array(cut, pa.list_(pa.int64()))],
                    ["head", "tag", "more", "n_words", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed_spans"],
                )

    whole = by_document(marks, texts, "left", "low", "high").select("doc", "tag", "more", "z", "found")
    done = whole.mapInArrow(run, "head long, tag long, more long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string, removed_spans array<long>")
    out = rows.join(done.hint("merge"), ["tag", "more"])
    later = (F.col("doc") > F.col("head")) & (F.col("n_words") >= length)  # all of it starts earlier, in the head
    either = lambda then, c: F.when(later, then).otherwise(F.col(c)).alias(c)
    return out.select(
        "doc_id", "n_words", either(F.col("n_words"), "n_removed"), either(F.lit(1).cast("long"), "n_spans"), either(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256"), either(F.lit(""), "kept_text"), either(F.array(F.lit(0).cast("long"), F.col("n_words")), "removed_spans")
    )
