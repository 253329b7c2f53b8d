"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary.

Two deterministic transducers:

* ``Splitter`` finds where pre-tokens start. Its states say what role the last character
  played; texts are cut into chunks of ``CHUNK`` characters, each chunk is read from all
  states at once, which gives its map from entry to exit state, and the maps are composed by
  a parallel prefix scan. Entry states known, a second reading gives every state.
* ``Transducer`` reads the bytes of a pre-token; each transition carries the number of
  tokens by which the count of what has been read changes. A state is what decides the
  future: the longest suffix that can still grow into a token, with the last token of each
  prefix inside it. States and transitions are compiled when first needed and kept; beyond
  ``STATES`` they are compiled anew, so memory is bounded.

Equal pre-tokens of a block are read once. Counts equal those of the `tokenizers` library
without added special tokens; the strings of special tokens inside a text count one each,
as is that library's default. Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

CHUNK = 64
STATES = 600_000
KNOWN = 2_000_000

# Classes of characters: letters apart from those of contractions, numbers, space, other white space, the rest, apostrophe, s t m d, l, v, r, e, end.
LETTER, NUMBER, SPACE, WHITE, OTHER, APOSTROPHE, STMD, ELL, VEE, ARR, EEE, END = range(12)
# States: start, in letters, in numbers, in others, after space, after other white space, apostrophe that starts a pre-token, contraction of one letter, its l, v, r, contraction of two letters.
S0, SL, SN, SP, SS, SW, SA, SK, SKL, SKV, SKR, SKK = range(12)


def _table() -> np.ndarray:
    to = np.zeros((12, 12), dtype=np.uint8)
    letters = [LETTER, STMD, ELL, VEE, ARR, EEE]
    for state in range(12):
        to[state, letters] = SL
        to[state, [NUMBER, SPACE, WHITE, OTHER, END]] = [SN, SS, SW, SP, S0]
        to[state, APOSTROPHE] = SP if state in (SP, SS, SA) else SA
    to[SA, [STMD, ELL, VEE, ARR]] = [SK, SKL, SKV, SKR]
    to[SKL, ELL] = to[SKV, EEE] = to[SKR, EEE] = SKK
    return to


TO = _table()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        by = {"L": LETTER, "N": NUMBER}
        out = np.array([by.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
        for c in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            out[c] = WHITE
        for c, kind in ((" ", SPACE), ("'", APOSTROPHE), *((c, STMD) for c in "stmd"), ("l", ELL), ("v", VEE), ("r", ARR), ("e", EEE)):
            out[ord(c)] = kind
        _classes = out
    return _classes


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """The map from entry to exit state of each row of classes."""
    maps = np.broadcast_to(np.arange(12, dtype=np.uint8), (len(kinds), 12)).copy()
    flat = TO.ravel()
    for k in range(kinds.shape[1]):
        maps = flat[maps.astype(np.intp) * 12 + kinds[:, k, None]]
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps, by doubling."""
    out, step = maps, 1
    while step < len(out):
        later = np.take_along_axis(out[step:], out[:-step].astype(np.intp), axis=1)
        out = np.concatenate((out[:step], later))
        step *= 2
    return out


def states(kinds: np.ndarray) -> np.ndarray:
    """The splitter's state after every character."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, dtype=np.uint8)
    padded[:n] = kinds
    grid = padded.reshape(rows, CHUNK)
    entry = np.zeros(rows, dtype=np.uint8)
    entry[1:] = scan(chunk_maps(grid))[:-1, S0]
    out = np.empty((rows, CHUNK), dtype=np.uint8)
    flat, now = TO.ravel(), entry
    for k in range(CHUNK):
        now = flat[now.astype(np.intp) * 12 + grid[:, k]]
        out[:, k] = now
    return out.ravel()[:n]


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; none does at an end."""
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    state = states(kinds)
    before = np.concatenate((np.array([S0], np.uint8), state[:-1]))
    after = np.concatenate((kinds[1:], np.array([END], np.uint8)))
    after_state = np.concatenate((state[1:], np.array([S0], np.uint8)))
    white = (kinds == SPACE) | (kinds == WHITE)
    letter = (kinds == LETTER) | (kinds >= STMD) & (kinds <= EEE)
    other = (kinds == OTHER) | (kinds == APOSTROPHE)
    ends_white = (after != SPACE) & (after != WHITE) & (after != END)
    out = np.where(white, (before != SS) & (before != SW) | ends_white, True)
    solid = ~white
    out[solid & (before == SS)] = False
    out[(before == SL) & letter] = False
    out[(before == SN) & (kinds == NUMBER)] = False
    out[(before == SP) & other] = False
    first = before == SA
    out[first & other] = False
    out[first & (state == SK)] = False
    half = (state >= SKL) & (state <= SKR)
    out[first & half & (after_state == SKK)] = False
    partial = (before >= SKL) & (before <= SKR)
    out[partial & letter] = False
    out[kinds == END] = False
    return out


class Transducer:
    """Byte-level BPE as a transducer; ``count`` gives the number of tokens of one pre-token."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.token = {bytes([b]): b for b in range(256)}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for a, b in merges:
            at = (self.token[a], self.token[b])
            if a + b not in self.token:
                self.token[a + b] = len(self.halves)
                self.halves.append(at)
                self.pair[at] = self.token[a + b]
        self.grows = {t[:i] for t in self.token for i in range(1, len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        self.step: dict[int, int] = {}  # state and byte -> next state and what the count changes by
        self.what: list[tuple[bytes, tuple[tuple[int, int] | None, ...]]] = [(b"", ((-1, 0),))]
        self.known = {self.what[0]: 0}

    def beside(self, a: int, b: int) -> bool:
        """Whether BPE leaves a, b as they are: undoing merges from the border outwards, latest first, no earlier merge crosses it."""
        most = 1 << 60
        halves, pair = self.halves, self.pair
        while True:
            if pair.get((a, b), most) < most:
                return False
            if a > b:
                most, a = a, halves[a][1]
                if a != most:
                    continue
                most = b + 1
                b = halves[b][0]
                if b + 1 == most:
                    return True
            else:
                most, b = b + 1, halves[b][0]
                if b + 1 != most:
                    continue
                most = a
                a = halves[a][1]
                if a == most:
                    return True

    def compile(self, state: int, byte: int) -> int:
        """A new transition. A state's history holds, for each place in its suffix, the last token there and the count relative to now."""
        suffix, history = self.what[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            t = self.token.get(grown[i:])
            if t is None:
                continue
            last, count = history[i]
            if last == -1 or self.beside(last, t):
                break
        delta = count + 1
        grows = self.grows
        places = [i for i in range(len(grown)) if grown[i:] in grows]  # where a token can still start; other places can't matter again
        cut = places[0]
        past: list[tuple[int, int] | None] = [None] * (len(grown) - cut) + [(t, 0)]
        for i in places:
            last, count = history[i]
            past[i - cut] = (last, count - delta)
        key = (grown[cut:], tuple(past))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.what)
            self.what.append(key)
        out = self.step[state << 8 | byte] = to << 12 | (delta + 2048)
        return out

    def count(self, word: bytes) -> int:
        if len(self.what) > STATES:
            self.clear()
        state = total = 0
        step = self.step
        for byte in word:
            got = step.get(state << 8 | byte)
            if got is None:
                got = self.compile(state, byte)
            state = got >> 12
            total += (got & 4095) - 2048
        return total


def read_vocabulary(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges as bytes, and the strings of special tokens, of a byte-level BPE file."""
    spec = json.loads(Path(path).read_text())
    if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE is compiled")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    merges = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    return [tuple(bytes(byte[c] for c in half) for half in m) for m in merges], [t["content"] for t in spec["added_tokens"]]


class Counter:
    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]):
        self.machine, self.special, self.memo = Transducer(merges), [s.encode() for s in special], {}

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of a block."""
        rows = len(offsets) - 1
        out = np.zeros(rows, dtype=np.int64)
        if not len(data):
            return out
        raw = data.tobytes()
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = classes()[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
        # Rows have to end for the splitter; an end is put between them.
        char_offsets = np.searchsorted(at, offsets)
        for text in self.special:
            i = raw.find(text)
            while i >= 0:
                row = int(np.searchsorted(offsets, i, side="right")) - 1
                if i + len(text) <= offsets[row + 1]:
                    out[row] += 1
                    a = int(np.searchsorted(at, i))
                    kinds[a : a + len(text)] = END
                    i = raw.find(text, i + len(text))
                else:
                    i = raw.find(text, i + 1)
        inner = char_offsets[1:-1]
        begins = np.delete(starts(np.insert(kinds, inner, END)), inner + np.arange(len(inner)))
        first = np.flatnonzero(begins)
        if not len(first):
            return out
        low = at[first]
        # A pre-token ends where the next one starts, its row ends or a special string starts.
        stop = np.flatnonzero(begins | (kinds == END) & np.concatenate(([True], kinds[:-1] != END)))
        high_char = np.concatenate((stop, [len(kinds)]))[np.searchsorted(stop, first, side="right")]
        row = np.searchsorted(offsets, low, side="right") - 1
        high = np.minimum(np.concatenate((at, [len(data)]))[high_char], offsets[row + 1])
        keys = W.range_hash(W.prefix_hash(data), low, high) + (high - low).astype(W.U)
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        memo, machine = self.memo, self.machine
        if len(memo) > KNOWN:
            memo.clear()
        got = np.empty(len(unique), dtype=np.int64)
        for i, (key, a, b) in enumerate(zip(unique.tolist(), low[where].tolist(), high[where].tolist())):
            n = memo.get(key)
            if n is None:
                n = memo[key] = machine.count(raw[a:b])
            got[i] = n
        sums = np.concatenate(([0], np.cumsum(got[back])))
        edge = np.searchsorted(low, offsets)
        return out + sums[edge[1:]] - sums[edge[:-1]]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; ``vocabulary`` is the path of a byte-level BPE file on the driver."""
    merges, special = read_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((merges, special))  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(vocabulary)
        if counter is None:
            _counters.clear()
            counter = _counters[vocabulary] = Counter(*shared.value)
        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            n = np.zeros(batch.num_rows, dtype=np.int64)
            for i, j in W.slices(offsets):
                n[i:j] = counter.counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1]), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
