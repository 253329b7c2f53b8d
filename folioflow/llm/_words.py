"""Whole texts as flat numpy arrays: words, word hashes and k-word hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes. All hashes are 64 bits and
depend on nothing but the bytes, so every executor finds the same ones. Work goes
in blocks of about ``BLOCK`` bytes, so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64


def _trim() -> None:
    """Gives memory that is free inside this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, that leaves no freed memory behind in the worker: workers wait for the next stage, and what they hold counts against the executor meanwhile."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return tidied


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
with np.errstate(over="ignore"):
    BYTE = _splitmix(np.arange(1, 257, dtype=U))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(16, (n - 1).bit_length())
        have = np.full(m, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if m <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    return _splitmix(x)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences hash any range of ``data``."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes at whatever place."""
    if back is None:
        back = powers(INVERSE, len(sums))
    return (sums[end] - sums[start]) * back[start]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n+1 offsets of rows among the words. Words never cross rows."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One well-mixed hash per word, in blocks of bytes."""
    out = np.empty(len(start), dtype=U)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + BLOCK, side="right")), i + 1)
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = mix(range_hash(prefix_hash(data[a:b]), start[i:j] - a, end[i:j] - a) + (end[i:j] - start[i:j]).astype(U))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from every place; len(words)-k+1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    sums = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(INVERSE, n))


class Texts:
    """A block of rows: bytes, words and word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        self.start, self.end, self.rows = spans(self.data, offsets)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end)


def blocks(column: pa.Array, lower: bool = False, most: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over a whole column."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, most):
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)


def minimizers(keys: np.ndarray, window: int) -> np.ndarray:
    """Places of the least key (leftmost among equals) of every ``window`` consecutive keys, each place once.

    Equal stretches of keys choose equal places, which is what makes them anchors.
    Fewer keys than ``window`` have none.
    """
    n = len(keys)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    places = np.arange(n, dtype=np.int64)
    best, at, width = keys, places, 1
    while 2 * width <= window:
        best, at = _least(best[:-width], at[:-width], best[width:], at[width:])
        width *= 2
    if width < window:
        step = window - width
        best, at = _least(best[:-step], at[:-step], best[step:], at[step:])
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


def _least(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    right = b < a
    return np.where(right, b, a), np.where(right, pb, pa_)
