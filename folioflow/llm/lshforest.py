"""MinHash near-dedup by an LSH forest, links confirmed on full shingle sets.

1. One reading makes each document's shingle set, its size, a digest of it and a signature
   of ``HASHES`` one-byte minimum hashes. Equal sets are one class from here on.
2. Forest: ``TREES`` orders of the signature's places, each sorting all classes. Classes with
   a common prefix of ``DEPTH`` places are a region, and all of a region are candidates of
   each other. Range partitioning deals the orders out evenly whatever their prefixes; a
   class meets ``NEIGHBOURS`` before it there, which settles small regions. Larger ones and
   those on a partition's border are met again: classes outside a region's largest candidate
   group meet the whole region, dealt out in salts. Where more than ``LIMIT`` are outside,
   the region's classes go on to a level of more places and so many more trees that a pair
   at the threshold is as likely to share a region; the level of ``DEEPEST`` places meets in
   full. Candidates whose signatures rule out the threshold are dropped; of the rest a
   spanning forest goes on.
3. Candidate groups are the components of those edges. Inside a group every link counts,
   also between classes that were no neighbours. Groups of more than ``BLOCK`` classes are
   first divided by an exact prefix filter: in any order of all shingles two linked sets
   share one of their first few, and with the rarest first those that only share a common
   template don't. What is left is cut into blocks of ``BLOCK`` classes and each block is
   linked on full sets. In groups of several blocks, one class of each linked part, and then
   all classes outside the largest part, are compared with the other blocks, so that no part
   stays apart for want of a comparison.
4. Components of the confirmed links give component_id.

With ``exact`` the prefix filter takes the place of the forest: all classes are one group,
which costs a shuffle of a fifth of all shingles.

Cases: null, empty and all-white texts have empty sets, n_shingles 0 and no links; fewer
words than a shingle are one shingle; a null doc_id is the largest of its component; rows
sharing a doc_id but not a text are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._anchors import runs
from ._store import fresh, parts, scratch, stored
from .components import components, labels

HASHES = 96
TREES = 12
DEPTH = 2
NEIGHBOURS = 48
LIMIT = 4096
DEEPEST = 8
MISS = 1e-4
BLOCK = 256
COLUMNS = 4096
SKETCH = 1 << 20
SIGMAS = 4.5
NULL_ID = (1 << 63) - 1
U32 = np.uint32
_rng = np.random.Generator(np.random.PCG64(20_240_601))
FLIPS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(U32)
TIMES = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(U32)
ORDERS = np.stack([_rng.permutation(HASHES)[:16] for _ in range(TREES)])


def shingles(texts: W.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a block, row after row, and the rows' offsets among them; repeats stay."""
    words, rows = texts.hashes(), texts.rows
    counts = np.diff(rows)
    grams = W.gram_hashes(words, size)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(number.sum()), dtype=np.uint64)
    edge = np.concatenate(([0], np.cumsum(number)))
    long = np.flatnonzero(counts >= size)
    n = number[long]
    at = np.repeat(rows[:-1][long] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    out[np.repeat(edge[:-1][long] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))] = grams[at]
    for r in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        part = words[rows[r] : rows[r + 1]]
        out[edge[r]] = W.gram_hashes(part, len(part))[0] ^ np.uint64(len(part) << 48 | 0x5BD1)
    return out, edge


def signatures(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One row of HASHES bytes for each non-empty row of shingles."""
    rows = np.flatnonzero(np.diff(edge))
    start = edge[:-1][rows]
    high = (hashes >> np.uint64(32)).astype(U32)
    out = np.empty((len(rows), HASHES), dtype=np.uint8)
    for k in range(HASHES):
        least = np.minimum.reduceat((high ^ FLIPS[k]) * TIMES[k], start)
        out[:, k] = (least * U32(0x9E3779B1)) >> U32(24)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc, text_hash, n, digest, rep, sig) of every document; rep is 64 bits of the digest and stands for the class; digest, rep and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in W.blocks(batch.column("text"), lower=True):
                hashes, edge = shingles(texts, size)
                number, digest = np.zeros(j - i, np.int64), []
                for r in range(j - i):
                    own = np.unique(hashes[edge[r] : edge[r + 1]])
                    number[r] = len(own)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig: list[bytes | None] = [None] * (j - i)
                full = np.flatnonzero(number)
                if len(full):
                    for r, s in zip(full.tolist(), signatures(hashes, edge)):
                        sig[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), batch.column("text_hash").slice(i, j - i), pa.array(number), pa.array(digest, pa.binary()), pa.array([x and int.from_bytes(x[:8], "big", signed=True) for x in digest], pa.int64()), pa.array(sig, pa.binary())], ["doc", "text_hash", "n", "digest", "rep", "sig"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(W.tidy(run), "doc long, text_hash long, n long, digest binary, rep long, sig binary")


def level(depth: int, threshold: float) -> np.ndarray:
    """The orders of the level of ``depth`` places: for more than DEPTH so many that a pair at the threshold shares no region with a chance of MISS at most."""
    if depth == DEPTH:
        return ORDERS
    match, equal = threshold + (1 - threshold) / 256, np.arange(HASHES + 1)
    weight = np.array([math.comb(HASHES, k) * match**k * (1 - match) ** (HASHES - k) for k in range(HASHES + 1)])
    shared = np.prod([np.maximum(equal - i, 0) / (HASHES - i) for i in range(depth)], axis=0)
    some = equal >= _least_equal(threshold)
    trees = TREES
    while (weight * (1 - shared) ** trees)[some].sum() > MISS:
        trees += 1
    rng = np.random.Generator(np.random.PCG64(depth))
    return np.stack([rng.permutation(HASHES)[:16] for _ in range(trees)])


def _least_equal(threshold: float) -> int:
    """Equal places under which signatures rule out the threshold."""
    match = threshold + (1 - threshold) / 256
    return int(np.floor(HASHES * (match - SIGMAS * np.sqrt(match * (1 - match) / HASHES))))


def _ordered(orders: np.ndarray, depth: int):
    """Each class once in each tree: (tree, k1, k2, region, rep, n, sig), k1 and k2 being the first 16 places in the tree's order and region a hash of the tree and the first ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(m, HASHES)
            for tree in range(len(orders)):
                places = np.ascontiguousarray(sig[:, orders[tree]])
                keys = (places ^ np.where(np.arange(16) % 8 == 0, 0x80, 0).astype(np.uint8)).view(">i8").astype(np.int64)
                places[:, depth:] = 0
                head = places.view(np.uint64)
                region = W.mix(W.mix(W.mix(head[:, 0].copy()) + head[:, 1]) + np.uint64(tree)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, tree, np.int32)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(region), batch.column("rep"), batch.column("n"), batch.column("sig")], ["tree", "k1", "k2", "region", "rep", "n", "sig"])

    return run


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal places of pairs of signatures, eight counts in a word."""
    eight = (a == b).view(np.uint64).sum(1)
    return (eight * np.uint64(0x0101010101010101)) >> np.uint64(56)


def _joined(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``tree`` (the least node that each is connected with) after more edges (x, y)."""
    return labels(len(tree), np.concatenate((tree[x], np.arange(len(tree)))), np.concatenate((tree[y], tree)))


def neighbours(threshold: float):
    """Reads classes in a forest's order and gives a spanning forest of the candidates among neighbours, and as (region, null) the regions that neighbours don't settle: those of more than NEIGHBOURS + 1 classes and those at the borders of what was read."""
    least = _least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        length, first = 0, True  # of the region being read
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            now = [batch.column("region").to_numpy(), batch.column("rep").to_numpy(), batch.column("n").to_numpy(), np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(m, HASHES)]
            last = kept[0][-1] if kept is not None else now[0][0]
            edge = np.flatnonzero(np.concatenate((last, now[0][:-1]), axis=None) != now[0])
            closed = np.concatenate((last, now[0][edge[1:] - 1]), axis=None)[: len(edge)]
            sizes = np.diff(edge, prepend=-length)
            open_ = closed[(sizes > NEIGHBOURS + 1) | ((np.arange(len(edge)) == 0) & first)]
            if len(open_):
                yield pa.RecordBatch.from_arrays([pa.array(open_), pa.nulls(len(open_), pa.int64())], ["a", "b"])
            length, first = (m - int(edge[-1]), False) if len(edge) else (length + m, first)
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            old = 0 if kept is None else len(kept[0])
            region, rep, n, sig = now
            found = []
            for o in range(1, min(NEIGHBOURS, len(rep) - 1) + 1):
                a = np.arange(max(o, old), len(rep))
                a = a[region[a] == region[a - o]]
                if not len(a):
                    continue
                b = a - o
                fit = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
                a, b = a[fit], b[fit]
                for s in range(0, len(a), 50_000):
                    x, y = a[s : s + 50_000], b[s : s + 50_000]
                    ok = _equal(sig[x], sig[y]) >= least
                    if ok.any():
                        found.append(np.stack([x[ok], y[ok]]))
            if found:
                x, y = np.concatenate(found, 1)
                root = labels(len(rep), x, y)
                some = np.flatnonzero(root != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]])], ["a", "b"])
            kept = [x[-NEIGHBOURS:] for x in now]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0][-1:]), pa.nulls(1, pa.int64())], ["a", "b"])

    return run


def _met(threshold: float):
    """Rows (h, salt, guest, part, other, rep, n, sig) of regions' salts, residents first: candidates (a, b) between guests and residents of other parts, a spanning forest of them. ``other`` tells residents outside the largest part; they are guests too."""
    least = _least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 4096):
            h, salt, guest, part, other, rep, n = (table.column(c).to_numpy() for c in ("h", "salt", "guest", "part", "other", "rep", "n"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint8).reshape(len(h), HASHES)
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]), [True])))
            out = []
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
                m = int((guest[low:high] == 0).sum())  # residents first, by n
                names, at = np.unique(part[low:high], return_inverse=True)
                own, sizes, marks = at[:m], n[low : low + m], sig[low : low + m]
                tree = np.arange(len(names))
                for g in range(low + m, high, 64):
                    s = np.arange(g, min(g + 64, high))
                    fit = (sizes >= threshold * n[s, None] - 1e-9) & (sizes * threshold <= n[s, None] + 1e-9)
                    fit &= (tree[own] != tree[at[s - low], None]) & ((other[low : low + m] == 0) | (rep[low : low + m] < rep[s, None]))
                    x, y = np.nonzero(fit)
                    for a in range(0, len(x), 50_000):
                        b = slice(a, a + 50_000)
                        ok = _equal(marks[y[b]], sig[s[x[b]]]) >= least
                        tree = _joined(tree, at[s[x[b]][ok] - low], own[y[b]][ok])
                some = np.flatnonzero(tree != np.arange(len(names)))
                out += zip(names[some].tolist(), names[tree[some]].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def _sets(z: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted shingle sets of packed texts."""
    open_ = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    i = 0
    while i < len(z):
        raw, total, j = [], 0, i
        while j < len(z) and (not raw or total < W.BLOCK):
            raw.append(open_.decompress(z[j]))
            total += len(raw[-1])
            j += 1
        hashes, edge = shingles(W.Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower=True), size)
        out += [np.unique(hashes[edge[r] : edge[r + 1]]) for r in range(j - i)]
        i = j
    return out


def _shared(own: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each of the sets ``own`` shares with each of ``others`` (with each other if not given), by matrix products over COLUMNS shingles at a time."""
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    names, code, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    if others is None:
        keep = (often > 1)[code]  # the others are shared with none
        width = int((often > 1).sum())
        left = right = ((np.cumsum(often > 1) - 1)[code[keep]], rows[keep])
        alone = np.diag([len(x) for x in own])
    else:
        sent = np.concatenate(others)
        at = np.minimum(np.searchsorted(names, sent), len(names) - 1)
        keep, width, alone = names[at] == sent, len(names), 0
        left, right = (code, rows), (at[keep], np.repeat(np.arange(len(others)), [len(x) for x in others])[keep])
    sides = []
    for column, row in (left, right):
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order]))
    total = np.zeros((len(own), len(own if others is None else others)), dtype=np.int64)
    for low in range(0, width, COLUMNS):
        parts_, high = [], min(low + COLUMNS, width)
        for (column, row), n in zip(sides, total.shape):
            x, y = np.searchsorted(column, (low, high))
            m = np.zeros((n, high - low), dtype=np.float32)
            m[row[x:y], column[x:y] - low] = 1
            parts_.append(m)
        total += (parts_[0] @ parts_[1].T).astype(np.int64)  # exact: sums of ones, far below 2**24
    if others is None:
        np.fill_diagonal(total, np.diag(alone))
    return total


def _links_between(own: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which of ``own`` are linked with which of ``others``."""
    both = _shared(own, others)
    n = np.array([len(x) for x in own])
    m = n if others is None else np.array([len(x) for x in others])
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (group, block) after another, out of sorted batches."""
    have: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if have and row[:2] != have[0][:2]:
                yield have
                have = []
            have.append(row)
    if have:
        yield have


def _inside(size: int, percent: int):
    """Rows (c, block, node, blocks, z) of blocks to (node, label, c, blocks): label is the least class of the part that it is linked with in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _groups(batches):
            sets = _sets([r[4] for r in rows], size)
            linked = _links_between(sets, None, percent)
            label = np.full(len(rows), -1)  # rows are in order of their nodes, so the first of a part is its least
            for i in range(len(rows)):
                if label[i] < 0:
                    new = np.zeros(len(rows), dtype=bool)
                    new[i] = True
                    while new.any():
                        label[new] = i
                        new = linked[new].any(0) & (label < 0)
            out += [(r[2], rows[label[i]][2], r[0], r[3]) for i, r in enumerate(rows)]
            if len(out) > 10_000:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)

    return run


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["node", "label", "c", "blocks"])


def _across(size: int, percent: int):
    """Rows (c, block, node, part, guest, z), a block's own classes first: links (a, b) between guests and the block's own classes of other parts, one for each pair of parts and guest. A block's own sets are held, and 64 guests at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, sets, guests = None, [], None, []

        def meet() -> list[tuple]:
            nonlocal sets
            if sets is None:
                sets = _sets([r[5] for r in own], size)
            out = []
            linked = _links_between(sets, _sets([r[5] for r in guests], size), percent)
            for k, g in enumerate(guests):
                met = {g[3]}
                for i in np.flatnonzero(linked[:, k]).tolist():
                    if own[i][3] not in met:
                        met.add(own[i][3])
                        out.append((g[2], own[i][2]))
            guests.clear()
            return out

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if guests:
                        found += meet()
                    key, own, sets = row[:2], [], None
                if not row[4]:
                    own.append(row)
                elif own:
                    guests.append(row)
                    if len(guests) == 64:
                        found += meet()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        if guests and (found := meet()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _counted(size: int):
    """Rows (z) to (bucket, n): how many of the sets have a shingle in each of SKETCH buckets, a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            z = batch.column("z").to_pylist()
            for a in range(0, len(z), 256):
                total += np.bincount(np.concatenate([(x & np.uint64(SKETCH - 1)).astype(np.int64) for x in _sets(z[a : a + 256], size)]), minlength=SKETCH)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 100_000]), pa.array(total[some[a : a + 100_000]])], ["bucket", "n"])

    return run


def _prefixes(size: int, percent: int, rarity):
    """Rows (c, node, z) to (c, key, band, node, first): the shingles of each set's prefix in the order of their rarity.

    Two linked sets of sizes x <= y share one of the first x - ceil(2px / (100 + p)) + 1
    shingles of the smaller (``first``) and y - ceil(py / 100) + 1 of the larger. Sizes that
    can be linked are in one band or in neighbouring ones, so each is in its own and the one below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = rarity.value
        for batch in batches:
            c, node, z = (batch.column(x).to_pylist() for x in ("c", "node", "z"))
            for a in range(0, len(z), 256):
                out = []
                for i, s in enumerate(_sets(z[a : a + 256], size), a):
                    n = len(s)
                    own = s[np.lexsort((s, often[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))][: n + percent * -n // 100 + 1].view(np.int64)
                    first = n + 2 * percent * -n // (100 + percent) + 1
                    band = math.floor(math.log(n) / math.log(100 / percent) + 1e-9) if percent < 100 else n
                    m = len(own)
                    out.append((np.full(2 * m, c[i]), np.tile(own, 2), np.repeat([band, band - 1], m), np.full(2 * m, node[i]), np.arange(2 * m) < first))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["c", "key", "band", "node", "first"])

    return run


def prefix_groups(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of the classes among ``rows`` (c, node, z) that an exact prefix filter leaves together with others of their group c. No link is lost by it."""
    spark = rows.sparkSession
    counts = rows.select("z").mapInArrow(W.tidy(_counted(size)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    often = np.zeros(SKETCH, dtype=np.int64)
    often[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    rarity = spark.sparkContext.broadcast(often)
    keys = stored(rows.select("c", "node", "z").mapInArrow(W.tidy(_prefixes(size, percent, rarity)), "c long, key long, band long, node long, first boolean"), "forest-prefixes")
    hubs = stored(keys.groupBy("c", "key", "band").agg(F.min(F.when(F.col("first"), F.col("node"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").drop("n"), "forest-hubs")
    edges = keys.join(hubs.hint("merge"), ["c", "key", "band"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    out = stored(components(edges, "forest-divided"), "forest-divided")
    rarity.unpersist()
    return out


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, offsets = W.buffers(batch.column("text"))
        for i, j in W.slices(offsets, 4 << 20):
            z = [press.compress(data[a:b].tobytes()) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), batch.column("text_hash").slice(i, j - i), pa.array(z, pa.binary())], ["doc", "text_hash", "z"])


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b): spanning forests of candidates in each region of the forest over ``classes`` (rep, n, sig)."""
    spark = classes.sparkSession
    n = parts(spark)
    out = None
    for depth in range(DEPTH, DEEPEST + 1, 2):
        rows = classes.select("rep", "n", "sig").mapInArrow(_ordered(level(depth, threshold), depth), "tree int, k1 long, k2 long, region long, rep long, n long, sig binary")
        dealt = rows.repartitionByRange(n, "tree", "k1", "k2", "rep").sortWithinPartitions("tree", "k1", "k2", "rep")
        found = stored(dealt.mapInArrow(W.tidy(neighbours(threshold)), "a long, b long").distinct(), "forest-found")
        edges = found.where("b is not null")
        out = edges if out is None else out.unionByName(edges)
        # Regions that neighbours didn't settle.
        again = found.where("b is null").select(F.col("a").alias("region"))
        groups = stored(components(out, "forest-near"), "forest-near")
        rows = rows.select("region", "rep", "n", "sig").join(again, "region", "left_semi")
        rows = stored(rows.join(groups.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left").select("region", "rep", "n", "sig", F.coalesce("label", "rep").alias("part")), "forest-regions")
        sizes = rows.groupBy("region", "part").count()
        sizes = sizes.groupBy("region").agg(F.max_by("part", F.struct("count", "part")).alias("top"), F.sum("count").alias("m"), F.max("count").alias("most"))
        sizes = stored(sizes.where("m > most").withColumn("wide", (F.col("m") - F.col("most") > LIMIT) & F.lit(depth + 2 <= DEEPEST)), "forest-sizes")
        here = rows.join(sizes.where("not wide").hint("merge"), "region").withColumn("salts", F.ceil(F.col("m") / F.lit(LIMIT)).cast("int"))
        here = here.withColumn("other", (F.col("part") != F.col("top")).cast("int"))
        own = here.select(F.col("region").alias("h"), F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("guest"), "part", "other", "rep", "n", "sig")
        sent = here.where("other = 1").select(F.col("region").alias("h"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("guest"), "part", "other", "rep", "n", "sig")
        met = own.unionByName(sent).repartition(n, "h", "salt").sortWithinPartitions("h", "salt", "guest", "n", "rep")
        out = out.unionByName(stored(met.mapInArrow(W.tidy(_met(threshold)), "a long, b long"), "forest-met"))
        if not sizes.where("wide").head(1):
            break
        classes = stored(rows.join(sizes.where("wide").select("region").hint("merge"), "region", "left_semi").select("rep", "n", "sig").dropDuplicates(["rep"]), "forest-wide")
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (node, c) with the number of blocks of the group."""
    blocks = stored(groups.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), "forest-blocks")
    return groups.join(blocks.hint("merge"), "c")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, exact: bool = False) -> DataFrame:
    """Confirmed links (a, b) between classes that join whatever is linked."""
    n = parts(docs.sparkSession)
    if exact:
        groups = classes.select(F.col("rep").alias("node"), F.lit(0).cast("long").alias("c"), F.lit(2).cast("long").alias("blocks"))
    else:
        with scratch(docs.sparkSession):
            groups = stored(components(candidate_edges(classes, percent / 100), "forest"), "forest-groups", keep=True)
        groups = _blocks(groups.withColumnRenamed("label", "c"))
    # A class's text is that of its least row.
    members = groups.join(classes.select(F.col("rep").alias("node"), "doc", "text_hash"), "node")
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(W.tidy(_pressed), "doc long, text_hash long, z binary")
    texts = texts.groupBy("doc", "text_hash").agg(F.first("z").alias("z"))  # rows equal in doc_id and text; dealt as the join wants them
    members = stored(members.join(texts.hint("merge"), ["doc", "text_hash"]).select("node", "c", "blocks", "z"), "forest-members")
    wide = members.where("blocks > 1")
    if wide.head(1):
        parted = _blocks(prefix_groups(wide, size, percent).withColumnRenamed("label", "c"))
        members = stored(members.where("blocks = 1").unionByName(wide.select("node", "z").join(parted.hint("merge"), "node").select(*members.columns)), "forest-divided")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("c", "block", "node", "blocks", "z")
    dealt = members.repartition(n, "c", "block").sortWithinPartitions("c", "block", "node")
    local = stored(dealt.mapInArrow(W.tidy(_inside(size, percent)), "node long, label long, c long, blocks long"), "forest-parts")
    out = local.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    if not local.where("blocks > 1").head(1):
        return out

    def compare(part: DataFrame, guests: DataFrame) -> DataFrame:
        """``part`` (node, part) of all classes; guests (node) go to all other blocks of their group."""
        own = members.where("blocks > 1").join(part.hint("merge"), "node")
        here = own.select("c", "block", "node", "part", F.lit(0).alias("guest"), "z")
        sent = own.join(guests.hint("merge"), "node", "left_semi").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"), "block", "node", "part", F.lit(1).alias("guest"), "z").where("to <> block")
        rows = here.unionByName(sent.select("c", F.col("to").alias("block"), "node", "part", "guest", "z"))
        return stored(rows.repartition(n, "c", "block").sortWithinPartitions("c", "block", "guest", "node").mapInArrow(W.tidy(_across(size, percent)), "a long, b long"), "forest-across")

    many = local.where("blocks > 1")
    first = compare(many.select("node", F.col("label").alias("part")), many.where("node = label").select("node"))
    out = stored(out.unionByName(first), "forest-links")
    merged = many.select("node", "c").join(components(out, "forest-parts").hint("merge"), "node", "left").select("node", "c", F.coalesce("label", "node").alias("part"))
    merged = stored(merged, "forest-merged")
    sizes = merged.groupBy("c", "part").count()
    largest = sizes.groupBy("c").agg(F.max_by("part", F.struct("count", "part")).alias("top"), F.count("*").alias("n")).where("n > 1")
    rest = merged.join(largest.hint("merge"), "c").where("part <> top").select("node").join(many.where("node = label").select("node"), "node", "left_anti")
    second = compare(merged.select("node", "part"), rest)
    return out.unionByName(second)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (Spark's xxhash64) of every document: documents are linked where 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles; component_id is the least doc_id reachable, and kept tells whether it is the document's own."""
    sketch = stored(sketches(docs, size), "forest-sketches")
    classes = sketch.where("n > 0").groupBy("digest", "rep").agg(F.min(F.struct("doc", "text_hash")).alias("r"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.select("digest", "rep", "r.doc", "r.text_hash", "n", "sig"), "forest-classes")
    with scratch(docs.sparkSession):
        joined = components(links(docs, classes, size, percent, exact), "links").select(F.col("node").alias("rep"), "label")
        joined = stored(joined.join(classes.select("rep", "doc"), "rep"), "forest-joined", keep=True)
    least = stored(joined.groupBy("label").agg(F.min("doc").alias("least")), "forest-least")
    joined = joined.join(least, "label").select("rep", "least")
    reps = classes.select("digest", "rep", "doc").join(joined, "rep", "left").select("digest", F.coalesce("least", "doc").alias("component"))
    out = sketch.select("doc", "n", "digest", "text_hash").join(reps.hint("merge"), "digest", "left")
    doc, component = F.when(F.col("doc") != NULL_ID, F.col("doc")), F.coalesce("component", "doc")
    return out.select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"), (F.col("doc") == component).alias("kept"), "text_hash")


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the least doc_id. Of rows equal in doc_id and text one stays."""
    doc, text_hash = fresh(docs, "forest_doc", "forest_hash")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    found = stored(near_duplicates(docs, size, percent).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(doc), F.col("text_hash").alias(text_hash), "kept"), "forest-kept")
    gone = found.where("not kept").select(doc, text_hash).distinct()
    rows = docs.join(gone, same, "left_anti")
    twice = stored(found.where("kept").groupBy(doc, text_hash).count().where("count > 1").select(doc, text_hash), "forest-twice")
    if not twice.head(1):
        return rows
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
