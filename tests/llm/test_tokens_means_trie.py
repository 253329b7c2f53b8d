"""Token files, sort-means and the conversation trie against the library and brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from folioflow.llm import pfor, queries, sortmeans, trie
from folioflow.llm._store import new_path

WORD = r"[^\x20\x09-\x0D]+"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return pfor.Encoder(pfor.Encoder.checked(open(VOCABULARY, encoding="utf-8").read()))


# --- op11


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 1 << 32])
def test_blocks_round_trip(n, high):
    r = np.random.default_rng(n + high)
    ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[r.random(n) < 0.05] = high - 1
    data, starts = pfor.pack(ids, 0.9)
    assert (pfor.unpack(data, starts[:-1])[:n] == ids).all() and len(starts) == -(-n // pfor.BLOCK) + 1
    file = pfor.Segment(pfor.to_file([1, None, -3], np.array([0, n // 2, n]), ids, 4, 5) + b"\n")
    assert (file.ids() == ids).all() and (file.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    assert file.doc_ids.tolist() == [1, 0, -3] and file.null.tolist() == [False, True, False] and (file.part, file.number) == (4, 5)


def test_width_follows_the_percentile_and_outliers_are_exceptions():
    ids = np.full(pfor.BLOCK, 1000, np.uint32)
    ids[:100] += np.arange(100, dtype=np.uint32) % 16
    ids[5], ids[77] = 40_000_000, 3_000_000
    data, starts = pfor.pack(ids)
    assert data[:4].view("<u4")[0] == 1000 and data[4] == 4 and data[5] == 2  # least id, 4 bits, two exceptions
    assert starts[1] == pfor.HEAD + pfor.BLOCK // 8 * 4 + 2 * 5
    assert pfor.pack(ids, 1.0)[0][5] == 0  # wide enough for all


def test_damaged_files_are_told():
    raw = pfor.to_file([1], np.array([300]), np.arange(300, dtype=np.uint32))
    for bad in (b"", raw[:40], raw[:-5], b"x" + raw[1:], raw[:200] + bytes([raw[200] ^ 1]) + raw[201:]):
        with pytest.raises(ValueError):
            pfor.Segment(bad)


def test_pieces_give_the_library_s_ids(encoder):
    r = random.Random(1)
    some = ["a", "B", "s", "'", "'s", "'re", "t", "1", "23", ",", "!", "é", "é", "́", "Σ", "ς", "İ", "İ", " ", "\n", "\t", " ", "\u0085", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "startoftext", "~", "~~", "ß", "日本", "😀", "‍", "ﬁ", "½", "."]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(6000)] + [None, "", "  "]
    got = [x.tolist() for x in encoder.rows(pa.array(texts))]
    assert got == [x.ids for x in encoder.library.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_of_a_very_long_text(encoder, monkeypatch):
    monkeypatch.setattr(pfor.W, "BLOCK", 1000)
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "it's", "42nd,", "naïve", "x" * 1500, "\n\n"]) for _ in range(3000)), "y" * 9000, "short"]
    assert [x.tolist() for x in encoder.rows(pa.array(texts))] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    small = pfor.Encoder(encoder.library.to_str(), known=2)  # what is held is dropped again and again
    assert [x.tolist() for x in small.rows(pa.array(["a b c", "d e f", "a b c"]))] == [encoder.library.encode(t, add_special_tokens=False).ids for t in ("a b c", "d e f", "a b c")]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        pfor.Encoder.checked(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


TEXTS = [(7, "Seven words are here, aren't there? " * 9), (3, None), (5, ""), (1, "one"), (4, "<|endoftext|> é ß"), (2, "dup"), (2, "dup"), (2, "other dup"), (None, "no id"), (9, "long " * 30_000), (6, " \t")]


@pytest.mark.parametrize("ids", [1, 50, 1 << 20])
def test_token_files(spark, encoder, ids):
    docs = spark.createDataFrame([(*t, "x", 1, 2) for t in TEXTS], "doc_id long, text string, file string, Part int, h int").repartition(5)
    path = new_path(spark, "test-tokens")
    pfor.write_tokens(docs, VOCABULARY, path, ids=ids)
    read = sorted(pfor.read_tokens(spark, path).collect(), key=lambda r: (r["part"], r["number"], r["place"]))
    expect = {(d, t): [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in TEXTS}
    have = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read]
    assert sorted(have, key=repr) == sorted(((d, expect[d, t]) for d, t in TEXTS), key=repr)
    assert [d for d, _ in have] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))  # ascending, null first
    start = 0
    rows = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in pfor.digest(spark, path).collect()), key=lambda r: r[0])
    assert len(rows) == len(have)
    for (at, doc_id, n, crc), (d, x) in zip(rows, have):
        assert (at, doc_id, n, crc) == (start, d, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += n


def test_token_files_of_no_documents(spark):
    path = new_path(spark, "test-tokens")
    pfor.write_tokens(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, path)
    assert pfor.digest(spark, path).collect() == []


def test_op11_against_the_library(spark, encoder, sf):
    start, expect = 0, []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
        ids = [*encoder.library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expect.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op11_patched_frames(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == expect


# --- op12


def means(vectors, k, scale, rounds, seed):
    """Sort-means by brute force in Python's integers."""
    kept = [(i, [max(-(1 << 62), min(1 << 62, math.floor(Fraction(x) * scale))) for x in v]) for i, v in vectors]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    top = (1 << 63) - 1
    at = [near(v) for _, v in kept]
    d = [min(top, far(v, centres[a])) for (_, v), a in zip(kept, at)]
    own = defaultdict(int)
    for a, x in zip(at, d):
        own[a] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, x, min(top, own[a]), min(top, sum(own.values())), sha[a]) for (i, _), a, x in zip(kept, at, d)), key=repr)


def clustered(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, N int, data string")
    out = sortmeans.cluster(df.repartition(3), **more).collect()
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out), key=repr)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e7, 1e17])
def test_sort_means_against_brute_force(spark, size):
    r = random.Random(int(size))
    rows = [(i, [r.gauss(i % 5, 0.7) * size for _ in range(4)]) for i in range(150)]
    rows += [(None, [0.5 * size] * 4), (3, [0.25] * 4), (3, [0.25] * 4), (200, rows[0][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0]), (905, [float("inf")] * 4), (906, [1.0] * 5)]
    assert clustered(spark, rows + bad, k=6, length=4, scale=1024, rounds=4, rows=40) == means(rows, 6, 1024, 4, 3)


def test_sort_means_ties_and_empty_clusters(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(32)]  # every vector twice: equal centroids, equal distances
    assert clustered(spark, grid, k=8, length=2, scale=1, rounds=5, rows=7) == means(grid, 8, 1, 5, 3)
    assert clustered(spark, grid[:3], k=8, length=2, scale=1, rounds=5) == means(grid[:3], 8, 1, 5, 3)  # fewer vectors than centroids
    assert clustered(spark, [], k=8, length=2) == clustered(spark, [(1, [1.0])], k=8, length=2) == []


def test_sort_means_stops_early_and_misses_nothing():
    r = np.random.default_rng(3)
    middles = r.normal(0, 2000, (40, 8)).astype(np.int64)
    rows = (middles[r.integers(0, 40, 3000)] + r.normal(0, 50, (3000, 8))).astype(np.int64)
    d = ((rows[:, None].astype(np.int64) - middles[None]) ** 2).sum(2)
    at, far, taken = sortmeans.assign(rows, np.argmin(d, 1), middles)
    assert (at == np.argmin(d, 1)).all() and (far == d.min(1)).all() and taken < 0.1 * d.size
    at, far, _ = sortmeans.assign(rows, r.integers(0, 40, 3000), middles)  # from anywhere
    assert (at == np.argmin(d, 1)).all() and (far == d.min(1)).all()


# --- op13


def conversation_trie(rows, group=20, hashes=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    members, ends, full = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % hashes
        full[c] = tuple(own.get(c - int(np.fmod(c, group)), [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
        ends[full[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        worth = (len(members[p]) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += worth
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def built(spark, rows, parts=5, **more):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, Node int, words string")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in trie.prefix_trie(df.repartition(parts), **more).collect()), key=repr)


ODD = [(500, None, "user", "null turn first"), (500, 1, None, "b"), (500, 0, "user", None), (501, 3, "a", "tie"), (501, 3, "b", "tie"), (501, 3, "a", "tie"), (None, 1, "user", "no conversation"), (503, 0, "user", "one"), (-7, 0, "user", "one"), (-20, 1, "user", "x y"), (504, None, None, None), (520, 0, "", "w " * 3000)]


def test_trie_against_brute_force(spark):
    r = random.Random(4)
    words = ["hello there", "thanks", "what is  it\n?", "no", ""]
    rows = [(c, t, r.choice(["user", "bot"]), r.choice(words)) for c in range(120) if c % 7 for t in range(r.choice([0, 1, 2, 3, 5, 9]))]
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(4)]  # many copies
    assert built(spark, rows + ODD) == conversation_trie(rows + ODD)


def test_trie_of_very_long_conversations(spark):
    rows = [(c, t, "user", f"turn {t if c != 61 or t < 90 else -t}") for c in (40, 41, 60, 61) for t in range(150)]
    assert built(spark, rows, 3) == conversation_trie(rows)


def test_trie_of_no_conversations(spark):
    assert built(spark, []) == built(spark, [(None, 1, "user", "x")]) == []
    one = [(1, 0, "user", "gone")]  # h of 1 is 3, its base is absent: no turns are left
    assert built(spark, one) == conversation_trie(one) and len(built(spark, one)) == 1


def test_pieces_of_ends_meet_in_order(spark, monkeypatch):
    rows = [(c, 0, "user", "all alike") for c in range(40, 2040, 20)] + [(c, 0, "user", "all alike") for c in range(-400, 0, 20)]
    monkeypatch.setattr(trie, "PIECE", 64)  # in the driver only: workers keep theirs, ranges still cut the group
    assert built(spark, rows, 4) == conversation_trie(rows)


def test_rebuilding_takes_the_head_of_the_group(spark):
    rows = [(20, t, "a", f"base {t}") for t in range(2)] + [(c, t, "b", f"{c} own {t}") for c in range(21, 40) for t in range(5)]
    got, _ = trie.rebuilt(trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    expect = {c: len(([x for x in rows if x[0] == 20])[: zlib.crc32(str(c).encode()) % 4]) + 5 - zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)} | {20: 2}
    assert {r["conv"]: r["depth"] for r in got.collect()} == expect


def test_specification_is_json():
    assert json.loads(pfor.Encoder.checked(open(VOCABULARY, encoding="utf-8").read()))["model"]["type"] == "BPE"


def test_pipeline_leaves_its_result_alone(spark, sf):
    import os

    import corpus_pipeline
    from folioflow.llm._store import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, sf).count()
    left = {x.split("-", 2)[2] for x in set(os.listdir(folder)) - before}
    assert rows > 0 and left == {"pipeline-sharding"}
