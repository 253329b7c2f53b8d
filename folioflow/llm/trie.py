"""A prefix trie of conversations, rolled up by pointer jumping.

Texts are looked at once: each turn becomes a 128-bit digest of its role and text and its
number of words, and only these travel. Turns are dealt to partitions by ranges of
(conv_id, turn, digest), so one very long conversation lies on many; places inside it come
from windows inside a partition and from sums of what lies in partitions before.

A rebuilt conversation is the head of another one and the rest of its own (``rebuilt``). A
prefix is keyed by its depth and the sum of 160-bit hashes of (place, digest) over its
turns: a sum that grows by one window, so that a conversation's prefixes are not chained one
after another. Nodes are these keys, grouped.

The rollup keeps, for every node, an edge to an ancestor and sums over the part of its
subtree that it has seen. A round adds each node's sums to its ancestor's, grouped by that
ancestor, and replaces the edge by the ancestor's own edge. After k rounds a node has seen
2**k levels and its edge skips as many, so rounds follow the logarithm of the depth. Only
nodes deeper than an edge is long still take part. Popular ancestors are pre-aggregated by
the grouping, and are a skewed join key that Spark splits when it follows edges.

The digest of the conversations that end at a node needs them in order in one SHA-256. They
are sorted by ranges, joined into texts inside partitions, and only these texts, in order,
meet in one task a node, which streams them.

Turns: null role or text is empty; a null turn comes first; equal turns of a conversation go
by their digest. Repeated rows are turns like others. Rows with a null conv_id belong to no
conversation. A conversation whose rebuilt form has no turns is a member of the root alone.
An empty table gives no rows. Other columns are not looked at. Keys could collide with a
chance of about n**2 / 2**128 for n prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop_paths, scratch, stored

LIMBS = 4
WORD = r"[^\x20\x09-\x0D]+"
PIECE = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, words, pos, total): ``pos`` from 1, ``total`` the conversation's turns; stored."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"))
    rows = stored(rows, "trie-turns")  # the texts are read once, not again for the ranges
    dealt = stored(rows.repartitionByRange("conv", "turn", "digest").withColumn("part", F.spark_partition_id()), "trie-dealt")
    inside = F.row_number().over(Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return stored(_behind(dealt.withColumn("at", inside), dealt, {"n": F.count("*")}).select("conv", "turn", "digest", "words", "part", (F.col("at") + F.col("n_before")).alias("pos"), F.col("n_all").alias("total")), "trie-places")


def _behind(rows: DataFrame, counted: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (part, conv, ...) with each sum's value over the conversation's earlier partitions (``x_before``) and over all of them (``x_all``)."""
    each = counted.groupBy("part", "conv").agg(*[f.alias(x) for x, f in sums.items()])
    w = Window.partitionBy("conv")
    earlier = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", "conv", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in sums], *[F.sum(x).over(w).alias(f"{x}_all") for x in sums])
    return rows.join(each, ["part", "conv"])


def limbs(place: Column, digest: Column) -> list[Column]:
    """Hashes of 40 bits, whose sums over any conversation stay in a long."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(i), place, digest), 24) for i in range(LIMBS)]


def key(depth: Column, sums: list[Column], u: str = "u", v: str = "v") -> list[Column]:
    """A prefix's key: 128 bits in two columns."""
    return [F.xxhash64(F.lit(i), depth, *sums).alias(c) for i, c in enumerate((u, v))]


def _added(hashes: Column | str, limb: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + x[limb])


def rebuilt(places: DataFrame, group: int = 20, hashes: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (convs, rows), both stored.

    convs: conv, depth (its turns) and its last prefix's key u, v. rows: one a prefix, conv,
    depth, key u, v, its parent's key pu, pv, and words (of the last text). Conversation c takes the first h
    turns of c - c % group, h being crc32(c) % hashes, then its own after its first h.
    """
    heads_of = places.where((F.col("pos") < hashes) & (F.col("conv") % group == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("heads"))  # under ``hashes`` turns each
    conv = F.col("conv")
    h = F.pmod(F.crc32(F.encode(conv.cast("string"), "UTF-8")), F.lit(hashes))
    every = places.groupBy("conv").agg(F.max("total").alias("own"))
    none = F.expr("cast(array() as array<struct<pos: bigint, digest: binary, words: bigint>>)")
    convs = every.withColumn("base", conv - conv % group).withColumn("h", h).join(heads_of, "base", "left")
    convs = convs.select("conv", "own", "h", F.slice(F.coalesce(F.col("heads").cast("array<struct<pos: bigint, digest: binary, words: bigint>>"), none), F.lit(1), F.col("h").cast("int")).alias("heads"))
    hashed = F.transform("heads", lambda x, i: F.array(*limbs((i + 1).cast("long"), x["digest"])))
    convs = convs.withColumn("g", hashed).withColumn("m", F.size("heads").cast("long"))
    sums = [_added("g", i) for i in range(LIMBS)]
    convs = stored(convs.select("conv", "own", "h", "heads", "g", "m", *[s.alias(f"s{i}") for i, s in enumerate(sums)]), "trie-convs")

    # Own turns after the first h: their place in the rebuilt conversation and the sums up to it.
    depth = F.col("m") + F.col("pos") - F.col("h")
    own = places.select("conv", "turn", "digest", "words", "part", "pos").join(convs.select("conv", "h", "m", *[f"s{i}" for i in range(LIMBS)]), "conv").where(F.col("pos") > F.col("h"))
    own = stored(own.select("conv", "pos", "words", "part", depth.alias("depth"), *[x.alias(f"g{i}") for i, x in enumerate(limbs(depth, F.col("digest")))], *[f"s{i}" for i in range(LIMBS)]), "trie-own")
    w = Window.partitionBy("part", "conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = own.select("*", *[F.sum(f"g{i}").over(w).alias(f"r{i}") for i in range(LIMBS)])
    running = _behind(running, own, {f"t{i}": F.sum(f"g{i}") for i in range(LIMBS)})
    upto = [F.col(f"s{i}") + F.col(f"r{i}") + F.col(f"t{i}_before") for i in range(LIMBS)]
    before = [u - F.col(f"g{i}") for i, u in enumerate(upto)]
    tail = running.select("conv", "depth", *key(F.col("depth"), upto), *key(F.col("depth") - 1, before, "pu", "pv"), "words")

    # The heads, at most hashes - 1 a conversation.
    head = convs.where("m > 0").select("conv", "g", F.posexplode("heads").alias("i", "x"))
    i = F.col("i")
    head = head.select("conv", (i + 1).cast("long").alias("depth"), *key((i + 1).cast("long"), [_added(F.slice("g", 1, i + 1), k) for k in range(LIMBS)]), *key(i.cast("long"), [_added(F.slice("g", 1, i), k) for k in range(LIMBS)], "pu", "pv"), F.col("x.words").alias("words"))
    rows = stored(tail.unionByName(head), "trie-rows")

    full = F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))
    zero = [F.lit(0).cast("long")] * LIMBS
    ends = rows.select("conv", "depth", "u", "v").join(convs.select("conv", full.alias("depth")), ["conv", "depth"])
    bare = convs.where(full == 0).select("conv", F.lit(0).cast("long").alias("depth"), *key(F.lit(0).cast("long"), zero))
    return stored(ends.unionByName(bare), "trie-ends"), rows


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v, pu, pv, depth, conv_id, n_convs, words) of every node, the root too; stored."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    found = rows.groupBy("u", "v").agg(*[F.min(c).alias(c) for c in ("pu", "pv", "depth")], F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*key(zero, [zero] * LIMBS), none.alias("pu"), none.alias("pv"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"))
    return stored(found.unionByName(root), "trie-nodes")


def rollup(edges: DataFrame, *sums: str) -> DataFrame:
    """(u, v, *sums): each sum over the subtree of the node u, v, itself included. ``edges``: u, v, the parent's pu, pv (null at roots), depth and the nodes' own values; stored."""
    spark = edges.sparkSession
    total, jump = edges.select("u", "v", *sums), edges.where("pu is not null").select("u", "v", "pu", "pv")
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    k = 0
    while 1 << k <= deepest:
        got = jump.join(total, ["u", "v"]).groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(*[F.sum(s).alias(f"{s}_more") for s in sums])
        after = total.join(got, ["u", "v"], "left").select("u", "v", *[(F.col(s) + F.coalesce(f"{s}_more", F.lit(0))).alias(s) for s in sums])
        after = stored(after, f"trie-sums-{k}")
        if 2 << k <= deepest:
            # The ancestor's own edge; who has none stands less than twice as deep and is done.
            ahead = stored(jump.join(jump.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv")), ["pu", "pv"]).select("u", "v", F.col("qu").alias("pu"), F.col("qv").alias("pv")), f"trie-edges-{k}")
            if k:
                drop_paths(spark, jump)
            jump = ahead
        if k:
            drop_paths(spark, total)
        total, k = after, k + 1
    return total


def end_digests(convs: DataFrame) -> DataFrame:
    """(u, v, ends_sha256) of the nodes at which conversations end."""
    schema = "u long, v long, first long, piece string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["u", "v", "first", "piece"])

        for batch in batches:
            out = []
            for u, v, conv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "conv"))):
                if now != (u, v) or size >= PIECE:
                    if ids:
                        out.append(piece())
                    now, ids, size = (u, v), [], 0
                ids.append(conv)
                size += 8
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for u, v, text in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "piece"))):
                if now == (u, v):
                    sha.update(b",")
                else:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (u, v), hashlib.sha256()
                sha.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["u", "v", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], ["u", "v", "ends_sha256"])

    pieces = stored(convs.select("u", "v", "conv").repartitionByRange("u", "v", "conv").sortWithinPartitions("u", "v", "conv").mapInArrow(join, schema), "trie-pieces")
    return pieces.repartition("u", "v").sortWithinPartitions("u", "v", "first").mapInArrow(digest, "u long, v long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, hashes: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of ``conversations`` (conv_id, turn, role, text)."""
    with scratch(conversations.sparkSession):
        convs, rows = rebuilt(turns(conversations), group, hashes)
        found = nodes(convs, rows)
        children = found.where("pu is not null").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.count("*").alias("n_children"))
        found = stored(found.join(children, ["u", "v"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
        edges = found.select("u", "v", "pu", "pv", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
        sums = rollup(edges, "n_leaves", "saved_tokens")
        ends = stored(end_digests(convs), "trie-digests")
        above = found.select(F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("conv_id").alias("parent_conv_id"))
        out = found.join(above, ["pu", "pv"], "left").join(sums, ["u", "v"]).join(ends, ["u", "v"], "left")
        none = hashlib.sha256(b"").hexdigest()
        out = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
        return stored(out, "trie-out", keep=True)
