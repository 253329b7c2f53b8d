"""K-d tree partitioning with DataFrame operations only.

The tree's cells are split level by level. Each level measures every cell's dimensions,
takes the widest one (its range in the cell against its range in the table), and cuts at
the weighted median: bytes per bucket are counted distributedly, the bucket that holds the
middle is counted again in finer buckets until it is one value, and the cut goes to the
side of that value where the halves are most even.

A tree of a few levels (``leaves``) keeps its cells on the driver: at most ``BUCKETS`` rows
a cell and round, whatever the number of documents, and cuts as CASE expressions. A tree
whose leaves have at most the target bytes (``leaves_of_bytes``) has as many cells as the
data need; its cells, cuts and bucket counts are tables that rows are joined with, nothing
of it reaches the driver but whether cells are left to split.

The dimensions are the text's bytes, whole-number metadata columns that
the caller names (null counts as -1) and, so that ties can be told apart, a hash of the
text. Equal texts stay together whatever their metadata say: all copies of a text take the
least value that one of them has of a named column (``of_groups``). Only a group of copies
that alone outweighs ``SPLIT`` of a shard is divided, by a hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import parts, scratch, stored

BUCKETS = 1024
SPLIT = 0.05
FEW = 64  # shards of a tree whose cells are kept on the driver
NULL_ID = -(1 << 63)


def measured(docs: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, d0, d1, d2, m0, m1, ...): sizes and dimensions, no texts. d0 is the size, d1 a hash of the text, d2 one of doc_id, m0 and so on the named columns."""
    text = F.col("text")
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    size = F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(raw).alias("text_crc32"),
        size.alias("d0"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 24).alias("d1"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.lit(17)), 24).alias("d2"),
        *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-1)).alias(f"m{i}") for i, c in enumerate(dimensions)],
    )


def of_groups(meta: DataFrame) -> DataFrame:
    """``meta``, stored, with each named column's least value among the rows of equal size and text hashes."""
    named = [c for c in meta.columns if c[0] == "m" and c[1:].isdigit()]
    if not named:
        return meta
    keys = ["d1", "size", "text_crc32"]
    least = stored(meta.groupBy(*keys).agg(*[F.min(c).alias(c) for c in named]), "kdtree-least")
    return stored(meta.drop(*named).join(least.hint("merge"), keys).select(*meta.columns), "kdtree-alike")


def _case(pairs: list[tuple[int, Column]], key: Column, other: Column) -> Column:
    out = None
    for value, then in pairs:
        out = F.when(key == value, then) if out is None else out.when(key == value, then)
    return other if out is None else out.otherwise(other)


class _Cut:
    """The weighted median of one cell, found by narrowing [low, high] in a dimension. ``below``: the bytes under low."""

    def __init__(self, dim: str, low: int, high: int, total: int, goal: float):
        self.dim, self.low, self.high, self.below, self.total, self.goal = dim, low, high, 0, total, goal
        self.at: int | None = None  # rows with values under it go left: so many bytes
        self.left = self.heavy = 0  # heavy: the bytes of the value that holds the middle

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BUCKETS))

    def narrow(self, counts: dict[int, int]) -> None:
        width, below = self.width, self.below
        for bucket in sorted(counts):
            if below + counts[bucket] >= self.goal or bucket == max(counts):
                low, size = self.low + bucket * width, counts[bucket]
                if width == 1:
                    after = abs(below + size - self.goal) < abs(below - self.goal)
                    self.low, self.heavy, self.below = low, size, below
                    self.at, self.left = low + after, below + size * after
                else:
                    self.low, self.high, self.below = low, min(self.high, low + width - 1), below
                return
            below += counts[bucket]


def _cuts(rows: DataFrame, cells: dict[int, _Cut]) -> None:
    """Narrows all cuts of a level together until each is a value."""
    while open_ := {c: x for c, x in cells.items() if x.at is None}:
        cell = F.col("cell")
        value = _case([(c, F.col(x.dim)) for c, x in open_.items()], cell, F.lit(None))
        low, high, width = (_case([(c, F.lit(getattr(x, k))) for c, x in open_.items()], cell, F.lit(None)) for k in ("low", "high", "width"))
        found = rows.withColumn("v", value).where((F.col("v") >= low) & (F.col("v") <= high))
        found = found.groupBy("cell", F.call_function("div", F.col("v") - low, width).alias("bucket"))
        counts: dict[int, dict[int, int]] = {c: {} for c in open_}
        for r in found.agg(F.sum("size").alias("n")).collect():  # at most BUCKETS rows a cell
            counts[r["cell"]][r["bucket"]] = r["n"]
        for c, x in open_.items():
            x.narrow(counts[c])


def leaves(meta: DataFrame, levels: int, split: float = SPLIT) -> DataFrame:
    """``meta`` with ``shard``: the leaf that each row falls in, of a tree of ``levels`` levels."""
    extra = [c for c in meta.columns if c[0] == "m" and c[1:].isdigit()]
    dims = ["d0", *extra, "d1"]
    rows = meta.withColumn("cell", F.lit(1).cast("long"))  # the root; the halves of cell c are 2c and 2c + 1
    spans: dict[str, int] = {}
    for level in range(levels + 1):
        shape = rows.groupBy("cell").agg(F.sum("size").alias("n"), *[f(d).alias(f"{k}{d}") for d in (*dims, "d2") for k, f in (("lo", F.min), ("hi", F.max))]).collect()  # a row a cell
        if not shape or level == levels:
            break
        if not level:
            spans = {d: max(1, shape[0][f"hi{d}"] - shape[0][f"lo{d}"]) for d in dims}
        leaf = sum(r["n"] for r in shape) / 2**levels
        wide = {r["cell"]: r for r in shape}
        cells = {}
        for c, r in wide.items():
            dim = max(spans, key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / spans[d])
            cells[c] = _Cut(dim, r[f"lo{dim}"], r[f"hi{dim}"], r["n"], r["n"] / 2)
        _cuts(rows, cells)
        uneven = {c: _Cut("d1", wide[c]["lod1"], wide[c]["hid1"], wide[c]["n"], x.goal) for c, x in cells.items() if abs(x.left - x.goal) > split * x.goal / 2 and x.dim != "d1"}
        if uneven:  # many equal values of the dimension: the text's hash tells all but copies apart
            _cuts(rows, uneven)
            cells |= uneven
        go_left = []
        for c, x in cells.items():
            side = F.col(x.dim) < F.lit(x.at)
            if x.dim == "d1" and x.heavy > split * leaf and abs(x.left - x.goal) > split * leaf / 2:
                side = _divided(rows, c, x)
            go_left.append((c, side))
        rows = rows.withColumn("cell", _case([(c, F.when(side, 2 * c).otherwise(2 * c + 1).cast("long")) for c, side in go_left], F.col("cell"), F.col("cell")))
    # Leaves in the order of the tree, from the left.
    found = sorted((r["cell"] for r in shape), key=lambda c: bin(c)[3:])
    return rows.withColumn("shard", _case([(c, F.lit(i)) for i, c in enumerate(found)], F.col("cell"), F.lit(0)).cast("int")).drop("cell")


def _narrowed(rows: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
    """``cuts`` (cell, low, high, goal), whose rows (cell, v, size) are cut, as (cell, goal, at, left, heavy, value): values under ``at`` go left, ``left`` bytes of them; ``value`` holds the middle and has ``heavy`` bytes.

    Each round counts the bytes of at most ``BUCKETS`` buckets a cell and keeps the bucket
    that holds the middle, so rounds follow the logarithm of the widest range.
    """
    now = stored(cuts.select("cell", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("goal").cast("double").alias("goal"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("heavy")), f"{name}-0")
    width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("high") - F.col("low") + 1) / F.lit(BUCKETS)))
    for k in range(1, 9):  # 64 bits are eight rounds at most
        open_ = now.withColumn("width", width)
        counts = rows.join(open_.select("cell", "low", "high", "width"), "cell").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        counts = counts.groupBy("cell", F.call_function("div", F.col("v") - F.col("low"), F.col("width")).alias("bucket")).agg(F.sum("size").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("upto", upto).join(open_.select("cell", "goal", "below"), "cell")
        # The first bucket that reaches the goal, or the last one.
        reach = F.struct((F.col("below") + F.col("upto") < F.col("goal")).alias("short"), F.when(F.col("below") + F.col("upto") < F.col("goal"), -F.col("bucket")).otherwise(F.col("bucket")).alias("b"))
        best = counts.groupBy("cell").agg(F.min_by(F.struct("bucket", "m", "upto"), reach).alias("x"))
        new = open_.join(best, "cell").select(
            "cell", (F.col("low") + F.col("x.bucket") * F.col("width")).alias("low"), F.least("high", F.col("low") + (F.col("x.bucket") + 1) * F.col("width") - 1).alias("high"), "goal", (F.col("below") + F.col("x.upto") - F.col("x.m")).alias("below"), F.col("x.m").alias("heavy")
        )
        now = stored(new, f"{name}-{k}")
        if not now.where("high > low").head(1):
            break
    after = F.abs(F.col("below") + F.col("heavy") - F.col("goal")) < F.abs(F.col("below") - F.col("goal"))
    return now.select("cell", "goal", (F.col("low") + after.cast("long")).alias("at"), (F.col("below") + F.when(after, F.col("heavy")).otherwise(0)).alias("left"), "heavy", F.col("low").alias("value"), "below")


def leaves_of_bytes(meta: DataFrame, target: int, split: float = SPLIT) -> DataFrame:
    """``meta`` with ``shard``: the leaf that each row falls in, of a tree whose leaves have at most ``target`` bytes where rows can be told apart. Rows, cells and cuts are tables, stored level by level."""
    extra = [c for c in meta.columns if c[0] == "m" and c[1:].isdigit()]
    dims = ["d0", *extra, "d1"]
    rows = meta.withColumn("cell", F.lit(1).cast("long")).withColumn("over", F.lit(True))
    spans, before, depth = None, None, 0
    while True:
        shape = rows.where("over").groupBy("cell").agg(F.sum("size").alias("n"), *[f(d).alias(f"{k}{d}") for d in (*dims, "d2") for k, f in (("lo", F.min), ("hi", F.max))])
        if before is not None:  # a cell of all its parent's bytes could not be divided
            shape = shape.withColumn("up", F.call_function("div", F.col("cell"), F.lit(2))).join(before, "up").where("n < n_up").drop("up", "n_up")
        wide = stored(shape.where(F.col("n") > target), f"kdtree-cells-{depth}")
        if not wide.head(1):
            break
        if spans is None:
            root = wide.first()
            spans = {d: max(1, root[f"hi{d}"] - root[f"lo{d}"]) for d in dims}
        k = F.ceil(F.col("n") / target)
        ranges = F.array(*[(F.col(f"hi{d}") - F.col(f"lo{d}")) / spans[d] for d in dims])
        wide = wide.withColumn("dim", (F.array_position(ranges, F.array_max(ranges)) - 1).cast("int")).withColumn("goal", F.col("n") * F.floor(k / 2) / k)
        pick = lambda p: F.get(F.array(*[F.col(f"{p}{d}") for d in dims]), F.col("dim"))
        inside = rows.join(wide.select("cell", "dim"), "cell")
        first = stored(_narrowed(inside.select("cell", F.get(F.array(*dims), F.col("dim")).alias("v"), "size"), wide.select("cell", pick("lo").alias("low"), pick("hi").alias("high"), "goal"), f"kdtree-cut-{depth}").join(wide.select("cell", "dim", "lod1", "hid1", "lod2", "hid2"), "cell"), f"kdtree-first-{depth}")
        last = len(dims) - 1
        uneven = (F.abs(F.col("left") - F.col("goal")) > split * F.col("goal") / 2) & (F.col("dim") != last)
        again = first.where(uneven)
        cuts = first.where(~uneven)
        if again.head(1):  # many equal values of the dimension: the text's hash tells all but copies apart
            second = _narrowed(rows.select("cell", F.col("d1").alias("v"), "size"), again.select("cell", F.col("lod1").alias("low"), F.col("hid1").alias("high"), "goal"), f"kdtree-even-{depth}")
            cuts = cuts.unionByName(second.join(again.select("cell", "lod1", "hid1", "lod2", "hid2"), "cell").withColumn("dim", F.lit(last)))
        cuts = stored(cuts.select("cell", "dim", "at", "goal", "below", "value", "lod2", "hid2", ((F.col("dim") == last) & (F.col("heavy") > split * target) & (F.abs(F.col("left") - F.col("goal")) > split * target / 2)).alias("heavy")), f"kdtree-cuts-{depth}")
        inner = cuts.where("heavy")
        if inner.head(1):  # one group of copies holds the middle: it is cut by doc_id's hash
            copies = rows.join(inner.select("cell", "value"), "cell").where(F.col("d1") == F.col("value"))
            third = _narrowed(copies.select("cell", F.col("d2").alias("v"), "size"), inner.select("cell", F.col("lod2").alias("low"), F.col("hid2").alias("high"), F.greatest(F.lit(0.0), F.col("goal") - F.col("below")).alias("goal")), f"kdtree-copies-{depth}")
            cuts = cuts.join(third.select("cell", F.col("at").alias("at2")), "cell", "left")
        else:
            cuts = cuts.withColumn("at2", F.lit(None).cast("long"))
        v = F.get(F.array(*dims), F.col("dim"))
        left = F.when(F.col("heavy"), (F.col("d1") < F.col("value")) | (F.col("d1") == F.col("value")) & (F.col("d2") < F.col("at2"))).otherwise(v < F.col("at"))
        moved = rows.join(cuts.select("cell", "dim", "at", "value", "heavy", "at2"), "cell", "left")
        cell = F.when(F.col("dim").isNull(), F.col("cell")).when(left, 2 * F.col("cell")).otherwise(2 * F.col("cell") + 1)
        rows = stored(moved.select(*meta.columns, cell.alias("cell"), F.col("dim").isNotNull().alias("over")), f"kdtree-rows-{depth}")
        before = wide.select(F.col("cell").alias("up"), F.col("n").alias("n_up"))
        depth += 1
    # Leaves in the order of the tree, from the left: paths are filled up to the tree's depth. In one place there is a row a leaf.
    level = F.floor(F.log2(F.col("cell").cast("double"))).cast("int")
    found = rows.select("cell").distinct().withColumn("order", F.call_function("shiftleft", F.col("cell"), F.lit(depth) - level))
    found = stored(found.select("cell", (F.row_number().over(Window.orderBy("order")) - 1).alias("shard")), "kdtree-order")
    return rows.join(found, "cell").select(*meta.columns, "shard")


def _divided(rows: DataFrame, cell: int, cut: _Cut) -> Column:
    """The side of rows where one group of copies holds the middle: the group is cut by doc_id's hash."""
    mine = F.col("d1") == F.lit(cut.low)
    inside = rows.where((F.col("cell") == cell) & mine)
    r = inside.agg(F.sum("size").alias("n"), F.min("d2").alias("lo"), F.max("d2").alias("hi")).first()
    inner = {cell: _Cut("d2", r["lo"], r["hi"], r["n"], max(0, cut.goal - cut.below))}
    _cuts(inside, inner)
    return (F.col("d1") < F.lit(cut.low)) | mine & (F.col("d2") < F.lit(inner[cell].at))


def with_slots(rows: DataFrame, per_bucket: int = 50_000, piece: int = 50_000) -> DataFrame:
    """Adds ``slot``: 0, 1, ... in each shard. Equal rows (doc_id, text_crc32, size) are counted first and numbered together, different ones inside hash buckets whose counts are summed up, so neither a shard nor a group of equal rows is numbered in one task."""
    keys = ["shard", "doc_id", "text_crc32", "size"]
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")), "kdtree-groups")
    total, most = groups.agg(F.count("*"), F.max("n")).first()
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), "text_crc32"), F.lit(max(8, -(-total // per_bucket)))).cast("int")
    groups = groups.withColumn("b", bucket)
    before = F.sum("m").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.groupBy("shard", "b").agg(F.sum("n").alias("m")).select("shard", "b", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1))
    out = groups.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets.hint("merge"), ["shard", "b"]).withColumn("first", F.col("before") + F.col("inside"))
    zero = F.lit(0).cast("long")
    if (most or 0) > piece:  # large groups are dealt out in pieces before their rows are listed
        out = out.withColumn("skip", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(piece).cast("long"))))
        out = out.withColumn("first", F.col("first") + F.col("skip")).withColumn("n", F.least(F.lit(piece), F.col("n") - F.col("skip"))).repartition(parts(rows.sparkSession), "shard", "first")
    return out.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).select(*rows.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = 8, split: float = SPLIT, target_bytes: int | None = None, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, ``shards`` being a power of two.

    With ``target_bytes`` there are as many shards as leaves of at most so many bytes need,
    whatever ``shards`` says. ``dimensions`` names metadata columns that cells may be cut along.

    Law ``bytes``: the shards' sizes are near equal. Equal texts share a shard unless their
    group outweighs ``split`` of one. Null texts have size 1 and share a shard as the empty
    ones do; null doc_ids are rows like others; wholly equal rows have slots of their own;
    an empty table gives no rows.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels or shards > FEW:
        raise ValueError(f"shards has to be a power of two, {FEW} at most; more come of target_bytes")
    with scratch(docs.sparkSession):
        meta = of_groups(stored(measured(docs, dimensions), "kdtree-meta"))
        found = leaves(meta, levels, split) if target_bytes is None else leaves_of_bytes(meta, target_bytes, split)
        out = with_slots(stored(found.select("doc_id", "size", "text_crc32", "shard"), "kdtree-leaves"))
        out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
        return stored(out, "kdtree-out", keep=True)
