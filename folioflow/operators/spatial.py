"""Joins of boxes over a grid of tiles, and as-of joins down a page.

A box is listed once for every tile that it touches, so boxes meet by an equality on page
and tile: a page with very many boxes is spread over its tiles, and boxes that share no tile
are never compared. A pair that shares several tiles counts in the one that holds the upper
left corner of what they share. Boxes with a null side meet nothing. ``size`` is the length
of a tile; tiles much smaller than the boxes list them often, much larger ones compare more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh

TILE = 128.0
BOX = ("x0", "y0", "x1", "y1")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(_cell(low, size), F.greatest(_cell(low, size), _cell(high, size)))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], prefix: str, size: float = TILE) -> DataFrame:
    """Pairs of a box x0, y0, x1, y1 of ``left`` and one of ``right``, whose columns begin with ``prefix``, that share an area; each once."""
    tx, ty = fresh(["tx", "ty"], left, right)
    a, b = [F.col(c) for c in BOX], [F.col(prefix + c) for c in BOX]
    l = left.withColumn(tx, F.explode(_cells(a[0], a[2], size))).withColumn(ty, F.explode(_cells(a[1], a[3], size)))
    r = right.withColumn(tx, F.explode(_cells(b[0], b[2], size))).withColumn(ty, F.explode(_cells(b[1], b[3], size)))
    share = (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))
    here = (_cell(F.greatest(a[0], b[0]), size) == F.col(tx)) & (_cell(F.greatest(a[1], b[1]), size) == F.col(ty))
    return l.join(r, [*keys, tx, ty]).where(share & here).drop(tx, ty)


def beside(left: DataFrame, right: DataFrame, keys: list[str], prefix: str, size: float = TILE) -> DataFrame:
    """Pairs whose boxes touch or overlap sideways, at whatever height; each once. Boxes meet in columns of tiles."""
    (tx,) = fresh(["tx"], left, right)
    a, b = [F.col(c) for c in BOX], [F.col(prefix + c) for c in BOX]
    l, r = left.withColumn(tx, F.explode(_cells(a[0], a[2], size))), right.withColumn(tx, F.explode(_cells(b[0], b[2], size)))
    return l.join(r, [*keys, tx]).where((b[0] <= a[2]) & (b[2] >= a[0]) & (_cell(F.greatest(a[0], b[0]), size) == F.col(tx))).drop(tx)


def near(left: DataFrame, right: DataFrame, keys: list[str], prefix: str, reach: float) -> DataFrame:
    """Pairs whose centres are less than ``reach`` apart on both axes; each once. A box of ``right`` lies in the tile of its centre, one of ``left`` looks into that and the eight around it."""
    tx, ty = fresh(["tx", "ty"], left, right)
    mid = lambda p, u, v: (F.col(p + u) + F.col(p + v)) / 2
    around = lambda c: F.explode(F.sequence(_cell(c, reach) - 1, _cell(c, reach) + 1))
    l = left.withColumn(tx, around(mid("", "x0", "x1"))).withColumn(ty, around(mid("", "y0", "y1")))
    r = right.withColumn(tx, _cell(mid(prefix, "x0", "x1"), reach)).withColumn(ty, _cell(mid(prefix, "y0", "y1"), reach))
    apart = lambda u, v: F.abs(mid("", u, v) - mid(prefix, u, v))
    return l.join(r, [*keys, tx, ty]).where((apart("x0", "x1") < reach) & (apart("y0", "y1") < reach)).drop(tx, ty)


def last_above(points: DataFrame, lines: DataFrame, keys: list[str], at: str, line: str, out: str) -> DataFrame:
    """``points`` with ``out``: the largest ``line`` of ``lines`` that is not above ``at``, null where there is none.

    An as-of join without pairs: points and lines are put in one order per key, lines first
    where they tie, and the last line is carried on. Null values of ``at`` find nothing, null
    lines are no lines.
    """
    order, kind, value = fresh(["order_", "kind_", "value_"], points)
    p = points.withColumn(order, F.col(at).cast("double")).withColumn(kind, F.lit(1)).withColumn(value, F.lit(None).cast("double"))
    seen = lines.where(F.col(line).isNotNull()).groupBy(*keys, F.col(line).cast("double").alias(order)).agg(F.lit(0).alias(kind)).withColumn(value, F.col(order))
    both = p.unionByName(seen, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), kind).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last(value, ignorenulls=True).over(w)).where(F.col(kind) == 1).drop(order, kind, value)
