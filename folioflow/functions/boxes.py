"""Boxes (x0, y0, x1, y1) in points, pixels or thousandths of a page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def to_pixels(c: Column, dpi: int) -> Column:
    return (c * dpi / 72).cast("int")


def to_fraction(c: Column, page: float) -> Column:
    """Thousandths of a page, cut off."""
    return (c / page * 1000).cast("int")


def _channel(hex_color: Column, at: int) -> Column:
    return F.conv(F.substring(hex_color, at, 2), 16, 10).cast("int")


def luma(hex_color: Column) -> Column:
    """Brightness of #rrggbb, 0 to 255."""
    return 0.299 * _channel(hex_color, 2) + 0.587 * _channel(hex_color, 4) + 0.114 * _channel(hex_color, 6)


def relative_luma(hex_color: Column) -> Column:
    """Relative luminance of #rrggbb, 0 to 1."""
    return 0.2126 * (_channel(hex_color, 2) / 255) + 0.7152 * (_channel(hex_color, 4) / 255) + 0.0722 * (_channel(hex_color, 6) / 255)
