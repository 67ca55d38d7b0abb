"""Sizes, rectangles and curves as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contain(w: Column, h: Column, most: float) -> tuple[Column, Column]:
    """Size with the longer edge at most ``most``; never larger than it was, and at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    one = lambda x: F.greatest(F.lit(1), F.round(x * scale)).cast("int")
    return one(w), one(h)


def fit_scale(w: Column, h: Column, into_w: float, into_h: float) -> Column:
    return F.least(F.lit(float(into_w)) / w, F.lit(float(into_h)) / h)


def crop_clamped(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """The part of a rectangle inside an image, at least one pixel."""
    left, top = F.least(F.greatest(x, F.lit(0)), F.lit(width - 1)), F.least(F.greatest(y, F.lit(0)), F.lit(height - 1))
    return left, top, F.greatest(F.lit(1), F.least(x + w, F.lit(width)) - left), F.greatest(F.lit(1), F.least(y + h, F.lit(height)) - top)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """x, y, w, h of what two rectangles share; w and h are 0 where they share nothing."""
    left, top = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    return left, top, F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - left), F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - top)


def quadratic_extent(p0: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """Least and greatest value of a quadratic Bézier curve: its ends, and where it turns between them."""
    bend = p0 - 2 * p1 + p2
    t = F.when(F.abs(bend) > 1e-12, (p0 - p1) / bend)
    turn = F.when((t > 0) & (t < 1), (1 - t) * (1 - t) * p0 + 2 * (1 - t) * t * p1 + t * t * p2)
    return F.least(p0, p2, turn), F.greatest(p0, p2, turn)


def brush(x: Column, y: Column, stamps: list[tuple[float, float, float, float]], hardness: float = 0.5) -> Column:
    """0 to 1: stamps (x, y, radius, pressure) added one after the other, each with a smooth fall from its hard core, and clamped."""
    total = F.lit(0.0)
    for cx, cy, radius, pressure in stamps:
        d = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / radius
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - hardness) / (1 - hardness)))
        total = F.least(F.lit(1.0), total + (1 - t * t * (3 - 2 * t)) * pressure)
    return total
