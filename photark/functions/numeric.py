"""Numbers: clamping, smooth steps, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def smoothstep(a: float, b: float, x: Column) -> Column:
    """Hermite step from a to b; runs down where a > b."""
    t = clamp((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a * (1 - t) + b * t


def signed_pow(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, added up from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rounded(x: Column, digits: int = 6) -> Column:
    """To so many digits, and never -0.0."""
    return F.round(x, digits) + F.lit(0.0)
