"""Masks as expressions on a pixel's place: brush strokes in bytes, and masks made again from saved parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions.numeric import clamp


def stamped(m: Column, x: Column, y: Column, stamps: list[tuple[float, float, float, float, bool]]) -> Column:
    """The mask's bytes after stamps (x, y, radius, softness, erase), one after the other: a hard core and a cosine's fall to the
    radius. Painting takes the greater byte, erasing the lesser one of what is left; beyond the radius nothing changes."""
    for cx, cy, radius, softness, erase in stamps:
        if radius <= 0:
            raise ValueError("a brush needs a radius")
        core = radius * (1 - min(max(softness, 0.0), 1.0))
        far = F.pow(x + 0.5 - cx, F.lit(2.0)) + F.pow(y + 0.5 - cy, F.lit(2.0))
        fall = 0.5 * (1 + F.cos((F.sqrt(far) - core) / max(radius - core, 1.1920929e-07) * math.pi))
        alpha = F.when(far <= core * core, 1.0).otherwise(fall)
        byte = lambda v: F.floor(v * 255).cast("int")
        changed = F.least(m, byte(1 - alpha)) if erase else F.greatest(m, byte(alpha))
        m = F.when(far <= radius * radius, changed).otherwise(m)
    return m


def strokes(m: Column, x: Column, y: Column, stamps: list[tuple[float, float, float, float, float, bool]]) -> Column:
    """The mask (0 to 1) after stamps (x, y, radius, hardness, pressure, erase) of a pen: each is added to what is there, or taken
    from it, with a smooth fall from its core, and clamped."""
    for cx, cy, radius, hardness, pressure, erase in stamps:
        far = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
        t = clamp((radius - far) / (radius - radius * hardness), 0, 1) if hardness < 1 else (far <= radius).cast("double")
        by = t * t * (3 - 2 * t) * pressure
        m = F.greatest(F.lit(0.0), m - by) if erase else F.least(F.lit(1.0), m + by)
    return m


def restored(layers: DataFrame, params: DataFrame) -> DataFrame:
    """layers (layer, mask, and more columns) with the saved parameters (mask, kind, a, b, c, d, bytes) of their masks beside them
    and ``mask`` null where none are saved: such a layer has no mask any more. params has each mask once."""
    saved = params.select(F.col("mask").alias("mask_"), "kind", "a", "b", "c", "d", "bytes")
    joined = layers.join(saved, F.col("mask") == F.col("mask_"), "left")
    return joined.withColumn("mask", F.when(F.col("mask_").isNotNull(), F.col("mask"))).drop("mask_")


def drawn(kind: Column, a: Column, b: Column, c: Column, d: Column, bytes_: Column, x: Column, y: Column, width: int) -> Column:
    """A pixel's byte of a mask by its kind: linear (from a, b to c, d), radial (middle a, b, radius c) or brush (the stored bytes,
    a wide). A gradient of no length and a radius of 0 are errors; beyond stored bytes, and for other kinds, null."""
    fails = F.raise_error(F.lit("a gradient needs two different points, and a radius over 0")).cast("double")
    length = (c - a) * (c - a) + (d - b) * (d - b)
    along = ((x + 0.5 - a) * (c - a) + (y + 0.5 - b) * (d - b)) / F.when(length > 0, length).otherwise(fails)
    out = 1 - F.sqrt((x + 0.5 - a) * (x + 0.5 - a) + (y + 0.5 - b) * (y + 0.5 - b)) / F.when(c > 0, c).otherwise(fails)
    byte = lambda v: F.floor(clamp(v, 0, 1) * 255).cast("int")
    inside = (x < a) & (F.octet_length(bytes_) > y * a + x)
    stored = F.when(inside, F.conv(F.hex(F.substring(bytes_, (y * a + x + 1).cast("int"), F.lit(1))), 16, 10).cast("int"))
    return F.when(kind == "linear", byte(along)).when(kind == "radial", byte(out)).when(kind == "brush", stored)
