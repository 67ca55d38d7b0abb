"""Operators on rasters held as rows (x, y, channels): neighbourhoods, resampling, statistics, layer stacks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions import color
from photark.functions.numeric import clamp
from photark.operators import tiles
from photark.operators.prefix import running


def stencil(df: DataFrame, weights: dict[tuple[int, int], float], width: int, height: int, value: str, out: str) -> DataFrame:
    """(x, y, value, out): the weighted mean of each pixel's neighbours at the offsets; beyond an edge the edge repeats.

    One shuffle deals pixels to square tiles and their borders, whatever the number of weights; a tile is a group of bounded size."""
    border = max(max(abs(dx), abs(dy)) for dx, dy in weights)
    total = sum(weights.values())

    def kernel(pixels: np.ndarray) -> np.ndarray:
        return sum(w * tiles.window(pixels, dy, dx, border) for (dx, dy), w in weights.items()) / total

    return over_tiles(df, border, kernel, width, height, value, out)


def over_tiles(df: DataFrame, border: int, kernel: Callable[[np.ndarray], np.ndarray], width: int, height: int, value: str, out: str) -> DataFrame:
    """(x, y, value, out) of a raster of one channel, which goes through the kernel as the first of three."""
    one = df.select("x", "y", F.col(value).cast("double").alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.col(value).cast("double").alias("own_"))
    return tiles.tiled(one, border, kernel, width, height, carry=["own_"]).select("x", "y", F.col("own_").alias(value), F.col("r").alias(out))


def box(radius: int = 1) -> dict[tuple[int, int], float]:
    return {(dx, dy): 1.0 for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}


def sharpen(df: DataFrame, amount: float, threshold: float, width: int, height: int, value: str = "v") -> DataFrame:
    """Unsharp mask against a separable blur; differences up to the threshold are masked out smoothly."""
    return over_tiles(df, *tiles.sharpening(amount, threshold), width, height, value, "sharp")


def resample(df: DataFrame, value: str, size: tuple[int, int], out_size: tuple[int, int], crop: tuple[float, float, float, float], degrees: float) -> DataFrame:
    """(x, y, value) of the picture's crop (x, y, width, height in source pixels), turned about its middle: each
    pixel's middle is mapped to the source and read bilinearly; beyond an edge the edge repeats."""
    (w, h), (ow, oh), (cx, cy, cw, ch) = size, out_size, crop
    spark = df.sparkSession
    at = spark.range(ow * oh).select((F.col("id") % ow).cast("int").alias("ox"), F.expr(f"cast(id div {ow} as int)").alias("oy"))
    u, v = (F.col("ox") + 0.5) / ow * cw - cw / 2, (F.col("oy") + 0.5) / oh * ch - ch / 2
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    sx, sy = u * c - v * s + (cx + cw / 2 - 0.5), u * s + v * c + (cy + ch / 2 - 0.5)
    at = at.select("ox", "oy", clamp(sx, 0, w - 1).alias("sx"), clamp(sy, 0, h - 1).alias("sy"))
    at = at.select("ox", "oy", "sx", "sy", F.floor("sx").cast("int").alias("fx"), F.floor("sy").cast("int").alias("fy"))
    tx, ty = F.col("sx") - F.col("fx"), F.col("sy") - F.col("fy")
    corners = F.array(*[
        F.struct(F.least(F.col("fx") + i, F.lit(w - 1)).alias("x"), F.least(F.col("fy") + j, F.lit(h - 1)).alias("y"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ])
    asked = at.select("ox", "oy", F.explode(corners).alias("c")).select("ox", "oy", "c.x", "c.y", "c.w")
    mixed = asked.join(df.select("x", "y", value), ["x", "y"]).groupBy("ox", "oy").agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return mixed.withColumnsRenamed({"ox": "x", "oy": "y"})


def histogram(pixels: DataFrame, bins: int = 64) -> DataFrame:
    """(bin, n): numbers of pixels by luma; only luma of 1 and more is in the last bin."""
    y = clamp(color.luma((F.col("r"), F.col("g"), F.col("b")), (0.2126, 0.7152, 0.0722)), 0, 1)
    return pixels.groupBy(F.floor(y * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def difference(a: DataFrame, b: DataFrame, on: list[str], channels: list[str], tolerance: float) -> DataFrame:
    """One row: the greatest difference of any channel, and the share of pixels with one over the tolerance."""
    right = b.select(*on, *[F.col(c).alias("o_" + c) for c in channels])
    most = F.greatest(*[F.abs(F.col(c) - F.col("o_" + c)) for c in channels])
    joined = a.join(right, on).select(most.alias("d"))
    return joined.agg(F.max("d").alias("max_diff"), F.avg((F.col("d") > tolerance).cast("double")).alias("changed_ratio"))


OPS: dict[str, Callable[..., DataFrame]] = {"Tone": color.tone, "Color": color.color}


def register(name: str, op: Callable[..., DataFrame]) -> None:
    """Add an operator df, **params -> df on columns r, g, b to those that stacks may name."""
    OPS[name] = op


def render(pixels: DataFrame, stack: str) -> DataFrame:
    """pixels with r, g, b after a stack of adjustment layers, bottom first.

    stack is JSON: a list of layers, or an object with ``layers``; a layer has ``ops`` (objects of one
    operator name and its parameters), and may have ``visible``, ``opacity`` and ``blend_mode``. Layers
    become projections of one plan, in stack order; hidden ones and those of opacity 0 are left out.
    """
    parsed = json.loads(stack)
    for layer in parsed["layers"] if isinstance(parsed, dict) else parsed:
        opacity = min(max(float(layer.get("opacity", 1.0)), 0.0), 1.0)
        if not layer.get("visible", True) or opacity == 0:
            continue
        base = pixels.withColumns({"base_" + c: F.col(c) for c in "rgb"})
        for op in layer.get("ops", []):
            (name, params), = op.items()
            base = OPS[name](base, **params)
        mixed = color.composite(tuple(F.col("base_" + c) for c in "rgb"), tuple(F.col(c) for c in "rgb"), layer.get("blend_mode", "normal"), opacity)
        pixels = base.withColumns(dict(zip("rgb", mixed, strict=True))).drop("base_r", "base_g", "base_b")
    return pixels


def visible_window(rows: DataFrame, height: Column, order: list, top: float, bottom: float) -> DataFrame:
    """Rows that a scroll window shows, by the running sum of heights (whole pixels) before them."""
    placed = running(rows, order, {"offset": height})
    return placed.where((F.col("offset") < bottom) & (F.col("offset") + height > top))
