"""Hue, saturation and lightness: conversion and the two adjustments that work in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions.color import lut, stage
from photark.functions.numeric import clamp, smoothstep


def with_hsl(df: DataFrame) -> DataFrame:
    """df with hdr (the greatest channel, 1 at least) and hue, sat, light of the pixel divided by it, all of 0 to 1."""
    df = df.withColumn("hdr", F.greatest("r", "g", "b", F.lit(1.0)))
    df = df.withColumns({"nr": F.col("r") / F.col("hdr"), "ng": F.col("g") / F.col("hdr"), "nb": F.col("b") / F.col("hdr")})
    df = df.withColumns({"top": F.greatest("nr", "ng", "nb"), "low": F.least("nr", "ng", "nb")})
    df = df.withColumns({"chroma": F.col("top") - F.col("low"), "light": (F.col("top") + F.col("low")) / 2})
    grey = F.col("chroma") < 0.0001
    safe = F.when(grey, 1.0).otherwise(F.col("chroma"))
    room = F.when(F.col("light") < 0.5, F.col("top") + F.col("low")).otherwise(2 - F.col("top") - F.col("low"))
    sixth = F.when(F.col("top") == F.col("nr"), (F.col("ng") - F.col("nb")) / safe + F.when(F.col("ng") >= F.col("nb"), 0.0).otherwise(6.0))
    sixth = sixth.when(F.col("top") == F.col("ng"), (F.col("nb") - F.col("nr")) / safe + 2).otherwise((F.col("nr") - F.col("ng")) / safe + 4)
    df = df.withColumns({"hue": F.when(grey, 0.0).otherwise(sixth / 6), "sat": F.when(grey, 0.0).otherwise(F.col("chroma") / F.when(grey, 1.0).otherwise(room))})
    return df.drop("nr", "ng", "nb", "top", "low", "chroma")


def from_hsl(df: DataFrame) -> DataFrame:
    """r, g, b of hue, sat, light and hdr, which go. Each channel is the lightness less a trapezoid of the hue."""
    span = F.when(F.col("sat") < 0.0001, 0.0).otherwise(F.col("sat") * F.least(F.col("light"), 1 - F.col("light")))
    df = df.withColumn("span", span)

    def channel(n: int) -> Column:
        k = F.pmod(F.col("hue") * 12 + n, F.lit(12.0))
        return (F.col("light") - F.col("span") * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * F.col("hdr")

    return stage(df, lambda _: (channel(0), channel(8), channel(4))).drop("hue", "sat", "light", "hdr", "span")


def balance(df: DataFrame, red=(0.0, 0.0, 0.0), green=(0.0, 0.0, 0.0), blue=(0.0, 0.0, 0.0)) -> DataFrame:
    """Shifts of hue (1 is half a turn), saturation and lightness (in stops) around three hues. Each hue's share falls
    to none a third of a turn away, and grey pixels have none."""
    df = with_hsl(df)

    def share(center: float) -> Column:
        d = F.abs(F.col("hue") - center)
        return F.greatest(F.lit(0.0), 1 - F.least(d, 1 - d) * 3) * smoothstep(0.0, 0.05, F.col("sat"))

    df = df.withColumns({"share_r": share(0.0), "share_g": share(1 / 3), "share_b": share(2 / 3)})
    by = lambda i: F.col("share_r") * red[i] + F.col("share_g") * green[i] + F.col("share_b") * blue[i]
    df = df.withColumns({
        "hue": F.pmod(F.col("hue") + by(0) * 0.5, F.lit(1.0)), "sat": clamp(F.col("sat") + by(1), 0, 1),
        "light": clamp(F.col("light") * F.pow(F.lit(2.0), by(2)), 0, 1),
    })
    return from_hsl(df.drop("share_r", "share_g", "share_b"))


def saturation_curve(df: DataFrame, table: list[float]) -> DataFrame:
    """Saturation times the table's value at the pixel's lightness."""
    df = with_hsl(df)
    return from_hsl(df.withColumn("sat", clamp(F.col("sat") * lut(table, F.col("light")), 0, 1)))
