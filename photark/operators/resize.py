"""Rasters (x, y and channels as rows) in another size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(width: int, height: int, most: int) -> tuple[int, int]:
    """The size of a preview whose longer edge is ``most`` at most; never larger than the picture, and at least one pixel."""
    longest = max(width, height)
    if longest <= most:
        return width, height
    return tuple(max(1, int(n * most / longest + 0.5)) for n in (width, height))


def thumbnail_size(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int]:
    """The size of a mask's thumbnail, which fits into both."""
    scale = min(most_width / width, most_height / height, 1.0)
    return tuple(max(1, int(n * scale + 0.5)) for n in (width, height))


def thumbnail(pixels: DataFrame, width: int, height: int, most_width: int, most_height: int) -> DataFrame:
    """A mask that fits into the given size, by its pixels at floor(target / target size * size); never larger than it was.

    A pixel is the source of one target or none, and tells which: nothing is joined or shuffled."""
    new_width, new_height = thumbnail_size(width, height, most_width, most_height)

    def target(at: str, n: int, into: int) -> Column:
        first = F.expr(f"cast(({at} * {into} + {n - 1}) div {n} as int)")  # the first target that is not before the pixel
        return F.when(F.expr(f"({at} * {into} + {n - 1}) div {n} * {n} div {into} = {at}"), first)

    rows = pixels.withColumns({"tx_": target("x", width, new_width), "ty_": target("y", height, new_height)}).where("tx_ is not null and ty_ is not null")
    return rows.withColumns({"x": F.col("tx_"), "y": F.col("ty_")}).drop("tx_", "ty_")


def region(pixels: DataFrame, size: tuple[int, int], new_size: tuple[int, int], crop: tuple[float, float, float, float]) -> DataFrame:
    """A mask's crop (x, y, width, height) in a new size: each new pixel takes the old one nearest to the middle of its
    part, halves up, inside the mask. Two tables, of a row for each new column and row, are broadcast: they grow with the new size, not with the data."""
    spark = pixels.sparkSession

    def axis(name: str, n: int, into: int, start: float, length: float) -> DataFrame:
        middle = F.lit(start + length * 0.5) if into == 1 else (F.col("id") + 0.5) / into * length + (start - 0.5)
        place = F.floor(F.least(F.greatest(middle, F.lit(0.0)), F.lit(float(n - 1))) + 0.5).cast("int")
        return F.broadcast(spark.range(into).select(F.col("id").cast("int").alias("t" + name), F.least(place, F.lit(n - 1)).alias(name)))

    (width, height), (new_width, new_height), (x, y, w, h) = size, new_size, crop
    joined = pixels.join(axis("x", width, new_width, x, w), "x").join(axis("y", height, new_height, y, h), "y")
    return joined.drop("x", "y").withColumnsRenamed({"tx": "x", "ty": "y"})


def triangle(pixels: DataFrame, width: Column, height: Column, new_width: Column, new_height: Column, channels: list[str], image: list[str] | None = None) -> DataFrame:
    """(image, x, y, channels) of pictures in a new size, by a triangle filter as wide as a new pixel, or as an old one if that is
    more. Sizes are columns, so each picture may have its own, told by the columns ``image``.

    Every old pixel knows the new ones whose filter it lies in, and its weights there; a sum of products and one of weights for
    each new pixel, added up before the shuffle, are all that moves. Weights are shared out by what lies inside the picture."""
    image = image or []

    def taken(at: str, n: Column, into: Column) -> tuple[Column, Column]:
        ratio = n / into
        wide = F.greatest(ratio, F.lit(1.0))
        first = F.greatest(F.lit(0), F.ceil((F.col(at) + 0.5 - wide) / ratio - 0.5)).cast("int")
        last = F.least(into - 1, F.floor((F.col(at) + 0.5 + wide) / ratio - 0.5)).cast("int")
        weight = lambda t: 1 - F.abs((t + 0.5) * ratio - 0.5 - F.col(at)) / wide
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        both = F.transform(places, lambda t: F.struct(t.alias("to"), weight(t).alias("w")))
        return F.filter(both, lambda s: s["w"] > 0)

    sized = pixels.select(*image, "x", "y", *channels, width.alias("w_"), height.alias("h_"), new_width.alias("nw_"), new_height.alias("nh_"))
    spread = sized.withColumn("a_", F.explode(taken("x", F.col("w_"), F.col("nw_")))).withColumn("b_", F.explode(taken("y", F.col("h_"), F.col("nh_"))))
    weight = F.col("a_.w") * F.col("b_.w")
    sums = [F.sum(weight * F.col(c)).alias(c) for c in channels]
    out = spread.groupBy(*image, F.col("a_.to").alias("x"), F.col("b_.to").alias("y")).agg(*sums, F.sum(weight).alias("weight_"))
    return out.select(*image, "x", "y", *[(F.col(c) / F.col("weight_")).alias(c) for c in channels])


def model_input(pixels: DataFrame, image: str, width: Column, height: Column, edge: int, mean: float = 0.5, deviation: float = 0.5) -> DataFrame:
    """(image, channel, at, value): pictures (image, x, y and r, g, b as bytes) as a model takes them: edge x edge pixels by the
    triangle filter, rounded to bytes (from six digits, so that the order of summation can't turn a half), divided by 255, less mean, over deviation; ``at`` is the place in channel, row, column."""
    small = triangle(pixels, width, height, F.lit(edge), F.lit(edge), ["r", "g", "b"], [image])
    value = lambda c: (F.round(F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(255.0)), 6)) / 255.0 - mean) / deviation
    each = F.array(*[F.struct(F.lit(i).alias("channel"), value(c).alias("value")) for i, c in enumerate("rgb")])
    rows = small.select(image, "x", "y", F.inline(each))
    return rows.select(image, "channel", (F.col("channel") * edge * edge + F.col("y") * edge + F.col("x")).alias("at"), "value")


def tensors(rows: DataFrame, image: str) -> DataFrame:
    """(image, values) of model_input, the values in the order of ``at``: an array of as many numbers as a picture has."""
    return rows.groupBy(image).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("values"))
