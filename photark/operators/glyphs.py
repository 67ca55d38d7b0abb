"""Text as outlines: cubic curves as quadratic ones, buffers of glyphs, and how much of each pixel a glyph covers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.functions.geometry import quadratic_extent
from photark.functions.numeric import clamp
from photark.operators.prefix import running, written

#: How far a quadratic curve may be from its cubic one, in units of the outline, and how often one is halved.
TOLERANCE, DEPTH = 1.0, 10
NEARLY_LINEAR = 1 / 65536
#: About as many pixels a task, lines in a strip of an instance, and instances laid over each other at once.
PIXELS, STRIP, GROUP = 1 << 18, 64, 512


def quadratics(cubics: DataFrame, tolerance: float = TOLERANCE, depth: int = DEPTH) -> DataFrame:
    """cubics (x0, y0, .. x3, y3 and more columns) as quadratic curves: those columns without the cubic's, ``part`` (from 0) and px0,
    py0, px1, py1, px2, py2.

    A quadratic curve with the same ends is off by at most sqrt(3) / 36 times the cubic's third difference, which each
    halving makes eight times less, everywhere alike. So the number of halvings is known beforehand: as many as bring that below
    the tolerance, ``depth`` at most, and the parts are equal pieces of the parameter."""
    p = {a: [F.col(f"{a}{i}") for i in range(4)] for a in "xy"}
    third = {a: q[3] - 3 * q[2] + 3 * q[1] - q[0] for a, q in p.items()}
    off = F.sqrt(third["x"] * third["x"] + third["y"] * third["y"]) * (math.sqrt(3) / 36)
    least = F.ceil(F.round(F.log2(F.greatest(off / tolerance, F.lit(1.0))) / 3, 12))
    n = F.pow(F.lit(2.0), F.least(least, F.lit(depth))).cast("int")
    kept = [c for c in cubics.columns if c not in {f"{a}{i}" for a in "xy" for i in range(4)}]
    rows = cubics.withColumn("n_", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    rows = rows.withColumns({"a_": F.col("part") / F.col("n_"), "b_": (F.col("part") + 1) / F.col("n_")})

    def at(q: list[Column], t: Column) -> Column:
        s = 1 - t
        return s * s * s * q[0] + 3 * s * s * t * q[1] + 3 * s * t * t * q[2] + t * t * t * q[3]

    def slope(q: list[Column], t: Column) -> Column:
        s = 1 - t
        return s * s * (q[1] - q[0]) + 2 * s * t * (q[2] - q[1]) + t * t * (q[3] - q[2])  # a third of it

    out = []
    a, b = F.col("a_"), F.col("b_")
    for axis, q in p.items():
        first, last = at(q, a), at(q, b)
        c1, c2 = first + slope(q, a) * (b - a), last - slope(q, b) * (b - a)
        out += [first.alias(f"p{axis}0"), ((3 * (c1 + c2) - first - last) / 4).alias(f"p{axis}1"), last.alias(f"p{axis}2")]
    return rows.select(*kept, "part", *out)


def packed_glyphs(uses: DataFrame, key: list[str], order: list[str], curves: str, bands: str, band_curves: str) -> DataFrame:
    """One row for each key of ``uses``, each at its first use in ``order`` (a sortable row of columns): meta_index and where in
    shared buffers its curves, its band headers and their curves begin. ``curves``, ``bands`` and ``band_curves`` are how many of
    each a key has; they are the key's own. Distinct keys are found with partial sums, their places by running sums over ranges."""
    first = uses.groupBy(*key).agg(F.min(F.struct(*order)).alias("first_"), *[F.first(c).alias(c) for c in (curves, bands, band_curves)])
    return running(first, [F.col("first_"), *map(F.col, key)], {"meta_index": F.lit(1), "curves_offset": F.col(curves), "band_headers_offset": F.col(bands), "band_curves_offset": F.col(band_curves)}).drop("first_")


def band_of(v: Column, axis: str, bands: int) -> Column:
    span = F.greatest(F.col(f"high_{axis}") - F.col(f"low_{axis}"), F.lit(1e-9))
    return F.least(F.greatest(F.floor((v - F.col(f"low_{axis}")) / span * bands), F.lit(0)), F.lit(bands - 1)).cast("int")


def boxes(curves: DataFrame, glyph: str) -> DataFrame:
    """(glyph, low_x, low_y, high_x, high_y): the box of each glyph's curves."""
    x, y = (quadratic_extent(*[F.col(f"p{a}{i}") for i in range(3)]) for a in "xy")
    return curves.groupBy(glyph).agg(F.min(x[0]).alias("low_x"), F.min(y[0]).alias("low_y"), F.max(x[1]).alias("high_x"), F.max(y[1]).alias("high_y"))


def crossings(across: list[Column], along: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Of a quadratic curve relative to a sample: if it falls and if it rises through the sample's line (``across`` 0), and where
    along the line. Of the two roots one falls and one rises. With ends on different sides of the line the curve goes through once;
    with ends on one side, and the middle point on the other, it does twice or not at all, and then the roots are taken as equal."""
    under = [c < 0 for c in across]
    twice = (under[0] == under[2]) & (under[1] != under[0])
    falls, rises = (~under[0] & under[2]) | twice, (under[0] & ~under[2]) | twice
    a, b = across[0] - 2 * across[1] + across[2], across[0] - across[1]
    linear = F.abs(a) < NEARLY_LINEAR
    d = F.sqrt(F.greatest(b * b - a * across[0], F.lit(0.0)))
    straight = F.when(b != 0, across[0] * 0.5 / F.when(b != 0, b)).otherwise(0.0)
    root = lambda sign: F.when(linear, straight).otherwise((b + sign * d) / F.when(linear, 1.0).otherwise(a))
    place = lambda t: ((along[0] - 2 * along[1] + along[2]) * t - 2 * (along[0] - along[1])) * t + along[0]
    return falls, rises, place(root(-1)), place(root(1))


def in_bands(curves: DataFrame, glyph: str, bands: int) -> DataFrame:
    """One row for each glyph: its box, and for each axis across (``bands_y``, ``bands_x``) an array of ``bands`` arrays, which hold
    the curves whose extents meet that band: across0 .. 2, along0 .. 2 and if the axis across is y."""
    boxed = curves.join(boxes(curves, glyph).withColumnRenamed(glyph, "glyph_"), F.col(glyph).eqNullSafe(F.col("glyph_")))
    lists = []
    for across, along in ("yx", "xy"):
        low, high = quadratic_extent(*[F.col(f"p{across}{i}") for i in range(3)])
        curve = F.struct(*[F.col(f"p{across}{i}").alias(f"across{i}") for i in range(3)], *[F.col(f"p{along}{i}").alias(f"along{i}") for i in range(3)], F.lit(across == "y").alias("level"))
        lists.append(F.struct(band_of(low, across, bands).alias("first"), band_of(high, across, bands).alias("last"), curve.alias("curve")))
    box = ["low_x", "low_y", "high_x", "high_y"]
    found = boxed.groupBy(glyph, *box).agg(*[F.collect_list(c).alias(f"bands_{a}") for c, a in zip(lists, "yx", strict=True)])  # a glyph's curves are one row's worth
    inside = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda n: F.transform(F.filter(c, lambda x: n.between(x["first"], x["last"])), lambda x: x["curve"]))
    return found.select(glyph, *box, *[inside(F.col(f"bands_{a}")).alias(f"bands_{a}") for a in "yx"])


def covered(placed: DataFrame, curves: DataFrame, instance: str, glyph: str, bands: int, part: str, clip: tuple[int, int] | None = None) -> DataFrame:
    """(part, strip, instance, x, y, coverage) as in coverage(), dealt by (part, strip), with only the pixels of a canvas of ``clip`` (width, height) if given.

    A glyph's curves come to its instances once, and these are dealt in so many parts that a task has about PIXELS pixels. All that
    belongs to a pixel then comes from one row, so samples are neither shuffled nor sorted, and no task holds more of them as the input grows."""
    shapes = in_bands(curves, glyph, bands)
    own = placed.select(F.col(part).alias("part_"), instance, glyph, *[F.col(c).cast("double").alias(c) for c in ("pen_x", "pen_y", "scale")]).join(shapes, glyph)
    ends = {
        "from_x": F.ceil(F.col("pen_x") + F.col("low_x") * F.col("scale") - 1), "to_x": F.floor(F.col("pen_x") + F.col("high_x") * F.col("scale")),
        "from_y": F.ceil(F.col("pen_y") - F.col("high_y") * F.col("scale") - 1), "to_y": F.floor(F.col("pen_y") - F.col("low_y") * F.col("scale")),
    }
    if clip is not None:
        ends = {n: (F.greatest(c, F.lit(0)) if n[0] == "f" else F.least(c, F.lit(clip["xy".index(n[-1])] - 1))) for n, c in ends.items()}
    own = own.withColumns({n: c.cast("int") for n, c in ends.items()}).where("from_x <= to_x and from_y <= to_y")
    pixels = own.agg(F.sum((F.col("to_x") - F.col("from_x") + 1).cast("long") * (F.col("to_y") - F.col("from_y") + 1))).first()[0] or 0
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixels // PIXELS))
    strips = own.withColumn("strip", F.explode(F.expr(f"sequence(cast(floor(from_y / {STRIP}) as int), cast(floor(to_y / {STRIP}) as int))"))).repartition(tasks, "part_", "strip")
    lines = strips.withColumn("y", F.explode(F.sequence(F.greatest("from_y", F.col("strip") * STRIP), F.least("to_y", F.col("strip") * STRIP + STRIP - 1))))
    lines = lines.withColumn("at_y", (F.col("pen_y") - F.col("y") - 0.5) / F.col("scale"))
    lines = lines.withColumn("level_", F.get("bands_y", band_of(F.col("at_y"), "y", bands))).drop("bands_y")
    samples = lines.withColumn("x", F.explode(F.sequence("from_x", "to_x"))).withColumn("at_x", (F.col("x") + 0.5 - F.col("pen_x")) / F.col("scale"))
    key = ["part_", "strip", instance, "x", "y"]
    met = samples.select(*key, "scale", "at_x", "at_y", F.inline(F.concat("level_", F.get("bands_x", band_of(F.col("at_x"), "x", bands)))))
    across, along = (F.when(F.col("level"), F.col(f"at_{a}")).otherwise(F.col(f"at_{b}")) for a, b in ("yx", "xy"))
    met = met.withColumns({"across_": across, "along_": along})
    met = met.select(*key, "scale", "level", *[(F.col(f"{n}{i}") - F.col(f"{n}_")).alias(f"{n}{i}") for n in ("across", "along") for i in range(3)])
    falls, rises, first, second = crossings([F.col(f"across{i}") for i in range(3)], [F.col(f"along{i}") for i in range(3)])
    met = met.withColumns({"falls": falls, "rises": rises, "first": first * F.col("scale"), "second": second * F.col("scale")})
    share = lambda c, on: F.when(F.col(on), clamp(F.col(c) + 0.5, 0, 1)).otherwise(0.0)
    near = lambda c, on: F.when(F.col(on), clamp(1 - F.abs(F.col(c)) * 2, 0, 1)).otherwise(0.0)
    met = met.select(*key, "level", (share("first", "falls") - share("second", "rises")).alias("cov"), F.greatest(near("first", "falls"), near("second", "rises")).alias("near"))
    of = lambda level, c: F.when(F.col("level") if level else ~F.col("level"), F.col(c)).otherwise(0.0)
    sums = met.groupBy(*key).agg(F.sum(of(True, "cov")).alias("xc"), F.sum(-of(False, "cov")).alias("yc"), F.max(of(True, "near")).alias("xw"), F.max(of(False, "near")).alias("yw"))
    weighed = F.abs(F.col("xc") * F.col("xw") + F.col("yc") * F.col("yw")) / F.greatest(F.col("xw") + F.col("yw"), F.lit(NEARLY_LINEAR))
    out = clamp(F.greatest(weighed, F.least(F.abs("xc"), F.abs("yc"))), 0, 1)
    return sums.select(*key, out.alias("coverage")).where("coverage > 0")


def coverage(placed: DataFrame, curves: DataFrame, instance: str, glyph: str, bands: int = 8) -> DataFrame:
    """(instance, x, y, coverage): how much (0 to 1) of each pixel a placed glyph covers, where it covers any.

    placed has instance, glyph, pen_x, pen_y (pixels, y down) and scale (pixels a unit); curves has glyph and px0 .. py2 (units, y up),
    closed outlines. A pixel meets the curves of the two bands of its glyph that it lies in, so no
    pixel meets a curve that its lines do not come near. A ray along each axis counts the outline's crossings, each softened
    over a pixel; the two sums are weighed by how near the crossings are."""
    return covered(placed, curves, instance, glyph, bands, instance).select(instance, "x", "y", "coverage")


def text_layer(placed: DataFrame, curves: DataFrame, instance: str, glyph: str, width: int, height: int, shift: tuple[float, float] = (0.0, 0.0), bands: int = 8) -> DataFrame:
    """(x, y, r, g, b, a): the pixels of a canvas that placed glyphs (with red, green, blue, alpha, and their order in ``instance``)
    cover, each over those before it, straight alpha. Only the shift of a layer's placement counts; glyphs without curves draw nothing.

    Laying one over another can be grouped in any way that keeps the order: GROUP instances in a row are laid over each other where their
    coverage is made, then GROUP of these groups, and so on, so no row holds more than GROUP colours of a pixel."""
    moved = placed.withColumns({"pen_x": F.col("pen_x") + shift[0], "pen_y": F.col("pen_y") + shift[1]})
    paint = ["red", "green", "blue", "alpha"]
    columns = [instance, glyph, "pen_x", "pen_y", "scale", *paint]
    moved = running(moved.select(*columns), [F.col(instance)], {"nth_": F.lit(1)}).withColumn("part", F.expr(f"nth_ div {GROUP}"))
    found = covered(moved.withColumn("drawn_", F.struct(instance, *paint)), curves, "drawn_", glyph, bands, "part", (width, height))
    one = F.struct(F.col(f"drawn_.{instance}").alias("i"), *[F.col(f"drawn_.{c}").cast("double").alias(c[0]) for c in paint[:3]], (F.col("drawn_.alpha") * F.col("coverage")).alias("a"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def over(base: Column, top: Column) -> Column:
        a = top["a"] + base["a"] * (1 - top["a"])
        mix = lambda c: F.when(a > 0, (top[c] * top["a"] + base[c] * base["a"] * (1 - top["a"])) / F.when(a > 0, a)).otherwise(0.0)
        return F.struct(*[mix(c).alias(c) for c in "rgb"], a.alias("a"))

    laid = lambda drawn: F.aggregate(F.sort_array(F.collect_list(drawn)), start, over).alias("p")
    layers = written(found.groupBy("part_", "strip", "x", "y").agg(laid(one)).select("part_", "x", "y", "p.*"), "layers")
    groups = (layers.agg(F.max("part_")).first()[0] or 0) + 1
    while groups > 1:
        one = F.struct(F.col("part_").alias("i"), *"rgba")
        layers = layers.groupBy(F.expr(f"part_ div {GROUP}").alias("part_"), "x", "y").agg(laid(one)).select("part_", "x", "y", "p.*")
        groups = -(-groups // GROUP)
    return layers.select("x", "y", *"rgba")
