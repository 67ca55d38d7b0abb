"""Colour spaces, sizes of rasters and masks against hand-worked values and NumPy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from photark.functions import masks, spaces
from photark.operators import resize
from photark.plans import colors


def pixels(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "r double, g double, b double")


def values(df):
    return np.array([tuple(r) for r in df.select("r", "g", "b").collect()])


LOG = lambda x: np.where(x <= 0.0078125, 10.5402377417 * x + 0.0729055342, (np.log2(np.maximum(x, 1e-30)) + 9.72) / 17.52)
EXP = lambda x: np.where(x < 0.1552511416, (x - 0.0729055342) / 10.5402377417, 2.0 ** (x * 17.52 - 9.72))
SRGB = lambda x: np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
TO_SRGB = lambda x: np.where(x <= 0.0031308, np.maximum(x, 0) * 12.92, 1.055 * np.maximum(x, 1e-30) ** (1 / 2.4) - 0.055)
A = np.array([[0.5, 0.25, 0.75], [0.0, 1.0, 0.02], [1.0, 1.0, 1.0], [0.18, 0.18, 0.18]])


@pytest.mark.parametrize("space", ["srgb", "unknown", "custom", "display_p3", "adobe_rgb", "prophoto_rgb", "linear_srgb", "acescct"])
def test_working_space(spark, space):
    got = values(spaces.to_working(pixels(spark, A), space))
    if space == "acescct":
        assert np.array_equal(got, A)
        return
    linear = A if space == "linear_srgb" else A ** {"adobe_rgb": 2.2, "prophoto_rgb": 1.8}[space] if space in spaces.GAMMA else SRGB(A)
    m = np.array(spaces.SRGB_TO_AP1) @ np.array(spaces.TO_SRGB.get(space, np.eye(3)))
    assert np.allclose(got, LOG(linear @ m.T), atol=1e-9)
    if space in ("srgb", "linear_srgb", "display_p3"):  # and back
        assert np.allclose(values(spaces.from_working(spaces.to_working(pixels(spark, A), space), space)), A, atol=2e-3)


def test_hand_worked_pixels(spark):
    grey = values(spaces.to_working(pixels(spark, [(0.18, 0.18, 0.18)]), "linear_srgb"))[0]
    assert np.allclose(grey, (math.log2(0.18) + 9.72) / 17.52, atol=1e-6)  # 0.4136: the middle grey
    white = values(spaces.preview_bytes(pixels(spark, [tuple(LOG(np.ones(3)))])))[0]
    assert white.tolist() == [255, 255, 255]
    red = values(spaces.from_working(pixels(spark, [LOG(np.array([0.6130974, 0.0701442, 0.0205687]))]), "srgb"))[0]
    assert np.allclose(red, (1, 0, 0), atol=2e-3)
    p3 = values(spaces.to_linear(pixels(spark, [(1.0, 0.5, 0.0)]), "display_p3"))[0]  # 2.2 here, not sRGB's curve
    assert np.allclose(p3, [1.2249 - 0.2247 * 0.5**2.2, -0.0420 + 1.0419 * 0.5**2.2, -0.0197 - 0.0786 * 0.5**2.2])


def test_spaces_without_a_way_out_give_srgb(spark):
    want = values(spaces.from_working(pixels(spark, A), "srgb"))
    for space in ("adobe_rgb", "prophoto_rgb", "custom", "unknown"):
        assert np.array_equal(values(spaces.from_working(pixels(spark, A), space)), want)
    assert np.array_equal(values(spaces.from_linear(pixels(spark, A), "adobe_rgb")), values(spaces.from_linear(pixels(spark, A), "srgb")))


def test_half_precision(spark):
    x = np.array([0.0, 1 / 3, -0.1, 1.0, 65504.0, 65519.9, 65520.0, 6e-8, 2.9e-8, 1e-5, 2047.5, 0.1552511416])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(spaces.half(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))


def test_display_bytes(spark):
    x = np.linspace(-0.1, 1.1, 997)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(spaces.display_byte(F.col("v"))).collect()]
    table = TO_SRGB(np.arange(8193) / 8192)
    at = np.clip(x, 0, 1) * 8192
    low = np.floor(at).astype(int)
    assert got == np.floor((table[low] + (table[np.minimum(low, 8191) + 1] - table[low]) * (at - low)) * 255 + 0.5).astype(int).tolist()
    grey = pixels(spark, [(v, v, v) for v in np.linspace(0, 0.6, 50)])
    near = np.abs(values(spaces.preview_bytes(grey)) - values(spaces.channel_bytes(grey)))
    assert near.max() <= 2  # greys need no gamut


def raster(spark, a, image=None):
    rows = [(int(x), int(y), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "x int, y int, v double").repartition(3)
    return df if image is None else df.withColumn("image", F.lit(image))


def array(df, width, height):
    out = np.full((height, width), np.nan)
    for r in df.collect():
        assert np.isnan(out[r["y"], r["x"]])
        out[r["y"], r["x"]] = r["v"]
    return out


def filtered(a, width, height):
    """Each axis by the filter's definition."""
    for axis, into in ((0, height), (1, width)):
        n = a.shape[axis]
        ratio = n / into
        wide = max(ratio, 1.0)
        w = np.maximum(0, 1 - np.abs(((np.arange(into) + 0.5) * ratio - 0.5)[:, None] - np.arange(n)) / wide)
        a = np.moveaxis(np.tensordot(w / w.sum(1, keepdims=True), a, (1, axis)), 0, axis)
    return a


@pytest.mark.parametrize("size", [(5, 3), (40, 31), (17, 11), (1, 1), (17, 4)])
def test_triangle_filter(spark, size):
    a = np.random.default_rng(1).random((11, 17))
    got = resize.triangle(raster(spark, a), F.lit(17), F.lit(11), F.lit(size[0]), F.lit(size[1]), ["v"])
    assert np.allclose(array(got, *size), filtered(a, *size), atol=1e-12)


def test_triangle_filter_of_many_sizes(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((6, 9)), rng.random((3, 2))
    both = raster(spark, a, 1).unionByName(raster(spark, b, 2))
    w, h = F.when(F.col("image") == 1, 9).otherwise(2), F.when(F.col("image") == 1, 6).otherwise(3)
    got = resize.triangle(both, w, h, F.lit(4), F.lit(4), ["v"], ["image"])
    assert np.allclose(array(got.where("image = 1"), 4, 4), filtered(a, 4, 4)) and np.allclose(array(got.where("image = 2"), 4, 4), filtered(b, 4, 4))
    assert resize.triangle(both.limit(0), w, h, F.lit(4), F.lit(4), ["v"], ["image"]).count() == 0


def test_model_input(spark):
    a = np.floor(np.random.default_rng(3).random((6, 6)) * 256)
    df = raster(spark, a, 7).select("image", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.lit(255.0).alias("b"))
    got = resize.tensors(resize.model_input(df, "image", F.lit(6), F.lit(6), 4), "image").collect()
    small = (np.floor(np.round(filtered(a, 4, 4), 6) + 0.5) / 255 - 0.5) / 0.5
    assert len(got) == 1 and np.allclose(got[0]["values"], [*small.ravel(), *small.ravel(), *np.ones(16)])


def test_sizes():
    assert resize.within(100, 50, 200) == (100, 50) and resize.within(300, 3, 30) == (30, 1) and resize.within(1000, 1, 10) == (10, 1)
    assert resize.thumbnail_size(10, 8, 100, 100) == (10, 8) and resize.thumbnail_size(100, 8, 50, 2) == (25, 2)


@pytest.mark.parametrize("most", [(4, 9), (3, 3), (17, 11), (50, 50), (1, 1)])
def test_thumbnail(spark, most):
    a = np.random.default_rng(1).random((11, 17))
    w, h = resize.thumbnail_size(17, 11, *most)
    want = a[np.arange(h)[:, None] * 11 // h, np.arange(w) * 17 // w]
    assert np.array_equal(array(resize.thumbnail(raster(spark, a), 17, 11, *most), w, h), want)


def test_region(spark):
    a = np.random.default_rng(1).random((11, 17))
    for (w, h), (x, y, cw, ch) in (((5, 4), (2.5, 1.0, 9.0, 8.0)), ((30, 1), (-3.0, 4.0, 25.0, 3.0)), ((1, 25), (0.0, 0.0, 17.0, 11.0))):
        def places(n, into, start, length):
            m = np.full(1, start + length / 2) if into == 1 else start + (np.arange(into) + 0.5) / into * length - 0.5
            return np.minimum(np.floor(np.clip(m, 0, n - 1) + 0.5), n - 1).astype(int)

        want = a[places(11, h, y, ch)[:, None], places(17, w, x, cw)]
        assert np.array_equal(array(resize.region(raster(spark, a), (17, 11), (w, h), (x, y, cw, ch)), w, h), want)


def test_brushes(spark):
    a = np.full((9, 9), 100.0)
    df = raster(spark, a).select("x", "y", F.col("v").cast("int").alias("m"))
    out = df.select("x", "y", masks.stamped(F.col("m"), F.col("x"), F.col("y"), [(4.5, 4.5, 3.0, 0.0, False), (4.5, 4.5, 1.0, 1.0, True)]).alias("v"))
    got = array(out, 9, 9)
    assert got[4, 4] == 0 and got[4, 6] == 255 and got[4, 7] == 255 and got[0, 0] == 100 and got[4, 8] == 100
    with pytest.raises(ValueError, match="radius"):
        masks.stamped(F.col("m"), F.col("x"), F.col("y"), [(0, 0, 0, 0, False)])
    pen = df.select("x", "y", masks.strokes(F.lit(0.0), F.col("x"), F.col("y"), [(4.0, 4.0, 3.0, 1.0, 0.8, False), (4.0, 4.0, 2.0, 0.5, 0.5, True)]).alias("v"))
    got = array(pen, 9, 9)
    assert got[4, 4] == pytest.approx(0.3) and got[4, 7] == 0.8 and got[4, 8] == 0 and got[4, 6] == 0.8


def test_restored_masks(spark):
    layers = spark.createDataFrame([(0, 1), (1, 9), (2, None), (3, 2)], "layer int, mask int")
    params = spark.createDataFrame([(1, "linear", 0.0, 0.0, 10.0, 0.0, None), (2, "brush", 2.0, 2.0, 0.0, 0.0, b"\1\2\3\xff")], "mask int, kind string, a double, b double, c double, d double, bytes binary")
    held = masks.restored(layers, params)
    assert {r["layer"]: r["mask"] for r in held.collect()} == {0: 1, 1: None, 2: None, 3: 2}
    grid = spark.createDataFrame([(x, y) for x in range(3) for y in range(3)], "x int, y int")
    m = masks.drawn(*[F.col(c) for c in ("kind", "a", "b", "c", "d", "bytes", "x", "y")], 3)
    got = {(r["layer"], r["x"], r["y"]): r["m"] for r in grid.crossJoin(held).select("layer", "x", "y", m.alias("m")).collect()}
    assert [got[3, x, y] for y in range(2) for x in range(2)] == [1, 2, 3, 255] and got[3, 2, 0] is None and got[3, 0, 2] is None
    assert [got[0, x, 1] for x in range(3)] == [12, 38, 63] and got[1, 0, 0] is None
    bad = spark.createDataFrame([(0, 1)], "layer int, mask int").join(params.withColumn("c", F.lit(0.0)).where("kind = 'linear'"), "mask")
    with pytest.raises(Exception, match="two different points"):
        grid.crossJoin(bad).select(m).collect()


def test_modes_side_by_side(spark, sf_dir):
    """As each mode by itself, in code that the JVM compiles: it leaves methods of 8000 bytes and more as they are."""
    rng = random.Random(4)
    m = spaces.into_working("display_p3")[2]
    df = spark.createDataFrame([(i, *[rng.uniform(-0.2, 1.4) for _ in "rgb"]) for i in range(50)], "i int, r double, g double, b double")
    found = spaces.side_by_side(df, ["i"], 2.2, m)
    got = {(r["mode"], r["i"]): (r["r"], r["g"], r["b"]) for r in found.collect()}
    want = {(n, r["i"]): (r["r"], r["g"], r["b"]) for n in spaces.MODES for r in spaces.transformed(df, n, 2.2, m).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12, equal_nan=True) for k in want)
    query = colors.QUERIES["px_transform_modes"](spark, sf_dir)
    code = query._jdf.queryExecution().explainString(query._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
