"""Layer stacks against their adjustments applied by hand, one after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photark.functions import color, hsl
from photark.operators import stack, tiles
from photark.plans.stacks import COLOR, EVERY, HSL, POINTS, SHARP, TONE, VIGNETTE

W, H = 40, 24


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(7).uniform(0.05, 0.9, (H, W, 3))


@pytest.fixture(scope="module")
def sources(spark, picture):
    rows = [(x, y, *map(float, picture[y, x])) for y in range(H) for x in range(W)]
    return {"p": (spark.createDataFrame(rows, "x int, y int, r double, g double, b double").repartition(3), W, H)}


def grid(df, w=W, h=H, columns="rgba"):
    out = np.full((h, w, len(columns)), np.nan)
    for r in df.collect():
        assert np.isnan(out[r["y"], r["x"], 0])
        out[r["y"], r["x"]] = [r[c] for c in columns]
    return out


def through(spark, a, f):
    """Pixels of an array after an operator on single pixels."""
    df = spark.createDataFrame([(x, y, *map(float, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "x int, y int, r double, g double, b double")
    return grid(f(df), a.shape[1], a.shape[0], "rgb")


def tile(a, made):
    border, kernel = made
    return kernel(np.pad(a, ((border, border), (border, border), (0, 0)), mode="edge"))


def bilinear(a, sx, sy):
    sx, sy = np.clip(sx, 0, a.shape[1] - 1), np.clip(sy, 0, a.shape[0] - 1)
    x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
    tx, ty = (sx - x)[..., None], (sy - y)[..., None]
    x1, y1 = np.minimum(x + 1, a.shape[1] - 1), np.minimum(y + 1, a.shape[0] - 1)
    return (a[y, x] * (1 - tx) + a[y, x1] * tx) * (1 - ty) + (a[y1, x] * (1 - tx) + a[y1, x1] * tx) * ty


VIEW = stack.View(0, 0, W, H, W, H, (0, 0, W, H))
LUT = color.curve_lut(POINTS)


def test_all_ten_adjustments_a_mask_and_a_crop_by_hand(spark, picture, sources):
    made = {"layers": [dict(EVERY["layers"][0], image="p"), *EVERY["layers"][1:]], "masks": EVERY["masks"]}
    got = grid(stack.render(made, sources, W, H, view=VIEW))
    a = tile(picture, tiles.bilateral(0.3, 0.3))
    for f in (lambda d: color.tone(d, **TONE), lambda d: color.curves(d, LUT), lambda d: hsl.saturation_curve(d, LUT), lambda d: hsl.balance(d, **HSL), lambda d: color.color(d, **COLOR)):
        a = through(spark, a, f)
    x, y = np.meshgrid(np.arange(W), np.arange(H))
    mask = np.floor(np.clip(((x + 0.5 - 12) * 48 + (y + 0.5) * 8) / (48**2 + 8**2), 0, 1) * 255)[..., None] / 255
    base = picture * (1 - mask) + a * mask
    a = tile(tile(base, tiles.glow(0.3, W)), tiles.sharpening(**SHARP))
    dist = np.hypot((x / W - 0.5) * VIGNETTE["roundness"], y / H - 0.5)
    t = np.clip((dist - 0.1) / 0.6, 0, 1)
    a = a * (1 - t * t * (3 - 2 * t) * VIGNETTE["amount"])[..., None]
    a = through(spark, a, lambda d: tiles.grain(d, 0.5, 2.0, 0.5, 3.0))
    base = base * 0.3 + a * 0.7
    c, s = math.cos(0.05), math.sin(0.05)
    px, py = x + 0.5 - 45, y + 0.5 - 7.5
    turned = bilinear(picture, 45 + px * c + py * s - 0.5, 7.5 - px * s + py * c - 0.5)
    want = base * 0.75 + turned * 0.25
    assert np.allclose(got[..., :3], want, atol=1e-9) and np.allclose(got[..., 3], 1)


def test_stages_cut_the_chain():
    ops = [{"Tone": TONE}, {"Color": COLOR}, {"Sharpen": {"amount": 0, "threshold": 0.1}}, {"Hsl": HSL}, {"Glow": {"amount": 0.2}}, {"Denoise": {"luma": 0.1}}, {"Vignette": VIGNETTE}]
    assert [(k, [n for n, _ in own]) for k, own in stack.stages(ops)] == [("pixels", ["Tone", "Color", "Hsl"]), ("tiles", ["Glow"]), ("tiles", ["Denoise"]), ("pixels", ["Vignette"])]
    with pytest.raises(ValueError, match="no adjustment Blur"):
        stack.stages([{"Blur": {}}])


def test_pixel_layers_shuffle_nothing(sources):
    made = {"layers": [{"image": "p"}, {"ops": [{"Tone": TONE}, {"Color": COLOR}], "opacity": 0.5}, {"ops": [{"Hsl": HSL}]}, {"crop": {"x": 4, "y": 2, "width": 20, "height": 10}}]}
    plan = stack.render(made, sources, W, H)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the test's own table


def test_crops(picture, sources):
    whole = {"layers": [{"image": "p"}, {"crop": {"x": 4, "y": 2, "width": 20, "height": 10}}]}
    assert np.array_equal(grid(stack.render(whole, sources, W, H), 20, 10)[..., :3], picture[2:12, 4:24])
    part = {"layers": [{"image": "p"}, {"crop": {"x": 4.5, "y": 2.25, "width": 10.4, "height": 7.6}}]}
    x, y = np.meshgrid(np.arange(10), np.arange(8))
    want = bilinear(picture, 4.5 + (x + 0.5) / 10 * 10.4 - 0.5, 2.25 + (y + 0.5) / 8 * 7.6 - 0.5)
    assert np.allclose(grid(stack.render(part, sources, W, H), 10, 8)[..., :3], want)
    hidden = {"layers": [{"image": "p"}, {"crop": {"x": 4, "y": 2, "width": 20, "height": 10}, "visible": False}]}
    assert np.array_equal(grid(stack.render(hidden, sources, W, H))[..., :3], picture)
    twice = {"layers": [*whole["layers"], {"crop": {"x": 14, "y": 0, "width": 10, "height": 7}}]}  # the view stays as large as the first one
    x, y = np.meshgrid(np.arange(20), np.arange(10))
    want = bilinear(picture[2:12, 4:24], 10 + (x + 0.5) / 2 - 0.5, (y + 0.5) / 2 - 0.5)
    assert np.allclose(grid(stack.render(twice, sources, W, H), 20, 10)[..., :3], want)
    with pytest.raises(ValueError, match="outside"):
        stack.render({"layers": [*whole["layers"], {"crop": {"x": 30, "y": 0, "width": 5, "height": 5}}]}, sources, W, H)


def test_export_sizes():
    view = stack.export_view({"layers": [{"crop": {"x": 1, "y": 2, "width": 9.5, "height": 3.4}, "visible": False}, {"crop": {"x": 90, "y": -3, "width": 10.5, "height": 3.4}}]}, W, H)
    assert (view.x, view.y, view.w, view.h, view.width, view.height) == (W - 10.5, 0, 10.5, 3.4, 11, 3)
    for bad in (0.4, math.nan, math.inf, 2.0**33):
        with pytest.raises(ValueError, match="a crop of"):
            stack.export_size(bad)


def test_layers_over_each_other(spark, picture, sources):
    small = spark.createDataFrame([(x, y, 1.0, 0.5, 0.0, 0.5 if x else 0.0) for x in range(2) for y in range(2)], "x int, y int, r double, g double, b double, a double")
    glyph = spark.createDataFrame([(1, 0.0, -1.0, 2.0, -1.0, 4.0, -1.0), (1, 4.0, -1.0, 4.0, 1.0, 4.0, 3.0), (1, 4.0, 3.0, 2.0, 3.0, 0.0, 3.0), (1, 0.0, 3.0, 0.0, 1.0, 0.0, -1.0)], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double")
    placed = spark.createDataFrame([(0, 1, 8.0, 10.0, 2.0, 0.0, 0.0, 1.0, 1.0)], "i int, glyph int, pen_x double, pen_y double, scale double, red double, green double, blue double, alpha double")
    brush = spark.createDataFrame([(3, 4, 255), (5, 6, 51)], "x int, y int, m int")
    made = {"layers": [{"image": "p"}, {"image": "small", "opacity": 2.0, "mask": "b"}, {"image": "none"}, {"text": "t", "blend_mode": "multiply"}, {"ops": [], "opacity": 0.0}], "masks": {"b": {"brush": "b"}}}
    got = grid(stack.render(made, sources | {"small": (small, 2, 2)}, W, H, {"b": brush}, {"t": (placed, glyph)}))
    x, y = np.meshgrid(np.arange(W), np.arange(H))
    top = bilinear(np.array([[[1, 0.5, 0, 0.0], [1, 0.5, 0, 0.5]]] * 2), (x + 0.5) / W * 2 - 0.5, (y + 0.5) / H * 2 - 0.5)
    m = np.zeros((H, W))
    m[4, 3], m[6, 5] = 1, 0.2
    alpha = (m * top[..., 3])[..., None]
    want = picture * (1 - alpha) + top[..., :3] * alpha
    want[4:12, 8:16] = want[4:12, 8:16] * [0, 0, 1]
    assert np.allclose(got[..., :3], want)


def test_stacks_without_a_picture(sources):
    with pytest.raises(ValueError, match="without a picture"):
        stack.render({"layers": [{"ops": [{"Tone": TONE}]}, {"image": "none"}]}, sources, W, H)
    empty = {"p": (sources["p"][0].limit(0), W, H)}
    assert stack.render({"layers": [{"image": "p"}, {"ops": [{"Sharpen": SHARP}]}]}, empty, W, H).count() == 0
    assert stack.render({"layers": [{"image": "p", "mask": "gone"}]}, sources, W, H).where(F.col("a") == 1).count() == W * H


def test_sharpening_by_hand(picture):
    taps = np.array([1, 2, 3, 4, 3, 2, 1]) / 16
    p = np.pad(picture, ((3, 3), (3, 3), (0, 0)), mode="edge")
    blur = sum(taps[i] * taps[j] * p[i : i + H, j : j + W] for i in range(7) for j in range(7))
    edge = picture - blur
    t = np.clip(np.linalg.norm(edge, axis=-1, keepdims=True) / 0.051, 0, 1)
    assert np.allclose(tile(picture, tiles.sharpening(0.8, 0.05)), picture + edge * t * t * (3 - 2 * t) * 0.8)
