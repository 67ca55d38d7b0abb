"""Registered queries that render layer stacks: one with SQL, one with every adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.functions.numeric import rounded
from photark.operators import stack as st
from photark.plans.images import CURVE, HSL, RASTER, TONE, K, _by, _h, _hl, _share, color_sql, height, rgb_sql, smooth, tone_sql
from photark.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}

COLOR = {"saturation": 1.2, "vibrancy": 0.3, "temperature": 0.4, "tint": -0.2}
POINTS = [(0, 0.05), (64, 0.2), (128, 0.55), (200, 0.9)]
SHARP = {"amount": 0.8, "threshold": 0.05}
VIGNETTE = {"amount": 0.6, "midpoint": 0.4, "feather": 0.3, "roundness": 0.9}
RECT = {"x": 10, "y": 2, "width": 60, "height": 10}

FULL = {
    "layers": [
        {"image": "raster"},
        {"ops": [{"Tone": TONE}, {"Curves": {"master": POINTS}}], "mask": "slope", "opacity": 0.8},
        {"ops": [{"Glow": {"amount": 1.0}}], "visible": False},
        {"ops": [{"Hsl": HSL}, {"Tone": {"gamma": 1.0}}, {"Sharpen": SHARP}, {"Color": COLOR}], "opacity": 0.5, "blend_mode": "soft_light"},
        {"crop": RECT},
        {"ops": [{"Vignette": VIGNETTE}], "mask": "spot"},
        {"ops": []},
    ],
    "masks": {"slope": {"linear": [12.0, 0.0, 60.0, 8.0]}, "spot": {"radial": [40.0, 6.0, 30.0]}},
}


def source(spark, sf_dir) -> dict:
    f = t.raster(spark, sf_dir)
    df = f.select("x", "y", F.col("v").alias("r"), (F.col("v") * 0.9).alias("g"), (F.col("v") * 0.8 + 0.05).alias("b"))
    return {"raster": (df, 100, height(f))}


def stack_full(spark, sf_dir) -> DataFrame:
    """Image, adjustments under a mask and a blend mode, a crop and a vignette, as exported."""
    s = source(spark, sf_dir)
    out = st.render(FULL, s, 100, s["raster"][2])
    return out.select("x", "y", *[rounded(F.col(c), 5).alias(c) for c in "rgba"])


QUERIES["stack_full"] = stack_full

KEPT = "x, y, a, b_r, b_g, b_b, b_a"


def over(source: str, name: str, mode: str, opacity: str) -> str:
    """Puts r, g, b over b_r, b_g, b_b."""
    mixed = {"normal": "$", "soft_light": "CASE WHEN $ > 0.5 THEN b_$ + ($ * 2 - 1) * (sqrt(b_$) - b_$) ELSE b_$ - (1 - $ * 2) * b_$ * (1 - b_$) END"}[mode]
    rgb = ", ".join(f"b_{c} * (1 - a * {opacity}) + ({mixed.replace('$', c)}) * (a * {opacity}) AS {c}" for c in "rgb")
    return f", {name} AS (SELECT x, y, {rgb}, b_a * (1 - a * {opacity}) + a * (a * {opacity}) AS a FROM {source}), {name}u AS (SELECT *, r AS b_r, g AS b_g, b AS b_b, a AS b_a FROM {name})"


def _sql() -> str:
    out = RASTER.replace("v FROM orders", "v FROM orders WHERE (o_orderkey % 100) BETWEEN 10 AND 69 AND o_orderkey // 100 BETWEEN 2 AND 11")
    out += ", p AS (SELECT x - 10 AS x, y - 2 AS y, v AS r, v * 0.9 AS g, v * 0.8 + 0.05 AS b, 1.0::DOUBLE AS a FROM f), pu AS (SELECT *, r AS b_r, g AS b_g, b AS b_b, a AS b_a FROM p)"
    tone, last = tone_sql("pu", "t", **TONE)
    out += tone.replace(K, KEPT)
    table = "[" + ", ".join(map(repr, CURVE)) + "]"
    at = "(greatest(least(floor($ * 255), 254), 0))::INTEGER"
    curve = ", ".join(f"t[{at} + 1] + (t[{at} + 2] - t[{at} + 1]) * ($ * 255 - {at}) AS $".replace("$", c) for c in "rgb")
    out += f", l AS (SELECT {table}::DOUBLE[] AS t), c AS (SELECT {KEPT}, {curve} FROM {last}, l)"
    slope = "floor(greatest(least(((x + 10 + 0.5 - 12.0) * 48.0 + (y + 2 + 0.5) * 8.0) / 2368.0, 1.0), 0.0) * 255) / 255.0 * 0.8"
    out += over("c", "o1", "normal", slope)
    hues = _h.replace("FROM p)", "FROM o1u)")
    by = HSL
    shift = [_by(*[by[c][i] for c in ("red", "green", "blue")]) for i in range(3)]
    out += hues + f", s AS (SELECT *, {_share(0.0)} AS sr, {_share(1 / 3)} AS sg, {_share(2 / 3)} AS sb FROM {_hl})"
    out += f", ha AS (SELECT {KEPT}, hdr, hue + {shift[0]} * 0.5 - floor(hue + {shift[0]} * 0.5) AS hue, greatest(least(sat + {shift[1]}, 1.0), 0.0) AS sat, greatest(least(light * pow(2.0, {shift[2]}), 1.0), 0.0) AS light FROM s)"
    out += rgb_sql("ha", "h").replace(K, KEPT)
    taps = "(VALUES (-3, 1.0), (-2, 2.0), (-1, 3.0), (0, 4.0), (1, 3.0), (2, 2.0), (3, 1.0)) k(d, w)"
    sums = ", ".join(f"sum(q.{c} * w::DOUBLE) / 16 AS {c}" for c in "rgb")
    out += f", sh AS (SELECT e.x, e.y, {sums} FROM h e, {taps} JOIN h q ON q.x = least(greatest(e.x + d, 0), 59) AND q.y = e.y GROUP BY 1, 2), sv AS (SELECT e.x, e.y, {sums} FROM sh e, {taps} JOIN sh q ON q.x = e.x AND q.y = least(greatest(e.y + d, 0), 9) GROUP BY 1, 2)"
    edge = "sqrt((h.r - sv.r) * (h.r - sv.r) + (h.g - sv.g) * (h.g - sv.g) + (h.b - sv.b) * (h.b - sv.b))"
    kept = ", ".join(f"h.{c.strip()}" for c in KEPT.split(","))
    out += f", se AS (SELECT {kept}, least({edge} / 0.051, 1.0) AS e, {', '.join(f'h.{c} AS {c}, h.{c} - sv.{c} AS d{c}' for c in 'rgb')} FROM h JOIN sv USING (x, y)), sp AS (SELECT {KEPT}, {', '.join(f'{c} + d{c} * (e * e * (3 - 2 * e)) * 0.8 AS {c}' for c in 'rgb')} FROM se)"
    colors, last = color_sql("sp", "w", **COLOR)
    out += colors.replace(K, KEPT) + over(last, "o2", "soft_light", "0.5")
    far = "sqrt(pow((x / 60.0::DOUBLE - 0.5) * 0.9, 2) + pow(y / 10.0::DOUBLE - 0.5, 2))"
    out += f", v AS (SELECT {KEPT}, {', '.join(f'{c} * (1 - {smooth(0.4 - 0.3, 0.4 + 0.3, far)} * 0.6) AS {c}' for c in 'rgb')} FROM o2u)"
    out += over("v", "o3", "normal", "(floor(greatest(least(1 - sqrt(pow(x + 10.5 - 40.0, 2) + pow(y + 2.5 - 6.0, 2)) / 30.0, 1.0), 0.0) * 255) / 255.0)")
    return out + " SELECT x, y, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in "rgba") + " FROM o3"


SQL["stack_full"] = _sql()

EVERY = {
    "layers": [
        {"image": "raster"},
        {"ops": [{"Denoise": {"luma": 0.3, "chroma": 0.3, "mode": "bilateral"}}, {"Tone": TONE}, {"Curves": {"master": POINTS}}, {"LsCurve": {"master": POINTS}}, {"Hsl": HSL}, {"Color": COLOR}], "mask": "slope"},
        {"ops": [{"Glow": {"amount": 0.3}}, {"Sharpen": SHARP}, {"Vignette": VIGNETTE}, {"Grain": {"amount": 0.5, "size": 2.0, "roughness": 0.5, "seed": 3.0}}], "opacity": 0.7},
        {"crop": {"x": 20, "y": 3, "width": 50, "height": 9, "rotation": 0.05}, "opacity": 0.25},
    ],
    "masks": {"slope": {"linear": [12.0, 0.0, 60.0, 8.0]}},
}


def stack_every_op(spark, sf_dir) -> DataFrame:
    """All ten adjustments, a mask and a turned crop, over the whole raster."""
    s = source(spark, sf_dir)
    h = s["raster"][2]
    view = st.View(0, 0, 100, h, 100, h, (0, 0, 100, h))
    return st.render(EVERY, s, 100, h, view=view).select("x", "y", "r", "g", "b")


QUERIES["stack_every_op"] = stack_every_op
