"""Registered image and tagging queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photark.functions import color, hsl
from photark.functions.numeric import rounded
from photark.operators import raster, tagging, tiles
from photark.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
K = ", ".join(KEY)
PIXELS = f"WITH p AS (SELECT {K}, l_discount * 5 + 0.0::DOUBLE AS r, l_tax * 5 + 0.0::DOUBLE AS g, l_quantity / 50 AS b FROM lineitem)"
LUMA = "(r * 0.2722287 + g * 0.6740818 + b * 0.0536895)"


def step(name: str, source: str, carry: str = "", **made: str) -> str:
    """One more CTE with columns r, g, b (and others) replaced or added, and those in carry kept."""
    keep = [c for c in ("r", "g", "b") if c not in made] + ([carry] if carry else [])
    return f", {name} AS (SELECT {', '.join([K, *keep, *[f'{v} AS {k}' for k, v in made.items()]])} FROM {source})"


def every(pattern: str) -> dict[str, str]:
    return {c: pattern.replace("$", c) for c in "rgb"}


def smooth(a: float, b: float, x: str) -> str:
    t = f"greatest(least(({x} - {a}) / ({b} - {a}), 1.0), 0.0)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def final(source: str) -> str:
    return f" SELECT {K}, round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(b, 6) + 0.0 AS b FROM {source}"


def shown(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[rounded(F.col(c)).alias(c) for c in "rgb"])


def tone_sql(source: str, prefix: str, exposure, contrast, blacks, whites, shadows, highlights, gamma) -> tuple[str, str]:
    steps = [
        f"{exposure * 0.05707}", f"({LUMA} - 0.4136) * {contrast}", f"(1 - {smooth(0.0, 0.4136, LUMA)}) * {blacks}",
        f"{smooth(0.4136, 0.6, LUMA)} * {whites}", f"(1 - {smooth(0.05, 0.38, LUMA)}) * {shadows * 0.05707}", f"{smooth(0.45, 0.65, LUMA)} * {-highlights * 0.05707}",
    ]
    out = ""
    for i, s in enumerate(steps):
        out += step(f"{prefix}{i}", source, **every(f"$ + {s}"))
        source = f"{prefix}{i}"
    out += step(f"{prefix}g", source, **every(f"sign($ / 0.4136) * pow(abs($ / 0.4136) + 1e-7, {gamma}) * 0.4136"))
    return out, f"{prefix}g"


TONE = {"exposure": 0.5, "contrast": 0.2, "blacks": 0.05, "whites": -0.04, "shadows": 0.6, "highlights": 0.4, "gamma": 1.1}
_sql, _last = tone_sql("p", "t", **TONE)


@query(PIXELS + _sql + final(_last))
def px_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(color.tone(t.pixels(spark, sf_dir), **TONE))


DECODE = "CASE WHEN $ < 0.1552511416 THEN ($ - 0.0729055342) / 10.5402377417 ELSE pow(2.0, $ * 17.52 - 9.72) END"
ENCODE = "CASE WHEN $ <= 0.0078125 THEN $ * 10.5402377417 + 0.0729055342 ELSE (log2(greatest($, 1.1754944e-38)) + 9.72) / 17.52 END"
STEP = 0.5 / 17.52


def color_sql(source: str, prefix: str, saturation, vibrancy, temperature, tint, carry: str = "") -> tuple[str, str]:
    tt, m = temperature * STEP, tint * STEP
    out = step(f"{prefix}0", source, carry, r=f"r + {tt + m / 2}", g=f"g - {m}", b=f"b + {m / 2 - tt}")
    out += step(f"{prefix}1", f"{prefix}0", carry, **every(DECODE))
    out += step(f"{prefix}2", f"{prefix}1", carry, **every(f"greatest({LUMA} + ($ - {LUMA}) * {saturation}, 0.0)"))
    vivid = "CASE WHEN greatest(r, g, b) <= 1e-6 THEN 0.0 ELSE greatest(least((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 1.0), 0.0) END"
    out += step(f"{prefix}3", f"{prefix}2", carry, **every(f"{LUMA} + ($ - {LUMA}) * greatest(0.0, 1 + (1 - {vivid}) * {vibrancy})"))
    out += step(f"{prefix}4", f"{prefix}3", carry, **every(ENCODE))
    return out, f"{prefix}4"


COLOR = {"saturation": 1.3, "vibrancy": 0.4, "temperature": 0.6, "tint": -0.3}
_csql, _clast = color_sql("p", "c", **COLOR)


@query(PIXELS + _csql + final(_clast))
def px_color(spark, sf_dir):
    return shown(color.color(t.pixels(spark, sf_dir), **COLOR))


CURVE = color.curve_lut([(0, 0.05), (64, 0.2), (128, 0.55), (200, 0.9)])
_table = "[" + ", ".join(map(repr, CURVE)) + "]"
_at = "(greatest(least(floor($ * 255), 254), 0))::INTEGER"


@query(PIXELS + f", l AS (SELECT {_table}::DOUBLE[] AS t)" + step("u", "p, l", **every(f"t[{_at} + 1] + (t[{_at} + 2] - t[{_at} + 1]) * ($ * 255 - {_at})")) + final("u"))
def px_curves(spark, sf_dir):
    return shown(color.curves(t.pixels(spark, sf_dir), CURVE))


@query(PIXELS + step("l", "p", **every(DECODE)) + f" SELECT {K}, round(r, 6) + 0.0 AS linear_r, round({ENCODE.replace('$', 'r')}, 6) + 0.0 AS r FROM l")
def px_transform_acescct(spark, sf_dir):
    p = t.pixels(spark, sf_dir).withColumn("linear", color.decode(F.col("r")))
    return p.select(*KEY, rounded(F.col("linear")).alias("linear_r"), rounded(color.encode(F.col("linear"))).alias("r"))


@query(PIXELS + f" SELECT {K}, round(CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE 1.055 * pow(x, 1 / 2.4) - 0.055 END, 6) + 0.0 AS r FROM (SELECT *, greatest(least(r, 1.0), 0.0) AS x FROM p)")
def px_transform_srgb(spark, sf_dir):
    return t.pixels(spark, sf_dir).select(*KEY, rounded(color.srgb_encode(F.col("r"))).alias("r"))


def hsl_sql(source: str, prefix: str) -> tuple[str, str]:
    """CTEs that add hdr, hue, sat and light, and the name of the last."""
    out = f", {prefix}0 AS (SELECT *, greatest(r, g, b, 1.0) AS hdr FROM {source}), {prefix}1 AS (SELECT *, greatest(r, g, b) / hdr AS mx, least(r, g, b) / hdr AS mn FROM {prefix}0)"
    hue = "CASE WHEN mx = r / hdr THEN (g - b) / hdr / (mx - mn) + CASE WHEN g >= b THEN 0 ELSE 6 END WHEN mx = g / hdr THEN (b - r) / hdr / (mx - mn) + 2 ELSE (r - g) / hdr / (mx - mn) + 4 END"
    out += f", {prefix}2 AS (SELECT *, (mx + mn) / 2 AS light, CASE WHEN mx - mn < 0.0001 THEN 0.0 WHEN (mx + mn) / 2 < 0.5 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END AS sat, CASE WHEN mx - mn < 0.0001 THEN 0.0 ELSE ({hue}) / 6 END AS hue FROM {prefix}1)"
    return out, f"{prefix}2"


def rgb_sql(source: str, name: str) -> str:
    span = "(CASE WHEN sat < 0.0001 THEN 0.0 ELSE sat * least(light, 1 - light) END)"
    one = lambda n: f"(light - {span} * greatest(-1.0, least((hue * 12 + {n}) % 12 - 3, 9 - (hue * 12 + {n}) % 12, 1.0))) * hdr"
    return f", {name} AS (SELECT {K}, {one(0)} AS r, {one(8)} AS g, {one(4)} AS b FROM {source})"


_h, _hl = hsl_sql("p", "h")
_share = lambda c: f"(greatest(0.0, 1 - least(abs(hue - {c}), 1 - abs(hue - {c})) * 3) * {smooth(0.0, 0.05, 'sat')})"
_by = lambda a, b, c: f"(sr * {a} + sg * {b} + sb * {c})"
HSL = {"red": (0.2, -0.3, 0.1), "green": (-0.4, 0.2, -0.2), "blue": (0.1, 0.4, 0.3)}


@query(PIXELS + _h + f", s AS (SELECT *, {_share(0.0)} AS sr, {_share(1 / 3)} AS sg, {_share(2 / 3)} AS sb FROM {_hl})"
       + f", a AS (SELECT {K}, hdr, hue + {_by(0.2, -0.4, 0.1)} * 0.5 - floor(hue + {_by(0.2, -0.4, 0.1)} * 0.5) AS hue, greatest(least(sat + {_by(-0.3, 0.2, 0.4)}, 1.0), 0.0) AS sat, greatest(least(light * pow(2.0, {_by(0.1, -0.2, 0.3)}), 1.0), 0.0) AS light FROM s)"
       + rgb_sql("a", "o") + final("o"))
def px_hsl(spark, sf_dir):
    return shown(hsl.balance(t.pixels(spark, sf_dir), **HSL))


_la = "(greatest(least(floor(light * 255), 254), 0))::INTEGER"


@query(PIXELS + _h + f", l AS (SELECT {_table}::DOUBLE[] AS t), a AS (SELECT {K}, hdr, hue, light, greatest(least(sat * (t[{_la} + 1] + (t[{_la} + 2] - t[{_la} + 1]) * (light * 255 - {_la})), 1.0), 0.0) AS sat FROM {_hl}, l)" + rgb_sql("a", "o") + final("o"))
def px_lscurve(spark, sf_dir):
    return shown(hsl.saturation_curve(t.pixels(spark, sf_dir), CURVE))


WIDE = color.wide_curve_lut([(40, 1.6), (128, 0.4), (220, 2.5)])
_wide = "[" + ", ".join(map(repr, WIDE)) + "]"


@query(PIXELS + _h + f", l AS (SELECT {_wide}::DOUBLE[] AS t), a AS (SELECT {K}, hdr, hue, light, greatest(least(sat * (t[{_la} + 1] + (t[{_la} + 2] - t[{_la} + 1]) * (light * 255 - {_la})), 1.0), 0.0) AS sat FROM {_hl}, l)" + rgb_sql("a", "o") + final("o"))
def px_lscurve_wide(spark, sf_dir):
    """Saturation by an editor's table, which goes up to twice."""
    return shown(hsl.saturation_curve(t.pixels(spark, sf_dir), WIDE))


RASTER = "WITH f AS (SELECT (o_orderkey % 100)::INTEGER AS x, (o_orderkey // 100)::INTEGER AS y, o_totalprice / 500000 AS v FROM orders)"


def height(df: DataFrame) -> int:
    return (df.agg(F.max("y")).first()[0] or 0) + 1


@query(RASTER + ", n AS (SELECT max(y) + 1 AS h FROM f), d AS (SELECT x, y, v, sqrt((x / 100.0::DOUBLE - 0.5) * 0.8 * ((x / 100.0::DOUBLE - 0.5) * 0.8) + (y / h::DOUBLE - 0.5) * (y / h::DOUBLE - 0.5)) AS d FROM f, n) SELECT x, y, round(v * (1 - " + smooth(0.3, 0.7, "d") + " * 0.7), 9) + 0.0 AS v FROM d")
def px_vignette(spark, sf_dir):
    f = t.raster(spark, sf_dir)
    return f.select("x", "y", rounded(color.vignette(F.col("v"), F.col("x"), F.col("y"), 100, height(f), 0.7, roundness=0.8), 9).alias("v"))


@query(RASTER + " SELECT x, y, floor(greatest(least(((x + 0.5 - 10.0) * 70.0 + (y + 0.5 - 20.0) * 40.0) / 6500.0, 1.0), 0.0) * 255)::INTEGER AS m FROM f")
def mask_linear(spark, sf_dir):
    return t.raster(spark, sf_dir).select("x", "y", color.linear_mask(F.col("x"), F.col("y"), 10.0, 20.0, 80.0, 60.0).alias("m"))


@query(RASTER + " SELECT x, y, floor(greatest(least(1 - sqrt((x + 0.5 - 50.0) * (x + 0.5 - 50.0) + (y + 0.5 - 40.0) * (y + 0.5 - 40.0)) / 37.0, 1.0), 0.0) * 255)::INTEGER AS m FROM f")
def mask_radial(spark, sf_dir):
    return t.raster(spark, sf_dir).select("x", "y", color.radial_mask(F.col("x"), F.col("y"), 50.0, 40.0, 37.0).alias("m"))


BLENDS = {
    "normal": "x", "multiply": "b * x", "screen": "1 - (1 - b) * (1 - x)", "overlay": "CASE WHEN b > 0.5 THEN 1 - (1 - b) * (1 - x) * 2 ELSE b * x * 2 END",
    "soft_light": "CASE WHEN x > 0.5 THEN b + (x * 2 - 1) * (sqrt(b) - b) ELSE b - (1 - x * 2) * b * (1 - b) END",
}
_lift = "((g * 0.299 + b * 0.587 + r * 0.114) - (r * 0.299 + g * 0.587 + b * 0.114))"


@query(PIXELS + " " + " UNION ALL ".join(
    [f"SELECT {K}, '{m}' AS mode, round(b * 0.4 + ({e}) * 0.6, 6) + 0.0 AS r FROM (SELECT {K}, r AS b, g AS x FROM p)" for m, e in BLENDS.items()]
    + [f"SELECT {K}, 'luminosity' AS mode, round(r * 0.4 + (r + {_lift}) * 0.6, 6) + 0.0 AS r FROM p"]
))
def composite_blend_modes(spark, sf_dir):
    p = t.pixels(spark, sf_dir)
    base, layer = tuple(map(F.col, "rgb")), tuple(map(F.col, "gbr"))
    modes = [*BLENDS, "luminosity"]
    values = F.create_map(*[x for m in modes for x in (F.lit(m), rounded(color.composite(base, layer, m, 0.6)[0]))])
    return p.select(*KEY, F.explode(values).alias("mode", "r"))


STACK = '{"layers": [{"ops": [{"Tone": {"exposure": 0.4, "contrast": 0.1}}]}, {"ops": [{"Color": {"saturation": 0.5}}], "visible": false}, {"ops": [{"Color": {"saturation": 1.2, "vibrancy": 0.3}}], "opacity": 0.5, "blend_mode": "normal"}]}'
_s1, _l1 = tone_sql("p", "s", 0.4, 0.1, 0.0, 0.0, 0.0, 0.0, 1.0)
_base = step("sb", _l1, base_r="r", base_g="g", base_b="b")
_s2, _l2 = color_sql("sb", "w", 1.2, 0.3, 0.0, 0.0, carry="base_r, base_g, base_b")


@query(PIXELS + _s1 + _base + _s2 + step("m", _l2, **every("base_$ * 0.5 + $ * 0.5")) + final("m"))
def stack_render(spark, sf_dir):
    return shown(raster.render(t.pixels(spark, sf_dir), STACK))


@query(RASTER + ", n AS (SELECT max(y) + 1 AS h FROM f), o AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) SELECT c.x, c.y, round(avg(s.v), 9) + 0.0 AS v FROM f c, o, n JOIN f s ON s.x = least(greatest(c.x + dx, 0), 99) AND s.y = least(greatest(c.y + dy, 0), h - 1) GROUP BY 1, 2")
def stencil_box(spark, sf_dir):
    f = t.raster(spark, sf_dir)
    out = raster.stencil(f, raster.box(), 100, height(f), "v", "mean")
    return out.select("x", "y", rounded(F.col("mean"), 9).alias("v"))


_taps = "(VALUES (-3, 1.0), (-2, 2.0), (-1, 3.0), (0, 4.0), (1, 3.0), (2, 2.0), (3, 1.0)) k(d, w)"


@query(RASTER + f", n AS (SELECT max(y) + 1 AS h FROM f), a AS (SELECT c.x, c.y, sum(s.v * w::DOUBLE) / 16 AS v FROM f c, {_taps} JOIN f s ON s.x = least(greatest(c.x + d, 0), 99) AND s.y = c.y GROUP BY 1, 2), "
       f"e AS (SELECT c.x, c.y, sum(s.v * w::DOUBLE) / 16 AS v FROM a c, {_taps}, n JOIN a s ON s.x = c.x AND s.y = least(greatest(c.y + d, 0), h - 1) GROUP BY 1, 2), "
       "m AS (SELECT f.x, f.y, f.v, f.v - e.v AS d, least(abs(f.v - e.v) / (0.1 + 0.001), 1.0) AS t FROM f JOIN e USING (x, y)) SELECT x, y, round(v + d * (t * t * (3 - 2 * t)) * 0.77, 6) + 0.0 AS v FROM m")
def stencil_sharpen(spark, sf_dir):
    f = t.raster(spark, sf_dir)
    return raster.sharpen(f, 0.77, 0.1, 100, height(f)).select("x", "y", rounded(F.col("sharp")).alias("v"))


@query(RASTER + """, n AS (SELECT max(y) AS bottom FROM f), g AS (SELECT (i % 40)::INTEGER AS ox, (i // 40)::INTEGER AS oy FROM range(1200) t(i)),
u AS (SELECT ox, oy, (ox + 0.5) / 40 * 60.0 - 30.0 AS u, (oy + 0.5) / 30 * 45.0 - 22.5 AS v FROM g),
q AS (SELECT ox, oy, greatest(least(u * cos(radians(10)) - v * sin(radians(10)) + 39.5, 99.0), 0.0) AS sx, greatest(least(u * sin(radians(10)) + v * cos(radians(10)) + 27.0, bottom::DOUBLE), 0.0) AS sy FROM u, n),
k AS (SELECT ox, oy, floor(sx)::INTEGER AS fx, floor(sy)::INTEGER AS fy, sx - floor(sx) AS tx, sy - floor(sy) AS ty FROM q),
c AS (SELECT ox, oy, least(fx + i, 99) AS x, least(fy + j, bottom) AS y, (CASE WHEN i = 1 THEN tx ELSE 1 - tx END) * (CASE WHEN j = 1 THEN ty ELSE 1 - ty END) AS w FROM k, n, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT ox AS x, oy AS y, round(sum(w * f.v), 9) + 0.0 AS v FROM c JOIN f ON c.x = f.x AND c.y = f.y GROUP BY 1, 2""")
def resample_crop_rotate(spark, sf_dir):
    f = t.raster(spark, sf_dir)
    return raster.resample(f, "v", (100, height(f)), (40, 30), (10.0, 5.0, 60.0, 45.0), 10.0).select("x", "y", rounded(F.col("v"), 9).alias("v"))


@query(PIXELS + " SELECT floor(greatest(least(r * 0.2126 + g * 0.7152 + b * 0.0722, 1.0), 0.0) * 63)::INTEGER AS bin, count(*) AS n FROM p GROUP BY 1")
def histogram_luma(spark, sf_dir):
    return raster.histogram(t.pixels(spark, sf_dir))


@query(PIXELS + _csql + f" SELECT round(max(d), 6) AS max_diff, round(avg((d > 0.05)::INTEGER), 6) AS changed_ratio FROM (SELECT greatest(abs(p.r - c.r), abs(p.g - c.g), abs(p.b - c.b)) AS d FROM p JOIN {_clast} c USING ({K}))")
def raster_diff(spark, sf_dir):
    p = t.pixels(spark, sf_dir)
    d = raster.difference(p, color.color(p, **COLOR), KEY, ["r", "g", "b"], 0.05)
    return d.select(rounded(F.col("max_diff")).alias("max_diff"), rounded(F.col("changed_ratio")).alias("changed_ratio"))


SCORES = "WITH s AS (SELECT i.vec_id AS image, p.label, max(round(1 / (1 + exp(-(list_dot_product(i.embedding::DOUBLE[], p.embedding::DOUBLE[]) * 6.0 - 1.0))), 6)) AS score FROM embeddings i, embeddings p WHERE p.vec_id < 20 GROUP BY 1, 2)"


def scores(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    prompts = e.where("vec_id < 20").select("label", F.col("embedding").alias("vector"))
    return tagging.label_scores(e.select(F.col("vec_id").alias("image"), F.col("embedding").alias("vector")), prompts, 6.0, -1.0)


ACCEPTED = SCORES + ", a AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, label) AS place FROM s WHERE score >= 0.3), k AS (SELECT * FROM a WHERE place <= 3)"


@query(SCORES + " SELECT image, label, score FROM s")
def embedding_scores(spark, sf_dir):
    return scores(spark, sf_dir)


@query(ACCEPTED + " SELECT image, label, score, place FROM k")
def zero_shot_tags(spark, sf_dir):
    return tagging.accepted(scores(spark, sf_dir), 0.3, 3)


@query(ACCEPTED + ", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY image) AS n FROM k) SELECT label, count(*) AS n, round(avg(score), 6) + 0.0 AS mean_score, max(score) AS max_score, string_agg(CASE WHEN n <= 3 THEN image::VARCHAR END, ',' ORDER BY image) AS examples FROM o GROUP BY 1")
def label_statistics(spark, sf_dir):
    return tagging.label_statistics(tagging.accepted(scores(spark, sf_dir), 0.3, 3))


def picture(spark, sf_dir):
    """The raster as a grey picture."""
    return t.raster(spark, sf_dir).select("x", "y", *[(F.col("v") * k).alias(c) for c, k in (("r", 1.0), ("g", 0.9), ("b", 0.8))])


def only(f):
    """Register a query that SQL can't express in reasonable size; its kernel has its own test."""
    QUERIES[f.__name__] = f
    return f


@only
def denoise_nlm(spark, sf_dir):
    p = picture(spark, sf_dir)
    return tiles.tiled(p, *tiles.non_local_means(0.5, 0.5), 100, height(p))


@only
def denoise_bilateral(spark, sf_dir):
    p = picture(spark, sf_dir)
    return tiles.tiled(p, *tiles.bilateral(0.5, 0.5), 100, height(p))


@only
def glow(spark, sf_dir):
    p = picture(spark, sf_dir)
    return tiles.tiled(p, *tiles.glow(0.4, 150), 100, height(p))


@only
def grain(spark, sf_dir):
    return tiles.grain(picture(spark, sf_dir), 0.8, 2.0, 0.5, 1.0)
