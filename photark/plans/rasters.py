"""Registered queries on sizes of rasters and on masks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.functions import masks
from photark.functions.numeric import rounded
from photark.operators import resize
from photark.plans.images import RASTER, height
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


SIZED = RASTER + ", n AS (SELECT max(y) + 1 AS h FROM f)"


@query(SIZED + """, z AS (SELECT h, least(40.0 / 100, 60.0 / h, 1.0) AS s FROM n), q AS (SELECT h, greatest(1, floor(100 * s + 0.5))::INTEGER AS tw, greatest(1, floor(h * s + 0.5))::INTEGER AS th FROM z),
xs AS (SELECT i::INTEGER AS tx, (i * 100 // tw)::INTEGER AS x FROM q, range(100) r(i) WHERE i < tw), ys AS (SELECT i::INTEGER AS ty, (i * h // th)::INTEGER AS y FROM q, range(100) r(i) WHERE i < th)
SELECT tx AS x, ty AS y, round(v, 9) + 0.0 AS v FROM xs, ys JOIN f ON f.x = xs.x AND f.y = ys.y""")
def mask_thumbnail(spark, sf_dir) -> DataFrame:
    f = t.raster(spark, sf_dir)
    return resize.thumbnail(f, 100, height(f), 40, 60).select("x", "y", rounded(F.col("v"), 9).alias("v"))


@query(SIZED + """, xs AS (SELECT i::INTEGER AS tx, floor(least(greatest((i + 0.5) / 150 * 60.5 + 9.5, 0.0), 99.0) + 0.5)::INTEGER AS x FROM range(150) r(i)),
ys AS (SELECT i::INTEGER AS ty, floor(least(greatest((i + 0.5) / 7 * 9.0 + 1.75, 0.0), h - 1.0) + 0.5)::INTEGER AS y FROM n, range(7) r(i))
SELECT tx AS x, ty AS y, round(v, 9) + 0.0 AS v FROM xs, ys JOIN f ON f.x = xs.x AND f.y = ys.y""")
def mask_region(spark, sf_dir):
    """A part of a mask, wider and lower than it is there."""
    f = t.raster(spark, sf_dir)
    return resize.region(f, (100, height(f)), (150, 7), (10.0, 2.25, 60.5, 9.0)).select("x", "y", rounded(F.col("v"), 9).alias("v"))


def filter_sql(name: str, n: str, into: str, count: int) -> str:
    """A table of the new places t, the old ones o and their weights w."""
    middle = f"(i + 0.5) * ({n})::DOUBLE / ({into}) - 0.5"
    wide = f"greatest(({n})::DOUBLE / ({into}), 1.0)"
    return f"{name} AS (SELECT i::INTEGER AS t, o::INTEGER AS o, 1 - abs({middle} - o) / {wide} AS w FROM n, range({count}) a(i), range(100000) b(o) WHERE i < {into} AND o < {n} AND abs({middle} - o) < {wide})"


@query(SIZED.replace("max(y) + 1 AS h", "max(y) + 1 AS h, CASE WHEN max(y) + 1 <= 64 AND 100 <= 64 THEN 100 ELSE greatest(1, floor(100 * 64.0 / greatest(100, max(y) + 1) + 0.5)) END::INTEGER AS tw, greatest(1, floor((max(y) + 1) * 64.0 / greatest(100, max(y) + 1) + 0.5))::INTEGER AS th")
       + ", " + filter_sql("xs", "100", "tw", 64) + ", " + filter_sql("ys", "h", "th", 64) + """
SELECT xs.t AS x, ys.t AS y, round(sum(xs.w * ys.w * v) / sum(xs.w * ys.w), 6) + 0.0 AS v FROM f JOIN xs ON f.x = xs.o JOIN ys ON f.y = ys.o GROUP BY 1, 2""")
def preview_triangle(spark, sf_dir):
    """The raster with a longer edge of 64 pixels."""
    f = t.raster(spark, sf_dir)
    h = height(f)
    w2, h2 = resize.within(100, h, 64)
    out = resize.triangle(f, F.lit(100), F.lit(h), F.lit(w2), F.lit(h2), ["v"])
    return out.select("x", "y", rounded(F.col("v")).alias("v"))


def pictures(spark, sf_dir) -> DataFrame:
    """Vectors as pictures 8 wide: image, x, y and bytes r, g, b, and the height."""
    e = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.expr("size(embedding) div 8").alias("h"), F.posexplode("embedding").alias("at", "v"))
    byte = lambda k: F.floor(F.least(F.greatest(F.col("v").cast("double") * k + 0.5, F.lit(0.0)), F.lit(1.0)) * 255)
    return e.where("at < 8 * h").select("image", "h", (F.col("at") % 8).alias("x"), F.expr("at div 8").alias("y"), byte(1.0).alias("r"), byte(2.0).alias("g"), byte(-1.0).alias("b"))


_byte = lambda k: f"floor(least(greatest(v::DOUBLE * {k} + 0.5, 0.0), 1.0) * 255)"


@query(f"""WITH e AS (SELECT vec_id AS image, unnest(embedding) AS v, unnest(range(len(embedding))) AS i, len(embedding) // 8 AS h FROM embeddings),
f AS (SELECT image, i % 8 AS x, i // 8 AS y, {_byte('1.0')} AS r, {_byte('2.0')} AS g, {_byte('-1.0')} AS b FROM e WHERE i < 8 * h), n AS (SELECT 8 AS h),
""" + filter_sql("xs", "8", "5", 5) + ", " + filter_sql("ys", "h", "5", 5) + """,
s AS (SELECT image, xs.t AS x, ys.t AS y, sum(xs.w * ys.w * r) / sum(xs.w * ys.w) AS r, sum(xs.w * ys.w * g) / sum(xs.w * ys.w) AS g, sum(xs.w * ys.w * b) / sum(xs.w * ys.w) AS b FROM f JOIN xs ON f.x = xs.o JOIN ys ON f.y = ys.o GROUP BY 1, 2, 3)
SELECT image, channel, channel * 25 + y * 5 + x AS "at", round((round(round(c, 6)) / 255 - 0.5) / 0.5, 6) + 0.0 AS value FROM (SELECT image, x, y, 0 AS channel, r AS c FROM s UNION ALL SELECT image, x, y, 1, g FROM s UNION ALL SELECT image, x, y, 2, b FROM s)""")
def tagger_input(spark, sf_dir):
    """Vectors as pictures of 8 x 8, as a tagger for 5 x 5 takes them."""
    out = resize.model_input(pictures(spark, sf_dir), "image", F.lit(8), F.lit(8), 5)
    return out.select("image", "channel", "at", rounded(F.col("value")).alias("value"))


def stamp_sql(source: str, name: str, cx: float, cy: float, radius: float, softness: float, erase: bool) -> str:
    core = radius * (1 - softness)
    alpha = f"CASE WHEN far <= {core * core}::DOUBLE THEN 1.0 ELSE 0.5 * (1 + cos((sqrt(far) - {core}) / ({radius} - {core}) * pi())) END"
    new = f"least(m, floor((1 - {alpha}) * 255)::INTEGER)" if erase else f"greatest(m, floor(({alpha}) * 255)::INTEGER)"
    return f", {name}0 AS (SELECT x, y, m, pow(x + 0.5 - {cx}, 2.0::DOUBLE) + pow(y + 0.5 - {cy}, 2.0::DOUBLE) AS far FROM {source}), {name} AS (SELECT x, y, CASE WHEN far <= {radius * radius}::DOUBLE THEN {new} ELSE m END AS m FROM {name}0)"


STAMPS = [(30.2, 6.7, 12.5, 0.5, False), (36.0, 8.0, 6.0, 1.0, True), (60.0, 5.0, 9.0, 0.25, False)]


@query(RASTER + ", s AS (SELECT x, y, floor(v * 40)::INTEGER AS m FROM f)" + stamp_sql("s", "a", *STAMPS[0]) + stamp_sql("a", "b", *STAMPS[1]) + stamp_sql("b", "c", *STAMPS[2]) + " SELECT x, y, m FROM c")
def mask_stamps(spark, sf_dir):
    """Two strokes painted over a mask, and one between them that erases."""
    f = t.raster(spark, sf_dir).select("x", "y", F.floor(F.col("v") * 40).cast("int").alias("m"))
    return f.select("x", "y", masks.stamped(F.col("m"), F.col("x"), F.col("y"), STAMPS).alias("m"))


def pen_sql(source: str, name: str, cx: float, cy: float, radius: float, hardness: float, pressure: float, erase: bool) -> str:
    t = f"greatest(least(({radius} - sqrt((x - {cx})::DOUBLE * (x - {cx}) + (y - {cy})::DOUBLE * (y - {cy}))) / {radius - radius * hardness}, 1.0), 0.0)"
    new = f"m {'-' if erase else '+'} t * t * (3 - 2 * t) * {pressure}"
    return f", {name}0 AS (SELECT x, y, m, {t} AS t FROM {source}), {name} AS (SELECT x, y, {f'greatest(0.0, {new})' if erase else f'least(1.0, {new})'} AS m FROM {name}0)"


PEN = [(20.0, 5.0, 15.0, 0.5, 0.7, False), (26.0, 6.0, 8.0, 0.25, 0.5, True), (30.0, 8.0, 12.0, 0.5, 0.6, False)]


@query(RASTER + ", s AS (SELECT x, y, 0.0::DOUBLE AS m FROM f)" + pen_sql("s", "a", *PEN[0]) + pen_sql("a", "b", *PEN[1]) + pen_sql("b", "c", *PEN[2]) + " SELECT x, y, round(m, 6) + 0.0 AS m FROM c")
def mask_strokes(spark, sf_dir):
    """A pen's strokes on an empty mask, the second one erasing."""
    f = t.raster(spark, sf_dir)
    return f.select("x", "y", rounded(masks.strokes(F.lit(0.0), F.col("x"), F.col("y"), PEN)).alias("m"))


@query(RASTER + """, k AS (SELECT n_nationkey AS layer, n_nationkey % 8 AS mask FROM nation WHERE n_nationkey < 12),
q AS (SELECT r_regionkey AS mask, CASE r_regionkey % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'radial' ELSE 'brush' END AS kind, 10.0::DOUBLE + r_regionkey * 5 AS a, 4.0::DOUBLE AS b, 30.0::DOUBLE + r_regionkey AS c, 9.0::DOUBLE AS d FROM region)
SELECT layer, q.mask, x, y, CASE kind WHEN 'linear' THEN floor(greatest(least(((x + 0.5 - a) * (c - a) + (y + 0.5 - b) * (d - b)) / ((c - a) * (c - a) + (d - b) * (d - b)), 1.0), 0.0) * 255)
WHEN 'radial' THEN floor(greatest(least(1 - sqrt((x + 0.5 - a) * (x + 0.5 - a) + (y + 0.5 - b) * (y + 0.5 - b)) / c, 1.0), 0.0) * 255) WHEN 'brush' THEN CASE WHEN x < a AND y * a + x < 40 THEN 65 + (y * a + x) % 4 END END::INTEGER AS m
FROM k LEFT JOIN q USING (mask), f""")
def masks_restored(spark, sf_dir):
    """Masks of layers made again from saved parameters, pixel by pixel; layers whose mask isn't saved have none."""
    layers = t.table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").alias("layer"), (F.col("n_nationkey") % 8).alias("mask"))
    k = F.col("r_regionkey")
    kind = F.when(k % 3 == 0, "linear").when(k % 3 == 1, "radial").otherwise("brush")
    params = t.table(spark, sf_dir, "region").select(k.alias("mask"), kind.alias("kind"), (10.0 + k * 5).alias("a"), F.lit(4.0).alias("b"), (30.0 + k).alias("c"), F.lit(9.0).alias("d"), F.lit(b"ABCD" * 10).alias("bytes"))
    held = masks.restored(layers, params)
    drawn = masks.drawn(*[F.col(c) for c in ("kind", "a", "b", "c", "d", "bytes", "x", "y")], 100)
    return t.raster(spark, sf_dir).crossJoin(F.broadcast(held)).select("layer", "mask", "x", "y", drawn.alias("m"))
