"""Registered queries on outlines of text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.functions.numeric import rounded
from photark.operators import glyphs
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


CUBIC = {"x0": "(k % 7)", "y0": "(k % 11)", "x1": "(k % 101 * 3 - 50)", "y1": "(k % 89 * 4 - 150)", "x2": "(k % 53 * 5 - 100)", "y2": "(k % 97 * 2)", "x3": "(k % 211)", "y3": "(k % 13 * 20)"}


def _cubic(at: str, a: str) -> str:
    return f"(pow(1 - {at}, 3) * {a}0 + 3 * pow(1 - {at}, 2) * {at} * {a}1 + 3 * (1 - {at}) * pow({at}, 2) * {a}2 + pow({at}, 3) * {a}3)"


def _slope(at: str, a: str) -> str:
    return f"(pow(1 - {at}, 2) * ({a}1 - {a}0) + 2 * (1 - {at}) * {at} * ({a}2 - {a}1) + pow({at}, 2) * ({a}3 - {a}2))"


def _control(a: str) -> str:
    first, last = _cubic("s", a), _cubic("e", a)
    return f"(3 * ({first} + {_slope('s', a)} * (e - s) + {last} - {_slope('e', a)} * (e - s)) - {first} - {last}) / 4"


@query("WITH RECURSIVE k AS (SELECT p_partkey AS k, " + ", ".join(f"{v}::DOUBLE AS {n}" for n, v in CUBIC.items()).replace("(k %", "(p_partkey %") + """ FROM part),
h AS (SELECT k, 0 AS level, sqrt(pow(x3 - 3 * x2 + 3 * x1 - x0, 2) + pow(y3 - 3 * y2 + 3 * y1 - y0, 2)) * sqrt(3.0::DOUBLE) / 36 AS off FROM k UNION ALL SELECT k, level + 1, off / 8 FROM h WHERE off > 1.0 AND level < 10),
n AS (SELECT k, pow(2, max(level))::INTEGER AS n FROM h GROUP BY k), s AS (SELECT k.*, unnest(range(n))::INTEGER AS part, n FROM k JOIN n USING (k)), q AS (SELECT *, part / n::DOUBLE AS s, (part + 1) / n::DOUBLE AS e FROM s)
SELECT k, part""" + "".join(f", round({_cubic('s', a)}, 6) + 0.0 AS p{a}0, round({_control(a)}, 6) + 0.0 AS p{a}1, round({_cubic('e', a)}, 6) + 0.0 AS p{a}2" for a in "xy") + " FROM q")
def cubic_outlines(spark, sf_dir) -> DataFrame:
    """A cubic curve for each part, as quadratic ones."""
    k = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    cubics = k.select("k", *[F.expr(f"cast({v} as double)").alias(n) for n, v in CUBIC.items()])
    return glyphs.quadratics(cubics).select("k", "part", *[rounded(F.col(f"p{a}{i}")).alias(f"p{a}{i}") for a in "xy" for i in range(3)])


@query("""WITH u AS (SELECT l_suppkey % 7 AS font, l_partkey % 500 AS glyph, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 500 % 9 + l_suppkey % 7 AS curves, 4 + l_suppkey % 7 % 3 AS bands, l_partkey % 500 % 17 AS band_curves FROM lineitem),
d AS (SELECT font, glyph, curves, bands, band_curves, row_number() OVER (PARTITION BY font, glyph ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n, l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS e FROM u),
f AS (SELECT *, row_number() OVER w - 1 AS meta_index, sum(curves) OVER w - curves AS curves_offset, sum(bands) OVER w - bands AS band_headers_offset, sum(band_curves) OVER w - band_curves AS band_curves_offset FROM d WHERE n = 1 WINDOW w AS (ORDER BY a, b, c, e, font, glyph ROWS UNBOUNDED PRECEDING))
SELECT font, glyph, meta_index::BIGINT AS meta_index, curves_offset::BIGINT AS curves_offset, band_headers_offset::BIGINT AS band_headers_offset, band_curves_offset::BIGINT AS band_curves_offset FROM f""")
def glyph_buffers(spark, sf_dir) -> DataFrame:
    """Glyphs that the lines of orders use, once each, and their places in the shared buffers."""
    uses = t.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("font"), (F.col("l_partkey") % 500).alias("glyph"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    uses = uses.withColumns({"curves": F.col("glyph") % 9 + F.col("font"), "bands": 4 + F.col("font") % 3, "band_curves": F.col("glyph") % 17})
    out = glyphs.packed_glyphs(uses, ["font", "glyph"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "curves", "bands", "band_curves")
    return out.select("font", "glyph", "meta_index", "curves_offset", "band_headers_offset", "band_curves_offset")


#: A closed outline of four curves with corners and a bulge, by g: its corners and, between them, its middle points.
CORNERS = ((0, -40), (50, 0), (0, 60), (-30, 0))


def outlines(glyph: DataFrame) -> DataFrame:
    rows = []
    for i, (x, y) in enumerate(CORNERS):
        nx, ny = CORNERS[(i + 1) % 4]
        bulge = F.col("glyph") * (i + 1) % 5 * 6
        rows.append(F.struct(F.lit(float(x)).alias("px0"), F.lit(float(y)).alias("py0"), ((x + nx) / 2.0 + bulge * (1 if x + nx > 0 else -1)).alias("px1"), ((y + ny) / 2.0 + bulge * (1 if y + ny > 0 else -1)).alias("py1"), F.lit(float(nx)).alias("px2"), F.lit(float(ny)).alias("py2")))
    return glyph.select("glyph", F.inline(F.array(*rows)))


def placed(spark, sf_dir) -> DataFrame:
    s = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    return s.select("i", (F.col("i") % 15).alias("glyph"), (F.col("i") * 7 % 60 + 0.25).alias("pen_x"), (F.col("i") * 5 % 50 + 0.5).alias("pen_y"), (0.08 + F.col("i") % 4 * 0.05).alias("scale"),
                    (F.col("i") % 3 / 2.0).alias("red"), (F.col("i") % 5 / 4.0).alias("green"), F.lit(0.5).alias("blue"), (0.4 + F.col("i") % 2 * 0.5).alias("alpha"))


def _outline_sql() -> str:
    rows = []
    for i, (x, y) in enumerate(CORNERS):
        nx, ny = CORNERS[(i + 1) % 4]
        bulge = f"(glyph * {i + 1} % 5 * 6)"
        rows.append(f"SELECT glyph, {x}.0::DOUBLE AS px0, {y}.0::DOUBLE AS py0, {(x + nx) / 2} {'+' if x + nx > 0 else '-'} {bulge} AS px1, {(y + ny) / 2} {'+' if y + ny > 0 else '-'} {bulge} AS py1, {nx}.0::DOUBLE AS px2, {ny}.0::DOUBLE AS py2 FROM g")
    return " UNION ALL ".join(rows)


def _extent_sql(a: str, which: str) -> str:
    turn = f"(p{a}0 - p{a}1) / nullif(p{a}0 - 2 * p{a}1 + p{a}2, 0)"
    value = f"CASE WHEN {turn} > 0 AND {turn} < 1 THEN (1 - {turn}) * (1 - {turn}) * p{a}0 + 2 * (1 - {turn}) * {turn} * p{a}1 + {turn} * {turn} * p{a}2 END"
    return f"{which}(p{a}0, p{a}2, {value})"


def _ray_sql(name: str, axis: str, across: str) -> str:
    """All curves of the glyph against each sample: no bands."""
    y, x = ([f"(p{a}{i} - at_{a})" for i in range(3)] for a in (across, axis))
    a, b = f"({y[0]} - 2 * {y[1]} + {y[2]})", f"({y[0]} - {y[1]})"
    root = lambda sign: f"CASE WHEN abs({a}) < 1 / 65536 THEN coalesce({y[0]} * 0.5 / nullif({b}, 0), 0.0) ELSE ({b} {sign} sqrt(greatest({b} * {b} - {a} * {y[0]}, 0.0))) / {a} END"
    place = lambda r: f"((({x[0]} - 2 * {x[1]} + {x[2]}) * {r} - 2 * ({x[0]} - {x[1]})) * {r} + {x[0]}) * scale"
    n = [f"({c} < 0)" for c in y]
    twice = f"({n[0]} = {n[2]} AND {n[1]} <> {n[0]})"
    rows = f", {name}0 AS (SELECT i, x, y, scale, at_x, at_y, px0, py0, px1, py1, px2, py2, (NOT {n[0]} AND {n[2]}) OR {twice} AS falls, ({n[0]} AND NOT {n[2]}) OR {twice} AS rises, {root('-')} AS t1, {root('+')} AS t2 FROM m JOIN c USING (glyph))"
    rows += f", {name}1 AS (SELECT *, {place('t1')} AS r1, {place('t2')} AS r2 FROM {name}0)"
    part = lambda r, on: f"CASE WHEN {on} THEN greatest(least({r} + 0.5, 1.0), 0.0) ELSE 0.0 END"
    near = lambda r, on: f"CASE WHEN {on} THEN greatest(least(1 - abs({r}) * 2, 1.0), 0.0) ELSE 0.0 END"
    sign = "" if axis == "x" else "-"
    return rows + f", {name} AS (SELECT i, x, y, sum({sign}({part('r1', 'falls')} - {part('r2', 'rises')})) AS cov, max(greatest({near('r1', 'falls')}, {near('r2', 'rises')})) AS near FROM {name}1 GROUP BY 1, 2, 3)"


COVERAGE = f"""WITH s AS (SELECT s_suppkey AS i, s_suppkey % 15 AS glyph, s_suppkey * 7 % 60 + 0.25::DOUBLE AS pen_x, s_suppkey * 5 % 50 + 0.5::DOUBLE AS pen_y, 0.08::DOUBLE + s_suppkey % 4 * 0.05::DOUBLE AS scale,
s_suppkey % 3 / 2.0::DOUBLE AS red, s_suppkey % 5 / 4.0::DOUBLE AS green, 0.5::DOUBLE AS blue, 0.4::DOUBLE + s_suppkey % 2 * 0.5::DOUBLE AS alpha FROM supplier), g AS (SELECT range AS glyph FROM range(15)), c AS ({_outline_sql()}),
b AS (SELECT glyph, min({_extent_sql('x', 'least')}) AS lx, min({_extent_sql('y', 'least')}) AS ly, max({_extent_sql('x', 'greatest')}) AS hx, max({_extent_sql('y', 'greatest')}) AS hy FROM c GROUP BY 1),
w AS (SELECT s.*, unnest(range(ceil(pen_x + lx * scale - 1)::BIGINT, floor(pen_x + hx * scale)::BIGINT + 1))::INTEGER AS x, pen_y - hy * scale AS top, pen_y - ly * scale AS bottom FROM s JOIN b USING (glyph)),
v AS (SELECT * EXCLUDE (top, bottom), unnest(range(ceil(top - 1)::BIGINT, floor(bottom)::BIGINT + 1))::INTEGER AS y FROM w), m AS (SELECT *, (x + 0.5 - pen_x) / scale AS at_x, (pen_y - y - 0.5) / scale AS at_y FROM v)
{_ray_sql('hx', 'x', 'y')}{_ray_sql('vy', 'y', 'x')}, o AS (SELECT i, x, y, greatest(least(greatest(abs(h.cov * h.near + v.cov * v.near) / greatest(h.near + v.near, 1 / 65536), least(abs(h.cov), abs(v.cov))), 1.0), 0.0) AS coverage FROM hx h JOIN vy v USING (i, x, y))"""


@query(COVERAGE + " SELECT i, x, y, round(coverage, 5) AS coverage FROM o WHERE coverage > 1e-6")
def glyph_coverage(spark, sf_dir) -> DataFrame:
    """How much of each pixel placed glyphs cover, one for each supplier."""
    s = placed(spark, sf_dir)
    curves = outlines(s.select("glyph").distinct())
    out = glyphs.coverage(s, curves, "i", "glyph").where("coverage > 1e-6")
    return out.select("i", "x", "y", rounded(F.col("coverage"), 5).alias("coverage"))


@query(COVERAGE + """, k AS (SELECT o.x, o.y, row_number() OVER (PARTITION BY o.x, o.y ORDER BY i) AS n, red, green, blue, alpha * coverage AS a FROM o JOIN s USING (i) WHERE coverage > 0 AND o.x + 3 BETWEEN 0 AND 63 AND o.y - 2 BETWEEN 0 AND 47),
d AS (SELECT x, y, list({'r': red, 'g': green, 'b': blue, 'a': a} ORDER BY n) AS l FROM k GROUP BY 1, 2), e AS (SELECT x, y, list_reduce(list_prepend({'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE}, l),
lambda p, q: {'r': coalesce((q.r * q.a + p.r * p.a * (1 - q.a)) / nullif(q.a + p.a * (1 - q.a), 0), 0.0), 'g': coalesce((q.g * q.a + p.g * p.a * (1 - q.a)) / nullif(q.a + p.a * (1 - q.a), 0), 0.0), 'b': coalesce((q.b * q.a + p.b * p.a * (1 - q.a)) / nullif(q.a + p.a * (1 - q.a), 0), 0.0), 'a': q.a + p.a * (1 - q.a)}) AS z FROM d)
SELECT x + 3 AS x, y - 2 AS y, round(z.r, 5) AS r, round(z.g, 5) AS g, round(z.b, 5) AS b, round(z.a, 5) AS a FROM e WHERE z.a > 1e-4""")
def text_layer(spark, sf_dir) -> DataFrame:
    """A canvas of 64 x 48 with the glyphs of all suppliers, shifted by (3, -2)."""
    s = placed(spark, sf_dir)
    curves = outlines(s.select("glyph").distinct())
    out = glyphs.text_layer(s, curves, "i", "glyph", 64, 48, (3.0, -2.0)).where("a > 1e-4")
    return out.select("x", "y", *[rounded(F.col(c), 5).alias(c) for c in "rgba"])
