"""Outlines of text against recursion, supersampling and running sums by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from photark.operators import glyphs
from photark.operators.prefix import running


def halved(p, tolerance, depth):
    p = np.array(p, float).reshape(4, 2)
    if depth == 0 or math.sqrt(3) / 36 * np.hypot(*(p[3] - 3 * p[2] + 3 * p[1] - p[0])) <= tolerance:
        return [[p[0], (3 * (p[1] + p[2]) - p[0] - p[3]) / 4, p[3]]]
    a, b, c = (p[:-1] + p[1:]) / 2
    d, e = (a + b) / 2, (b + c) / 2
    f = (d + e) / 2
    return halved([p[0], a, d, f], tolerance, depth - 1) + halved([f, e, c, p[3]], tolerance, depth - 1)


def test_cubics_as_by_recursion(spark):
    rng = random.Random(6)
    curves = [[rng.uniform(-300, 300) for _ in range(8)] for _ in range(40)] + [[0, 0, 1, 1, 2, 2, 3, 3], [0.0] * 8, [0, 0, 1e6, 1e6, -1e6, 1e6, 0, 5]]
    names = [f"{a}{i}" for i in range(4) for a in "xy"]
    df = spark.createDataFrame([(n, *map(float, c)) for n, c in enumerate(curves)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = glyphs.quadratics(df, 1.0, 6).orderBy("id", "part").collect()
    want = [(n, q) for n, c in enumerate(curves) for q in halved(c, 1.0, 6)]
    assert [r["id"] for r in got] == [n for n, _ in want]
    for r, (_, q) in zip(got, want, strict=True):
        assert np.allclose([[r[f"px{i}"], r[f"py{i}"]] for i in range(3)], q, atol=1e-6)
    flat = {n: [r for r in got if r["id"] == n] for n in range(40)}
    for n, parts in flat.items():  # within the tolerance at matching parameters
        c = np.array(curves[n]).reshape(4, 2)
        for r in parts:
            for s in np.linspace(0, 1, 9):
                t = (r["part"] + s) / len(parts)
                cubic = sum(math.comb(3, k) * t**k * (1 - t) ** (3 - k) * c[k] for k in range(4))
                quad = sum(math.comb(2, k) * s**k * (1 - s) ** (2 - k) * np.array([r[f"px{k}"], r[f"py{k}"]]) for k in range(3))
                assert np.hypot(*(cubic - quad)) <= 1.0 + 1e-9


def outline(points):
    """Closed quadratic curves through corners and middle points in turn."""
    n = len(points) // 2
    return [(*points[2 * i], *points[2 * i + 1], *points[(2 * i + 2) % len(points)]) for i in range(n)]


def circle(r, cx=0.0, cy=0.0, turn=1):
    pts = []
    for i in range(8):
        a = turn * (2 * math.pi * i) / 8
        b = turn * (2 * math.pi * (i + 0.5)) / 8
        pts += [(cx + r * math.cos(a), cy + r * math.sin(a)), (cx + r / math.cos(math.pi / 8) * math.cos(b), cy + r / math.cos(math.pi / 8) * math.sin(b))]
    return outline(pts)


SHAPES = {
    1: circle(100),
    2: circle(100) + circle(50, 10, 5, turn=-1),  # a ring
    3: outline([(-90, -80), (0, -80), (90, -80), (90, 0), (90, 70), (0, 70), (-90, 70), (-90, 0)]),  # a box of straight lines
    4: outline([(0, -100), (80, 10), (60, 90), (0, 40), (-70, 80), (-20, -10)]),
}


def inside(curves, x, y):
    """Winding number of flattened curves."""
    t = np.linspace(0, 1, 17)[:, None]
    winding = np.zeros(np.broadcast(x, y).shape, int)
    for x0, y0, x1, y1, x2, y2 in curves:
        p = (1 - t) ** 2 * [x0, y0] + 2 * t * (1 - t) * [x1, y1] + t * t * [x2, y2]
        for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
            crosses = (ay <= y) != (by <= y)
            at = ax + (y - ay) * (bx - ax) / (by - ay if by != ay else 1)
            winding += np.where(crosses & (at > x), 1 if by > ay else -1, 0)
    return winding != 0


@pytest.mark.parametrize("bands", [1, 8])
def test_coverage_is_near_supersampling(spark, bands):
    curves = spark.createDataFrame([(g, *map(float, c)) for g, cs in SHAPES.items() for c in cs], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double").repartition(3)
    placed = [(10 * g + k, g, x, y, s) for g in SHAPES for k, (x, y, s) in enumerate(((14.3, 15.8, 0.11),))]
    df = spark.createDataFrame(placed, "i int, glyph int, pen_x double, pen_y double, scale double")
    got = {(r["i"], r["x"], r["y"]): r["coverage"] for r in glyphs.coverage(df, curves, "i", "glyph", bands).collect()}
    off = []
    for i, g, px, py, s in placed:
        sub = (np.arange(8) + 0.5) / 8
        for x in range(-2, 32):
            for y in range(-2, 32):
                if abs(x + 0.5 - px) > 101 * s + 1 or abs(y + 0.5 - py) > 101 * s + 1:
                    assert (i, x, y) not in got
                    continue
                ex, ey = (x + sub[None, :] - px) / s, (py - y - sub[:, None]) / s
                off.append(abs(inside(SHAPES[g], ex, ey).mean() - got.get((i, x, y), 0.0)))
    assert np.mean(off) < 0.01 and np.quantile(off, 0.99) < 0.2 and max(off) < 0.5, (np.mean(off), np.quantile(off, 0.99), max(off))


def test_bands_change_nothing(spark):
    curves = spark.createDataFrame([(g, *map(float, c)) for g, cs in SHAPES.items() for c in cs], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double")
    df = spark.createDataFrame([(g, g, 20.25, 19.5, 0.15) for g in SHAPES], "i int, glyph int, pen_x double, pen_y double, scale double")
    one, many = ({(r["i"], r["x"], r["y"]): round(r["coverage"], 9) for r in glyphs.coverage(df, curves, "i", "glyph", b).collect() if r["coverage"] > 1e-9} for b in (1, 16))
    assert one == many


def test_text_layers(spark):
    curves = spark.createDataFrame([(3, *map(float, c)) for c in SHAPES[3]], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double")
    rows = [(0, 3, 10.0, 10.0, 0.1, 1.0, 0.0, 0.0, 1.0), (1, 3, 10.0, 10.0, 0.1, 0.0, 1.0, 0.0, 0.5), (2, 99, 10.0, 10.0, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, glyph int, pen_x double, pen_y double, scale double, red double, green double, blue double, alpha double")
    got = {(r["x"], r["y"]): tuple(r)[2:] for r in glyphs.text_layer(df, curves, "i", "glyph", 12, 100, (-1.0, 4.0)).collect()}
    assert got[9, 14] == (0.5, 0.5, 0.0, 1.0)  # half green over red; the glyph without curves draws nothing
    assert max(x for x, _ in got) == 11 and min(x for x, _ in got) >= 0
    assert glyphs.text_layer(df.where("i = 2"), curves, "i", "glyph", 12, 100).count() == 0


def test_running_sums(spark):
    rows = [(g, i, i * 7 % 5) for g in (None, "a", "b") for i in range(70)] + [("hot", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("sum_0_", F.lit(1)).repartition(7)
    got = running(df, [F.col("i")], {"before": F.col("v"), "n": F.lit(1)}, "g").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n"] == r["i"] and r["before"] == (r["i"] if r["g"] == "hot" else sum(k * 7 % 5 for k in range(r["i"])))
    whole = running(df.select("g", "i", "v"), [F.col("g").asc_nulls_first(), F.col("i")], {"n": F.lit(1)}).collect()
    keys = sorted(rows, key=lambda r: (r[0] or "", r[1]))
    assert {(r["g"], r["i"]): r["n"] for r in whole} == {(g, i): n for n, (g, i, _) in enumerate(keys)}
    assert running(df.limit(0), [F.col("i")], {"n": F.lit(1)}).count() == 0


def test_samples_are_not_shuffled(spark):
    curves = spark.createDataFrame([(g, *map(float, c)) for g, cs in SHAPES.items() for c in cs], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double")
    df = spark.createDataFrame([(i, 1 + i % 4, i + 0.25, 19.5, 0.15) for i in range(30)], "i int, glyph int, pen_x double, pen_y double, scale double")
    found = glyphs.coverage(df, curves, "i", "glyph")
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and not [s for s in sent if re.search(r"\bx#", s)], sent


def test_layers_in_groups(spark, monkeypatch):
    """Pixels that many glyphs cover, laid over each other a few at a time."""
    monkeypatch.setattr(glyphs, "GROUP", 3)
    curves = spark.createDataFrame([(3, *map(float, c)) for c in SHAPES[3]], "glyph int, px0 double, py0 double, px1 double, py1 double, px2 double, py2 double")
    rng = random.Random(5)
    rows = [(i, 3, 10.0, 10.0, 0.1, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(31)]
    df = spark.createDataFrame(rows, "i int, glyph int, pen_x double, pen_y double, scale double, red double, green double, blue double, alpha double").repartition(5)
    want = np.zeros(4)
    for *_, r, g, b, a in rows:
        out = a + want[3] * (1 - a)
        want = np.array([*((np.array([r, g, b]) * a + want[:3] * want[3] * (1 - a)) / out), out])
    got = {(r["x"], r["y"]): tuple(r)[2:] for r in glyphs.text_layer(df, curves, "i", "glyph", 12, 100).collect()}
    assert np.allclose(got[9, 9], want) and len(got) == len(set(got))
