"""Operators that were rewritten for hot keys, against what they mean row by row."""

import random

import pytest
from pyspark.sql import functions as F

from photark.operators import catalog, items, library, raster, vocabulary


def exported(names):
    """One after the other, by what is there."""
    taken, out = set(), []
    for stem, ext in names:
        name, n = f"{stem}.{ext}", 0
        while name in taken:
            n += 1
            name = f"{stem}_{n}.{ext}"
        taken.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    names = [("a", "png"), ("a", "png"), ("a_1", "png")] if seed == 0 else [(rng.choice(["a", "a_1", "a_2", "a_1_1", "a_01", "a_", "b", "c", "c_3", "a_10"]), rng.choice(["png", "jpg"])) for _ in range(120)]
    df = spark.createDataFrame([(i, s, e, "old") for i, (s, e) in enumerate(names)], "i int, stem string, ext string, name string").repartition(5)
    got = {r["i"]: r["name"] for r in items.unique_names(df, "stem", "ext", ["i"]).collect()}
    assert [got[i] for i in range(len(names))] == exported(names)
    assert len(set(got.values())) == len(names)


def test_roots(spark, monkeypatch):
    rng = random.Random(2)
    roots = [("/a/", 3), ("/a/b/", 1), ("/a/b/c", None), ("/", 9), ("", 99), ("/z", 1)] + [(f"/r{i}/", i) for i in range(30)]
    paths = [(i, rng.choice(["/a/b/c/d", "/a/x", "/q", "zz", "/r7/x", "/r29/", "/zz", None])) for i in range(60)]
    df, known = spark.createDataFrame(paths, "i int, p string"), spark.createDataFrame(roots, "root string, root_order int")
    want = {}
    for i, p in paths:
        hits = sorted((o is None, o or 0, r) for r, o in roots if p is not None and p.startswith(r))
        want[i] = (hits[0][2], None if hits[0][0] else hits[0][1]) if hits else (None, None)
    for short in (64, 4):
        monkeypatch.setattr(catalog, "SHORT_LIST", short)
        assert {r["i"]: (r["root"], r["root_order"]) for r in catalog.root_of(df, known, "i", "p").collect()} == want


def test_latest_keeps_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, None, 9), (None, 1, 1), (2, None, 3), (2, None, 4)], "key int, created_at int, id int")
    assert sorted(map(tuple, catalog.latest_per(df, "key").collect()), key=str) == sorted([(1, 5, 2), (2, None, 4), (None, 1, 1)], key=str)


def test_selected_between(spark):
    df = spark.createDataFrame([(c, i % 3) for i, c in enumerate("abcdefgh")], "k string, o int")
    order = sorted(range(8), key=lambda i: (i % 3, "abcdefgh"[i]))
    names = ["abcdefgh"[i] for i in order]
    for a, b in (("b", "f"), ("h", "a"), ("c", "c"), ("c", "none")):
        at = sorted(names.index(x) for x in (a, b) if x in names)
        assert sorted(r["k"] for r in library.selected_between(df, "k", ["o"], a, b).collect()) == sorted(names[at[0] : at[-1] + 1])


def test_bands_grid_and_window(spark):
    curves = [(i, i * 7 % 40, i * 7 % 40 + i % 9) for i in range(80)]
    got = library.bands(spark.createDataFrame(curves, "id int, low int, high int"), "low", "high", 10).collect()
    for r in got:
        band = sorted((-h, lo, i) for i, lo, h in curves if lo // 10 <= r["band"] <= h // 10)
        assert band[r["place"] - 1][2] == r["id"]
    assert len(got) == sum(h // 10 - lo // 10 + 1 for _, lo, h in curves)
    df = spark.createDataFrame([(i, i % 2) for i in range(21)], "i int, g int")
    assert {(r["g"], r["i"]): (r["grid_row"], r["grid_column"]) for r in catalog.grid(df, [F.desc("i")], ["g"], 4).collect()} == {(g, i): divmod(n, 4) for g in (0, 1) for n, i in enumerate(sorted((i for i in range(21) if i % 2 == g), reverse=True))}
    shown = raster.visible_window(df, F.col("i"), [F.col("i")], 20, 40).collect()
    assert sorted(r["i"] for r in shown) == [i for i in range(21) if sum(range(i)) < 40 and sum(range(i + 1)) > 20]


def test_vocabularies(spark):
    assert len(vocabulary.CATEGORIES) == 10
    asked = [tuple(r) for r in vocabulary.auto_tags(vocabulary.categories(spark)).collect()]
    assert len(set(asked)) == len(asked) and {label for label, _ in asked} == {label.lower().replace("-", " ") for labels in vocabulary.CATEGORIES.values() for label in labels}
    assert ("owl", "an owl") in [tuple(r) for r in vocabulary.auto_tags(vocabulary.categories(spark, {"a": (" Owl", "owl"), "b": ("OWL", "")})).collect()]
    tags = spark.createDataFrame([(1, "Dog"), (1, "dog"), (1, "lake"), (2, "none"), (3, "star_trail")], "i int, t string")
    got = sorted(map(tuple, vocabulary.in_category(tags, vocabulary.categories(spark), "i", "t").collect()))
    assert got == [(1, "animals", 1), (1, "landscape", 1), (3, "sky", 1)]
