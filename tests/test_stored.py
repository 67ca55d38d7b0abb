"""Small files, stored tables, pages and progressive scans."""

import json
import os

import pytest
from pyspark.sql import functions as F

from photark.sources import paged, stored
from photark.streaming import progress


def test_presets(spark, tmp_path):
    p = stored.Presets(spark, f"file://{tmp_path}/presets")
    assert p.list().collect() == []
    p.save(" Warm + é 100% ", [{"image": 1}, {"ops": [{"Tone": {"exposure": 1}}]}], {"1": {"radial": [1, 2, 3]}})
    p.save("b", [])
    p.save("b", [{"ops": []}])  # over the old one
    assert {r["name"] for r in p.list().collect()} == {"Warm + é 100%", "b"}
    assert p.get("b") == {"version": 1, "layers": [{"ops": []}], "mask_params": {}} and len(p.get("Warm + é 100%")["layers"]) == 1
    p.move("b", "c")
    with pytest.raises(KeyError, match="no preset b"):
        p.get("b")
    with pytest.raises(ValueError, match="there is a preset c"):
        p.move("Warm + é 100%", "c")
    p.move("c", " c ")  # the same
    with pytest.raises(KeyError):
        p.move("x", "y")
    p.remove("c")
    with pytest.raises(KeyError):
        p.remove("c")
    for bad in ("", "  ", "a/b", "a\\b", "..", "a..b"):
        with pytest.raises(ValueError):
            p.save(bad, [])
    p.save_json("old", '{"version": 7, "layers": [1]}')
    for bad in ("{", "[]", '{"layers": []}', '{"version": "1", "layers": []}'):
        with pytest.raises(ValueError):
            p.save_json("bad", bad)
    got = {r["name"]: tuple(r)[1:] for r in p.all().collect()}
    assert got == {"old": (7, "[1]", "{}"), "Warm + é 100%": (1, '[{"ops":[{"Tone":{"exposure":1}}]}]', '{"1":{"radial":[1,2,3]}}')}
    assert not [f for f in os.listdir(tmp_path / "presets") if f.startswith(".") and not f.endswith(".crc")]


def test_configurations(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert stored.load_config(spark, folder)["libraries"] == []
    old = {"directories": ["/a", "/b"], "s3_libraries": [{"id": "x", "bucket": "k"}], "paired_peers": ["p1"], "libraries": [{"kind": "local", "path": "/a", "name": "first"}], "library_order": ["s3:x", "gone", "s3:x"], "library_modes": {"s3:x": "sync"}}
    (tmp_path / "config.json").write_text(json.dumps(old))
    now = stored.load_config(spark, folder)
    assert now["libraries"] == [{"kind": "local", "path": "/a"}, {"kind": "local", "path": "/b"}, {"kind": "s3", "id": "x", "bucket": "k"}, {"kind": "peer", "peer_id": "p1", "name": None}]
    assert now["library_order"] == ["pictures", "s3:x", "local:/a", "local:/b", "peer:p1"]
    stored.save_config(spark, folder, now)
    assert stored.load_config(spark, folder) == now == stored.current_config(now)
    rows = {r["library_id"]: (r["kind"], r["mode"], r["place"]) for r in stored.libraries(spark, now).collect()}
    assert rows["s3:x"] == ("s3", "sync", 1) and len(rows) == 4
    (tmp_path / "config.json").write_text("[1")
    with pytest.raises(ValueError):
        stored.load_config(spark, folder)


STEPS = [stored.renamed("file_hash", "fingerprint"), stored.added("rating", "cast(null as int)"), stored.rebuilt("version", {"id": "concat_ws('-', fingerprint, version)", "rating": "rating"})]


def test_three_versions_migrate_to_one_twice_without_change(spark, tmp_path):
    tables = [spark.createDataFrame([("h", 1)], "file_hash string, version int"), spark.createDataFrame([("h", 1)], "fingerprint string, version int"), spark.createDataFrame([("h", 1, 5)], "fingerprint string, version int, rating int")]
    for n, df in enumerate(tables):
        kept = stored.Stored(spark, f"file://{tmp_path}/{n}")
        kept.put(df, n)
        assert kept.migrate(STEPS) and kept.schema_version() == 3
        assert [tuple(r) for r in kept.table().collect()] == [("h-1", 5 if n == 2 else None)]
        state = kept.state()
        assert not kept.migrate(STEPS) and kept.state() == state
        assert kept.clean() == 1 and kept.table().count() == 1
    for step in STEPS:  # each step may run again
        df = step(tables[2])
        assert step(df).columns == df.columns


def test_a_migration_that_fails_changes_nothing(spark, tmp_path):
    kept = stored.Stored(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no table"):
        kept.table()
    kept.put(spark.createDataFrame([(1,)], "a int"), 0)
    before = kept.state()
    with pytest.raises(Exception, match="stop"):
        kept.migrate([lambda df: df.withColumn("b", F.when(F.col("a") > 0, F.raise_error(F.lit("stop"))))])
    assert kept.state() == before and kept.table().columns == ["a"]
    assert kept.clean() >= 0 and kept.table().count() == 1


@pytest.mark.parametrize("n", [0, 1, 5, 6, 47, 60])
def test_pages(spark, tmp_path, n):
    items = [{"id": i, "name": f"n{i}"} if i % 3 else {"id": i} for i in range(n)]
    for at in range(0, max(n, 1), 5):
        (tmp_path / f"{at}.json").write_text(json.dumps({"items": items[at : at + 5], "has_more": at + 5 < n}))
    df = paged.pages(spark, f"test{n}", paged.from_folder(str(tmp_path)), "id int, name string, size long", 5)
    assert sorted(map(tuple, df.collect())) == [(i, f"n{i}" if i % 3 else None, None) for i in range(n)] or n % 3
    assert {r["id"]: r["name"] for r in df.collect()} == {i: f"n{i}" if i % 3 else None for i in range(n)}
    assert df.rdd.getNumPartitions() == max(1, -(-n // 5))


def test_few_calls_find_the_last_page():
    calls = []

    def fetch(offset, limit):
        calls.append(offset)
        return [], offset + limit < 256 * 1000

    assert paged.last_page(fetch, 256) == 999 and len(calls) < 25


def test_pages_that_change_are_an_error(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"items": [{"id": 1}], "has_more": True}))
    (tmp_path / "2.json").write_text(json.dumps({"items": [{"id": 2}], "has_more": False}))
    with pytest.raises(Exception, match="ended early"):
        paged.pages(spark, "short", paged.from_folder(str(tmp_path)), "id int", 2).collect()


def test_progressive_scans(spark, tmp_path):
    root, table = tmp_path / "root", f"file://{tmp_path}/table"
    (root / "sub").mkdir(parents=True)
    for i in range(9):
        (root / ("sub" if i % 2 else ".") / f"p{i}.JPG").write_bytes(b"x" * (i + 1))
    (root / "no.txt").write_bytes(b"x")
    seen = []
    query = progress.scan(spark, f"file://{root}", table, 2)
    while query.isActive:
        row = progress.progress(spark, table).first()
        seen.append((row["n_items"], row["is_complete"]))
    progress.finished(query, spark, table)
    last = progress.progress(spark, table).first()
    assert tuple(last) == (9, 5, True) and all(not done for _, done in seen) and [n for n, _ in seen] == sorted(n for n, _ in seen)
    assert any(0 < n < 9 for n, _ in seen)  # partial results were there
    assert {(r["name"], r["size"]) for r in progress.found(spark, table).collect()} == {(f"p{i}.JPG", i + 1) for i in range(9)}
    (root / "new.png").write_bytes(b"abc")  # a second scan takes what is new
    again = progress.scan(spark, f"file://{root}", table, 2)
    progress.finished(again, spark, table)
    assert tuple(progress.progress(spark, table).first()) == (10, 6, True)
    assert progress.found(spark, f"file://{tmp_path}/none").count() == 0
