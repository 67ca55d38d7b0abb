"""Edge cases of operators that the tables do not hold, against literal expectations."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from photark.functions import color, numeric
from photark.functions import text as tx
from photark.operators import catalog, fingerprints, library, merge, raster
from photark.plans import catalog as plans
from photark.sources import images
from photark.streaming import changes


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if not isinstance(v, (str, int, float, type(None))) else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [("5", 5), (" 3 ", 3), ("", None), ("0", None), ("-1", None)])
def test_rating(spark, value, want):
    assert one(spark, tx.rating(F.col("v")), v=value) == want


@pytest.mark.parametrize("value", ["7", "x"])
def test_rating_rejects(spark, value):
    with pytest.raises(Exception, match="not a rating"):
        one(spark, tx.rating(F.col("v")), v=value)


def test_labels_and_tags(spark):
    assert one(spark, tx.normal_label(F.col("v")), v=" Red_Panda - x ") == "red panda x"
    assert one(spark, tx.variants(F.col("v")), v="owl") == ["an owl", "owl", "the owl"]
    assert one(spark, tx.normal_tags(F.array(F.lit(" b "), F.lit(""), F.lit("a"), F.lit("b")))) == ["a", "b"]


@pytest.mark.parametrize(("head", "kind"), [(b"\0\0\0\x18ftypcrx ", "image/x-canon-cr3"), (b"\0\0\0\x1cftypavif", "image/avif"), (b"\0\0\0\x18ftypheic", "image/heic"), (b"RIFF1234WEBP", "image/webp"), (b"II*\0", "image/tiff"), (b"\0\0\0\x18ftypmp42", None), (b"", None)])
def test_media_types(spark, head, kind):
    assert one(spark, images.media_type(F.col("v")), v=F.lit(head)) == kind


def test_timestamps(spark):
    for v in ("Mon, 01 Jan 2024 00:00:01 +0000", "2024-01-01T00:00:01Z", "2024-01-01 00:00:01", "2024-01-01T00:00:01"):
        assert one(spark, tx.timestamp_millis(F.col("v")), v=v) == 1704067201000
    assert one(spark, tx.timestamp_millis(F.col("v")), v="") is None


def test_percent(spark):
    assert one(spark, tx.percent_encode(F.col("v")), v="a b~*+é") == "a%20b~%2A%2B%C3%A9"
    assert one(spark, tx.percent_decode(F.col("v")), v="a%20b+%C3%A9") == "a b+é"


def test_xmp(spark):
    assert one(spark, tx.xmp_rating(F.col("v")), v='<rdf:Description xmp:Rating="4"/>') == 4
    assert one(spark, tx.xmp_rating(F.col("v")), v="<xmp:Rating>3</xmp:Rating>") == 3
    assert one(spark, tx.xmp_rating(F.col("v")), v="<x/>") is None


def test_previews(spark):
    html = '<meta property="og:image" content="a?x=1&amp;y=2"><meta property=\'og:image\' content=\'b\'>'
    assert one(spark, images.preview_images(F.col("v")), v=html) == ["a?x=1&y=2", "b"]
    assert one(spark, images.chosen_preview(F.col("v"), F.lit(9)), v=html) == "b"
    turned = """<META content='c&amp;d' property="og:image"><meta property="og:image:width" content="9"><meta property=og:image content="">"""
    assert one(spark, images.preview_images(F.col("v")), v=turned) == ["c&d", "9"]
    assert one(spark, images.chosen_preview(F.col("v"), F.lit(1)), v="<p>") is None


def test_listing(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "c.png"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in images.list_images(spark, str(tmp_path)).collect()) == ["a.JPG", "c.png"]


@pytest.mark.parametrize(("n", "want"), [(0, []), (65536, [(0, 65536)]), (65537, [(0, 16384), (21845, 16384), (43691, 16384), (49153, 16384)])])
def test_sample_plan(spark, n, want):
    assert [tuple(s) for s in one(spark, fingerprints.sample_plan(F.col("n")), n=n)] == want


def test_ties_keep_base(spark):
    base = spark.createDataFrame([(1, 5, "b"), (2, 5, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 5, "i"), (2, 6, "i"), (3, 1, "i")], "k int, at int, v string")
    got = {r["k"]: r["v"] for r in merge.last_writer_wins(base, new, ["k"], "at").collect()}
    assert got == {1: "b", 2: "i", 3: "i"}
    peer = spark.createDataFrame([(9, 0, "p"), (8, 1, "p")], "k int, at int, v string")
    got = {r["k"] for r in merge.merged_ratings(base, peer, "k", "v", "at").collect()}
    assert got == {1, 2, 8}


def test_empty_collection_shows_all(spark):
    items = spark.range(3).withColumnRenamed("id", "path")
    assert catalog.in_collection(items, spark.createDataFrame([], "m long"), "path").count() == 3
    assert catalog.in_collection(items, spark.createDataFrame([(1,)], "m long"), "path").count() == 1


def test_transfer_round_trip(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(0, 4, 50)], "v double")
    back = df.select("v", color.decode(color.encode(F.col("v"))).alias("w"), color.srgb_decode(color.srgb_encode(F.col("v"))).alias("s")).collect()
    assert max(abs(r["v"] - r["w"]) for r in back) < 1e-4
    assert max(abs(min(r["v"], 1) - r["s"]) for r in back) < 1e-4
    assert abs(one(spark, color.encode(F.lit(0.18))) - 0.4135884) < 1e-4


def test_reversed_smoothstep(spark):
    assert one(spark, numeric.smoothstep(1.0, 0.65, F.lit(0.65))) == 1.0
    assert one(spark, numeric.smoothstep(1.0, 0.65, F.lit(1.0))) == 0.0


def test_curve_ends_and_duplicates():
    lut = color.curve_lut([(128, 0.5), (128.2, 0.9)])
    assert lut[0] == 0 and lut[255] == 1 and lut[128] == 0.5
    assert all(a <= b for a, b in zip(lut, lut[1:], strict=False))


def test_single_pixel_stencil(spark):
    df = spark.createDataFrame([(0, 0, 3.0)], "x int, y int, v double")
    assert raster.stencil(df, raster.box(), 1, 1, "v", "m").first()["m"] == 3.0


def test_hidden_layers_do_nothing(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.9)], "r double, g double, b double")
    same = raster.render(df, '[{"ops": [{"Tone": {"exposure": 1}}], "visible": false}]').first()
    assert tuple(same) == (0.1, 0.5, 0.9)


def test_stream_tags_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(src))
    score = lambda df: df.select("k", F.upper("v").alias("tag"))

    def run():
        stream = spark.readStream.schema("k int, v string").parquet(str(src))
        changes.tag_stream(stream, "k", score, str(out), str(tmp_path / "cp")).awaitTermination()

    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(str(src))
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).select("k", "tag").collect()) == [(1, "A"), (2, "B"), (3, "C")]


@pytest.mark.parametrize(("start", "to", "want"), [(0, 3, "bcad"), (3, 0, "dabc"), (1, 1, "abcd"), (1, 2, "abcd"), (2, 4, "abdc")])
def test_move(spark, start, to, want):
    assert "".join(one(spark, library.moved(F.array(*map(F.lit, "abcd")), start, to))) == want


def test_content_fingerprint_takes_every_length(spark, tmp_path):
    texts = {0: "", 1: "a", 2: "ab" * 32768, 3: "abc" * 21845 + "de", 4: "xyz-" * 50000, 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["fingerprint"] for r in plans.content_fingerprint(spark, str(tmp_path)).collect()}

    def want(data):
        n = len(data)
        at = [] if n == 0 else [(0, n)] if n <= 65536 else [(o, 16384) for o in (0, n // 3, 2 * n // 3, n - 16384)]
        return hashlib.sha256(b"%d:16384:%d:" % (n, len(at)) + b"".join(b"%d:" % o + data[o : o + length] for o, length in at)).hexdigest()

    assert [len(t) for t in texts.values() if t is not None] == [0, 1, 65536, 65537, 200000]
    assert got == {d: None if t is None else want(t.encode()) for d, t in texts.items()}


def test_wide_curves():
    table = color.wide_curve_lut([(128, 3.0)])
    assert table[0] == 1 and table[128] == 2 and table[255] == 1 and max(table) == 2  # up to twice, and 1 at the left
    assert color.curve_lut([(128, 0.5)])[0] == 0 and max(color.curve_lut([(128, 1.5)])) == 1
