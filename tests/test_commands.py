"""The command line, in this process."""

import json

import pytest

from photark.__main__ import main
from photark.functions import blake3


def test_files(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\1sRGB\0crc!")
    (root / "b.txt").write_bytes(b"x")
    for command in ("list", "digest", "describe"):
        main([command, f"file://{root}", f"file://{tmp_path}/{command}"])
    assert [r["name"] for r in spark.read.parquet(f"file://{tmp_path}/list").collect()] == ["a.png"]
    data = (root / "a.png").read_bytes()
    n = len(data)
    message = n.to_bytes(8, "little") + (16384).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(8) + data
    assert spark.read.parquet(f"file://{tmp_path}/digest").first()["fingerprint"] == blake3.tops([message])[0].hex()
    assert spark.read.parquet(f"file://{tmp_path}/describe").first()["color_space"] == "srgb"


def test_rasters_and_queries(spark, tmp_path, sf_dir):
    rows = [(x, y, 0.1 * x, 0.2, 0.3) for x in range(4) for y in range(3)]
    spark.createDataFrame(rows, "x int, y int, r double, g double, b double").write.parquet(f"file://{tmp_path}/p")
    (tmp_path / "ops.json").write_text(json.dumps([{"Tone": {"exposure": 1.0}}]))
    (tmp_path / "stack.json").write_text(json.dumps({"layers": [{"image": "raster"}, {"crop": {"x": 1, "y": 0, "width": 2, "height": 2}}]}))
    main(["edit", f"{tmp_path}/ops.json", f"file://{tmp_path}/p", f"file://{tmp_path}/edited"])
    main(["stack", f"{tmp_path}/stack.json", f"file://{tmp_path}/p", f"file://{tmp_path}/cut"])
    assert spark.read.parquet(f"file://{tmp_path}/edited").count() == 12 and spark.read.parquet(f"file://{tmp_path}/edited").where("g > 0.25").count() == 12
    assert sorted((r["x"], round(r["r"], 9)) for r in spark.read.parquet(f"file://{tmp_path}/cut").collect()) == [(0, 0.1), (0, 0.1), (1, 0.2), (1, 0.2)]
    main(["query", "collections_with_counts", sf_dir, f"file://{tmp_path}/q"])
    assert spark.read.parquet(f"file://{tmp_path}/q").count() > 0
    for bad in (["query", "none", sf_dir, "x"], ["nothing"], ["list"]):
        with pytest.raises((ValueError, SystemExit)):
            main(bad)
