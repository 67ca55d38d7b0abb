"""python -m photark: listings, fingerprints, descriptions, edits and registered queries, written as Parquet.

  list ROOT OUT                    images under a folder, newest first
  digest ROOT OUT                  their content fingerprints, by ranged reads
  describe ROOT OUT                orientation, colour space, bit depth and images inside, from their bytes
  edit OPS RASTER OUT              a JSON list of adjustments on a raster (Parquet: x, y, r, g, b and perhaps a)
  stack STACK RASTER OUT           a JSON stack of layers over a raster, which its image layers name "raster"
  query NAME TABLES OUT            a registered query over a folder of tables
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    df = spark.read.parquet(path)
    size = df.agg(F.max("x").alias("w"), F.max("y").alias("h")).first()
    if size["w"] is None:
        raise ValueError(f"no pixels in {path}")
    return df, size["w"] + 1, size["h"] + 1


def result(spark: SparkSession, command: str, what: str, where: str | None) -> DataFrame:
    from photark.operators import identity, stack
    from photark.plans import registry
    from photark.sources import containers, images, ranges

    if command == "list":
        return images.list_images(spark, what)
    if command == "digest":
        files = images.list_images(spark, what).select("path", "size")
        return identity.digests(ranges.samples(files).select("path", identity.sampled_message(F.col("size"), F.col("samples")).alias("m")), "m", "fingerprint")
    if command == "describe":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(what)
        return containers.described(files.where(images.extension(F.col("path")).isin(*images.EXTENSIONS)).select("path", "content"))
    if command == "query":
        if what not in registry.QUERIES:
            raise ValueError(f"no query {what}")
        return registry.QUERIES[what](spark, where)
    df, width, height = raster(spark, where)
    given = json.loads(Path(what).read_text())
    layers = {"layers": [{"image": "raster"}, {"ops": given}]} if command == "edit" else given
    return stack.render(layers, {"raster": (df, width, height)}, width, height)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="photark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("list", "digest", "describe"):
        one = commands.add_parser(name)
        one.add_argument("what", metavar="ROOT")
        one.add_argument("out")
    for name, first, second in (("edit", "OPS", "RASTER"), ("stack", "STACK", "RASTER"), ("query", "NAME", "TABLES")):
        one = commands.add_parser(name)
        one.add_argument("what", metavar=first)
        one.add_argument("where", metavar=second)
        one.add_argument("out")
    given = parser.parse_args(arguments)

    from photark.session import session

    result(session("photark"), given.command, given.what, getattr(given, "where", None)).write.parquet(given.out)


if __name__ == "__main__":
    main()
