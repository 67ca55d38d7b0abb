"""Catalog tables and the views over them that play the roles of a media library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a listing: path, library, size, modified_at (here the size, as there is no time)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("path"), F.col("source").alias("library"), F.col("n_chars").alias("size"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse ratings: quality of labelled documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").alias("rating"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as edit versions: key, id, created_at, layers (JSON), kind."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("layers"), F.col("event_type").alias("kind"), "value")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels: its four-column key, and r, g, b from three of its measures."""
    li = table(spark, sf_dir, "lineitem")
    zero = F.lit(0.0)  # -0.0 + 0.0 is 0.0
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        (F.col("l_discount") * 5 + zero).alias("r"), (F.col("l_tax") * 5 + zero).alias("g"), (F.col("l_quantity") / 50).alias("b"),
    )


def raster(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """orders as a raster of one channel: x, y, v by their dense key."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % width).cast("int").alias("x"), F.expr(f"cast(o_orderkey div {width} as int)").alias("y"), (F.col("o_totalprice") / 500000).alias("v"))
