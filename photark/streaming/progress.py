"""Scans that show what they have found so far, and go on where they were stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from photark.sources.images import EXTENSIONS, extension

#: Files in each part of a scan of a folder.
PART = 16
FILE = "path string, modificationTime timestamp, length long, content binary"
ITEM = "path string, name string, modified_at long, size long, part long"


def scan(spark: SparkSession, root: str, table: str, part: int = PART) -> StreamingQuery:
    """Start a scan of the images under root: every ``part`` files are one micro-batch, which adds its rows to ``table`` where
    found() sees them at once. Bodies of files are not read; files of no bytes are left out, as Spark's reader leaves them out.

    The scan ends when all is read. Started again it takes new files only, and a part that was cut off is written anew, over
    what there is of it. Finish it by finished()."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", part).load(root)
    rows = stream.where(extension(F.col("path")).isin(*EXTENSIONS))
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    mark(spark, table, False)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/items/part={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{table}/checkpoint").trigger(availableNow=True).start()


def mark(spark: SparkSession, table: str, complete: bool) -> None:
    spark.range(1).select(F.lit(complete).alias("is_complete")).coalesce(1).write.mode("overwrite").parquet(f"{table}/state")


def finished(query: StreamingQuery, spark: SparkSession, table: str) -> None:
    """Wait for the scan and say that it is complete; an error in it is raised, and it stays incomplete."""
    query.awaitTermination()
    mark(spark, table, True)


def found(spark: SparkSession, table: str) -> DataFrame:
    """What is found so far, newest first, then by path; the part of the scan it came in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/items")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ITEM)
    rows = spark.read.schema(ITEM).option("basePath", f"{table}/items").parquet(f"{table}/items")
    return rows.orderBy(F.coalesce("modified_at", F.lit(0)).desc(), "path")


def progress(spark: SparkSession, table: str) -> DataFrame:
    """One row: n_items, n_parts and is_complete."""
    counts = found(spark, table).agg(F.count("*").alias("n_items"), F.count_distinct("part").alias("n_parts"))
    return counts.crossJoin(F.broadcast(spark.read.parquet(f"{table}/state")))
