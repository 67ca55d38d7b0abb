"""Change streams: debounced refreshes, collapsed previews, stale answers, incremental tagging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def debounced(events: DataFrame, key: str, at: str, quiet: str) -> DataFrame:
    """(key, first, last, n_events) of each burst: events of a key with less than ``quiet`` between neighbours.

    Works on batches and, with a watermark on ``at``, on streams.
    """
    return events.groupBy(key, F.session_window(at, quiet)).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n_events")).select(key, "first", "last", "n_events")


def collapsed(jobs: DataFrame, order: list[str], kind: str, preview: str, partition: str) -> DataFrame:
    """Jobs in order (the last column of it tells jobs apart), of each run of previews only the newest; other jobs all stay."""
    w = Window.partitionBy(partition).orderBy(*order)
    followed = F.lead(kind).over(w) == preview
    return jobs.withColumn("followed", F.coalesce(followed, F.lit(False))).where((F.col(kind) != preview) | ~F.col("followed")).drop("followed")


def current(answers: DataFrame, key: str, generation: str) -> DataFrame:
    """Answers of each key's newest generation."""
    newest = F.max(generation).over(Window.partitionBy(key))
    return answers.withColumn("newest", newest).where(F.col(generation) == F.col("newest")).drop("newest")


def since(rows: DataFrame, stored: DataFrame, at: str) -> DataFrame:
    """Rows later than the greatest time stored; all of them if nothing is."""
    mark = stored.agg(F.max(at).alias("mark"))
    return rows.join(mark).where(F.col("mark").isNull() | (F.col(at) > F.col("mark"))).drop("mark")


def latest_state(changes: DataFrame, key: str, at: str, removed: Column, tie: str) -> DataFrame:
    """Keys that are present after all changes: the last change of each counts, of equal times the one with the greater tie column."""
    last = changes.withColumn("removed_", removed).groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct("*"), F.struct(at, tie)).alias("last_"))
    return last.select("last_.*").where(~F.col("removed_")).drop("removed_")


def tag_stream(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Tag each key once as it comes: every micro-batch drops keys that are tagged, scores the rest and appends.

    Results go to a Parquet table partitioned by batch, each batch overwriting its own part, so that a batch that
    runs again after a failure writes the same rows. Returns the started query; it stops when all is read.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            shape = T.StructType([score(fresh).schema[key], T.StructField("batch", T.LongType())])
            done = spark.read.schema(shape).parquet(path).where(F.col("batch") < number).select(F.col(key).alias("done")).distinct()
            fresh = fresh.join(done, F.col(key) == F.col("done"), "left_anti")
        score(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
