"""Helpers shared by the training-data operators: shared scratch tables, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a local one is made and set on a single machine (tests); a cluster must name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="photark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Lets Spark delete the shuffle files of a written table once it is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and every
    executor can recompute from those files after losing another executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/photark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.set(CLEAN, before)
    fields = sorted(df.schema, key=lambda f: f.name in (partition_by or ()))  # partition columns come last
    table = spark.read.schema(T.StructType(fields)).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """df's row as the one column ``row_``, beside columns of the operator's own: no name of the input can clash."""
    return df.select(F.struct("*").alias("row_"), *[c.alias(n) for n, c in own.items()])


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of boxed rows, and new ones; a new one takes the place of the input's of its name."""
    kept = [new[c].alias(c) if c in new else F.col("row_").getField(c).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(n) for n, v in new.items() if n not in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame) -> DataFrame:
    """df in an eighth of the tasks, but one a core at least: for rows of a few numbers, whose files would else be tiny."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // 8))


def running_sums(batches: Iterator[pa.RecordBatch], value: str, group: str | None, out: str) -> Iterator[pa.RecordBatch]:
    """Within one sorted partition: the sum of ``value`` over earlier rows (of the same group)."""
    before, last = 0, object()
    for batch in batches:
        total = batch.column(value).to_pylist()
        keys = batch.column(group).to_pylist() if group else None
        sums = []
        for i, v in enumerate(total):
            if keys is not None and keys[i] != last:
                before, last = 0, keys[i]
            sums.append(before)
            before += v
        yield batch.append_column(out, pa.array(sums, pa.int64()))


def prefix_sums(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before, by ``order``, within ``group``.

    No task sees more than its range: rows are range-partitioned and summed inside each range,
    then a table of one total per range (and group in it) is summed up and joined back.
    ``order`` must start with the group column. df should be cheap to read twice, as range
    partitioning samples it. Rows keep all their columns, and equal rows may swap places.
    """
    spark = df.sparkSession
    schema = T.StructType(list(df.schema)).add(out, "long").add("range_id", "integer")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in running_sums(batches, value, group, out):
            yield b.append_column("range_id", pa.array([part] * b.num_rows, pa.int32()))

    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    local = materialise(ranged.mapInArrow(summed, schema), "ranges")
    keys = [group] if group else []
    totals = local.groupBy("range_id", *keys).agg(F.sum(value).alias("range_total"))
    earlier = Window.partitionBy(*keys).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("range_total").over(earlier), F.lit(0))
    offsets = totals.select(F.col("range_id").alias("of_range"), *[F.col(k).alias("of_group") for k in keys], start.alias("range_start"))
    on = F.col("range_id") == F.col("of_range")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("of_group"))
    return local.join(offsets, on).select(*df.columns, (F.col(out) + F.col("range_start")).alias(out))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long) as (node, root): root is the least node reachable.

    Alternating large-star and small-star steps: each round joins every node to its least
    neighbour, so hubs send one row a neighbour and no group is gathered. Each round is written
    to the shared folder. Nodes without links are absent. Stops when a round changes nothing.
    """
    edges = few(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = materialise(edges, "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = e.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, now = None, mark(edges)
    while now != seen:  # each round takes nodes nearer to the least one of their component, so this ends
        grown = materialise(few(star(edges, True)), "large")
        smaller = materialise(few(star(grown, False)), "small")
        discard(edges, grown)
        edges, seen, now = smaller, now, mark(smaller)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()
