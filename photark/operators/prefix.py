"""Running sums over all rows without a window that one task holds, and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. On a single machine without that setting a local one is made and set; a
    cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="photark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that lost executors cost no more than a read."""
    path = f"{shared_folder(df.sparkSession)}/photark-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: str | None = None) -> DataFrame:
    """df with a column for each of ``sums`` (whole numbers): its sum over the rows before, in ``order``, of the same ``group``.

    Rows are dealt in ranges and summed up in each; a table of one row for each range and group in it tells where a range
    begins. No task holds more than a range, however large a group is. Rows with equal order may swap places."""
    spark = df.sparkSession
    names = list(sums)
    mark = uuid.uuid4().hex[:8]  # no column has these names
    own, inner, start = ({n: f"{kind}_{i}_{mark}" for i, n in enumerate(names)} for kind in ("own", "sum", "start"))
    group_, range_ = f"group_{mark}", f"range_{mark}"
    keyed = df.select("*", *[F.coalesce(c.cast("long"), F.lit(0)).alias(own[n]) for n, c in sums.items()], (F.col(group) if group else F.lit(0)).alias(group_))
    by = [F.col(group_), *order] if group else order
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    shape = T.StructType([*keyed.schema.fields, *[T.StructField(inner[n], T.LongType()) for n in names], T.StructField(range_, T.IntegerType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, before = TaskContext.get().partitionId(), object(), dict.fromkeys(names, 0)
        for b in batches:
            groups = b.column(group_).to_pylist()
            new = []
            for n in names:
                out, total, now = [], before[n], last
                for g, v in zip(groups, b.column(own[n]).to_pylist(), strict=True):
                    total, now = (total, now) if g == now else (0, g)
                    out.append(total)
                    total += v
                before[n] = total
                new.append(pa.array(out, pa.int64()))
            last = groups[-1] if groups else last
            yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array([part] * b.num_rows, pa.int32())], names=shape.names)

    local = written(ranged.mapInArrow(summed, shape), "ranges")
    totals = local.groupBy(range_, group_).agg(*[F.sum(own[n]).alias(own[n]) for n in names])
    earlier = Window.partitionBy(group_).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(range_).alias("r_"), F.col(group_).alias("g_"), *[F.coalesce(F.sum(own[n]).over(earlier), F.lit(0)).alias(start[n]) for n in names])
    joined = local.join(starts, (F.col(range_) == F.col("r_")) & F.col(group_).eqNullSafe(F.col("g_")))
    kept = [F.col(c) for c in df.columns if c not in names]
    return joined.select(*kept, *[(F.col(inner[n]) + F.col(start[n])).alias(n) for n in names])
