"""Exact top-k inner products: vectors by descending length, pruned by Cauchy-Schwarz bounds.

Vectors are range-sorted by length and kept in blocks. The block of longest vectors gives each
query a first threshold. A query meets a block only if |q| times the block's greatest length can
reach it: blocks of queries are dealt to the blocks by shuffle, and each task holds one block at a
time and lets its queries pass by. Inside, coordinates rotated by the SVD basis of all vectors are summed up to a few leading
ones, and what |q| and |x| have left bounds the rest, so that most vectors are dropped before their
integer product is taken. The kept ones' integer products are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import few, materialise, partitions, read

BLOCK, QUERIES, HEADS = 4096, 256, (8, 24)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, nth, dim, length, v) of the rows that take part: floor(scale * x) as longs; nth
    numbers the rows of one vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), finite.alias("finite"))
    rows = rows.where("vec_id is not null and finite").select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    return rows.select("vec_id", nth.alias("nth"), F.size("v").alias("dim"), length.alias("length"), "v")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), -1)


def rotation(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The most frequent dimension and the basis of its vectors' singular directions, from the sum
    of their outer products over all rows."""
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return 0, np.zeros((0, 0))
    d = dims["dim"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            m = matrix(b.column("v")).astype(np.float64) if b.num_rows else np.zeros((0, d))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["p"])

    per = rows.where(F.col("dim") == d).select("v").mapInArrow(products, "p array<double>")
    summed = per.select(F.posexplode("p").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(d * d)
    for r in summed:
        total[r["at"]] = r["x"]
    _, basis = np.linalg.eigh(total.reshape(d, d)) if d else (None, np.zeros((0, 0)))
    return d, basis[:, ::-1].copy()


class Block:
    """Vectors of one dimension, longest first."""

    def __init__(self, ids: np.ndarray, nth: np.ndarray, v: np.ndarray, basis: np.ndarray | None):
        self.ids, self.nth, self.v = ids, nth, v
        f = v.astype(np.float64)
        self.length = np.sqrt((f * f).sum(1))
        self.rotated = f @ basis if basis is not None and len(basis) == v.shape[1] else f
        left = np.cumsum((self.rotated**2)[:, ::-1], 1)[:, ::-1] if v.shape[1] else self.rotated
        self.rest = {h: np.sqrt(left[:, h]) if h < v.shape[1] else np.zeros(len(v)) for h in HEADS}


def top(queries: Block, floor: np.ndarray, block: Block, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, scores) of the k best of the block for each query, of those that can
    still reach the query's floor. Bounds are widened by 1e-6 of the lengths for rounding."""
    slack = 1e-6 * (1 + np.outer(queries.length, block.length))
    alive = np.outer(queries.length, block.length) + slack >= floor[:, None]
    for h in HEADS:
        if h < block.v.shape[1] and alive.any():
            bound = queries.rotated[:, :h] @ block.rotated[:, :h].T + np.outer(queries.rest[h], block.rest[h])
            alive &= bound + slack >= floor[:, None]
    out = []
    for q in np.flatnonzero(alive.any(1)):
        at = np.flatnonzero(alive[q])
        at = at[(block.ids[at] != queries.ids[q]) | (block.nth[at] != queries.nth[q])]
        scores = block.v[at] @ queries.v[q]
        at, scores = at[scores >= floor[q]], scores[scores >= floor[q]]
        best = np.lexsort((block.ids[at], -scores))[:k]
        out.append((int(q), block.ids[at[best]], scores[best]))
    return out


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, query_nth, rank, vec_id, score: the k greatest integer inner products of each query row
    (vec_id divisible by ``every``) with all other rows of its length, ties to smaller vec_id.

    vectors has vec_id and embedding (and any more columns). Rows whose vec_id is null, or whose
    vector is null or holds null or non-finite components, take no part. A repeated vec_id is a
    row of its own: each is a query (numbered by query_nth) and a candidate of the others. Scores
    are 64-bit. No query, or no candidate, gives no row.
    """
    spark = vectors.sparkSession
    rows = materialise(integers(vectors, scale), "vectors")
    d, basis = rotation(rows)

    def packed(size: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            held: dict[int, list] = {}
            number = itertools.count()

            def flush(dim: int) -> pa.RecordBatch:
                ids, nth, floats, v = zip(*held.pop(dim), strict=True)
                values = [part + next(number) * dealt, dim, float(max(floats)), np.array(ids, "<i8").tobytes(), np.array(nth, "<i8").tobytes(), np.array(v, "<i8").tobytes()]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["block", "dim", "longest", "ids", "nth", "v"])

            for b in batches:
                for i, n, dim, length, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "nth", "dim", "length", "v")), strict=True):
                    held.setdefault(dim, []).append((i, n, length, v))
                    if len(held[dim]) == size:
                        yield flush(dim)
            for dim in list(held):
                yield flush(dim)

        return pack

    dealt = partitions(spark)
    shape = "block long, dim int, longest double, ids binary, nth binary, v binary"
    ranged = rows.repartitionByRange(dealt, F.desc("length"), "vec_id", "nth").sortWithinPartitions(F.desc("length"), "vec_id", "nth")
    blocks = materialise(ranged.mapInArrow(packed(BLOCK), shape), "blocks")

    def load(ids: bytes, nth: bytes, v: bytes, dim: int) -> Block:
        n = len(ids) // 8
        return Block(np.frombuffer(ids, "<i8"), np.frombuffer(nth, "<i8"), np.frombuffer(v, "<i8").reshape(n, dim), basis if dim == d else None)

    # its number first: an ordered limit would send the first block of every task to the driver
    longest = blocks.where(F.col("dim") == d).select("block", "longest").orderBy(F.desc("longest"), "block").first()
    head = blocks.where(F.col("block") == longest["block"]).collect() if longest is not None else []  # one block

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score within the longest block: no smaller one can be among the k best."""
        first = load(head[0]["ids"], head[0]["nth"], head[0]["v"], d) if head else None
        for batch in packed(QUERIES)(batches):
            r = batch.to_pylist()[0]
            q = load(r["ids"], r["nth"], r["v"], r["dim"])
            floor = np.full(len(q.ids), np.iinfo(np.int64).min, np.int64)
            if first is not None and r["dim"] == d:
                for row, _, scores in top(q, floor, first, k):
                    if len(scores) == k:
                        floor[row] = scores[-1]
            need = float((floor / np.maximum(q.length, 1e-9)).min()) if (floor > 0).all() else 0.0
            yield batch.append_column("floor", pa.array([floor.tobytes()], pa.binary())).append_column("need", pa.array([need * (1 - 1e-6)], pa.float64()))

    asked = few(rows.where(F.col("vec_id") % every == 0))
    queries = materialise(asked.mapInArrow(with_floor, shape + ", floor binary, need double"), "queries")
    # a few numbers for each block are broadcast; vectors of queries and of blocks meet by shuffle
    known = F.broadcast(blocks.select("block", F.col("dim").alias("b_dim"), "longest"))
    asking = queries.drop("block", "longest").join(known, (F.col("dim") == F.col("b_dim")) & (F.col("longest") >= F.col("need")))
    columns = ["block", "dim", "ids", "nth", "v"]
    both = blocks.select(*columns, F.lit(None).cast("binary").alias("floor")).unionByName(asking.select(*columns, "floor"))
    met = both.repartitionById(dealt, F.pmod("block", F.lit(dealt)).cast("int")).sortWithinPartitions("block", F.col("floor").isNotNull())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "query_nth", "vec_id", "score"]
        block = None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own = load(r["ids"], r["nth"], r["v"], r["dim"])
                if r["floor"] is None:  # the block itself comes first, and its queries after it
                    block = own
                    continue
                out: list[tuple] = []
                for row, ids, scores in top(own, np.frombuffer(r["floor"], "<i8"), block, k):
                    out += [(int(own.ids[row]), int(own.nth[row]), i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    best = met.select("dim", "ids", "nth", "v", "floor").mapInArrow(scored, "query_id long, query_nth long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_nth").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "query_nth", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
