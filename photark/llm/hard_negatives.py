"""Hard negatives by a vector-approximation file.

Rows are kept in blocks. Each block cuts every dimension into cells of about equal numbers of its own rows and
keeps a row's cell numbers, one byte a dimension. For a query, a table of the least and the greatest product with
each cell turns these bytes into a lower and an upper bound of the score by lookup and sum. Only rows whose bounds
let them enter the answer are scored exactly: the k best of the anchor's label first, and then, for each of these
positives, the k best rows of other labels within its window of scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import few, materialise, partitions, read

BLOCK, QUERIES, CELLS = 2048, 128, 256
BLOBS = ("rows", "ids", "labels", "v")
SHAPE = "block long, dim int, least_label long, most_label long, " + ", ".join(f"{c} binary" for c in BLOBS)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, dim, v) of the rows that take part; row numbers them, and stays once this is written."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), finite.alias("finite"))
    kept = own.where("vec_id is not null and label is not null and finite")
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dim"), v.alias("v"))


def packed(size: int, dealt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one dimension, ``size`` at a time, as one row of arrays each. Its number modulo ``dealt`` is its partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        number = itertools.count()

        def flush(dim: int) -> pa.RecordBatch:
            rows, ids, labels, v = (np.array(c, "<i8") for c in zip(*held.pop(dim), strict=True))
            values = [part + next(number) * dealt, dim, int(labels.min()), int(labels.max()), rows.tobytes(), ids.tobytes(), labels.tobytes(), v.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["block", "dim", "least_label", "most_label", *BLOBS])

        for b in batches:
            for dim, *own in zip(*(b.column(c).to_pylist() for c in ("dim", "row", "vec_id", "label", "v")), strict=True):
                held.setdefault(dim, []).append(own)
                if len(held[dim]) == size:
                    yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return pack


def approximate(v: np.ndarray, cells: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Cell numbers (a row a dimension), and the least and the greatest value in each cell of each dimension."""
    codes, spans = np.zeros(v.T.shape, np.uint8), []
    for d, x in enumerate(v.T):
        values = np.unique(x)
        if len(values) > cells:
            values = np.unique(np.sort(x)[np.arange(cells) * len(x) // cells])  # cells begin here
        at = np.searchsorted(values, x, "right") - 1
        low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, at, x)
        np.maximum.at(high, at, x)
        codes[d] = at
        spans.append((low, high))
    return codes, spans


def approximated(size: int, cells: int, dealt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with their approximations: codes, the number of cells of each dimension, and the cells' spans."""

    def approximating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in packed(size, dealt)(batches):
            r = block.to_pylist()[0]
            codes, spans = approximate(np.frombuffer(r["v"], "<i8").reshape(len(r["rows"]) // 8, r["dim"]), cells)
            sizes = np.array([len(low) for low, _ in spans], "<i4")
            ends = [np.concatenate([s[i] for s in spans] or [np.zeros(0, np.int64)]).astype("<i8") for i in (0, 1)]
            for name, value in zip(("codes", "sizes", "lows", "highs"), (codes, sizes, *ends), strict=True):
                block = block.append_column(name, pa.array([value.tobytes()], pa.binary()))
            yield block

    return approximating


def bounds(q: np.ndarray, r: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of all q with the n rows of a block: per dimension a table of the
    products with each cell's ends, looked up by the rows' cell numbers."""
    codes = np.frombuffer(r["codes"], np.uint8).reshape(r["dim"], n)
    ends = np.cumsum(np.frombuffer(r["sizes"], "<i4"))
    lows, highs = np.frombuffer(r["lows"], "<i8"), np.frombuffer(r["highs"], "<i8")
    lower, upper, at = np.zeros((len(q), n), np.int64), np.zeros((len(q), n), np.int64), 0
    for d, end in enumerate(ends):
        a, b = np.outer(q[:, d], lows[at:end]), np.outer(q[:, d], highs[at:end])
        lower += np.minimum(a, b)[:, codes[d]]
        upper += np.maximum(a, b)[:, codes[d]]
        at = end
    return lower, upper


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value, or less than any if there are fewer."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else np.iinfo(np.int64).min


class Best:
    """The k best (score, id, row) for each key, over the blocks that one query block has met in this task."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, key: tuple) -> int:
        found = self.held.get(key, ())
        return -found[-1][0] if len(found) == self.k else np.iinfo(np.int64).min

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        first = np.lexsort((ids, -scores))[: self.k]
        new = zip((-scores[first]).tolist(), ids[first].tolist(), rows[first].tolist(), strict=True)
        self.held[key] = sorted([*self.held.get(key, ()), *new])[: self.k]


def best_of(q: dict, r: dict, best: Best, windows: bool, percents: tuple[int, int]) -> None:
    """Adds a block's rows to what its queries have: rows of the query's label, or with ``windows`` those of other
    labels within the window of each of its positives."""
    qv, v = (np.frombuffer(x["v"], "<i8").reshape(len(x["rows"]) // 8, q["dim"]) for x in (q, r))
    qrow, qlabel, rows, ids, labels = (np.frombuffer(x, "<i8") for x in (q["rows"], q["labels"], r["rows"], r["ids"], r["labels"]))
    lower, upper = bounds(qv, r, len(rows))
    for i in range(len(qrow)):
        fits = (labels != qlabel[i]) if windows else (labels == qlabel[i]) & (rows != qrow[i])
        if not fits.any():
            continue
        if windows:  # 100 * score lies from the first to the second percent of the positive's
            ranges = [((int(qrow[i]), n, p_id, p), -(-percents[0] * p // 100), percents[1] * p // 100) for n, p_id, p in q["positives"][i]]
        else:
            ranges = [((int(qrow[i]),), None, None)]
        for key, least, most in ranges:
            may, surely = fits, fits
            if windows:
                may = fits & (upper[i] >= least) & (lower[i] <= most)
                surely = may & (lower[i] >= least) & (upper[i] <= most)
            reach = max(best.floor(key), kth(lower[i, surely], best.k))
            at = np.flatnonzero(may & (upper[i] >= reach))
            scores = v[at] @ qv[i]
            if windows:
                inside = (scores >= least) & (scores <= most)
                at, scores = at[inside], scores[inside]
            if len(at):
                best.add(key, scores, ids[at], rows[at])


def meet(queries: DataFrame, blocks: DataFrame, k: int, windows: bool, percents: tuple[int, int], shape: str) -> DataFrame:
    """Each query block beside each block of its dimension that it may need, and for each two the k best for each key.

    A few numbers for each block are broadcast. Vectors of queries and of blocks meet by shuffle: a task holds one block at
    a time, and its queries pass by."""
    dealt = partitions(queries.sparkSession)
    mixed = (F.col("least") != F.col("most_label")) | (F.col("most") != F.col("least_label"))
    apart = (F.col("least") > F.col("most_label")) | (F.col("most") < F.col("least_label"))
    known = F.broadcast(blocks.select("block", F.col("dim").alias("b_dim"), F.col("least_label").alias("least"), F.col("most_label").alias("most")))
    asking = queries.drop("block").join(known, (F.col("dim") == F.col("b_dim")) & (mixed if windows else ~apart))
    asked = ["block", "dim", "rows", "labels", "v", *(["positives"] if windows else [])]
    held = ["block", "dim", *BLOBS, "codes", "sizes", "lows", "highs"]
    both = blocks.select(F.lit(False).alias("asks"), *held).unionByName(asking.select(F.lit(True).alias("asks"), *asked), allowMissingColumns=True)
    met = both.repartitionById(dealt, F.pmod("block", F.lit(dealt)).cast("int")).sortWithinPartitions("block", "asks")
    names = [c.split()[0] for c in shape.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if not r["asks"]:  # the block itself comes first, and its queries after it
                    block = r
                    continue
                best = Best(k)
                best_of(r | {"positives": [[tuple(p.values()) for p in one] for one in r.get("positives") or ()]}, block, best, windows, percents)
                out = [(*key, *one) for key, held in best.held.items() for one in held]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))], names=names)

    return met.mapInArrow(found, shape)


def ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("minus", "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, percents: tuple[int, int] = (30, 90), scale: int = 256, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, embedding and an integer label (and any more columns). Rows with a null id or label, or whose
    vector is null or holds null or non-finite components, take no part. Scores are inner products of floor(scale * x),
    64-bit: |scale * x| should stay below 2**31 / dimensions. Anchors are rows whose vec_id is divisible by ``every``;
    an anchor's positives are the first of the other rows of its label, by descending score, ties by smaller vec_id. For
    each positive come the first rows of other labels, in that order, whose score in percent of the positive's lies
    within ``percents``, ends included. A repeated vec_id is a row of its own. Only vectors of the same number of
    dimensions meet. ``block`` rows are approximated together, with up to ``cells`` (256 at most) cells a dimension. An anchor without a positive, or a positive with an empty window, gives no row; no anchor, no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(integers(vectors, scale), "vectors")
    dealt = partitions(spark)
    ranged = rows.repartitionByRange(dealt, "label", "row").sortWithinPartitions("label", "row")
    blocks = materialise(ranged.mapInArrow(approximated(block, cells, dealt), SHAPE + ", codes binary, sizes binary, lows binary, highs binary"), "approximations")
    asked = few(rows.where(F.col("vec_id") % every == 0).repartitionByRange(dealt, "label", "row").sortWithinPartitions("label", "row"))
    queries = materialise(asked.mapInArrow(packed(QUERIES, dealt), SHAPE), "anchors")

    near = meet(queries, blocks, positives, False, percents, "anchor long, minus long, id long, row long")
    near = ranked(near, ["anchor"], positives).select("anchor", F.struct("row", "id", (-F.col("minus")).alias("score")).alias("positive"))
    near = materialise(near.groupBy("anchor").agg(F.sort_array(F.collect_list("positive")).alias("positives")), "positives")  # a few each

    with_positives = rows.where(F.col("vec_id") % every == 0).join(near, F.col("row") == F.col("anchor")).drop("anchor")
    asked = few(with_positives.repartitionByRange(dealt, "label", "row").sortWithinPartitions("label", "row"))
    kind = "array<array<struct<row:long,id:long,score:long>>>"

    def with_positives_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept.update(zip(b.column("row").to_pylist(), b.column("positives").to_pylist(), strict=True))
                yield b

        for block in packed(QUERIES, dealt)(seen()):
            own = [kept.pop(x) for x in np.frombuffer(block.column("rows")[0].as_py(), "<i8").tolist()]
            struct = pa.struct([("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
            yield block.append_column("positives", pa.array([own], pa.list_(pa.list_(struct))))

    queries = materialise(asked.mapInArrow(with_positives_packed, f"{SHAPE}, positives {kind}"), "anchors")
    found = meet(queries, blocks, negatives, True, percents, "anchor long, positive long, positive_id long, positive_score long, minus long, id long, row long")
    found = ranked(found, ["anchor", "positive", "positive_id", "positive_score"], negatives)
    ids = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(ids, "anchor").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", (-F.col("minus")).alias("negative_score"))


def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")))


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.rid <> c.rid
), p AS (
  SELECT anchor, rid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY s.anchor, positive ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM n WHERE rank <= 10
"""
