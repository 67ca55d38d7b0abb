"""Harmonic packing of token sequences.

A document is cut into pieces of reciprocal capacity: whole sequences of C tokens, then C//2,
C//3, ..., each the largest that fits, until fewer than ``loose`` tokens are left. A piece of
class k goes to a bin with k - 1 others of its class, so every worker fills bins on its own by
counting. A remainder under ``loose`` is of the class k = C // length, and its bins are more than
k/(k+1) full. What a worker can't complete is completed with that of neighbouring workers, 64 at
a time; the fewer than k pieces a class that remain in the end (a fixed bound) are laid end to
end, and the last part of a sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import materialise, read
from photark.llm.tokens import encoded

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STATE = FIELDS + ", klass int, worker int, ids binary"
ROUND = 1 << 57


def cuts(n: int, capacity: int, loose: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, class) of the pieces of n tokens."""
    start = 0
    while n:
        if n < loose:
            length, k = n, capacity // n
        else:
            k = -(-capacity // n)
            while capacity // k > n:
                k += 1
            length = capacity // k
        yield start, length, k
        start, n = start + length, n - length


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, loose: int = 128, neighbours: int = 64) -> DataFrame:
    """One row a piece of docs (doc_id, text, any more columns): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; long texts make many pieces; equal rows are packed
    each for itself; no rows give no rows. Memory holds one batch of texts and under k pieces a class.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        waiting: dict[int, list] = defaultdict(list)
        bins = 0
        out: list[tuple] = []
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for row, ids in encoded(batch, tokenizer):
                ids += end
                n = len(ids) // 4
                for start, length, k in cuts(n, capacity, loose):
                    part = ids[4 * start : 4 * (start + length)]
                    waiting[k].append((ids_of[row], start, length, zlib.crc32(part), n, part))
                    if len(waiting[k]) == k:
                        at = 0
                        for d, s, m, crc, total, _ in waiting.pop(k):
                            out.append((d, s, m, crc, total, (worker << 32) + bins, at, k, worker, None))
                            at += m
                        bins += 1
                if len(out) >= 10_000:
                    yield rows(out)
                    out = []
        yield rows(out + [(d, s, m, crc, n, None, None, k, worker, part) for k, ps in sorted(waiting.items()) for d, s, m, crc, n, part in ps])

    filled = materialise(docs.select("doc_id", "text").mapInArrow(fill, STATE), "packed")
    done = filled.where("sequence_id is not null")
    pending = filled.where("sequence_id is null")
    workers = (filled.agg(F.max("worker")).first()[0] or 0) + 1
    step = 0
    while workers > 1:
        step, workers = step + 1, -(-workers // neighbours)
        pending = pending.withColumn("worker", F.expr(f"worker div {neighbours}").cast("int"))
        group = Window.partitionBy("klass", "worker")
        n = F.row_number().over(group.orderBy("doc_id", "start", "ids")) - 1
        counted = pending.withColumn("n", n).withColumn("full", F.count("*").over(group) - F.count("*").over(group) % F.col("klass"))
        binned = F.lit(step * ROUND) + F.col("klass").cast("long") * (1 << 45) + F.col("worker").cast("long") * (1 << 25) + F.expr("n div klass")
        counted = counted.withColumn("sequence_id", F.when(F.col("n") < F.col("full"), binned))
        within = Window.partitionBy("sequence_id", "klass", "worker").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        placed = F.when(F.col("sequence_id").isNotNull(), F.coalesce(F.sum("length").over(within), F.lit(0)))
        counted = materialise(counted.withColumn("offset", placed).drop("n", "full"), "packed-round")
        done = done.unionByName(counted.where("sequence_id is not null"))
        pending = counted.where("sequence_id is null")
    step += 1

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most k - 1 pieces of each class come here."""
        left = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["klass"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        total = sum(r["length"] for r in left)
        bounds = [*range(0, total, capacity)]
        if bounds:  # the last sequence is cut at powers of two
            at, rest = bounds[-1], total - bounds[-1]
            while rest:
                at, rest = at + (1 << rest.bit_length() - 1), rest - (1 << rest.bit_length() - 1)
                bounds.append(at)
        out, begin, i = [], 0, 0
        for r in left:
            done_ = 0
            while done_ < r["length"]:
                while bounds[i + 1] <= begin + done_:
                    i += 1
                m = min(r["length"] - done_, bounds[i + 1] - begin - done_)
                part = r["ids"][4 * done_ : 4 * (done_ + m)]
                out.append((r["doc_id"], r["start"] + done_, m, zlib.crc32(part), r["doc_tokens"], step * ROUND + i, begin + done_ - bounds[i], r["klass"], 0, None))
                done_ += m
            begin += r["length"]
        yield rows(out)

    final = pending.repartition(1).mapInArrow(last, STATE)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return done.select(names).unionByName(final.select(names))


def rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in STATE.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def op5_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
