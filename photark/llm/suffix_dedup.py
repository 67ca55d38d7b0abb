"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Every 100-byte string holds at least one anchor: a position whose 32-byte prefix has the least hash
of some 69 neighbouring ones. Anchors depend on those bytes only, so equal strings have equal
anchors in equal places, and the suffixes that start at anchors are enough to find every match.

Documents come in batches by ascending doc_id. A batch's suffixes, sorted by the hash of their
prefix and of their surroundings, are merge-scanned with the sorted levels of the batches before;
each level is twice the size of the one above it, and equal ones merge into the next. The scan
finds two kinds of repeats. A suffix whose whole surroundings (all 100-byte strings around its
prefix) came before is covered. Where prefixes agree but surroundings differ, the 100-byte
strings in the surroundings are compared one offset at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import binary, materialise, partitions, read

SPAN, PREFIX = 100, 32
REACH = SPAN - PREFIX  # bytes before a prefix, and after it, that a string around it can take
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:8] for i in range(256)), "<u8")
ANCHOR = "key long, ctx long, doc long, nth int, pos int"
CHUNK = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


class Rolling:
    """Hashes of any substrings of data, the same wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.full(n, INVERSE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        self.sums = np.zeros(n, U64)
        np.cumsum(GEAR[data] * powers[:-1], out=self.sums[1:])
        self.back = np.full(n, BASE)
        self.back[0] = 1
        self.back = np.multiply.accumulate(self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def sliding(h: np.ndarray, width: int, op) -> np.ndarray:
    done, out = 1, h
    while 2 * done <= width:
        out, done = op(out[:-done], out[done:]), 2 * done
    return op(out[: len(h) - width + 1], out[width - done :]) if done < width else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text's number, position, key, ctx) of all anchors of some texts laid end to end."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return empty, empty, empty.astype(U64), empty.astype(U64)
    rolling = Rolling(data)
    starts = np.arange(len(data) - PREFIX + 1)
    h = mixed(rolling.of(starts, starts + PREFIX))
    h[h == U64(2**64 - 1)] -= U64(1)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    for e in ends[:-1]:  # prefixes over the end of a text are none
        h[max(0, e - PREFIX + 1) : e] = U64(2**64 - 1)
    least = sliding(h, REACH + 1, np.minimum)
    pad = np.zeros(REACH, U64)
    chosen = sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
    at = np.flatnonzero((chosen == h) & (h != U64(2**64 - 1)))
    number = np.searchsorted(ends, at, side="right")
    fits = lengths[number] >= SPAN
    at, number = at[fits], number[fits]
    left = np.maximum(begins[number], at - REACH)
    right = np.minimum(ends[number], at + SPAN)
    ctx = mixed(rolling.of(left, right) ^ ((at - left).astype(U64) << U64(8) | (right - at).astype(U64)))
    return number, at - begins[number], h[at], ctx


def places(docs: DataFrame) -> DataFrame:
    """docs as (doc, nth, text): doc_id, null as the least long; nth numbers the rows of one doc_id by text."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        return docs.select("doc", F.lit(0).alias("nth"), "text")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1
    return docs.select("doc", nth.cast("int").alias("nth"), "text")


def first_of_each(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by keys, then place; and in that order, which are the first of their keys."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, first


def batch_rows(docs: DataFrame) -> DataFrame:
    """Of docs (doc, nth, text): the anchors (stop is -1), and the intervals (pos to stop, under any key) that earlier
    anchors of the same surroundings cover within one group of texts; those anchors are left out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(docs_: list[int], nths: list[int], texts: list[bytes]) -> pa.RecordBatch:
            number, pos, key, ctx = anchors(texts)
            doc, nth = np.array(docs_, np.int64)[number], np.array(nths, np.int32)[number]
            order, first = first_of_each([key, ctx], [doc, nth, pos])
            keep, gone = np.sort(order[first]), np.sort(order[~first])
            start, stop = np.maximum(pos[gone] - REACH, 0), pos[gone] + SPAN
            if len(gone):  # neighbours' intervals overlap
                new = np.ones(len(gone), bool)
                new[1:] = (number[gone][1:] != number[gone][:-1]) | (start[1:] > stop[:-1])
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(gone)) - 1
                gone, start, stop = gone[at], start[at], stop[last]
            n, m = len(keep), len(gone)
            columns = [
                pa.array(np.concatenate([key[keep].view(np.int64), key[gone].view(np.int64)])), pa.array(np.concatenate([ctx[keep].view(np.int64), np.zeros(m, np.int64)])),
                pa.array(np.concatenate([doc[keep], doc[gone]])), pa.array(np.concatenate([nth[keep], nth[gone]])),
                pa.array(np.concatenate([pos[keep], start]).astype(np.int32)), pa.array(np.concatenate([np.full(n, -1), stop]).astype(np.int32)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["key", "ctx", "doc", "nth", "pos", "stop"])

        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for d, n, t in zip(batch.column("doc").to_pylist(), batch.column("nth").to_pylist(), batch.column("text"), strict=True):
                text = (t.as_py() or "").encode()
                for h, x in zip(held, (d, n, text), strict=True):
                    h.append(x)
                size += len(text)
                if size >= CHUNK:
                    yield emit(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield emit(*held)

    return docs.mapInArrow(made, ANCHOR + ", stop int")


def scan(rows: DataFrame, keep_level: bool) -> DataFrame:
    """Merge-scan of batch_rows with levels, sorted by key, ctx and place. old: 0 the batch, 1 a level that merges with
    it, 2 another level. Returns kind 'i': intervals (pos to stop), now also of new anchors that are not the
    first of their surroundings; 'e': the first of each surroundings of a key that has several, a new one
    among them; and if the level is kept 'n': other new firsts, 'o': other rows of merging levels."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        names = ["key", "ctx", "doc", "nth", "pos", "stop", "old"]

        def output(c: list[np.ndarray], kind: np.ndarray) -> pa.RecordBatch:
            columns = [*c[:4], c[4].astype(np.int32), c[5].astype(np.int32), c[6]]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kind.astype(object), pa.string())], names=[*names, "kind"])

        def emit(c: list[np.ndarray]) -> pa.RecordBatch:
            key, ctx, doc, nth, pos, stop, old = c
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            first = new_key.copy()
            first[1:] |= ctx[1:] != ctx[:-1]
            group = np.cumsum(new_key) - 1
            classes = np.bincount(group, first, minlength=group[-1] + 1)[group]
            fresh = np.bincount(group, first & (old == 0), minlength=group[-1] + 1)[group]
            rest = np.where(old == 0, "n", np.where(old == 1, "o", "")) if keep_level else np.full(len(key), "")
            kind = np.where(~first, np.where(old == 0, "i", ""), np.where((classes > 1) & (fresh > 0), "e", rest))
            interval = kind == "i"
            c[4], c[5] = np.where(interval, np.maximum(pos - REACH, 0), pos), np.where(interval, pos + SPAN, stop)
            return output([x[kind != ""] for x in c], kind[kind != ""])

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            done = cols[5] >= 0
            if done.any():
                yield output([c[done] for c in cols], np.full(done.sum(), "i"))
                cols = [c[~done] for c in cols]
            if carry is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            carry = [c[cut:] for c in cols]
            if cut:
                yield emit([c[:cut] for c in cols])
        if carry is not None and len(carry[0]):
            yield emit(carry)

    by = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "ctx", "doc", "nth", "pos")
    return by.mapInArrow(scanned, ANCHOR + ", stop int, old int, kind string")


def surroundings(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (key, doc, nth, pos) with the bytes before (at most REACH) and from the anchor on (at most SPAN)."""
    per = edges.groupBy("doc", "nth").agg(F.collect_list(F.struct("key", "pos")).alias("at"))
    per = per.select(F.col("doc").alias("of"), F.col("nth").alias("of_nth"), "at")
    joined = docs.join(per, (F.col("doc") == F.col("of")) & (F.col("nth") == F.col("of_nth"))).select("doc", "nth", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "nth", "pos", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for d, n, t, at in zip(batch.column("doc").to_pylist(), batch.column("nth").to_pylist(), batch.column("text"), batch.column("at"), strict=True):
                text = (t.as_py() or "").encode()
                for a in at.as_py():
                    p = a["pos"]
                    out.append((a["key"], d, n, p, text[max(0, p - REACH) : p], text[p : p + SPAN]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(cut, "key long, doc long, nth int, pos int, left binary, right binary")


def compare(around: DataFrame) -> DataFrame:
    """Intervals (doc, nth, pos, stop) of edges that earlier ones of their key cover: around an anchor the
    string at each offset is looked up among those of the same key and offset; covered ones overlap."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc", "nth", "pos"]
        carry: pa.Table | None = None

        def emit(t: pa.Table) -> pa.RecordBatch:
            key, doc, nth, pos = (t.column(n).to_numpy() for n in names)
            group = np.cumsum(np.append(True, key[1:] != key[:-1])).astype(U64)
            low, high = np.full(len(key), -1), np.full(len(key), -1)
            left, right = t.column("left").to_pylist(), t.column("right").to_pylist()
            width = REACH + SPAN
            text = np.frombuffer(b"".join(l.rjust(REACH, b"\0") + r.ljust(SPAN, b"\0") for l, r in zip(left, right, strict=True)), np.uint8).reshape(-1, width)
            powers = np.multiply.accumulate(np.append(U64(1), np.full(width, INVERSE)))
            back = np.multiply.accumulate(np.append(U64(1), np.full(width, BASE)))
            sums = np.zeros((len(text), width + 1), U64)
            np.cumsum(GEAR[text] * powers[:-1], axis=1, out=sums[:, 1:])
            begin = REACH - np.array([len(x) for x in left])
            end = REACH + np.array([len(x) for x in right])
            for s in range(REACH + 1):
                rows = np.flatnonzero((begin <= s) & (s + SPAN <= end))
                h = mixed((sums[rows, s + SPAN] - sums[rows, s]) * back[s]) ^ mixed(group[rows] * BASE)
                _, first = np.unique(h, return_index=True)  # rows are in place order within a key
                again = np.ones(len(rows), bool)
                again[first] = False
                hit = rows[again]
                low[hit] = np.where(low[hit] < 0, s, low[hit])
                high[hit] = s
            found = low >= 0
            columns = [doc[found], nth[found], (pos - REACH + low)[found].astype(np.int32), (pos - REACH + high + SPAN)[found].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "nth", "pos", "stop"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            if not t.num_rows:
                continue
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            for a, b in pieces(key[:cut], 5000):
                yield emit(t.slice(a, b - a))
            carry = t.slice(cut)
        if carry is not None and carry.num_rows:
            yield emit(carry)

    by = around.repartition(partitions(around.sparkSession), "key").sortWithinPartitions("key", "doc", "nth", "pos")
    return by.mapInArrow(compared, "doc long, nth int, pos int, stop int")


def pieces(key: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Parts of sorted keys with about so many rows, whole keys each."""
    start = 0
    while start < len(key):
        end = min(len(key), start + rows)
        if end < len(key):
            end = int(np.searchsorted(key, key[end - 1], side="right"))
        yield start, end
        start = end


def repeats(docs: DataFrame, batches: int = 3) -> DataFrame:
    """Intervals (doc, nth, pos, stop) that cover every repeated byte of docs (doc, nth, text), and no other.
    They may overlap and end beyond the text."""
    spark = docs.sparkSession
    bounds = docs.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    limits = [None, *sorted(set(bounds)), None]
    levels: list[tuple[int, DataFrame]] = []  # (batches inside, rows), largest first
    scans = []
    for low, high in zip(limits, limits[1:], strict=False):
        part = docs
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        merging, size = len(levels), 1  # levels from here on merge with the batch
        while merging and levels[merging - 1][0] == size:
            merging, size = merging - 1, 2 * size
        rows = batch_rows(part).withColumn("old", F.lit(0))
        for n, (_, level) in enumerate(levels):
            rows = rows.unionByName(level.select("*", F.lit(-1).alias("stop"), F.lit(1 if n >= merging else 2).alias("old")))
        found = materialise(scan(rows, high is not None), "scan", partition_by=["kind"], compression="zstd")
        scans.append(found)
        level = found.where("kind in ('e', 'n', 'o') and old < 2").select("key", "ctx", "doc", "nth", "pos")
        levels = [*levels[:merging], (size, level)]
    found = scans[0]
    for f in scans[1:]:
        found = found.unionByName(f)
    edges = found.where("kind = 'e'").select("key", "doc", "nth", "pos").distinct()
    around = materialise(surroundings(edges, docs), "surroundings", compression="zstd")
    compared = materialise(compare(around), "edges")
    return found.where("kind = 'i'").select("doc", "nth", "pos", "stop").unionByName(compared)


def covered(intervals: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals, within n bytes."""
    out: list[list[int]] = []
    for start, stop in sorted(intervals):
        stop = min(stop, n)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        elif start < stop:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, batches: int = 3) -> DataFrame:
    """docs (doc_id, text, any more columns) without bytes covered by a SPAN-byte string that also starts
    earlier: (doc_id, n_bytes, n_removed, n_spans, kept).

    Earlier is by doc_id (null first), rows of one doc_id by text, then by position; equal rows count
    as one after the other. Null texts are empty. Texts under SPAN bytes are kept whole. kept is
    binary, as cuts may fall inside a character.
    """
    placed = places(docs)
    found = repeats(placed, batches)
    per = found.groupBy("doc", "nth").agg(F.collect_list(F.struct("pos", "stop")).alias("spans"))
    per = per.select(F.col("doc").alias("of"), F.col("nth").alias("of_nth"), "spans")
    joined = placed.join(per, (F.col("doc") == F.col("of")) & (F.col("nth") == F.col("of_nth")), "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for d, text, spans in zip(part.column("doc").to_pylist(), binary(part, "text"), part.column("spans"), strict=True):
                    runs = covered([(s["pos"], s["stop"]) for s in spans.as_py() or ()], len(text))
                    edges = [0, *[x for run in runs for x in run], len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((None if d == -(1 << 63) else d, len(text), len(text) - len(kept), len(runs), kept))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_suffix_dedup(spark, sf_dir) -> DataFrame:
    kept = remove(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
