"""Media payloads in content-defined chunks, each different chunk stored once.

A text's bytes become 8-bit samples, 64 a row, of a PGM picture. The samples are cut where a gear
hash of the last 32 bytes has its upper bits zero, so equal stretches give equal chunks wherever they
stand. Spark joins on the chunks' SHA-256 digests keep one payload a digest; an ordered list of
digests rebuilds a picture, and its own digest, taken before storing, must agree.

Most pictures share no chunk with another. A filter of fixed size, made from all digests that
occur more than once, tells where a chunk may be shared: pictures without such chunks are stored in place,
chunk after chunk, and only the others' chunks move. A filter that is too small for the data
moves more chunks than needed, and changes no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.llm.common import binary, materialise, read

ROW = 64
LEAST, MOST, CUT_BITS = 512, 8192, 11
GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), "<u4")
STORED = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("chunks", pa.list_(pa.binary())), ("payload", pa.binary())])
SHAPE = "kind string, key long, doc_id long, n_bytes long, digest binary, chunks array<binary>, payload binary"


def samples(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of ROW."""
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def picture(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def cut(payload: bytes) -> list[bytes]:
    """Chunks of LEAST to MOST bytes, the last may be shorter, that end where the gear hash says so."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # sums over the last 2, 4, ..., 32 bytes
        more = h.copy()
        more[s:] += h[:-s] << np.uint32(s)
        h = more
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, start, n = [], 0, len(payload)
    for end in [*ends, n]:
        while end - start > MOST:
            out.append(payload[start : start + MOST])
            start += MOST
        if end - start >= LEAST or end == n and end > start:
            out.append(payload[start:end])
            start = end
    return out


class Filter:
    """Two bits a digest, of ``bits`` (a power of two)."""

    def __init__(self, words: np.ndarray):
        self.bits = np.unpackbits(words.view(np.uint8), bitorder="little")

    def __contains__(self, digest: bytes) -> bool:
        a, b = int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")
        return bool(self.bits[a % len(self.bits)] and self.bits[b % len(self.bits)])


def repeated(docs: DataFrame, bits: int) -> np.ndarray:
    """The filter's 64-bit words, from all digests that occur more than once. At most bits / 64 rows are gathered."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(c).digest() for t in binary(batch, "text") for c in cut(samples(t))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])

    every = docs.select("text").mapInArrow(digests, "digest binary")
    several = every.groupBy("digest").count().where("count > 1")
    at = lambda n: F.conv(F.hex(F.substring("digest", n, 4)), 16, 10).cast("long") % bits
    places = several.select(F.explode(F.array(at(1), at(5))).alias("at"))
    words = places.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("x")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in words:
        out[r["word"]] = r["x"]
    return out


class Store(NamedTuple):
    """objects: 'solo' pictures with their payload, and 'recipe' ones by their chunks alone; pool: digest, payload."""

    objects: DataFrame
    pool: DataFrame


def store(docs: DataFrame, bits: int = 1 << 24) -> Store:
    """Store the texts of docs (doc_id, text, any more columns) as pictures. A null text counts as empty; equal
    rows are pictures of their own and share their chunks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(repeated(docs, bits))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = Filter(shared.value)
        key = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        seen: set[bytes] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), STORED, strict=True)], schema=STORED)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch, "text"), strict=True):
                payload = samples(text)
                chunks = cut(payload)
                names = [hashlib.sha256(c).digest() for c in chunks]
                whole = hashlib.sha256(picture(payload)).digest()
                if any(n in maybe for n in names):
                    out.append(("recipe", key, doc_id, len(text), whole, names, None))
                    for n, c in zip(names, chunks, strict=True):
                        if n not in seen:
                            out.append(("chunk", None, None, None, n, None, c))
                            seen.add(n)
                else:
                    out.append(("solo", key, doc_id, len(text), whole, names, payload))
                key, size = key + 1, size + len(payload)
                if size > 1 << 22 or len(out) > 5000:
                    yield flush()
                    out, size = [], 0
                if len(seen) > 100_000:
                    seen.clear()
        if out:
            yield flush()

    put_all = materialise(docs.mapInArrow(put, SHAPE), "media", partition_by=["kind"], compression="zstd")
    chunks = put_all.where("kind = 'chunk'").groupBy("digest").agg(F.first("payload").alias("payload"))
    return Store(put_all.where("kind <> 'chunk'"), materialise(chunks, "media-pool", compression="zstd"))


def load(stored: Store) -> DataFrame:
    """(doc_id, n_bytes, digest, payload) of every picture, joined from its chunks in their order."""
    columns = ["doc_id", "n_bytes", "digest", "payload"]
    solo = stored.objects.where("kind = 'solo'").select(columns)
    recipes = stored.objects.where("kind = 'recipe'").select("key", "doc_id", "n_bytes", F.col("digest").alias("whole"), F.posexplode("chunks").alias("n", "chunk"))
    found = recipes.join(stored.pool, F.col("chunk") == F.col("digest"), "left")
    lists = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("whole").alias("digest"), F.collect_list(F.struct("n", "payload")).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                whole = [b"".join(x["payload"] for x in sorted(p, key=lambda x: x["n"])) for p in part.column("parts").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns[:3]], pa.array(whole, pa.binary())], names=columns)

    rebuilt = lists.select("doc_id", "n_bytes", "digest", "parts").mapInArrow(joined, "doc_id long, n_bytes long, digest binary, payload binary")
    return solo.unionByName(rebuilt)


def feature(x: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, mean step between neighbours, and a histogram of 16 bins."""
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1)))
    return f"{x.mean():.6f}|{x.std():.6f}|{-(p * np.log2(p)).sum():.6f}|{step:.6f}|{bins}"


def describe(loaded: DataFrame) -> DataFrame:
    """What the stored pictures hold, checked against the digest taken before storing."""
    shape = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in shape.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, n, digest, payload in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "digest", "payload")), strict=True):
                data = payload.as_py()
                media = picture(data)
                if hashlib.sha256(media).digest() != digest.as_py():
                    raise ValueError(f"stored picture of document {d.as_py()} is not what was put in")
                out.append((d.as_py(), n.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), digest.as_py().hex(), feature(np.frombuffer(data, np.uint8))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

    return loaded.mapInArrow(made, shape)


def op7_media_chunks(spark, sf_dir) -> DataFrame:
    return describe(load(store(read(spark, sf_dir, "documents"))))
