"""Content identity by BLAKE3: of byte columns, of files in pieces, of samples, tags and sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photark.functions import blake3
from photark.operators.fingerprints import SAMPLE, sample_plan

SLICE = 4 << 20  # bytes that are hashed together
PIECE = 1 << 20  # bytes of a piece of a long file: a power of two, and a chunk's at least


def little_endian(n: Column, size: int) -> Column:
    """A whole number of 0 and more as ``size`` bytes, least first."""
    n = n.cast("long")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)])


def sampled_message(size: Column, samples: Column) -> Column:
    """What a content fingerprint is taken of: the size (8 bytes), a sample's length (4) and the number of samples (4), and each
    of ``samples`` (offset, bytes) as offset (8) and bytes."""
    head = F.concat(little_endian(size, 8), little_endian(F.lit(SAMPLE), 4), little_endian(F.size(samples), 4))
    parts = F.transform(samples, lambda s: F.concat(little_endian(s["offset"], 8), s["bytes"]))
    return F.aggregate(parts, head, lambda a, x: F.concat(a, x))


def content_message(content: Column) -> Column:
    """sampled_message of whole contents; null for null."""
    size = F.octet_length(content)
    taken = F.transform(sample_plan(size), lambda s: F.struct(s["offset"].alias("offset"), F.substr(content, s["offset"].cast("int") + 1, s["length"].cast("int")).alias("bytes")))
    return sampled_message(size, taken)


def tag_message(size: Column, tag: Column, domain: bytes) -> Column:
    """What an object's identity by its content tag is taken of: the domain, a zero byte, the size (8 bytes), and the tag without
    spaces and quotes around it. A domain keeps these apart from other fingerprints."""
    return F.concat(F.lit(domain + b"\0"), little_endian(size, 8), F.encode(F.regexp_replace(F.trim(tag), '^"+|"+$', ""), "UTF-8"))


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of SLICE bytes of ``column`` (or of one row): what hashing needs beside a batch does not grow with it."""
    for b in batches:
        given = b.column(column)
        lists = pa.types.is_list(given.type) or pa.types.is_large_list(given.type)
        sizes = pc.fill_null(pc.list_value_length(given) if lists else pc.binary_length(given), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64) * (4 if lists else 1) + blake3.CHUNK)  # a chunk is hashed for each
        at = 0
        while at < b.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")), at + 1)
            yield b.slice(at, to - at)
            at = to


def digests(df: DataFrame, message: str, out: str) -> DataFrame:
    """df with the column ``message`` (binary) replaced by ``out``, its BLAKE3-256 as 64 hex digits; null for null. All messages
    of a slice are hashed together; a message is a value of a row, so what is longer than that comes in pieces (piece_digests)."""
    kept = [f for f in df.schema.fields if f.name not in (message, out)]
    shape = T.StructType([*kept, T.StructField(out, T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, message):
            given = b.column(message).to_pylist()
            found = iter(blake3.tops([g for g in given if g is not None]))
            new = pa.array([None if g is None else next(found).hex() for g in given], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], new], names=shape.names)

    return df.select(*[f.name for f in kept], message).mapInArrow(hashed, shape)


def piece_digests(pieces: DataFrame, key: str, piece: int = PIECE) -> DataFrame:
    """(key, digest) of files whose rows are pieces: key, at (0, 1, ...) and data, each of ``piece`` bytes but a file's last.

    Every piece becomes the top of its own tree where it lies; only these 32 bytes are shuffled. Neighbours are then joined
    level by level, each level half as many, until each file has one node. Pieces that are missing, repeated or of another
    length raise an error: a file that is read short has no digest.
    """
    if piece < blake3.CHUNK or piece & (piece - 1):
        raise ValueError("a piece is a power of two of bytes, and a chunk or more")
    kind = pieces.schema[key].dataType
    sized = pieces.select(key, "at", F.octet_length("data").alias("size"))
    counts = sized.groupBy(key).agg(F.max("at").alias("last"), F.count("*").alias("n"), F.countDistinct("at").alias("different"), F.sum((F.col("size") != piece).cast("int")).alias("odd"), F.max_by("size", "at").alias("size"))
    whole = (F.col("n") == F.col("last") + 1) & (F.col("different") == F.col("n")) & (F.col("odd") == F.when(F.col("size") == piece, 0).otherwise(1)) & (F.col("size") <= piece) & ((F.col("size") > 0) | (F.col("last") == 0))
    counts = counts.select(F.col(key).alias("k"), "last", F.when(whole, True).otherwise(F.raise_error(F.lit("pieces missing, repeated or of a wrong length"))).alias("fits"))
    joined = pieces.join(counts, F.col(key).eqNullSafe(F.col("k"))).where("fits")
    shape = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("at", "last")], T.StructField("node", T.BinaryType())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "data"):
            at = b.column("at").to_pylist()
            found = blake3.tops(b.column("data").to_pylist(), [a * piece // blake3.CHUNK for a in at], [n == 0 for n in b.column("last").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("at"), b.column("last"), pa.array(found, pa.binary())], names=shape.names)

    def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = b.column("right").is_valid().to_numpy(zero_copy_only=False)
            nodes = b.column("left").to_pylist()
            if pairs.any():
                both = [b.column(c).filter(pa.array(pairs)).to_pylist() for c in ("left", "right")]
                words = [np.ascontiguousarray(np.frombuffer(b"".join(x), "<u4").reshape(-1, 8).T) for x in both]
                made = blake3.parents(*words, b.column("last").to_numpy()[pairs] == 0)
                made = iter(np.ascontiguousarray(made.T).astype("<u4"))
                nodes = [next(made).tobytes() if p else n for n, p in zip(nodes, pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("at"), b.column("last"), pa.array(nodes, pa.binary())], names=shape.names)

    longs = [F.col(c).cast("long").alias(c) for c in ("at", "last")]
    rows = joined.select(key, *longs, "data").mapInArrow(leaves, shape)
    side = lambda n: F.max(F.when(F.col("at") % 2 == n, F.col("node")))
    for _ in range(int(pieces.agg(F.max("at")).first()[0] or 0).bit_length()):
        two = rows.groupBy(key, F.expr("at div 2").alias("at"), F.expr("last div 2").alias("last")).agg(side(0).alias("left"), side(1).alias("right"))
        rows = two.mapInArrow(joins, shape)
    return rows.select(key, F.lower(F.hex("node")).alias("digest"))


def in_pieces(df: DataFrame, key: str, content: str, piece: int = PIECE) -> DataFrame:
    """(key, at, data): contents cut for piece_digests; an empty one has one empty piece, a null none."""
    n = F.greatest(F.ceil(F.octet_length(content) / piece), F.lit(1))
    cut = df.where(F.col(content).isNotNull()).select(key, content, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("at"))
    return cut.select(key, "at", F.expr(f"substring({content}, cast(at * {piece} + 1 as int), {piece})").alias("data"))


def source_identity(df: DataFrame, parts: list[str], out: str, digits: int = 16) -> DataFrame:
    """df with ``out``: the first digits of the digest of ``parts``, one a line; a null part counts as empty."""
    lines = F.array_join(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), "\n")
    return digests(df.withColumn("message_", F.encode(lines, "UTF-8")), "message_", out).withColumn(out, F.left(F.col(out), F.lit(digits)))


def pixel_keys(images: DataFrame, pixels: str, width: str, height: str, out: str) -> DataFrame:
    """images with ``out``: a digest of size and pixels (array<float>, as 4 bytes each, least first): equal pictures share one."""
    kept = [f for f in images.schema.fields if f.name != out]
    shape = T.StructType([*kept, T.StructField(out, T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, pixels):
            sizes = zip(b.column(width).to_pylist(), b.column(height).to_pylist(), strict=True)
            data = [None if p.as_py() is None else np.array([w, h], "<u4").tobytes() + np.array(p.as_py(), "<f4").tobytes() for p, (w, h) in zip(b.column(pixels), sizes, strict=True)]
            found = iter(blake3.tops([d for d in data if d is not None]))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array([None if d is None else next(found).hex() for d in data], pa.string())], names=shape.names)

    return images.select(*[f.name for f in kept]).mapInArrow(hashed, shape)


#: Start and factor of the 64-bit hash of Fowler, Noll and Vo.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3


def fnv(contents: list[bytes]) -> np.ndarray:
    """FNV-1a of each: all of them take their next byte together, for as long as they have one."""
    order = np.argsort([-len(c) for c in contents], kind="stable")
    lengths = np.array([len(contents[i]) for i in order], np.int64)
    out = np.full(len(contents), FNV_START, np.uint64)
    data = np.frombuffer(b"".join(contents[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    left = len(order)
    for at in range(int(lengths[0]) if left else 0):
        left = int(np.searchsorted(-lengths[:left], -at, "left"))  # those longer than ``at``
        out[:left] = (out[:left] ^ data[starts[:left] + at]) * np.uint64(FNV_FACTOR)
    back = np.empty_like(out)
    back[order] = out
    return back


def content_ids(df: DataFrame, content: str, out: str) -> DataFrame:
    """df with ``out``: FNV-1a of the bytes of ``content``, 16 hex digits; null for null. The id of a font by what is in it."""
    kept = [f for f in df.schema.fields if f.name != out]
    shape = T.StructType([*kept, T.StructField(out, T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, content):
            given = [None if c is None else c if isinstance(c, bytes) else c.encode() for c in b.column(content).to_pylist()]
            found = iter(fnv([g for g in given if g is not None]).tolist())
            ids = [None if g is None else f"{next(found):016x}" for g in given]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(ids, pa.string())], names=shape.names)

    return df.select(*[f.name for f in kept]).mapInArrow(hashed, shape)
