"""Token-id shards: zstandard frames of single documents under one shared dictionary.

A shard is one byte string: magic, version, SHA-256 of the dictionary, id width, number of
documents, then the index (doc_id, id count and frame end of each document), then the frames.
Any document is read by its index entry alone. Shards are written by Spark, through the commit
protocol of a table in the shared folder, so a lost executor leaves no half-written file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import materialise, partitions, read
from photark.llm.tokens import encoded, encoder

MAGIC = b"PTOKSHRD"
HEAD = struct.Struct("<8sI32sIQ")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_ids", "<u8"), ("end", "<u8")])


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, sample: int = 1000, size: int = 64 << 10, ids_each: int = 4096) -> bytes:
    """A dictionary from about ``sample`` documents chosen by a hash of their id, of each at most
    ``ids_each`` ids: this bounds what is gathered, and only the compression depends on it.
    Too few samples to train on become the dictionary's content themselves."""
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(n, 1)))).limit(2 * sample)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [narrow(ids[: 4 * ids_each] + end_id.to_bytes(4, "little"), width) for _, ids in encoded(batch, tokenizer)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    samples = sorted(bytes(r[0]) for r in chosen.select("text").mapInArrow(serialized, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def shard(entries: list[tuple[int | None, int, bytes]], hashed: bytes, width: int) -> bytes:
    index = np.zeros(len(entries), INDEX)
    end = 0
    for i, (doc_id, n, frame) in enumerate(entries):
        end += len(frame)
        index[i] = (doc_id or 0, doc_id is None, n, end)
    return HEAD.pack(MAGIC, 1, hashed, width, len(entries)) + index.tobytes() + b"".join(e[2] for e in entries)


class Shard:
    def __init__(self, blob: bytes, dictionary_bytes: bytes):
        magic, version, hashed, self.width, n = HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        if hashed != hashlib.sha256(dictionary_bytes).digest():
            raise ValueError("the shard was written with another dictionary")
        self.index = np.frombuffer(blob, INDEX, n, HEAD.size)
        self.base = HEAD.size + n * INDEX.itemsize
        self.blob = memoryview(blob)
        kwargs = {"dict_data": dictionary(dictionary_bytes)} if dictionary_bytes else {}
        self.reader = zstandard.ZstdDecompressor(**kwargs)

    def doc_id(self, i: int) -> int | None:
        return None if self.index[i]["null"] else int(self.index[i]["doc_id"])

    def ids(self, i: int) -> np.ndarray:
        """Of the i-th document only."""
        start = int(self.index[i - 1]["end"]) if i else 0
        frame = self.blob[self.base + start : self.base + int(self.index[i]["end"])]
        raw = self.reader.decompress(frame, max_output_size=int(self.index[i]["n_ids"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write(docs: DataFrame, tokenizer: str, end_id: int, width: int | None = None, level: int = 3, shard_bytes: int = 1 << 20) -> tuple[DataFrame, bytes]:
    """Shards of docs (doc_id, text, any more columns) in ascending doc_id order, null first and
    equal ids by text, as (part, number, n_docs, n_ids, blob), and their dictionary.

    A null text counts as empty and is its end id alone. Equal rows are stored each for itself. An id
    takes ``width`` bytes, 2 or 4: by default what the vocabulary needs; too few are an error.
    """
    needed = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    width = width or needed
    if width not in (2, 4) or width < needed:
        raise ValueError(f"ids of this vocabulary take {needed} bytes, not {width}")
    docs = docs.select("doc_id", "text")
    shared = train_dictionary(docs, tokenizer, end_id, width)
    hashed = hashlib.sha256(shared).digest()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kwargs = {"dict_data": dictionary(shared)} if shared else {}
        if shared:
            kwargs["dict_data"].precompute_compress(level=level)
        writer = zstandard.ZstdCompressor(level=level, **kwargs)
        entries, held, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "n_docs": len(entries), "n_ids": sum(e[1] for e in entries), "blob": shard(entries, hashed, width)}], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]))

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for row, ids in encoded(batch, tokenizer):
                ids += end_id.to_bytes(4, "little")
                frame = writer.compress(narrow(ids, width))
                entries.append((ids_of[row], len(ids) // 4, frame))
                held += len(frame)
                if held >= shard_bytes:
                    yield flush()
                    entries, held, number = [], 0, number + 1
        if entries:
            yield flush()

    ordered = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    table = ordered.mapInArrow(pack, "part int, number int, n_docs long, n_ids long, blob binary")
    return materialise(table, "token-shards", compression="uncompressed"), shared


def contents(shards: DataFrame, shared: bytes) -> DataFrame:
    """One row a document, read back from the shards: doc_id, start, n_tokens, ids_crc32, frame_bytes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "blob")), strict=True):
                s, out, start = Shard(blob, shared), [], 0
                for i in range(len(s.index)):
                    ids = s.ids(i).astype("<u4")
                    size = int(s.index[i]["end"]) - (int(s.index[i - 1]["end"]) if i else 0)
                    out.append((part, number, s.doc_id(i), start, len(ids), zlib.crc32(ids.tobytes()), size))
                    start += len(ids)
                names = ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes"]
                kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start"))
    starts = starts.join(totals, "part").select("part", "number", (F.col("part_start") + F.col("shard_start")).alias("base"))
    docs = shards.select("part", "number", "blob").mapInArrow(unpack, "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")
    return docs.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "frame_bytes")


def op3_token_store(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    shards, shared = write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return contents(shards, shared)
