"""Ranged reads: only the asked bytes of each file, read where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.operators.fingerprints import sample_plan


class SampleSource(Protocol):
    """Something that bytes can be read from by range."""

    def read_range(self, offset: int, length: int) -> bytes: ...

    def close(self) -> None: ...


class LocalFile:
    """A file of a file system that every executor mounts."""

    def __init__(self, path: str):
        self.file = open(unquote(urlsplit(path).path) if path.startswith("file:") else path, "rb")  # noqa: SIM115

    def read_range(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()


class ShortRead(OSError):
    """Fewer bytes than asked for: never padded."""


def read_ranges(files: DataFrame, ranges: str = "ranges", opened: Callable[[str], SampleSource] = LocalFile) -> DataFrame:
    """files (path, ranges as array of offset and length, and more columns) with ``ranges`` replaced by ``samples``, an array of
    offset and bytes. ``opened`` makes a source of a path and is called in the tasks, once a file. A range that ends beyond
    the file raises ShortRead."""
    kept = [f for f in files.schema.fields if f.name not in (ranges, "samples")]
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "samples array<struct<offset:bigint,bytes:binary>>"])
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.binary())]))

    def taken(path: str, asked: list[dict]) -> list[dict]:
        source = opened(path)
        try:
            out = []
            for r in asked:
                data = source.read_range(r["offset"], r["length"])
                if len(data) != r["length"]:
                    raise ShortRead(f"{path}: asked for {r['length']} bytes at {r['offset']}, got {len(data)}")
                out.append({"offset": r["offset"], "bytes": data})
            return out
        finally:
            source.close()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # at most four samples each
                b = batch.slice(at, 64)
                found = [None if p is None or r is None else taken(p, r) for p, r in zip(b.column("path").to_pylist(), b.column(ranges).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(found, kind)], names=[*[f.name for f in kept], "samples"])

    return files.mapInArrow(read, shape)


def samples(files: DataFrame, opened: Callable[[str], SampleSource] = LocalFile) -> DataFrame:
    """files (path, size, and more columns) with ``samples``: the bytes that a content fingerprint is taken of."""
    return read_ranges(files.withColumn("ranges", sample_plan(F.col("size"))), opened=opened)
