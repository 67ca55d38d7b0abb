"""Image files described from their bytes, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photark.functions import containers
from photark.sources.images import extension

IMAGE = "struct<width:bigint,height:bigint,compression:int,photometric:int,subfile:bigint,bits:array<int>,orientation:int,kind:string>"
ADDED = f"orientation int, color_space string, bit_depth string, images array<{IMAGE}>, best_image int"


def described(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """files without ``content``, and with orientation, color_space, bit_depth, images and best_image (from 0) read from it, in place
    of columns of these names. A null content gives nulls; one that is cut off or of an unknown kind has no orientation and no
    images, and the bit depth Unknown."""
    added = T.StructType.fromDDL(ADDED)
    kept = [f for f in files.schema.fields if f.name not in (content, *added.names)]
    shape = T.StructType([*kept, *added.fields])

    def one(data: bytes, ending: str | None) -> tuple:
        return containers.orientation(data), containers.color_space(data, ending or ""), containers.bit_depth(data), containers.images(data), containers.best_image(data)

    struct = pa.struct([("width", pa.int64()), ("height", pa.int64()), ("compression", pa.int32()), ("photometric", pa.int32()), ("subfile", pa.int64()), ("bits", pa.list_(pa.int32())), ("orientation", pa.int32()), ("kind", pa.string())])
    kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(struct), pa.int32()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(None,) * 5 if c.as_py() is None else one(c.as_py(), e.as_py()) for c, e in zip(b.column("content_"), b.column("ending_"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=shape.names)

    own = files.select(*[f.name for f in kept], F.col(content).alias("content_"), extension(F.col(path)).alias("ending_"))
    return own.mapInArrow(read, shape)
