"""Listings that come in pages: a Spark data source whose partitions are pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: fetch(offset, limit) gives up to limit items (dicts) from offset on, and whether more follow.
Fetch = Callable[[int, int], tuple[list[dict], bool]]
PAGE = 256


class Page(InputPartition):
    def __init__(self, offset: int, limit: int, last: bool):
        self.offset, self.limit, self.last = offset, limit, last


def last_page(fetch: Fetch, limit: int) -> int:
    """The number of the last page, the first that nothing follows: found by doubling and halving, in some 2 log2(pages) calls."""
    low, high = -1, 0  # after page low something follows, after page high nothing
    while fetch(high * limit, limit)[1]:
        low, high = high, 2 * high + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fetch(middle * limit, limit)[1] else (low, middle)
    return high


def pages(spark: SparkSession, name: str, fetch: Fetch, schema: str, limit: int = PAGE) -> DataFrame:
    """All items that ``fetch`` gives, as rows of ``schema``, each page read by a task of its own. A field that an item lacks is null.

    Pages are full but the last. A page that turns out shorter than the next one's offset says, or that ends before the
    last one when it is read, raises an error: the listing has changed while it was read."""
    kind = T.StructType.fromDDL(schema)
    fields = kind.names

    class Reader(DataSourceReader):
        def partitions(self) -> list[Page]:
            last = last_page(fetch, limit)
            return [Page(n * limit, limit, n == last) for n in range(last + 1)]

        def read(self, page: Page) -> Iterator[tuple]:
            items, more = fetch(page.offset, page.limit)
            if not page.last and (len(items) != page.limit or not more):
                raise ValueError(f"the page at {page.offset} ended early: {len(items)} items")
            for item in items:
                yield tuple(item.get(f) for f in fields)

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"pages_{name}"

        def schema(self) -> T.StructType:
            return kind

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Pages)
    return spark.read.format(f"pages_{name}").load()


def from_folder(folder: str) -> Fetch:
    """Pages that lie as files <offset>.json in a folder that all executors mount: {"items": [...], "has_more": true}; none is empty."""

    def fetch(offset: int, limit: int) -> tuple[list[dict], bool]:
        file = Path(folder) / f"{offset}.json"
        if not file.exists():
            return [], False
        page = json.loads(file.read_text())
        return page["items"][:limit], bool(page["has_more"])

    return fetch
