"""Small files and stored tables: presets and configuration as JSON, and tables whose schema moves on.

Files go through Spark's own file systems, so any store that it reaches will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """A folder, by Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def fs(self):
        """The folder's file system; a local one without its checksum files, which other programs would not keep up."""
        fs = self.path(".").getFileSystem(self.conf)
        if fs.getUri().getScheme() != "file":
            return fs
        raw = self.jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        raw.initialize(fs.getUri(), self.conf)
        return raw

    def exists(self, name: str) -> bool:
        return self.fs().exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs().open(self.path(name))
        try:
            return bytearray(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write the whole file beside its place and move it there in one step: a reader sees the old one or the new one."""
        beside = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs().create(self.path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.rename(beside, name, over=True)

    def rename(self, old: str, new: str, over: bool = False) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs().getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if over else kind.NONE
        context.rename(self.path(old), self.path(new), options)

    def delete(self, name: str) -> None:
        self.fs().delete(self.path(name), True)


class Presets(Files):
    """Presets of a library: a JSON file each, {"version", "layers", "mask_params"}."""

    @staticmethod
    def file(name: str) -> str:
        name = name.strip()
        if not name:
            raise ValueError("a preset needs a name")
        if "/" in name or "\\" in name or ".." in name:
            raise ValueError(f"not a preset's name: {name}")
        return f"{name}.json"

    def list(self) -> DataFrame:
        """(name, created_at in ms), oldest first, then by name; none if there is no folder."""
        shape = "name string, created_at long"
        if not self.fs().exists(self.path(".")):
            return self.spark.createDataFrame([], shape)
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.folder)
        name = F.regexp_extract("path", r"([^/]*)\.json$", 1)
        return found.select(name.alias("name"), F.unix_millis("modificationTime").alias("created_at")).orderBy("created_at", "name")

    def all(self) -> DataFrame:
        """(name, version, layers, mask_params) of all presets: the last two as JSON, no mask parameters as {}."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.folder)
        text = F.col("content").cast("string")
        name = F.regexp_extract("path", r"([^/]*)\.json$", 1)
        part = lambda p: F.get_json_object(text, p)
        return found.select(name.alias("name"), part("$.version").cast("int").alias("version"), part("$.layers").alias("layers"), F.coalesce(part("$.mask_params"), F.lit("{}")).alias("mask_params"))

    def get(self, name: str) -> dict:
        file = self.file(name)
        if not self.exists(file):
            raise KeyError(f"no preset {name.strip()}")
        return json.loads(self.read(file))

    def save(self, name: str, layers: list[dict], mask_params: dict | None = None) -> None:
        """Layers without images, whose masks are kept by their parameters; a preset of the name is replaced."""
        kept = [layer for layer in layers if "image" not in layer]
        self.replace(self.file(name), json.dumps({"version": 1, "layers": kept, "mask_params": mask_params or {}}, indent=2))

    def save_json(self, name: str, text: str) -> None:
        """A preset as it is, if it is one."""
        found = json.loads(text)
        if not isinstance(found, dict) or not isinstance(found.get("version"), int) or not isinstance(found.get("layers"), list):
            raise ValueError("not a preset")
        self.replace(self.file(name), text)

    def move(self, old: str, new: str) -> None:
        a, b = self.file(old), self.file(new)
        if a == b:
            return
        if not self.exists(a):
            raise KeyError(f"no preset {old.strip()}")
        if self.exists(b):
            raise ValueError(f"there is a preset {new.strip()}")
        self.rename(a, b)

    def remove(self, name: str) -> None:
        if not self.exists(self.file(name)):
            raise KeyError(f"no preset {name.strip()}")
        self.delete(self.file(name))


PINNED = "pictures"


def library_id(library: dict) -> str:
    """What a library is called in lists: its kind and what tells it from others of its kind."""
    kind = library["kind"]
    return f"{kind}:{library[{'local': 'path', 's3': 'id', 'camera': 'host', 'peer': 'peer_id'}[kind]]}"


def current_config(saved: dict) -> dict:
    """A saved configuration of any age as it is now: directories, s3_libraries and paired_peers of old ones become libraries, each
    once, a later one in the place of its like; the order holds known libraries only, all of them, the pinned one first."""
    libraries: dict[str, dict] = {}
    old = [{"kind": "local", "path": d} for d in saved.get("directories", [])]
    old += [{"kind": "s3", **s} for s in saved.get("s3_libraries", [])] + [{"kind": "peer", "peer_id": p, "name": None} for p in saved.get("paired_peers", [])]
    for library in [*saved.get("libraries", []), *old]:
        libraries[library_id(library)] = library
    order = list(dict.fromkeys(i for i in saved.get("library_order", []) if i in libraries or i == PINNED))
    order += [i for i in libraries if i not in order]
    if order[:1] != [PINNED]:
        order.insert(0, PINNED)
    return {"libraries": list(libraries.values()), "library_order": order, "library_modes": saved.get("library_modes", {}), "sync_targets": saved.get("sync_targets", {}), "p2p_secret_key": saved.get("p2p_secret_key")}


def load_config(spark: SparkSession, folder: str) -> dict:
    """The configuration in folder/config.json as it is now; an empty one if there is none. Text that is no JSON object is an error."""
    files = Files(spark, folder)
    if not files.exists("config.json"):
        return current_config({}) | {"library_order": []}
    saved = json.loads(files.read("config.json"))
    if not isinstance(saved, dict):
        raise ValueError(f"not a configuration: {folder}/config.json")
    return current_config(saved)


def save_config(spark: SparkSession, folder: str, config: dict) -> None:
    Files(spark, folder).replace("config.json", json.dumps(config, indent=2))


def libraries(spark: SparkSession, config: dict) -> DataFrame:
    """(library_id, kind, mode, place) of a configuration's libraries; place is the one in the order."""
    at = {i: n for n, i in enumerate(config["library_order"])}
    rows = [(library_id(x), x["kind"], config["library_modes"].get(library_id(x)), at[library_id(x)]) for x in config["libraries"]]
    return spark.createDataFrame(rows, "library_id string, kind string, mode string, place int")


Step = Callable[[DataFrame], DataFrame]


def added(column: str, value: str) -> Step:
    """A step that adds a column, by an SQL expression, where it isn't there yet."""
    return lambda df: df if column in df.columns else df.withColumn(column, F.expr(value))


def renamed(old: str, new: str) -> Step:
    """A step that renames a column where it still has its old name."""
    return lambda df: df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def rebuilt(needed: str, columns: dict[str, str]) -> Step:
    """A step that makes the table of these columns (SQL expressions) anew, if it still has the column ``needed``."""
    return lambda df: df.select(*[F.expr(c).alias(n) for n, c in columns.items()]) if needed in df.columns else df


class Stored(Files):
    """A table kept as Parquet in versions of its own folder; ``current.json`` says which one counts, and the version of its schema.

    A change is written whole beside what is there, then the small file is replaced in one step: readers see the old table or
    the new one, and a job that dies in between changes nothing."""

    def state(self) -> dict:
        return json.loads(self.read("current.json")) if self.exists("current.json") else {"schema": 0, "data": None}

    def schema_version(self) -> int:
        return self.state()["schema"]

    def table(self) -> DataFrame:
        data = self.state()["data"]
        if data is None:
            raise ValueError(f"no table in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{data}")

    def put(self, df: DataFrame, schema: int) -> None:
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{data}")
        self.replace("current.json", json.dumps({"schema": schema, "data": data}))

    def migrate(self, steps: list[Step]) -> bool:
        """Bring the table to the schema that all steps give, from whatever step it is at: step n leads from version n to n + 1. If it
        is there already nothing is written. Returns whether anything was."""
        at = self.schema_version()
        if at >= len(steps):
            return False
        df = self.table()
        for step in steps[at:]:
            df = step(df)
        self.put(df, len(steps))
        return True

    def clean(self) -> int:
        """Delete data that doesn't count any more; how many tables there were."""
        keep = self.state()["data"]
        found = [f.getPath().getName() for f in self.fs().listStatus(self.path("."))]
        gone = [n for n in found if n.startswith("data-") and n != keep]
        for n in gone:
            self.delete(n)
        return len(gone)
