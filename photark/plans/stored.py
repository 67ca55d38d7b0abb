"""Registered queries over stored tables, small files and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.operators import vocabulary
from photark.operators.prefix import shared_folder
from photark.sources import stored
from photark.sources import tables as t
from photark.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/photark-core/{name}-{uuid.uuid4().hex}"


PARTS = {"small": ("ring", "bolt"), "shiny": ("Ring", "gear"), "other": ("valve", "washer", "pin")}


@query("WITH c AS (SELECT * FROM (VALUES ('small', 'ring'), ('small', 'bolt'), ('shiny', 'ring'), ('shiny', 'gear'), ('other', 'valve'), ('other', 'washer'), ('other', 'pin')) v(category, label)), w AS (SELECT DISTINCT p_partkey, lower(unnest(string_split(p_name, ' '))) AS label FROM part) SELECT p_partkey, category, count(*) AS n FROM w JOIN c USING (label) GROUP BY 1, 2")
def tagged_categories(spark, sf_dir) -> DataFrame:
    """Words of parts' names as tags, counted by the category they belong to."""
    tags = t.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    return vocabulary.in_category(tags, vocabulary.categories(spark, PARTS), "p_partkey", "tag")


#: From numbered versions of a hash, by way of a new name and an origin, to versions with ids.
STEPS = [
    stored.renamed("file_hash", "fingerprint"),
    stored.added("peer_origin", "cast(null as string)"),
    stored.rebuilt("version", {"id": "md5(concat_ws('-', fingerprint, version))", "fingerprint": "fingerprint", "created_at": "created_at", "peer_origin": "peer_origin"}),
]


@query("SELECT md5(user_id || '-' || event_id) AS id, user_id AS fingerprint, ts AS created_at, CASE WHEN event_id % 3 = 2 THEN event_type END AS peer_origin FROM events")
def migrated_tables(spark, sf_dir) -> DataFrame:
    """Edit versions kept by three generations of a library, as tables of today."""
    e = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("file_hash"), F.col("event_id").alias("version"), F.col("ts").alias("created_at"), "event_type")
    old = {0: e.drop("event_type"), 1: e.drop("event_type").withColumnRenamed("file_hash", "fingerprint"), 2: e.withColumnsRenamed({"file_hash": "fingerprint", "event_type": "peer_origin"})}
    out = None
    for schema, df in old.items():
        kept = stored.Stored(spark, folder(spark, f"versions-{schema}"))
        kept.put(df.where(F.col("version") % 3 == schema), schema)
        kept.migrate(STEPS)
        df = kept.table().select("id", "fingerprint", "created_at", "peer_origin")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT 'preset ' || n_name AS name, 1 AS version, '[{\"ops\":[{\"Tone\":{\"exposure\":' || n_nationkey || '}}]}]' AS layers, CASE WHEN n_regionkey = 1 THEN '{\"1\":{\"radial\":[' || n_nationkey || ',2,3]}}' ELSE '{}' END AS mask_params FROM nation WHERE n_nationkey % 5 <> 4")
def presets_kept(spark, sf_dir) -> DataFrame:
    """A preset for each nation saved, some renamed, some removed, and all read back."""
    presets = stored.Presets(spark, folder(spark, "presets"))
    for r in t.table(spark, sf_dir, "nation").orderBy("n_nationkey").toLocalIterator():
        k = r["n_nationkey"]
        masks = {"1": {"radial": [k, 2, 3]}} if r["n_regionkey"] == 1 else {}
        name = f"preset {r['n_name']}" if k % 2 else f"old {k}"
        presets.save(name, [{"image": "p"}, {"ops": [{"Tone": {"exposure": k}}]}], masks)
        if not k % 2:
            presets.move(name, f"preset {r['n_name']}")
        if k % 5 == 4:
            presets.remove(f"preset {r['n_name']}")
    return presets.all()


@query("SELECT doc_id, unnest(list_filter(['de', 'en', 'es', 'fr'], lambda x: x = lang OR (x = 'en' AND n_chars > 2000))) AS tag FROM (SELECT DISTINCT doc_id, lang, n_chars FROM documents)")
def stream_tagging(spark, sf_dir) -> DataFrame:
    """Documents tagged once each as a stream brings them."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    place = folder(spark, "tagging")
    d.repartition(4).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/in")
    tags = F.filter(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), lambda x: (x == F.col("lang")) | ((x == "en") & (F.col("n_chars") > 2000)))
    changes.tag_stream(stream, "doc_id", lambda b: b.select("doc_id", F.explode(tags).alias("tag")), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("doc_id", "tag")
