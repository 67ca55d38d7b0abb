"""One library as immutable tables: reads give DataFrames, changes give a library with new ones."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photark.functions import text as tx
from photark.operators import catalog, library, merge
from photark.operators.prefix import written
from photark.sources import tables as t

SCHEMAS = {
    "items": "path string, name string, modified_at bigint",
    "ratings": "path string, rating int, updated_at bigint",
    "tags": "path string, tag string",
    "versions": "path string, id string, created_at bigint, layers string",
    "collections": "id string, name string, position bigint",
    "members": "collection string, path string, position bigint",
}


CUT = 16


@dataclass(frozen=True)
class Library:
    """Tables of SCHEMAS. Changes are lazy plans; every CUT changes a table is written to the shared folder, so that no plan grows
    without end."""

    items: DataFrame
    ratings: DataFrame
    tags: DataFrame
    versions: DataFrame
    collections: DataFrame
    members: DataFrame
    changes: dict = field(default_factory=dict)

    def changed(self, **tables: DataFrame) -> Library:
        """This library with other tables."""
        changes = dict(self.changes)
        for name, df in tables.items():
            changes[name] = (changes.get(name, 0) + 1) % CUT
            if not changes[name]:
                tables[name] = written(df, f"library-{name}")
        return replace(self, changes=changes, **tables)

    @staticmethod
    def empty(spark: SparkSession) -> Library:
        return Library(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    def rows(self, table: str, values: list[tuple]) -> DataFrame:
        return self.items.sparkSession.createDataFrame(values, SCHEMAS[table])

    # reads

    def listing(self, search: str = "", collection: str | None = None) -> DataFrame:
        """path, name, modified_at, rating, tags, latest: newest first, then by path."""
        tags = catalog.tags_per(self.tags, "path", "tag").select(F.col("path").alias("t_path"), "tags")
        rated = self.ratings.select(F.col("path").alias("r_path"), "rating")
        last = catalog.latest_per(self.versions, "path").select(F.col("path").alias("v_path"), F.col("id").alias("latest"))
        out = self.items.join(tags, F.col("path") == F.col("t_path"), "left").join(rated, F.col("path") == F.col("r_path"), "left").join(last, F.col("path") == F.col("v_path"), "left")
        out = out.select("path", "name", "modified_at", "rating", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "latest")
        if search:
            out = catalog.search(out, "name", "tags", search)
        if collection is not None:
            out = catalog.in_collection(out, self.members.where(F.col("collection") == collection).select("path"), "path")
        return out.orderBy(F.coalesce("modified_at", F.lit(0)).desc(), "path")

    def history(self, path: str) -> DataFrame:
        """Versions of one item with their numbers, newest first."""
        own = self.versions.where(F.col("path") == path)
        return own.withColumn("display_index", F.row_number().over(Window.partitionBy("path").orderBy("created_at", "id"))).orderBy(F.desc("display_index"))

    def collection_list(self) -> DataFrame:
        return catalog.with_counts(self.collections, self.members, "id", "collection").orderBy("position", "id")

    # changes

    def scanned(self, found: DataFrame) -> Library:
        """Items as found; those that are gone go."""
        return self.changed(items=found.select(*self.items.columns))

    def rate(self, path: str, rating: int | None, at: int) -> Library:
        """Set or, with null, remove a rating."""
        if rating is not None and not 1 <= rating <= 5:
            raise ValueError("a rating is 1 to 5")
        rest = self.ratings.where(F.col("path") != path)
        return self.changed(ratings=rest if rating is None else rest.unionByName(self.rows("ratings", [(path, rating, at)])))

    def tag(self, path: str, tags: list[str]) -> Library:
        """Replace the tags of an item; none at all leaves the empty tag, which says that it was tagged."""
        given = self.rows("tags", [(path, "")]).select("path", F.explode(tx.normal_tags(F.array(*map(F.lit, [*tags, ""])))).alias("tag"))
        blank = self.rows("tags", [(path, "")])
        return self.changed(tags=self.tags.where(F.col("path") != path).unionByName(given if any(t.strip() for t in tags) else blank))

    def save_version(self, path: str, id_: str, at: int, layers: str) -> Library:
        return self.changed(versions=merge.ignore(self.versions, self.rows("versions", [(path, id_, at, layers)]), ["id"]))

    def apply_preset(self, paths: list[str], layers: str, at: int) -> Library:
        """One new version of each item, all with the same layers."""
        new = self.rows("versions", [(p, f"{p}@{at}", at, layers) for p in dict.fromkeys(paths)])
        return self.changed(versions=self.versions.unionByName(new))

    def clear_versions(self, paths: list[str]) -> Library:
        return self.changed(versions=self.versions.where(~F.col("path").isin(paths)))

    def add_collection(self, id_: str, name: str) -> Library:
        top = self.collections.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position"))
        new = top.select(F.lit(id_).alias("id"), F.trim(F.lit(name)).alias("name"), "position")
        return self.changed(collections=self.collections.unionByName(new))

    def drop_collection(self, id_: str) -> Library:
        gone = self.collections.where(F.col("id") == id_)
        parents, children = library.cascade_delete(self.collections, self.members, gone, "id", "collection")
        return self.changed(collections=parents, members=children)

    def add_members(self, collection: str, paths: list[str]) -> Library:
        added = self.rows("members", [(collection, p, i) for i, p in enumerate(dict.fromkeys(paths))])
        new = catalog.append(self.members, added, "collection", "path", "position", gapless=True)
        return self.changed(members=self.members.unionByName(new.select("collection", "path", F.col("position").cast("bigint").alias("position"))))

    def merge_peer(self, ratings: DataFrame, tags: DataFrame) -> Library:
        """A peer's later ratings, and its tags in addition."""
        return self.changed(ratings=merge.merged_ratings(self.ratings, ratings, "path", "rating", "updated_at"), tags=merge.union_sets(self.tags, tags, ["path", "tag"]))


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a library: rated by labels, tagged by language, with events as versions; listed after some changes."""
    d, e = t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "events")
    path = F.col("doc_id").cast("string").alias("path")
    own = Library.empty(spark).changed(
        items=d.select(path, F.coalesce("source", F.lit("")).alias("name"), F.col("n_chars").alias("modified_at")),
        ratings=t.table(spark, sf_dir, "labels").select(path, (F.col("quality") + 1).alias("rating"), F.lit(0).cast("long").alias("updated_at")),
        tags=d.select(path, F.col("lang").alias("tag")),
        versions=e.select(F.col("user_id").cast("string").alias("path"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"), F.col("props").alias("layers")),
    )
    own = own.rate("3", 5, 9).rate("4", None, 9).tag("5", ["b", " a ", "b"]).apply_preset(["6", "7"], "{}", 1 << 60).clear_versions(["7"])
    return own.listing().withColumn("tags", F.array_join("tags", ","))


QUERIES = {"library_listing": library_listing}
SQL = {"library_listing": """WITH v AS (SELECT user_id, max_by(lpad(event_id::VARCHAR, 12, '0'), (ts, event_id)) AS id FROM events GROUP BY 1)
SELECT d.doc_id::VARCHAR AS path, coalesce(source, '') AS name, n_chars AS modified_at, CASE d.doc_id WHEN 3 THEN 5 WHEN 4 THEN NULL ELSE quality + 1 END AS rating,
CASE d.doc_id WHEN 5 THEN 'a,b' ELSE coalesce(lang, '') END AS tags, CASE d.doc_id WHEN 6 THEN '6@1152921504606846976' WHEN 7 THEN NULL ELSE v.id END AS latest
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN v ON d.doc_id = v.user_id"""}
