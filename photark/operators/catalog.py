"""Catalog queries: listings, latest versions, collections, filters, positions, runs and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photark.functions import text as tx
from photark.operators.prefix import running


def latest_per(df: DataFrame, key: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key; of equal times the greater tie column's."""
    newest = F.max_by(F.struct("*"), F.struct(at, tie))  # kept per key before the shuffle, and nothing is sorted
    return df.groupBy(F.col(key).alias("key_")).agg(newest.alias("newest_")).select("newest_.*")


def tags_per(df: DataFrame, key: str, tag: str) -> DataFrame:
    """key and its tags, sorted, each once; the empty tag only marks that tagging found nothing."""
    kept = F.array_remove(F.collect_set(tag), "")
    return df.groupBy(key).agg(F.array_sort(kept).alias("tags"))


def enriched_listing(files: DataFrame, ratings: DataFrame, versions: DataFrame) -> DataFrame:
    """Files with rating, id of the latest version and tags, largest first, then by path."""
    latest = latest_per(versions, "key").select(F.col("key").alias("v_key"), F.col("id").alias("latest_version"))
    tags = tags_per(versions, "key", "kind").select(F.col("key").alias("t_key"), "tags")
    rated = ratings.select(F.col("path").alias("r_path"), "rating")
    out = files.join(rated, F.col("path") == F.col("r_path"), "left").join(latest, F.col("path") == F.col("v_key"), "left").join(tags, F.col("path") == F.col("t_key"), "left")
    joined = out.select("path", "library", "size", F.coalesce("rating", F.lit(0)).alias("rating"), "latest_version", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))
    return joined.orderBy(F.coalesce("size", F.lit(0)).desc(), "path")


def display_index(versions: DataFrame) -> DataFrame:
    """Number of each version within its key, oldest first from 1."""
    return versions.select("key", "id", F.row_number().over(Window.partitionBy("key").orderBy("created_at", "id")).alias("display_index"))


def with_counts(parents: DataFrame, items: DataFrame, key: str, item_key: str) -> DataFrame:
    """Parents with the number of their items, 0 for none."""
    counts = items.groupBy(F.col(item_key).alias("c_key")).agg(F.count("*").alias("n_items"))
    return parents.join(counts, F.col(key) == F.col("c_key"), "left").drop("c_key").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def next_position(items: DataFrame, key: str, position: str) -> DataFrame:
    return items.groupBy(key).agg((F.coalesce(F.max(position), F.lit(-1)) + 1).alias("next_position"))


def append(items: DataFrame, added: DataFrame, key: str, item: str, order: str, gapless: bool) -> DataFrame:
    """Positions of added items that the list does not hold yet, after its last one. With gaps, an item that
    it holds already uses up a number."""
    known = items.select(F.col(key).alias("k"), F.col(item).alias("i"), F.lit(True).alias("held")).distinct()
    start = items.groupBy(F.col(key).alias("s_key")).agg((F.max("position") + 1).alias("start"))
    rows = added.join(known, (F.col(key) == F.col("k")) & (F.col(item) == F.col("i")), "left")
    fresh = rows.where("held is null")
    numbered = (fresh if gapless else rows).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    placed = numbered.where("held is null").join(start, F.col(key) == F.col("s_key"), "left")
    return placed.select(key, item, (F.coalesce("start", F.lit(0)) + F.col("n")).alias("position"))


def in_collection(items: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Items in the collection; an empty collection does not filter at all."""
    m = members.select(F.col(members.columns[0]).alias("member")).distinct()
    none = m.agg(F.count("*").alias("n_members"))
    return items.join(none).join(m, F.col(key) == F.col("member"), "left").where("n_members = 0 or member is not null").select(items.columns)


def null_safe_hits(rows: DataFrame, cache: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose values, nulls included, are in the cache."""
    c = cache.select([F.col(x).alias("c_" + x) for x in on]).distinct()
    same = F.lit(True)
    for x in on:
        same = same & F.col(x).eqNullSafe(F.col("c_" + x))
    return rows.join(c, same, "left_semi")


def starts_with_ignoring_case(value: Column, prefix: str) -> Column:
    return F.startswith(F.lower(value), F.lit(prefix.lower()))


#: So many roots are told apart by one expression, more by joins.
SHORT_LIST = 64


def root_of(paths: DataFrame, roots: DataFrame, key: str, path: str) -> DataFrame:
    """paths with the first root (of root and root_order) whose text starts the path, nulls if none does.

    A short list becomes an expression, so that nothing is shuffled; of a longer one each path is joined with its beginnings
    of the lengths that roots have, on equal texts, and keeps the first hit."""
    known = roots.select("root", "root_order").where("root is not null")
    first = known.orderBy(F.col("root_order").asc_nulls_last(), "root").limit(SHORT_LIST + 1).collect()
    kinds = {c: known.schema[c].dataType for c in ("root", "root_order")}
    if len(first) <= SHORT_LIST:
        hits = {c: F.coalesce(*[F.when(F.startswith(F.col(path), F.lit(r["root"])), F.lit(r[c])) for r in first if r[c] is not None], F.lit(None)).cast(k) for c, k in kinds.items()}
        return paths.withColumns(hits)
    lengths = known.agg(F.array_sort(F.collect_set(F.char_length("root"))).alias("lengths_"))  # a few hundred at most
    begun = paths.select(F.col(key).alias("k_"), F.col(path).alias("p_")).crossJoin(F.broadcast(lengths)).select("k_", F.explode(F.transform(F.filter("lengths_", lambda n: n <= F.char_length("p_")), lambda n: F.left(F.col("p_"), n))).alias("root"))
    best = begun.join(known, "root").groupBy("k_").agg(F.min_by(F.struct("root", "root_order"), F.struct(F.col("root_order").isNull(), "root_order", "root")).alias("b_"))
    return paths.join(best, F.col(key) == F.col("k_"), "left").select(*paths.columns, "b_.root", "b_.root_order")


def runs(df: DataFrame, order: list, value: str, partition: list[str]) -> DataFrame:
    """Number of the run of equal values that a row stands in, in order, from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def grid(df: DataFrame, order: list, partition: list[str], columns: int) -> DataFrame:
    """Row and column of each item in a grid within its partition."""
    numbered = running(df.withColumn("grid_of_", F.struct(*partition)), order, {"n": F.lit(1)}, "grid_of_")
    return numbered.withColumn("grid_row", F.expr(f"cast(n div {columns} as int)")).withColumn("grid_column", (F.col("n") % columns).cast("int")).drop("n", "grid_of_")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in order, and whether more rows follow it."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(total).withColumn("has_more", F.lit(offset + limit) < F.col("total")).drop("total")


def ordered_by(df: DataFrame, key: str, known: list, then: str) -> DataFrame:
    """Position of each row: those of the known keys in their order, all others after them."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), F.col(key)), F.lit(0)), F.lit(len(known) + 1))
    return running(df, [place, F.col(then)], {"place": F.lit(1)}).withColumn("place", (F.col("place") + 1).cast("int"))


def search(items: DataFrame, name: str, tags: str, terms: str) -> DataFrame:
    return items.where(tx.matches_all_terms(F.col(name), F.col(tags), F.lit(terms)))
