"""Maintenance of a library: sources, versions, presets, ordered lists, search, caches, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photark.operators.prefix import running


def not_listed(rows: DataFrame, key: str, json_list: str) -> DataFrame:
    """Rows whose key is not in a JSON array of numbers."""
    listed = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json_list), "array<bigint>")).alias("listed"))
    return rows.join(listed, F.col(key) == F.col("listed"), "left_anti")


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, item: str) -> DataFrame:
    """Parents with the sorted array of their children's items, empty for none."""
    lists = children.groupBy(F.col(child_key).alias("n_key")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = parents.join(lists, F.col(key) == F.col("n_key"), "left").drop("n_key")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def all_sources(configured: DataFrame, discovered: DataFrame, key: str) -> DataFrame:
    """Configured sources, with whether they are online, and discovered ones that are not configured."""
    seen = discovered.select(F.col(key).alias("seen")).distinct()
    known = configured.select(F.col(key).alias("known")).distinct()
    own = configured.join(seen, F.col(key) == F.col("seen"), "left").select(key, F.lit(True).alias("configured"), F.col("seen").isNotNull().alias("online"))
    new = seen.join(known, F.col("seen") == F.col("known"), "left_anti").select(F.col("seen").alias(key), F.lit(False).alias("configured"), F.lit(True).alias("online"))
    return own.unionByName(new)


def merged_variants(vocabulary: DataFrame, label: str, variants: str) -> DataFrame:
    """Union of the variants of equal labels, sorted, each once."""
    each = vocabulary.select(label, F.explode(variants).alias("variant_")).distinct()
    return each.groupBy(label).agg(F.array_sort(F.collect_list("variant_")).alias("variants"))


def pass_averages(frames: DataFrame, frame: str, step: str, micros: str) -> DataFrame:
    """Whole average of each step over all frames, also those that it is missing from."""
    n = frames.agg(F.count_distinct(frame).alias("n_frames"))
    sums = frames.groupBy(step).agg(F.sum(micros).alias("total"))
    return sums.crossJoin(F.broadcast(n)).select(step, F.expr("total div n_frames").alias("average"))


def with_current(versions: DataFrame, path: str, id_: str, order: list) -> DataFrame:
    """Version numbers within each path from 1; only the last is current."""
    w = Window.partitionBy(path)
    numbered = versions.withColumn("version", F.row_number().over(w.orderBy(*order)))
    return numbered.withColumn("is_current", F.col("version") == F.max("version").over(w))


def selected_between(rows: DataFrame, key: str, order: list[str], a, b) -> DataFrame:
    """Rows from one key to another in order (ties by key), both included, whichever comes first, and their number ``n`` in the
    whole order, by running sums over ranges."""
    numbered = running(rows, [F.col(c) for c in [*order, key]], {"n": F.lit(1)}).withColumn("n", (F.col("n") + 1).cast("int"))
    ends = numbered.where(F.col(key).isin(a, b)).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return numbered.join(F.broadcast(ends), F.col("n").between(F.col("low"), F.col("high"))).drop("low", "high")


def moved(items: Column, start: int, to: int) -> Column:
    """An array with the element at start (from 0) put before the one at to; to start and start + 1 changes nothing."""
    one = F.slice(items, start + 1, 1)
    rest = F.concat(F.slice(items, F.lit(1), F.lit(start)), F.slice(items, F.lit(start + 2), F.size(items)))
    at = to - 1 if to > start else to
    return F.concat(F.slice(rest, F.lit(1), F.lit(at)), one, F.slice(rest, F.lit(at + 1), F.size(items)))


def search_rank(title: Column, description: Column, term: str) -> Column:
    """2 for a term in the title, 1 for one in the description, else 0; case does not count."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    return F.when(has(title), 2).when(has(description), 1).otherwise(0)


def first_write(base: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows with null columns filled from incoming; what is set stays."""
    right = incoming.select(F.col(key).alias("i_key"), *[F.col(c).alias("i_" + c) for c in columns])
    joined = base.join(right, F.col(key) == F.col("i_key"), "left")
    return joined.select(*[(F.coalesce(c, "i_" + c) if c in columns else F.col(c)).alias(c) for c in base.columns])


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of the keys that are gone."""
    g = gone.select(F.col(key).alias("gone")).distinct()
    return parents.join(g, F.col(key) == F.col("gone"), "left_anti"), children.join(g, F.col(child_key) == F.col("gone"), "left_anti")


def insert_by_hash(known: DataFrame, added: DataFrame, hash_: str) -> DataFrame:
    """Id of each different added content: that of the known row with its hash, else the next free ones by hash.

    hash_ is hexadecimal text: new ones are numbered within each of the 4096 ranges of its first three digits, from the number
    of those in the ranges before, so no task numbers all."""
    last = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    have = known.groupBy(F.col(hash_).alias("k_hash")).agg(F.min("id").alias("k_id"))
    rows = added.select(hash_).distinct().join(have, F.col(hash_) == F.col("k_hash"), "left")
    new = rows.where("k_id is null").withColumn("start", F.substr(hash_, F.lit(1), F.lit(3)))
    earlier = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # over at most 4096 rows
    before = new.groupBy("start").agg(F.count("*").alias("n")).select(F.col("start").alias("b_start"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("start").orderBy(hash_))
    numbered = new.withColumn("n", within).join(F.broadcast(before), F.col("start") == F.col("b_start"))
    return rows.where("k_id is not null").select(hash_, F.col("k_id").alias("id")).unionByName(numbered.select(hash_, (F.col("before") + F.col("n") + last).alias("id")))


def refreshed_names(stored: DataFrame, discovered: DataFrame, key: str, name: str) -> DataFrame:
    """Stored rows with names as discovered, and whether each changed."""
    d = discovered.select(F.col(key).alias("d_key"), F.col(name).alias("d_name"))
    joined = stored.join(d, F.col(key) == F.col("d_key"), "left")
    new = F.coalesce("d_name", name)
    return joined.withColumn("changed", ~new.eqNullSafe(F.col(name))).withColumn(name, new).drop("d_key", "d_name")


def best_tiles(tiles: DataFrame, board: str, generation: str, final: str) -> DataFrame:
    """Of each board's newest generation the final tile if there is one, else the interactive one."""
    best = Window.partitionBy(board).orderBy(F.desc(generation), F.desc(final))
    return tiles.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def etag_identity(size: Column, etag: Column, encryption: Column) -> Column:
    """Identity from an object's ETag where it is one: without quotes, not empty, and no key-managed encryption."""
    clean = F.nullif(F.trim(F.replace(etag, F.lit('"'), F.lit(""))), F.lit(""))
    fits = clean.isNotNull() & (encryption.isNull() | (encryption == "AES256"))
    return F.when(fits, F.sha2(F.concat_ws("|", F.lit("object-etag"), size.cast("string"), clean), 256))


def bands(curves: DataFrame, low: str, high: str, size: float) -> DataFrame:
    """One row for each strip of so much height that a curve's extent meets, with its place in the strip by the greatest end.
    Places come of running sums over ranges: there are as few strips as there may be, however many curves."""
    strips = curves.withColumn("band", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    order = [F.desc(high), F.col(low), *[F.col(c) for c in curves.columns if c not in (low, high)]]
    return running(strips, order, {"place": F.lit(1)}, "band").withColumn("place", (F.col("place") + 1).cast("int"))


def leading_u64(digest: Column) -> Column:
    """The first 16 hex digits as an unsigned number."""
    return F.conv(F.left(digest, F.lit(16)), 16, 10).cast("decimal(20,0)")
