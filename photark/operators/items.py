"""Listings, names, joins by fallback, ordered lists and layer lists of a media library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photark.operators.prefix import running


def with_heads(listing: DataFrame, heads: DataFrame, key: str, modified: str, override: str) -> DataFrame:
    """listing with ``modified`` taken from the object's own metadata where that has it."""
    h = heads.select(F.col(key).alias("h_key"), F.col(override).alias("h_modified"))
    joined = listing.join(h, F.col(key) == F.col("h_key"), "left")
    return joined.withColumn(modified, F.coalesce("h_modified", modified)).drop("h_key", "h_modified")


def flattened(groups: DataFrame, items: str, by: str, within: list[str]) -> DataFrame:
    """Each item of the arrays of structs, with its place: descending by ``by``, nulls last, then by its other fields. Places are
    running sums over ranges, so one of ``within`` may have any number of items."""
    each = groups.select(*within, F.explode(items).alias("item")).select(*within, "item.*").withColumn("within_", F.struct(*within))
    order = [F.desc_nulls_last(by), *[F.col(c) for c in each.columns if c not in (*within, by, "within_")]]
    return running(each, order, {"place": F.lit(1)}, "within_").withColumn("place", (F.col("place") + 1).cast("int")).drop("within_")


def unique_names(df: DataFrame, stem: str, extension: str, order: list[str], out: str = "name") -> DataFrame:
    """stem.ext for the first row of a name, in order; a row whose name is taken gets stem_1.ext, stem_2.ext, ..., the first that is
    free then.

    Names meet only within a family: what is left of a stem without its numbers, and the extension. In a family of one stem the
    number is that of the rows before, by running sums over ranges. Where several stems could meet (a, a_1) rows are taken
    in order, a family after the other in a stream, which holds a number for each stem but no rows."""
    family = F.regexp_replace(F.col(stem), r"(_[1-9][0-9]*)+$", "")
    rows = df.withColumn("family_", F.struct(family.alias("root"), F.col(extension).alias("ext")))
    several = rows.groupBy("family_").agg((F.min(stem) != F.max(stem)).alias("several_")).where("several_").select(F.col("family_").alias("f_"), "several_")
    marked = rows.join(several, F.col("family_") == F.col("f_"), "left").drop("f_")
    alone = running(marked.where("several_ is null"), [F.col(c) for c in order], {"number_": F.lit(1)}, "family_")
    name = F.concat(F.col(stem), F.when(F.col("number_") == 0, "").otherwise(F.concat(F.lit("_"), F.col("number_").cast("string"))), F.lit("."), F.col(extension))
    kept = [c for c in df.columns if c != out]
    shape = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plain, numbers = None, set(), {}
        for b in batches:
            names = []
            for f, s, e in zip(b.column("family_").to_pylist(), b.column(stem).to_pylist(), b.column(extension).to_pylist(), strict=True):
                if f != now:
                    now, plain, numbers = f, set(), {}
                before, _, last = s.rpartition("_")
                by_number = last.isdecimal() and last[0] != "0" and numbers.get(before, 1) > int(last)
                if s not in plain and not by_number:
                    plain.add(s)
                    names.append(f"{s}.{e}")
                    continue
                n = numbers.get(s, 1)
                while f"{s}_{n}" in plain:
                    n += 1
                numbers[s] = n + 1
                names.append(f"{s}_{n}.{e}")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(names, pa.string())], names=shape.names)

    together = marked.where("several_").repartition("family_").sortWithinPartitions("family_", *order)
    return alone.withColumn(out, name).select(*kept, out).unionByName(together.select(*kept, "family_").mapInArrow(named, shape))


def upload_names(incoming: DataFrame, existing: DataFrame, name: str, ms: Column) -> DataFrame:
    """``stored``: the name, or stem-<ms>.ext where a file of the name exists; and ``conflict``, for a policy that refuses it."""
    known = existing.select(F.col(name).alias("e_name")).distinct()
    stem, extension = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.substring_index(name, ".", -1)
    other = F.when(F.instr(name, ".") > 0, F.concat(stem, F.lit("-"), ms.cast("string"), F.lit("."), extension)).otherwise(F.concat(F.col(name), F.lit("-"), ms.cast("string")))
    joined = incoming.join(known, F.col(name) == F.col("e_name"), "left").withColumn("conflict", F.col("e_name").isNotNull())
    return joined.withColumn("stored", F.when(F.col("conflict"), other).otherwise(F.col(name))).drop("e_name")


def chunks(df: DataFrame, group: str, order: list[str], size: int, groups: DataFrame | None = None) -> DataFrame:
    """(group, chunk, n, done): chunks of so many rows, done on the last; a group (of groups) without rows is one empty chunk."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    found = df.withColumn("chunk", F.floor(n / size).cast("long")).groupBy(group, "chunk").agg(F.count("*").alias("n"))
    if groups is not None:
        empty = groups.select(group).distinct().join(df.select(group).distinct(), group, "left_anti")
        found = found.unionByName(empty.select(group, F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n")))
    return found.withColumn("done", F.col("chunk") == F.max("chunk").over(Window.partitionBy(group)))


def changed_since(df: DataFrame, time: str, since: Column, value: str) -> DataFrame:
    """Rows later than ``since`` with a value that is neither null nor empty."""
    return df.where((F.col(time) > since) & F.col(value).isNotNull() & (F.col(value) != ""))


def released(df: DataFrame, early: Column, include_early: bool) -> DataFrame:
    return df if include_early else df.where(~F.coalesce(early, F.lit(False)))


def first_rule(df: DataFrame, name: Column, rules: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Of (label, suffix, tokens) rules, the label of the first whose suffix and any of whose tokens fit the lower-case name."""
    out = F.lit(None).cast("string")
    for label, suffix, tokens in reversed(rules):
        some = F.lit(False)
        for token in tokens:
            some = some | F.contains(F.lower(name), F.lit(token))
        out = F.when(F.endswith(F.lower(name), F.lit(suffix)) & some, label).otherwise(out)
    return out


def contained(path: Column, root: str) -> Column:
    """If the path is the root or below it; a name that only starts alike is not."""
    base = root.rstrip("/")
    return (path == base) | F.startswith(path, F.lit(base + "/"))


def by_fallback(items: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """items with ``value`` of the first row of ``first`` by order, otherwise of ``second``, otherwise null."""
    tops = first.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("f_value")).withColumnRenamed(key, "f_key")
    others = second.groupBy(key).agg(F.min(value).alias("s_value")).withColumnRenamed(key, "s_key")
    joined = items.join(tops, F.col(key) == F.col("f_key"), "left").join(others, F.col(key) == F.col("s_key"), "left")
    return joined.select(*items.columns, F.coalesce("f_value", "s_value").alias(value))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def not_remote(local: DataFrame, remote: DataFrame, path: str) -> DataFrame:
    """Local files of whose base name there is no remote one."""
    names = remote.select(basename(F.col(path)).alias("r_name")).distinct()
    return local.join(names, basename(F.col(path)) == F.col("r_name"), "left_anti")


def rekeyed(old: DataFrame, names: DataFrame, old_key: str, name: str, new_key: str) -> DataFrame:
    """old rows under the key of the row whose name was their key; those without one go."""
    n = names.select(F.col(name).alias("n_name_"), F.col(new_key).alias(new_key))
    return old.join(n, F.col(old_key) == F.col("n_name_")).drop("n_name_", old_key)


def zipped(df: DataFrame, first: str, second: str, keep: list[str]) -> DataFrame:
    """(keep, place, first, second): arrays side by side; unequal lengths are an error."""
    checked = F.when(F.size(first) == F.size(second), F.arrays_zip(F.col(first), F.col(second))).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    each = df.select(*keep, F.posexplode(checked).alias("place", "z"))
    return each.select(*keep, "place", F.col("z")[first].alias(first), F.col("z")[second].alias(second))


def region_statistics(pixels: DataFrame, width: int, height: int, corner: int = 10) -> DataFrame:
    """Mean and population variance of v, and its means over the four corners, the centre and the upper half."""
    x, y = F.col("x"), F.col("y")
    corners = ((x < corner) | (x >= width - corner)) & ((y < corner) | (y >= height - corner))
    centre = (F.abs(x - width / 2) <= corner) & (F.abs(y - height / 2) <= corner)
    mean = lambda where: F.avg(F.when(where, F.col("v")))
    return pixels.agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), mean(corners).alias("corner_mean"), mean(centre).alias("center_mean"), mean(y < height / 2).alias("top_half_mean"))


def bounds(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return points.groupBy(group).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def by_priority(jobs: DataFrame, group: str, priority: Column, order: list[Column]) -> DataFrame:
    """jobs with ``turn``, their number within the group by priority."""
    return jobs.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(priority, *order)))


def lifo(requests: DataFrame, path: str, arrival: str, responder: str) -> DataFrame:
    """One row a path: its last arrival (the newest is served first), and all who wait for it, each once, sorted."""
    last = requests.groupBy(path, responder).agg(F.max(arrival).alias("arrived"))
    return last.groupBy(path).agg(F.max("arrived").alias("arrived"), F.sort_array(F.collect_list(responder)).alias("responders")).orderBy(F.desc("arrived"), path)


def unreferenced(fonts: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Fonts that no reference (first column) names."""
    used = references[0].select(F.col(references[0].columns[0]).alias("used"))
    for r in references[1:]:
        used = used.unionByName(r.select(F.col(r.columns[0]).alias("used")))
    return fonts.join(used.where("used is not null").distinct(), F.col(key) == F.col("used"), "left_anti")


def moved_list(ids: Column, old: Column, new: Column) -> Column:
    """An order list after an id has become another."""
    return F.transform(ids, lambda i: F.when(i == old, new).otherwise(i))


def moved_map(pairs: Column, old: Column, new: Column) -> Column:
    """A map of ids after an id has become another, in keys and values."""
    renamed = lambda i: F.when(i == old, new).otherwise(i)
    return F.transform_values(F.transform_keys(pairs, lambda k, v: renamed(k)), lambda k, v: renamed(v))


def upserted(items: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """(key, position, is_new): items keep their places, and new keys follow after the last, by key."""
    last = items.agg(F.coalesce(F.max(position), F.lit(-1))).first()[0]
    new = incoming.select(key).distinct().join(items.select(key), key, "left_anti")
    added = running(new, [F.col(key)], {"number_": F.lit(1)}).select(key, (F.col("number_") + 1 + last).cast("long").alias(position), F.lit(True).alias("is_new"))
    return items.select(key, F.col(position).cast("long").alias(position), F.lit(False).alias("is_new")).unionByName(added)


def get_or_compute(files: DataFrame, by_tag: DataFrame, by_sample: DataFrame, tag: str, sample: str, value: str, compute: Column) -> DataFrame:
    """files with ``value`` and ``found``: known under the tag, otherwise under the sample, otherwise computed now."""
    a = by_tag.select(F.col(tag).alias("t_key"), F.col(value).alias("t_value")).dropDuplicates(["t_key"])
    b = by_sample.select(F.col(sample).alias("s_key"), F.col(value).alias("s_value")).dropDuplicates(["s_key"])
    joined = files.join(a, F.col(tag) == F.col("t_key"), "left").join(b, F.col(sample) == F.col("s_key"), "left")
    found = F.when(F.col("t_value").isNotNull(), "tag").when(F.col("s_value").isNotNull(), "sample").otherwise("computed")
    return joined.select(*files.columns, F.coalesce("t_value", "s_value", compute).alias(value), found.alias("found"))


def completed_cache(wanted: DataFrame, cache: DataFrame, key: str, value: str, compute: Column) -> DataFrame:
    """cache with a row for each wanted key that it lacks, computed once."""
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    return cache.select(key, value).unionByName(missing.select(key, compute.alias(value)))


def set_changes(states: DataFrame, group: str, time: str, item: str) -> DataFrame:
    """(group, time, items) where the sorted set of items differs from that of the time before."""
    sets = states.groupBy(group, time).agg(F.sort_array(F.collect_set(item)).alias("items"))
    before = F.lag("items").over(Window.partitionBy(group).orderBy(time))
    return sets.withColumn("before", before).where("before is null or before <> items").drop("before")


# layer lists: arrays of structs


def without_variant(layers: Column, field: str, value: str) -> Column:
    return F.filter(layers, lambda x: ~x[field].eqNullSafe(F.lit(value)))


def edited(ops: Column, kind: Column, op: Column) -> Column:
    """ops with the one of its kind replaced in its place, or op at the end."""
    there = F.exists(ops, lambda x: x["kind"] == kind)
    return F.when(there, F.transform(ops, lambda x: F.when(x["kind"] == kind, op).otherwise(x))).otherwise(F.concat(ops, F.array(op)))


def loaded(current: Column, saved: Column, kind: str, image: str) -> Column:
    """Image layers of the current stack, then the saved layers."""
    return F.concat(F.filter(current, lambda x: x[kind] == image), saved)


def moved_layer(layers: Column, start: int, to: int) -> Column:
    """The layer at ``start`` (from 0) before what stood at ``to``; outside the list or in its own place nothing moves."""
    n = F.size(layers)
    target = to - 1 if to > start else to
    rest = F.filter(layers, lambda x, i: i != start)
    moved = F.concat(F.slice(rest, 1, target), F.slice(layers, start + 1, 1), F.slice(rest, target + 1, n))
    return F.when((F.lit(start) < n) & (F.lit(to) <= n) & F.lit(target != start), moved).otherwise(layers)


def renamed_layer(name: Column) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


# names and keys


def rating_or_null(value: Column) -> Column:
    return F.when(value.between(1, 5), value)


def bucket_label(name: Column, bucket: Column, prefix: Column) -> Column:
    """Name, otherwise bucket, and bucket/prefix as detail."""
    return F.concat(F.coalesce(renamed_layer(name), bucket), F.lit(" ("), F.concat_ws("/", bucket, prefix), F.lit(")"))


def trimmed_prefix(prefix: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(prefix), "^/+|/+$", ""), F.lit(""))


def thumbnail_key(path: Column, modified: Column, snapshot: Column) -> Column:
    """path::snapshot:id for a snapshot, otherwise path#modified (0 if unknown)."""
    plain = F.concat(path, F.lit("#"), F.coalesce(modified, F.lit(0)).cast("string"))
    return F.when(snapshot.isNotNull(), F.concat(path, F.lit("::snapshot:"), snapshot.cast("string"))).otherwise(plain)


def packet(text: Column, markers: list[tuple[str, str]]) -> Column:
    """The first of the (start, end) markers' stretch that the text holds, markers included; an open one is an error."""
    out = F.lit(None).cast("string")
    for start, end in reversed(markers):
        at = F.locate(start, text)
        rest = F.substr(text, at, F.char_length(text))
        close = F.instr(rest, end)
        found = F.when(close > 0, F.substr(rest, F.lit(1), close + len(end) - 1)).otherwise(F.raise_error(F.lit("unterminated packet")).cast("string"))
        out = F.when(at > 0, found).otherwise(out)
    return out


def text_or_number(json: Column, path: str) -> Column:
    """A JSON field that may be a number or text of one."""
    return F.get_json_object(json, path).try_cast("double")


def upload_name(prefix: str, ms: Column, extension: str) -> Column:
    return F.concat(F.lit(prefix + "-"), ms.cast("string"), F.lit("." + extension))


def email_token(email: Column) -> Column:
    """SHA-256 of the address without white space around it and in lower case."""
    return F.sha2(F.lower(F.trim(email)), 256)
