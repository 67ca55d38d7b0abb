"""Registered queries of listings, names, ordered lists, layer lists, colour spaces and geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from photark.functions import geometry
from photark.functions.numeric import rounded
from photark.operators import items as it
from photark.plans.images import RASTER, height
from photark.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT d.doc_id, d.source, coalesce(l.quality, d.n_chars) AS modified_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def object_listing(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("modified_at"))
    return it.with_heads(d, t.table(spark, sf_dir, "labels"), "doc_id", "modified_at", "quality")


@query("SELECT c AS o_custkey, row_number() OVER (PARTITION BY c ORDER BY m DESC NULLS LAST, k) AS place, k AS o_orderkey, m AS modified_at FROM (SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS m FROM orders)")
def nested_listing(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("modified_at"))
    groups = o.select("o_custkey", F.array(F.struct("o_orderkey", "modified_at")).alias("items"))  # as a device lists them: a folder at a time
    return it.flattened(groups, "items", "modified_at", ["o_custkey"])


@query("SELECT p_partkey, p_name || CASE WHEN n = 0 THEN '' ELSE '_' || n END || '.' || lower(p_type) AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) - 1 AS n FROM part)")
def export_names(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_type").alias("ext"))
    return it.unique_names(p, "p_name", "ext", ["p_partkey"]).select("p_partkey", "name")


@query("WITH f AS (SELECT p_partkey, p_name || '.' || lower(p_brand) AS name FROM part), e AS (SELECT DISTINCT name FROM f WHERE p_partkey % 2 = 0) SELECT p_partkey, f.name, e.name IS NOT NULL AS conflict, CASE WHEN e.name IS NULL THEN f.name ELSE regexp_extract(f.name, '^(.*)\\.[^.]*$', 1) || '-' || (1000 + p_partkey) || '.' || regexp_extract(f.name, '([^.]*)$', 1) END AS stored FROM f LEFT JOIN e ON f.name = e.name WHERE p_partkey % 2 = 1")
def upload_names(spark, sf_dir):
    f = t.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("."), F.lower("p_brand")).alias("name"))
    return it.upload_names(f.where("p_partkey % 2 = 1"), f.where("p_partkey % 2 = 0"), "name", 1000 + F.col("p_partkey"))


@query("WITH c AS (SELECT c_custkey AS o_custkey FROM customer), n AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS chunk FROM orders), g AS (SELECT o_custkey, chunk, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT o_custkey, 0, 0 FROM c WHERE o_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT *, chunk = max(chunk) OVER (PARTITION BY o_custkey) AS done FROM g")
def delivery_chunks(spark, sf_dir):
    groups = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return it.chunks(t.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], 4, groups)


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-03 00:00:00' AND event_type IS NOT NULL AND event_type <> ''")
def changed_with_fingerprint(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    return it.changed_since(e, "ts", F.lit("2024-01-03 00:00:00").cast(e.schema["ts"].dataType), "event_type").select("event_id", "user_id")


@query("SELECT p_partkey, p_type FROM part WHERE p_size <= 40")
def stable_releases(spark, sf_dir):
    return it.released(t.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("p_size") > 40, False).drop("p_size")


@query("SELECT p_partkey, CASE WHEN lower(n) LIKE '%widget' AND (lower(n) LIKE '%cold%' OR lower(n) LIKE '%hot%') THEN 'thermal' WHEN lower(n) LIKE '%t' AND (lower(n) LIKE '%small%' OR lower(n) LIKE '%cold%') THEN 'other' END AS label FROM (SELECT p_partkey, p_name AS n FROM part)")
def asset_rules(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", it.first_rule(p, F.col("p_name"), [("thermal", "widget", ("cold", "hot")), ("other", "t", ("small", "cold"))]).alias("label"))


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) = '/en' OR regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) LIKE '/en/%'")
def contained_paths(spark, sf_dir):
    p = t.table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1))
    return p.where(it.contained(F.col("path"), "/en/")).select("page_id")


@query("SELECT c_custkey, coalesce((SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1), (SELECT min(s_name) FROM supplier WHERE s_suppkey = c_custkey)) AS fingerprint FROM customer")
def fallback_fingerprint(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("fingerprint"), "o_orderdate", "o_orderkey")
    s = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("fingerprint"))
    return it.by_fallback(t.table(spark, sf_dir, "customer").select("c_custkey"), o, s, "c_custkey", "fingerprint", ["o_orderdate", "o_orderkey"])


@query("SELECT page_id FROM pages WHERE page_id % 2 = 0 AND regexp_extract(url, '([^/]*)$', 1) NOT IN (SELECT regexp_extract(url, '([^/]*)$', 1) FROM pages WHERE page_id % 2 = 1)")
def not_remote_names(spark, sf_dir):
    p = t.table(spark, sf_dir, "pages").select("page_id", "url")
    return it.not_remote(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), "url").select("page_id")


@query("SELECT DISTINCT regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def distinct_basenames(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select(it.basename(F.col("url")).alias("name")).distinct()


@query("SELECT p_partkey, s_suppkey AS source FROM (SELECT p_partkey, 'Supplier#' || lpad((p_partkey % 37)::VARCHAR, 9, '0') AS media_id FROM part) JOIN supplier ON media_id = s_name")
def migrated_keys(spark, sf_dir):
    old = t.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 37).cast("string"), 9, "0")).alias("media_id"))
    names = t.table(spark, sf_dir, "supplier").select("s_name", F.col("s_suppkey").alias("source"))
    return it.rekeyed(old, names, "media_id", "s_name", "source")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 AND l.quality IS NOT NULL AND d.source IS NOT NULL AND d.n_chars > 100 AND d.text <> '' ORDER BY d.n_chars, d.doc_id LIMIT 1")
def best_thumbnail(spark, sf_dir):
    d, lab = t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "labels")
    found = d.join(lab, "doc_id").where("toxic = 0 and quality is not null and source is not null and n_chars > 100 and text <> ''")
    return found.orderBy("n_chars", "doc_id").limit(1).select("doc_id", "source", "quality")


@query("SELECT p_partkey, unnest(range(len(w)))::INTEGER AS place, unnest(w) AS words, unnest(list_transform(w, lambda x: length(x)))::INTEGER AS scores FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def zipped_scores(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return it.zipped(p.withColumn("scores", F.transform("words", lambda w: F.char_length(w))), "words", "scores", ["p_partkey"])


@query(RASTER + ", n AS (SELECT max(y) + 1.0::DOUBLE AS h FROM f), b AS (SELECT *, (x < 10 OR x >= 90) AND (y < 10 OR y >= h - 10) AS corner, abs(x - 50.0) <= 10 AND abs(y - h / 2) <= 10 AS center FROM f, n) SELECT round(avg(v), 9) AS mean, round(var_pop(v), 9) AS variance, round(avg(v) FILTER (corner), 9) AS corner_mean, round(avg(v) FILTER (center), 9) AS center_mean, round(avg(v) FILTER (y < h / 2), 9) AS top_half_mean FROM b")
def region_statistics(spark, sf_dir):
    f = t.raster(spark, sf_dir)
    s = it.region_statistics(f, 100, height(f))
    return s.select(*[rounded(F.col(c), 9).alias(c) for c in s.columns])


@query("SELECT c_nationkey, min(c_custkey) AS min_x, min(c_acctbal) AS min_y, max(c_custkey) AS max_x, max(c_acctbal) AS max_y FROM customer GROUP BY 1")
def bounding_boxes(spark, sf_dir):
    return it.bounds(t.table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)::INTEGER, o_orderkey) AS turn FROM orders")
def job_priority(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return it.by_priority(o, "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int"), [F.col("o_orderkey")]).drop("o_orderpriority")


@query("SELECT event_type || '/' || (user_id % 7) AS path, max(event_id) AS arrived, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS responders FROM events GROUP BY 1")
def lifo_queue(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 7).cast("string")).alias("path"), "event_id", F.col("user_id").cast("string").alias("who"))
    return it.lifo(e, "path", "event_id", "who").withColumn("responders", F.array_join("responders", ","))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def flattened_categories(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unreferenced_fonts(spark, sf_dir):
    styles = t.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")
    spans = t.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return it.unreferenced(t.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", styles, spans)


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x = 'cold' THEN 'frozen' ELSE x END), ' ') AS ids, CASE WHEN p_brand = 'Brand#5' THEN 'frozen' ELSE p_brand END AS k, CASE WHEN p_type = 'Brand#5' THEN 'frozen' ELSE p_type END AS v FROM part")
def moved_identity(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    ids = it.moved_list(F.split("p_name", " "), F.lit("cold"), F.lit("frozen"))
    p = p.select("p_partkey", F.array_join(ids, " ").alias("ids"), it.moved_map(F.create_map("p_brand", "p_type"), F.lit("Brand#5"), F.lit("frozen")).alias("m"))
    return p.select("p_partkey", "ids", F.map_keys("m")[0].alias("k"), F.map_values("m")[0].alias("v"))


@query("WITH n AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)) SELECT n_name AS name, n_nationkey::BIGINT AS position, false AS is_new FROM nation UNION ALL SELECT name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name), true FROM n")
def ordered_upsert(spark, sf_dir):
    items = t.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    c = t.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))
    return it.upserted(items, c.unionByName(items.select("name")), "name", "position")


@query("WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS items FROM events GROUP BY 1, 2), b AS (SELECT *, lag(items) OVER (PARTITION BY user_id ORDER BY day) AS before FROM a) SELECT user_id, day::VARCHAR AS day, items FROM b WHERE before IS NULL OR before <> items")
def changed_sets(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return it.set_changes(e, "user_id", "day", "event_type").select("user_id", F.col("day").cast("string").alias("day"), F.array_join("items", ",").alias("items"))


@query("SELECT doc_id, coalesce(md5(t.source), md5(s.lang), md5(doc_id::VARCHAR)) AS fingerprint, CASE WHEN t.source IS NOT NULL THEN 'tag' WHEN s.lang IS NOT NULL THEN 'sample' ELSE 'computed' END AS found FROM documents d LEFT JOIN (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 0) t ON d.source = t.source LEFT JOIN (SELECT DISTINCT lang FROM documents WHERE doc_id % 70 = 0) s ON d.lang = s.lang")
def get_or_compute(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    by_tag = d.where("doc_id % 50 = 0").select("source", F.md5(F.col("source").cast("binary")).alias("fingerprint"))
    by_sample = d.where("doc_id % 70 = 0").select("lang", F.md5(F.col("lang").cast("binary")).alias("fingerprint"))
    found = it.get_or_compute(d, by_tag, by_sample, "source", "lang", "fingerprint", F.md5(F.col("doc_id").cast("string").cast("binary")))
    return found.select("doc_id", "fingerprint", "found")


@query("SELECT p_name AS prompt, length(p_name) + CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_partkey % 9 = 0) THEN 1000 ELSE 0 END AS score FROM (SELECT DISTINCT p_name FROM part)")
def prompt_cache(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select(F.col("p_name").alias("prompt"), "p_partkey")
    cache = p.where("p_partkey % 9 = 0").select("prompt").distinct().withColumn("score", (F.char_length("prompt") + 1000).cast("long"))
    return it.completed_cache(p, cache, "prompt", "score", F.char_length("prompt").cast("long"))


_layers = "WITH l AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"


@query(_layers + " SELECT p_partkey, array_to_string(list_filter(w, lambda x: x <> 'widget'), ',') AS kept, array_to_string(CASE WHEN len(w) = 2 THEN [w[2], w[1]] ELSE w END, ',') AS moved, array_to_string(CASE WHEN list_contains(w, 'cold') THEN list_transform(w, lambda x: CASE WHEN x = 'cold' THEN 'cold!' ELSE x END) ELSE list_append(w, 'cold!') END, ',') AS edited, array_to_string(list_concat(list_filter(w, lambda x: x = 'small'), ['saved']), ',') AS loaded FROM l")
def layer_changes(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_name", " "), lambda x: F.struct(x.alias("kind"), x.alias("value"))).alias("ops"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), ",")
    op = F.struct(F.lit("cold").alias("kind"), F.lit("cold!").alias("value"))
    saved = F.array(F.struct(F.lit("tone").alias("kind"), F.lit("saved").alias("value")))
    ops = F.col("ops")
    return p.select(
        "p_partkey", shown(it.without_variant(ops, "kind", "widget")).alias("kept"), shown(it.moved_layer(ops, 0, 2)).alias("moved"),
        shown(it.edited(ops, F.lit("cold"), op)).alias("edited"), shown(it.loaded(ops, saved, "kind", "small")).alias("loaded"),
    )


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 5 THEN p_size END AS rating, nullif(trim(substr(p_name, 1, p_size % 4)), '') AS layer_name, p_name || '#' || p_size AS key, p_name || '::snapshot:' || p_partkey AS snapshot_key, 'clipboard-' || (1000 * p_partkey) || '.png' AS upload, sha256(lower(trim('  ' || p_brand || '@X.org '))) AS token, coalesce(nullif(trim(substr(p_type, 1, p_size % 3)), ''), p_brand) || ' (' || p_brand || '/' || p_type || ')' AS label FROM part")
def item_names(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    none = F.lit(None).cast("long")
    return p.select(
        "p_partkey", it.rating_or_null(F.col("p_size")).alias("rating"), it.renamed_layer(F.substr("p_name", F.lit(1), F.col("p_size") % 4)).alias("layer_name"),
        it.thumbnail_key(F.col("p_name"), F.col("p_size"), none).alias("key"), it.thumbnail_key(F.col("p_name"), F.col("p_size"), F.col("p_partkey")).alias("snapshot_key"),
        it.upload_name("clipboard", 1000 * F.col("p_partkey"), "png").alias("upload"), it.email_token(F.concat(F.lit("  "), "p_brand", F.lit("@X.org "))).alias("token"),
        it.bucket_label(F.substr("p_type", F.lit(1), F.col("p_size") % 3), F.col("p_brand"), F.col("p_type")).alias("label"),
    )


@query("SELECT page_id, nullif(regexp_replace(trim(' /' || path || '// '), '^/+|/+$', '', 'g'), '') AS prefix FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM pages)")
def trimmed_prefixes(spark, sf_dir):
    p = t.table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/]*([^?#]*)", 1))
    return p.select("page_id", it.trimmed_prefix(F.concat(F.lit(" /"), "path", F.lit("// "))).alias("prefix"))


@query("SELECT page_id, regexp_extract(html, '(?s)(<title>.*?</title>)', 1) AS packet FROM pages WHERE contains(html, '<title>')")
def located_packets(spark, sf_dir):
    p = t.table(spark, sf_dir, "pages").select("page_id", it.packet(F.col("html"), [("<nothing>", "</nothing>"), ("<title>", "</title>")]).alias("packet"))
    return p.where("packet is not null")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def text_or_number(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", it.text_or_number(F.col("props"), "$.k").alias("k"))


_rect = "SELECT o_orderkey, (o_orderkey % 50 - 10)::INTEGER AS x, (o_custkey % 40 - 5)::INTEGER AS y, (o_orderkey % 37 + 1)::INTEGER AS w, (o_custkey % 29 + 1)::INTEGER AS h FROM orders"


@query(f"WITH r AS ({_rect}), c AS (SELECT *, least(greatest(x, 0), 39) AS cx, least(greatest(y, 0), 29) AS cy FROM r) SELECT o_orderkey, cx, cy, greatest(1, least(x + w, 40) - cx) AS cw, greatest(1, least(y + h, 30) - cy) AS ch, greatest(x, 5) AS ix, greatest(y, 5) AS iy, greatest(0, least(x + w, 25) - greatest(x, 5)) AS iw, greatest(0, least(y + h, 25) - greatest(y, 5)) AS ih, greatest(1, round(w * 7 * least(1.0::DOUBLE, 120.0::DOUBLE / greatest(w * 7, h * 7))))::INTEGER AS tw, greatest(1, round(h * 7 * least(1.0::DOUBLE, 120.0::DOUBLE / greatest(w * 7, h * 7))))::INTEGER AS th, round(least(640.0::DOUBLE / w, 480.0::DOUBLE / h), 6) AS scale FROM c")
def rectangles(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    r = o.selectExpr("o_orderkey", "cast(o_orderkey % 50 - 10 as int) x", "cast(o_custkey % 40 - 5 as int) y", "cast(o_orderkey % 37 + 1 as int) w", "cast(o_custkey % 29 + 1 as int) h")
    x, y, w, h = (F.col(c) for c in "xywh")
    out = dict(zip(("cx", "cy", "cw", "ch"), geometry.crop_clamped(x, y, w, h, 40, 30), strict=True))
    out |= dict(zip(("ix", "iy", "iw", "ih"), geometry.intersection((x, y, w, h), tuple(map(F.lit, (5, 5, 20, 20)))), strict=True))
    out |= dict(zip(("tw", "th"), geometry.contain(w * 7, h * 7, 120), strict=True)) | {"scale": rounded(geometry.fit_scale(w, h, 640, 480))}
    return r.select("o_orderkey", *[c.alias(n) for n, c in out.items()])


@query("WITH q AS (SELECT o_orderkey, (o_orderkey % 11)::DOUBLE AS a, (o_custkey % 17)::DOUBLE AS b, (o_orderkey % 7)::DOUBLE AS c FROM orders), s AS (SELECT *, CASE WHEN abs(a - 2 * b + c) > 1e-12 THEN (a - b) / (a - 2 * b + c) END AS t FROM q), e AS (SELECT *, CASE WHEN t > 0 AND t < 1 THEN (1 - t) * (1 - t) * a + 2 * (1 - t) * t * b + t * t * c END AS turn FROM s) SELECT o_orderkey, round(least(a, c, coalesce(turn, a)), 6) AS low, round(greatest(a, c, coalesce(turn, a)), 6) AS high FROM e")
def curve_extents(spark, sf_dir):
    q = t.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 11 as double) a", "cast(o_custkey % 17 as double) b", "cast(o_orderkey % 7 as double) c")
    low, high = geometry.quadratic_extent(F.col("a"), F.col("b"), F.col("c"))
    return q.select("o_orderkey", rounded(low).alias("low"), rounded(high).alias("high"))


_stamp = lambda cx, cy, r, p: f"(1 - t{cx} * t{cx} * (3 - 2 * t{cx})) * {p}"
_fall = lambda cx, cy, r: f"greatest(0.0, least(1.0, (sqrt((x - {cx}.0::DOUBLE) * (x - {cx}.0::DOUBLE) + (y - {cy}.0::DOUBLE) * (y - {cy}.0::DOUBLE)) / {r}.0 - 0.5) / 0.5)) AS t{cx}"


@query(RASTER + f", s AS (SELECT x, y, {_fall(20, 5, 15)}, {_fall(30, 8, 12)} FROM f) SELECT x, y, round(least(1.0, least(1.0, {_stamp(20, 5, 15, 0.7)}) + {_stamp(30, 8, 12, 0.6)}), 6) + 0.0 AS m, 1.0::DOUBLE AS everything, 0.0::DOUBLE AS nothing FROM s")
def mask_brush_additive(spark, sf_dir):
    m = geometry.brush(F.col("x"), F.col("y"), [(20.0, 5.0, 15.0, 0.7), (30.0, 8.0, 12.0, 0.6)])
    return t.raster(spark, sf_dir).select("x", "y", rounded(m).alias("m"), F.lit(1.0).alias("everything"), F.lit(0.0).alias("nothing"))
