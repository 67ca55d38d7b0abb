"""Registered catalog queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photark.functions import text as tx
from photark.operators import catalog as c
from photark.operators import fingerprints as fp
from photark.operators import merge as mg
from photark.sources import tables as t
from photark.streaming import changes as ch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


VERSIONS = "WITH v AS (SELECT user_id AS key, event_id AS id, ts AS created_at, event_type AS kind, value, props FROM events)"


@query("""WITH l AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
g AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1)
SELECT d.doc_id AS path, d.source AS library, d.n_chars AS size, coalesce(r.quality, 0) AS rating, l.event_id AS latest_version, coalesce(g.tags, '') AS tags
FROM documents d LEFT JOIN labels r ON d.doc_id = r.doc_id LEFT JOIN l ON d.doc_id = l.user_id LEFT JOIN g ON d.doc_id = g.user_id""")
def listing_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.enriched_listing(t.files(spark, sf_dir), t.ratings(spark, sf_dir), t.versions(spark, sf_dir))


@query(VERSIONS + " SELECT key, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, id DESC) AS n FROM v) WHERE n = 1")
def latest_version_by_key(spark, sf_dir):
    return c.latest_per(t.versions(spark, sf_dir), "key").select("key", "id", "kind")


@query(VERSIONS + " SELECT source, key, id FROM (SELECT key % 50 AS source, *, row_number() OVER (PARTITION BY key % 50 ORDER BY created_at DESC, id DESC) AS n FROM v) WHERE n = 1")
def latest_version_by_source(spark, sf_dir):
    return c.latest_per(t.versions(spark, sf_dir).withColumn("source", F.col("key") % 50), "source").select("source", "key", "id")


@query(VERSIONS + " SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY created_at, id) AS display_index FROM v")
def version_display_index(spark, sf_dir):
    return c.display_index(t.versions(spark, sf_dir))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_items FROM customer")
def collections_with_counts(spark, sf_dir):
    return c.with_counts(t.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), t.table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


POSITIONS = "WITH p AS (SELECT o_custkey AS collection, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders)"


def positions(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("item"), n.cast("long").alias("position"))


@query(POSITIONS + " SELECT collection, coalesce(max(position), -1) + 1 AS next_position FROM p GROUP BY 1")
def next_position(spark, sf_dir):
    return c.next_position(positions(spark, sf_dir), "collection", "position")


APPENDED = POSITIONS + """, i AS (SELECT * FROM p WHERE item % 3 <> 0), a AS (SELECT collection, item FROM p WHERE item % 2 = 0),
r AS (SELECT a.*, i.item IS NOT NULL AS held FROM a LEFT JOIN i ON a.collection = i.collection AND a.item = i.item),
s AS (SELECT collection, max(position) + 1 AS start FROM i GROUP BY 1)"""


def appended(spark, sf_dir, gapless):
    p = positions(spark, sf_dir)
    return c.append(p.where("item % 3 <> 0"), p.where("item % 2 = 0").select("collection", "item"), "collection", "item", "item", gapless)


@query(APPENDED + " SELECT r.collection, item, coalesce(start, 0) + row_number() OVER (PARTITION BY r.collection ORDER BY item) - 1 AS position FROM r LEFT JOIN s ON r.collection = s.collection WHERE NOT held")
def append_positions_gapless(spark, sf_dir):
    return appended(spark, sf_dir, True)


@query(APPENDED + " SELECT collection, item, position FROM (SELECT r.collection, item, held, coalesce(start, 0) + row_number() OVER (PARTITION BY r.collection ORDER BY item) - 1 AS position FROM r LEFT JOIN s ON r.collection = s.collection) WHERE NOT held")
def append_positions_gapped(spark, sf_dir):
    return appended(spark, sf_dir, False)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%') AND (lower(p_name) LIKE '%small%' OR lower(p_type) LIKE '%small%' OR lower(p_brand) LIKE '%small%')")
def tag_filter_search(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part").withColumn("tags", F.array("p_type", "p_brand"))
    return c.search(parts, "p_name", "tags", " Ring, SMALL,,").select("p_partkey", "p_name", "p_type")


@query("SELECT doc_id AS path, source AS library, n_chars AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def collection_filter(spark, sf_dir):
    return c.in_collection(t.files(spark, sf_dir), t.ratings(spark, sf_dir).where("rating = 0").select("path"), "path")


@query("SELECT doc_id AS path, source AS library, n_chars AS size FROM documents")
def collection_filter_empty(spark, sf_dir):
    return c.in_collection(t.files(spark, sf_dir), t.ratings(spark, sf_dir).where("rating > 5").select("path"), "path")


@query("WITH r AS (SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, lang, quality FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.doc_id % 100 = 0 AND b.lang IS NOT DISTINCT FROM a.lang AND b.quality IS NOT DISTINCT FROM a.quality)")
def null_safe_cache_lookup(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", "lang")
    l = t.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality")
    rows = d.join(l, F.col("doc_id") == F.col("l_doc"), "left").select("doc_id", "lang", "quality")
    return c.null_safe_hits(rows, rows.where("doc_id % 100 = 0"), ["lang", "quality"])


@query("SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'https://')")
def prefix_match_ci(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", "url").where(c.starts_with_ignoring_case(F.col("url"), "HTTPS://"))


ROOTS = ("https://blog.", "http://", "https://", "http://m.")


@query("WITH r(root, root_order) AS (VALUES ('https://blog.', 0), ('http://', 1), ('https://', 2), ('http://m.', 3)) SELECT page_id, url, root, root_order FROM (SELECT page_id, url, root, root_order, row_number() OVER (PARTITION BY page_id ORDER BY root_order) AS n FROM pages LEFT JOIN r ON starts_with(url, root)) WHERE n = 1")
def prefix_root_join(spark, sf_dir):
    roots = spark.createDataFrame([(r, i) for i, r in enumerate(ROOTS)], "root string, root_order int")
    return c.root_of(t.table(spark, sf_dir, "pages").select("page_id", "url"), roots, "page_id", "url").select("page_id", "url", "root", "root_order")


@query("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(spark, sf_dir):
    return fp.missing(t.files(spark, sf_dir).select("path"), t.ratings(spark, sf_dir), ["path"])


@query("SELECT doc_id AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_members(spark, sf_dir):
    return t.files(spark, sf_dir).select("path").join(t.ratings(spark, sf_dir), "path", "left_semi")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 1 AND ts > (SELECT max(ts) FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-03 00:00:00')")
def high_water_mark_delta(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ch.since(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0 and ts < '2024-01-03 00:00:00'"), "ts").select("event_id", "user_id")


@query("WITH m AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate FROM orders), c AS (SELECT *, CASE WHEN lag(month) OVER w IS DISTINCT FROM month THEN 1 ELSE 0 END AS changed FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)) SELECT o_custkey, o_orderkey, month, (sum(changed) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM c")
def month_runs(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumn("month", tx.month_key(F.col("o_orderdate")))
    return c.runs(o, [F.desc("o_orderdate"), F.col("o_orderkey")], "month", ["o_custkey"]).select("o_custkey", "o_orderkey", "month", "run")


@query("SELECT o_orderkey, month, (n // 4)::INTEGER AS grid_row, (n % 4)::INTEGER AS grid_column FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate DESC, o_orderkey) - 1 AS n FROM orders)")
def grid_rows(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumn("month", tx.month_key(F.col("o_orderdate")))
    return c.grid(o, [F.desc("o_orderdate"), F.col("o_orderkey")], ["month"], 4).select("o_orderkey", "month", "grid_row", "grid_column")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 512 AS has_more FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 256 OFFSET 256)")
def offset_page_has_more(spark, sf_dir):
    return c.page(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 256, 256)


@query("SELECT n_name, row_number() OVER (ORDER BY coalesce(nullif(coalesce(list_position(['NATION_7', 'NATION_2', 'NATION_20'], n_name), 0), 0), 4), n_name) AS place FROM nation")
def ordered_by_list(spark, sf_dir):
    return c.ordered_by(t.table(spark, sf_dir, "nation").select("n_name"), "n_name", ["NATION_7", "NATION_2", "NATION_20"], "n_name")


SIDES = """WITH s AS (SELECT user_id * 1000 + floor(value)::BIGINT AS k, event_id % 2 AS side, epoch_us(ts) AS stamp, event_id, value, row_number() OVER (PARTITION BY user_id * 1000 + floor(value)::BIGINT, event_id % 2 ORDER BY ts DESC, event_id) AS n FROM events),
b AS (SELECT k, stamp, value FROM s WHERE side = 0 AND n = 1), i AS (SELECT k, stamp, value FROM s WHERE side = 1 AND n = 1)"""


def sides(spark, sf_dir):
    """The newest event of each user and whole value, of even and of odd ids, as the two sides of a merge; many keys are on one side only."""
    key = F.col("user_id") * 1000 + F.floor("value").cast("bigint")
    e = t.table(spark, sf_dir, "events").select(key.alias("k"), (F.col("event_id") % 2).alias("side"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"), "event_id", "value")
    w = Window.partitionBy("k", "side").orderBy(F.desc("stamp"), "event_id")
    s = e.withColumn("n", F.row_number().over(w)).where("n = 1")
    return s.where("side = 0").select("k", "stamp", "value"), s.where("side = 1").select("k", "stamp", "value")


@query(SIDES + " SELECT coalesce(b.k, i.k) AS k, CASE WHEN b.k IS NULL OR i.stamp > b.stamp THEN i.stamp ELSE b.stamp END AS stamp, CASE WHEN b.k IS NULL OR i.stamp > b.stamp THEN i.value ELSE b.value END AS value FROM b FULL JOIN i ON b.k = i.k")
def merge_lww(spark, sf_dir):
    return mg.last_writer_wins(*sides(spark, sf_dir), ["k"], "stamp")


@query(SIDES + " SELECT * FROM b UNION ALL SELECT * FROM i WHERE k NOT IN (SELECT k FROM b)")
def merge_ignore(spark, sf_dir):
    return mg.ignore(*sides(spark, sf_dir), ["k"])


@query(SIDES + " SELECT * FROM i UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM i)")
def merge_replace(spark, sf_dir):
    return mg.replace(*sides(spark, sf_dir), ["k"])


@query(SIDES + " SELECT i.k, i.stamp, coalesce(b.value, i.value) AS value FROM i LEFT JOIN b ON i.k = b.k")
def merge_coalesce(spark, sf_dir):
    return mg.coalesced(*sides(spark, sf_dir), ["k"], ["value"])


@query(SIDES + " SELECT coalesce(b.k, i.k) AS k, CASE WHEN b.k IS NULL OR (i.k IS NOT NULL AND b.value <= 10) THEN i.stamp ELSE b.stamp END AS stamp, CASE WHEN b.k IS NULL OR (i.k IS NOT NULL AND b.value <= 10) THEN i.value ELSE b.value END AS value FROM b FULL JOIN i ON b.k = i.k")
def merge_guarded(spark, sf_dir):
    return mg.guarded(*sides(spark, sf_dir), ["k"], F.col("b.value") > 10)


@query("SELECT user_id, event_type FROM events WHERE event_id % 3 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 7 = 0) UNION ALL SELECT user_id, event_type FROM events WHERE event_id % 7 = 0")
def merge_replace_set(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return mg.replace_sets(e.where("event_id % 3 <> 0").select("user_id", "event_type"), e.where("event_id % 7 = 0").select("user_id", "event_type"), "user_id")


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT * FROM a UNION SELECT * FROM b")
def peer_tag_union(spark, sf_dir):
    e = t.table(spark, sf_dir, "events")
    side = lambda n: e.where(f"event_id % 2 = {n}").select("user_id", "event_type").distinct()
    return mg.union_sets(side(0), side(1), ["user_id", "event_type"])


@query(SIDES + " SELECT coalesce(b.k, i.k) AS k, CASE WHEN coalesce(i.stamp, 0) > coalesce(b.stamp, 0) THEN i.value ELSE b.value END AS value, CASE WHEN coalesce(i.stamp, 0) > coalesce(b.stamp, 0) THEN i.stamp ELSE b.stamp END AS stamp FROM b FULL JOIN i ON b.k = i.k")
def peer_rating_merge(spark, sf_dir):
    return mg.merged_ratings(*sides(spark, sf_dir), "k", "value", "stamp")


@query("SELECT p_partkey, trim(regexp_replace(lower(translate(p_name || '_' || p_type || '-X', '_-', '  ')), '\\s+', ' ', 'g')) AS label FROM part")
def label_normalize(spark, sf_dir):
    raw = F.concat("p_name", F.lit("_"), "p_type", F.lit("-X"))
    return t.table(spark, sf_dir, "part").select("p_partkey", tx.normal_label(raw).alias("label"))


@query("SELECT p_partkey, CASE WHEN substr(lower(p_type), 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article FROM part")
def indefinite_article(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", tx.article(F.col("p_type")).alias("article"))


@query("WITH l AS (SELECT DISTINCT lower(p_type) AS label FROM part), v AS (SELECT label, unnest([label, CASE WHEN substr(label, 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || label, 'the ' || label]) AS variant FROM l) SELECT label, 'a photo of ' || variant || '.' AS prompt FROM v")
def prompt_variants(spark, sf_dir):
    labels = t.table(spark, sf_dir, "part").select(tx.normal_label(F.col("p_type")).alias("label")).distinct()
    return labels.select("label", F.explode(tx.variants(F.col("label"))).alias("variant")).select("label", tx.prompt(F.col("variant")).alias("prompt"))


@query("""WITH s AS (SELECT doc_id, n_chars * 1000 AS n FROM documents), p AS (
SELECT doc_id, n, unnest(CASE WHEN n = 0 THEN [] WHEN n <= 65536 THEN [{'o': 0::BIGINT, 'l': n}] ELSE [{'o': 0::BIGINT, 'l': 16384::BIGINT}, {'o': n // 3, 'l': 16384::BIGINT}, {'o': n * 2 // 3, 'l': 16384::BIGINT}, {'o': n - 16384, 'l': 16384::BIGINT}] END) AS s FROM s)
SELECT doc_id, s.o AS offset, s.l AS length FROM p""")
def sample_plan(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(fp.sample_plan(F.col("n_chars") * 1000)).alias("s"))
    return d.select("doc_id", F.col("s.offset").alias("offset"), F.col("s.length").alias("length"))


@query("SELECT md5(text) AS fingerprint, count(*) AS n_paths, min(doc_id) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.md5("text").alias("fingerprint"), F.col("doc_id").alias("path"))
    return fp.duplicates(d, "fingerprint", "path")


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents),
p AS (SELECT *, CASE WHEN n = 0 THEN [] WHEN n <= 65536 THEN [{'o': 0::BIGINT, 'l': n}] ELSE [{'o': 0::BIGINT, 'l': 16384::BIGINT}, {'o': n // 3, 'l': 16384::BIGINT}, {'o': n * 2 // 3, 'l': 16384::BIGINT}, {'o': n - 16384, 'l': 16384::BIGINT}] END AS s FROM d)
SELECT doc_id, sha256(unhex(hex(encode(n || ':16384:' || len(s) || ':')) || array_to_string(list_transform(s, lambda q: hex(encode(q.o || ':')) || substr(x, 2 * q.o + 1, 2 * q.l)), ''))) AS fingerprint FROM p""")
def content_fingerprint(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return d.select("doc_id", fp.fingerprint(F.col("content")).alias("fingerprint"))


@query("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM pages")
def url_parts(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), tx.query_parameter(F.col("url"), "page").alias("page"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_variant_parse(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), r AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n_events FROM r GROUP BY user_id, run")
def debounce_sessions(spark, sf_dir):
    return ch.debounced(t.table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@query("SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE event_type <> 'view' OR next IS NULL OR next <> 'view'")
def coalesce_runs(spark, sf_dir):
    return ch.collapsed(t.table(spark, sf_dir, "events"), ["ts", "event_id"], "event_type", "view", "user_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id) AS newest FROM events) WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = newest")
def stale_discard(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").withColumn("generation", F.from_json("props", "k bigint")["k"])
    return ch.current(e, "user_id", "generation").select("event_id", "user_id")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def peer_latest_state(spark, sf_dir):
    return ch.latest_state(t.table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id").select("user_id", "event_type")
