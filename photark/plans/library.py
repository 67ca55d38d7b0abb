"""Registered library maintenance queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from photark.operators import library as lb
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


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (3, 5, 8, 13, 21)")
def json_not_in(spark, sf_dir):
    return lb.not_listed(t.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "[3, 5, 8, 13, 21]")


@query("SELECT n_nationkey, n_name, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS items FROM nation")
def nested_items(spark, sf_dir):
    n = lb.nested(t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), t.table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey", "s_name")
    return n.withColumn("items", F.array_join("items", ","))


@query("WITH c AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15), d AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, true AS configured, k IN (SELECT k FROM d) AS online FROM c UNION ALL SELECT k, false, true FROM d WHERE k NOT IN (SELECT k FROM c)")
def union_of_sources(spark, sf_dir):
    return lb.all_sources(t.table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("k")), t.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT p_type AS label, string_agg(DISTINCT w, ',' ORDER BY w) AS variants FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def variant_union(spark, sf_dir):
    v = t.table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.split("p_name", " ").alias("words"))
    return lb.merged_variants(v, "label", "words").select("label", F.array_join("variants", ",").alias("variants"))


@query("SELECT event_type AS step, (sum((value * 100)::BIGINT) // (SELECT count(DISTINCT user_id) FROM events))::BIGINT AS average FROM events GROUP BY 1")
def pass_averages(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("step"), F.round(F.col("value") * 100).cast("bigint").alias("micros"))
    return lb.pass_averages(e, "user_id", "step", "micros")


@query("SELECT user_id, event_id, n AS version, n = max(n) OVER (PARTITION BY user_id) AS is_current FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def current_versions(spark, sf_dir):
    return lb.with_current(t.table(spark, sf_dir, "events"), "user_id", "event_id", ["ts", "event_id"]).select("user_id", "event_id", "version", "is_current")


@query("WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS n FROM nation) SELECT n_name, n FROM r WHERE n BETWEEN (SELECT min(n) FROM r WHERE n_name IN ('NATION_17', 'NATION_3')) AND (SELECT max(n) FROM r WHERE n_name IN ('NATION_17', 'NATION_3'))")
def range_select(spark, sf_dir):
    return lb.selected_between(t.table(spark, sf_dir, "nation").select("n_name"), "n_name", ["n_name"], "NATION_3", "NATION_17")


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN 2 WHEN lower(p_type) LIKE '%ring%' OR lower(p_type) LIKE '%ring%' THEN 1 ELSE 0 END AS rank FROM part")
def ranked_search(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", lb.search_rank(F.col("p_name"), F.col("p_type"), "Ring").alias("rank"))


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, l.quality::VARCHAR) AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def first_write_wins(spark, sf_dir):
    base = t.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("state"))
    new = t.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("state"))
    return lb.first_write(base, new, "doc_id", ["state"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    c, o = t.table(spark, sf_dir, "customer"), t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lb.cascade_delete(c, o, c.where("c_acctbal < 0"), "c_custkey", "o_custkey")[1]


@query("WITH k AS (SELECT md5(text) AS h, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), a AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 1) SELECT h, id FROM a JOIN k USING (h) UNION ALL SELECT h, (SELECT max(doc_id) FROM documents WHERE doc_id % 2 = 0) + row_number() OVER (ORDER BY h) FROM a WHERE h NOT IN (SELECT h FROM k)")
def insert_by_hash(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    return lb.insert_by_hash(d.where("id % 2 = 0"), d.where("id % 2 = 1"), "h")


@query("SELECT n_nationkey AS k, coalesce(s.name, n_name) AS name, s.name IS NOT NULL AND s.name <> n_name AS changed FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey")
def refreshed_names(spark, sf_dir):
    found = t.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))
    return lb.refreshed_names(t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), found, "k", "name")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT) DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def best_tiles(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").withColumn("generation", F.from_json("props", "k bigint")["k"])
    return lb.best_tiles(e, "user_id", "generation", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, CASE WHEN lang <> '' AND (source <> 'src1') THEN sha256('object-etag|' || n_chars || '|' || lang) END AS identity FROM documents")
def etag_identity(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    sse = F.when(F.col("source") == "src1", "aws:kms").when(F.col("source") == "src2", "AES256")
    return d.select("doc_id", lb.etag_identity(F.col("n_chars"), F.concat(F.lit('"'), "lang", F.lit('"')), sse).alias("identity"))


@query("SELECT band, p_partkey, row_number() OVER (PARTITION BY band ORDER BY hi DESC, lo, p_partkey) AS place FROM (SELECT p_partkey, p_size AS lo, p_size + p_partkey % 9 AS hi, unnest(range(p_size // 10, (p_size + p_partkey % 9) // 10 + 1)) AS band FROM part)")
def curve_bands(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 9).alias("hi"))
    return lb.bands(p, "lo", "hi", 10).select("band", "p_partkey", "place")


@query("SELECT doc_id, ('0x' || left(md5(text), 16))::UBIGINT::VARCHAR AS source_id FROM documents")
def hex_u64(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", lb.leading_u64(F.md5("text")).cast("string").alias("source_id"))
