"""Each registered query on a fixture with nulls, empty, long and repeated texts, against brute force; empty tables; clashing names."""

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F
from test_operators import ids_of, rows  # noqa: F401

import corpus_pipeline
from photark.llm import registry, simhash, toxicity


@pytest.fixture(scope="module")
def fixture_dir(spark, rows, tmp_path_factory):  # noqa: F811
    path = tmp_path_factory.mktemp("fixture")
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}" if d % 5 else None, len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{path}/documents.parquet")
    labels = [(d, d % 2, d % 7 // 6) for d, _ in rows[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (2, None)], "page_id long, url string").write.parquet(f"file://{path}/pages.parquet")
    return f"file://{path}"


def got(spark, fixture_dir, name, key="doc_id"):
    return {r[key]: r.asDict() for r in registry.QUERIES[name](spark, fixture_dir).collect()}


def test_op1(spark, fixture_dir):
    out = registry.QUERIES["op1_url_filter"](spark, fixture_dir).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out) == [(1, "a.net", "/es/", "net/es/", "block")] * 2 + [(2, "", "", None, "block")]


def test_op2(spark, fixture_dir, rows):  # noqa: F811
    out, want = got(spark, fixture_dir, "op2_line_dedup"), brute.line_dedup(rows, 2, 10)
    for d, t in rows:
        kept = None if t is None else hashlib.sha256(want[d].encode()).hexdigest()
        assert (out[d]["n_lines"], out[d]["kept_sha256"]) == (0 if t is None else t.count("\n") + 1, kept)


def test_op3(spark, fixture_dir, rows):  # noqa: F811
    out, start = got(spark, fixture_dir, "op3_token_store"), 0
    for d, t in sorted(rows):
        ids = ids_of("word_bpe_49k.json", t, 2)
        assert (out[d]["start"], out[d]["n_tokens"], out[d]["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_op4(spark, fixture_dir, rows):  # noqa: F811
    out = got(spark, fixture_dir, "op4_toxicity")
    assert set(out) == {d for d, _ in rows} and all(0 <= r["p_toxic"] <= 1 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in out.values())


def test_op5(spark, fixture_dir, rows):  # noqa: F811
    pieces = {}
    for r in registry.QUERIES["op5_packing"](spark, fixture_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for d, t in rows:
        ids, at = ids_of("byte_bpe_50k.json", t, 1), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), brute.crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)


def test_op6(spark, fixture_dir, rows):  # noqa: F811
    out, ordered = got(spark, fixture_dir, "op6_suffix_dedup"), sorted(rows)
    for (d, _), want in zip(ordered, brute.repeats([t for _, t in ordered]), strict=True):
        assert tuple(out[d][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


def test_op7(spark, fixture_dir, rows):  # noqa: F811
    out = got(spark, fixture_dir, "op7_media_chunks")
    for d, t in rows:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = out[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({(t or "", out[d]["feature"], out[d]["media_sha256"]) for d, t in rows}) == len({t or "" for _, t in rows})


def test_op9(spark, fixture_dir, rows):  # noqa: F811
    out = got(spark, fixture_dir, "op9_simhash")
    fps = {d: brute.simhash(t, 3) for d, t in rows}
    g = brute.Groups(fps)
    for a in fps:
        for b in fps:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                g.link(a, b)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in out.items()} == {d: (f"{f:016x}", g.root(d)) for d, f in fps.items()}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_clashing_names(spark, fixture_dir, name, stage):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    assert stage(spark, docs.limit(0), fixture_dir).count() == 0
    more = {c: F.lit(1) for c in ("l_version", "l_doc", "p_toxic", "n_lines", "kept", "version", "fp", "sid", "virtual_finish")}
    clashing = docs.where("doc_id > 100").unionByName(docs.where("doc_id = 204")).withColumns(more)
    out = stage(spark, clashing, fixture_dir)
    assert out.count() > 0
    assert name == "packing" or out.columns == clashing.columns


def test_scores_replace_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "a b", 9.0)], "doc_id long, text string, p_toxic double")
    out = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, low_quality int, toxic int"))
    assert out.columns == ["doc_id", "text", "p_low_quality", "p_toxic"] and out.first()["p_toxic"] < 0.1


def test_no_fingerprints_have_no_links(spark):
    assert simhash.links(spark.createDataFrame([], "fp long"), 10).count() == 0
