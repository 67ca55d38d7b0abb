"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from photark.llm.common import materialise, read


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = out[name] = materialise(f(spark, docs, sf_dir), f"test-{name}")
    return out


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    labels = read(spark, sf_dir, "labels")
    kept = labels.join(stages["toxicity"].select("doc_id"), "doc_id", "left_semi")
    assert kept.where("toxic = 1").count() <= 0.1 * labels.where("toxic = 1").count()
    assert kept.where("toxic = 0").count() >= 0.98 * labels.where("toxic = 0").count()


def test_no_line_stays_twice(stages):
    lines = stages["line_dedup"].select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    assert lines.groupBy("line").count().where("count > 1").count() == 0
    assert stages["line_dedup"].where("n_chars <> char_length(text)").count() == 0


def test_copies_stay_once(stages):
    after = stages["simhash_near_dedup"]
    assert after.select("text").distinct().count() == after.count() <= stages["line_dedup"].count()


def test_packing_holds_the_mix(stages):
    p = stages["packing"]
    assert p.select("doc_id").distinct().count() == stages["mixing"].select("doc_id").distinct().count()
    assert p.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_rows_without_ids_or_texts_ties_and_repeats(spark, sf_dir):
    """What each stage's docstring says of them."""
    rows = [(None, "no id\nsame line here", "a"), (5, "some clean words of a text", "a"), (5, "some clean words of a text", "a"), (6, "some clean words of a text", None), (7, None, "a"), (8, "", "b"), (None, None, None), (9, "same line here\nanother line of this", "b"), (9, "same line here\na text of the same id", "b")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    got = {n: [tuple(r) for r in f(spark, docs, sf_dir).select(*(("doc_id", "text") if n != "packing" else ("doc_id", "start"))).collect()] for n, f in stage.items()}
    assert sorted(got["toxicity"], key=str) == sorted([r[:2] for r in rows], key=str)
    lines = sorted(got["line_dedup"], key=str)
    assert lines == sorted([rows[0][:2], *[(5, "some clean words of a text")] * 2, (7, None), (8, ""), (None, None), (9, "another line of this"), (9, "a text of the same id")], key=str)
    near = got["simhash_near_dedup"]
    assert near.count((5, "some clean words of a text")) == 1 and not [d for d, _ in near if d == 6]
    assert [(d, t) for d, t in near if not t] == [(None, None)] and len(near) == 5
    assert {t for _, t in got["mixing"]} <= {t for _, t, _ in rows if t} and all(t for _, t in got["mixing"])
    assert sorted(str(d) for d, start in got["packing"] if start == 0) == sorted(str(d) for d, _, _ in rows)
