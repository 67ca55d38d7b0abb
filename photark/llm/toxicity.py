"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted in turn; each model sees which of a vocabulary of words and word beginnings
a text holds, and the probabilities of the earlier categories. The vocabulary is that of the training
sample's terms which tell most about some category. In training these probabilities are out of fold:
each comes from a model that has not seen the text (copies of a text share a fold).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photark.llm.common import materialise, read

WORDS = re.compile(r"[^\W\d_]+|[^\w\s]{2,}")
CATEGORIES = ("low_quality", "toxic")


def word_terms(word: str) -> tuple[str, ...]:
    """Terms of a lower-case word: itself, its first four and its first five letters."""
    return word, "4" + word[:4], "5" + word[:5]


def terms(text: str | None) -> list[str]:
    """Terms of the whole text; null counts as empty."""
    return sorted({t for w in set(WORDS.findall((text or "").lower())) for t in word_terms(w)})


def vocabulary(rows: DataFrame, categories: tuple[str, ...], most: int, least_rows: int = 5) -> dict[str, int]:
    """For each category the ``most`` terms with the greatest chi-square, of those in ``least_rows`` rows; numbered."""
    totals = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    counts = rows.select(F.explode("terms").alias("term"), *categories).groupBy("term").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in categories])
    counts = materialise(counts.where(F.col("df") >= least_rows), "terms")
    chosen: set[str] = set()
    for c in categories:
        n, k = float(totals["n"]), float(totals[c] or 0)
        if 0 < k < n:
            off = F.col(c) - F.col("df") * (k / n)
            chi = off * off / (F.col("df") * F.greatest(n - F.col("df"), F.lit(1.0)))
            chosen.update(r[0] for r in counts.orderBy(chi.desc(), "term").limit(most).select("term").collect())
    return {t: i for i, t in enumerate(sorted(chosen))}


def training_rows(docs: DataFrame, labels: DataFrame, most: int, folds: int) -> DataFrame:
    """(fold, terms, one 0/1 column a category) of at most about ``most`` labelled documents, by hash of doc_id.
    The chosen labels are bounded by ``most``, so they are broadcast to the one scan of the documents."""
    known = labels.where("doc_id is not null and " + " and ".join(f"{c} is not null" for c in labels.columns if c != "doc_id"))
    kept = int((1 << 30) * min(1.0, most / max(known.count(), 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < kept).dropDuplicates(["doc_id"])
    rows = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(chosen), F.col("d") == F.col("doc_id"))
    kept_columns = [c for c in labels.columns if c != "doc_id"]
    fold = F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int")
    picked = rows.select(fold.alias("fold"), "text", *[F.col(c).cast("double").alias(c) for c in kept_columns])
    shape = "fold int, terms array<string>, " + ", ".join(f"`{c}` double" for c in kept_columns)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([terms(t.as_py()) for t in batch.column("text")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), found, *[batch.column(c) for c in kept_columns]], names=["fold", "terms", *kept_columns])

    return materialise(picked.mapInArrow(made, shape), "toxicity-sample")


Chain = tuple[dict[str, int], list[tuple[np.ndarray, float]]]
Fitted = LogisticRegressionModel | float


def fit_chain(rows: DataFrame, categories: tuple[str, ...], folds: int, regularization: float = 2e-4, most_terms: int = 4096) -> Chain:
    """The vocabulary, and (weights, intercept) of each category's model, in order. A category whose
    labels all agree gets zero weights and that answer. After the vocabulary's weights come those
    of the earlier categories."""
    known = vocabulary(rows, categories, most_terms)
    held = CountVectorizerModel.from_vocabulary(list(known) or ["no term"], inputCol="terms", outputCol="held", binary=True)
    rows = materialise(held.transform(rows.select("fold", "terms", *categories)).drop("terms"), "toxicity-rows")
    models: list[tuple[np.ndarray, float]] = []
    before: list[str] = []
    for n, c in enumerate(categories):
        made = VectorAssembler(inputCols=["held", *before], outputCol="features").transform(rows)
        w, b = weights(fit(made, c, regularization), max(len(known), 1) + n)
        models.append((np.concatenate([w[: len(known)], w[max(len(known), 1) :]]), b))
        if c != categories[-1]:
            by_fold = [fit(made.where(F.col("fold") != f), c, regularization) for f in range(folds)]
            before.append(f"chained_{n}")
            rows = materialise(out_of_fold(made, by_fold, before[-1]).drop("features"), "toxicity-chain")
    return known, models


def out_of_fold(rows: DataFrame, models: list[Fitted], out: str) -> DataFrame:
    """rows (fold, features, more columns) with ``out``: the probability by the model that was not trained on the row's fold."""
    columns, probability = rows.columns, F.lit(None).cast("double")
    for f, model in enumerate(models):
        if isinstance(model, float):
            mine = F.lit(sigmoid(model))
        else:
            rows = model.copy().setProbabilityCol(f"p_{f}").setRawPredictionCol("").setPredictionCol("").transform(rows)
            mine = vector_to_array(f"p_{f}")[1]
        probability = F.when(F.col("fold") == f, mine).otherwise(probability)
    return rows.select(*columns, probability.alias(out))


def fit(rows: DataFrame, label: str, regularization: float) -> Fitted:
    """A model of the column features, or a number of large size where all labels agree."""
    seen = [r[0] for r in rows.select(label).distinct().collect()]
    if len(seen) < 2:
        return 20.0 if seen and seen[0] == 1 else -20.0
    return LogisticRegression(labelCol=label, maxIter=40, regParam=regularization, elasticNetParam=1.0, maxBlockSizeInMB=4.0).fit(rows)


def weights(model: Fitted, size: int) -> tuple[np.ndarray, float]:
    return (np.zeros(size), model) if isinstance(model, float) else (model.coefficients.toArray(), float(model.intercept))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def score(docs: DataFrame, fitted: Chain, categories: tuple[str, ...]) -> DataFrame:
    """docs (any columns with text) and p_<category> for each category, in place of columns of that name. Null and empty
    texts have no words."""
    known, models = fitted
    names = [f"p_{c}" for c in categories]
    docs = docs.drop(*names)
    shape = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    by_term = np.stack([w[: len(known)] for w, _ in models], 1)
    used = {t: i for t, i in known.items() if by_term[i].any()}
    earlier = [(w[len(known) :].tolist(), b) for w, b in models]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}

        def places(word: str) -> tuple[int, ...]:
            found = cache.get(word)
            if found is None:
                if len(cache) >= 100_000:
                    cache.clear()
                found = cache[word] = tuple(used[t] for t in word_terms(word) if t in used)
            return found

        for batch in batches:
            out: list[list[float]] = [[] for _ in names]
            for text in batch.column("text"):
                present = sorted(set(chain.from_iterable(map(places, set(WORDS.findall((text.as_py() or "").lower()))))))
                sums = by_term[present].sum(0)
                before: list[float] = []
                for total, (more, b) in zip(sums.tolist(), earlier, strict=True):
                    before.append(sigmoid(b + total + sum(w * p for w, p in zip(more, before, strict=False))))
                for o, p in zip(out, before, strict=True):
                    o.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, pa.float64()) for o in out]], names=shape.names)

    return docs.mapInArrow(scored, shape)


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = 12_000, folds: int = 3) -> DataFrame:
    """docs with p_<category> of each category, from a chain trained on labels (doc_id, categories).

    At most about ``most`` labelled documents train it. Labels with a null count as none; no labels
    at all give every category the probability of about zero. Rows keep all columns and repeats; what a category's threshold
    makes of a probability that equals it is the caller's (the queries here take 0.5 and more as toxic).
    """
    rows = training_rows(docs, labels.select("doc_id", *categories), most, folds)
    return score(docs, fit_chain(rows, categories, folds), categories)


def table_labels(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, table_labels(spark, sf_dir))
    return found.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], (F.col("p_toxic") >= 0.5).alias("toxic"))
