"""Vocabularies of a tagger: labels with the words they are asked for by, and categories to search in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photark.functions import text as tx

#: Ten categories to search in, and labels of each; a deployment brings its own lists in the same shape.
CATEGORIES = {
    "people": ("child", "crowd", "musician", "selfie", "wedding party", "worker"),
    "animals": ("bird", "cat", "dog", "fish", "horse", "insect"),
    "plants": ("cactus", "fern", "flower", "garden", "mushroom", "tree"),
    "landscape": ("beach", "cliff", "desert", "forest", "lake", "mountain"),
    "sky": ("aurora", "cloud", "lightning", "rainbow", "star trail", "sunrise"),
    "city": ("bridge", "facade", "harbour", "market", "night street", "skyline"),
    "indoors": ("bedroom", "kitchen", "library", "museum hall", "stage", "workshop"),
    "food": ("bread", "breakfast", "cake", "coffee", "fruit bowl", "salad"),
    "transport": ("aeroplane", "bicycle", "bus", "motorcycle", "sailing boat", "train"),
    "style": ("black and white", "close-up", "film grain", "long exposure", "reflection", "silhouette"),
}


def categories(spark: SparkSession, given: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(category, place, label) of a dictionary like CATEGORIES."""
    rows = [(c, n, label) for c, labels in (given or CATEGORIES).items() for n, label in enumerate(labels)]
    return spark.createDataFrame(rows, "category string, place int, label string")


def auto_tags(categories: DataFrame) -> DataFrame:
    """(label, variant): each label once, in normal form, with the ways to ask for it: itself with and without articles, and as a
    picture of it. Labels of several categories are one."""
    labels = categories.select(tx.normal_label(F.col("label")).alias("label")).where("label <> ''").distinct()
    asked = F.array_distinct(F.concat(tx.variants(F.col("label")), F.array(F.concat(F.lit("photo of "), F.col("label")))))
    return labels.select("label", F.explode(asked).alias("variant"))


def in_category(tags: DataFrame, categories: DataFrame, item: str, label: str) -> DataFrame:
    """(item, category, n): how many of an item's tags belong to each category that any does."""
    known = categories.select(tx.normal_label(F.col("label")).alias("known_"), "category").distinct()
    joined = tags.select(item, tx.normal_label(F.col(label)).alias("label_")).distinct().join(F.broadcast(known), F.col("label_") == F.col("known_"))
    return joined.groupBy(item, "category").agg(F.count("*").alias("n"))
