"""Zero-shot tags: scores of pictures against prompts, the best variant of each label, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photark.functions.numeric import dot, rounded, sigmoid


def label_scores(images: DataFrame, prompts: DataFrame, scale: float, bias: float, block: int = 4096) -> DataFrame:
    """(image, label, score): the best score of a label's prompts for each image.

    images has image and vector, prompts label and vector. Labels go to the images with all their
    prompts, in blocks of about so many prompts, each one broadcast; an image's scores are made where it is.
    """
    labels = prompts.groupBy("label").agg(F.collect_list("vector").alias("prompts"))
    blocks = -(-max(prompts.count(), 1) // block)
    best = lambda p: F.array_max(F.transform(p, lambda v: rounded(sigmoid(dot(F.col("vector"), v) * scale + bias))))
    out = None
    for n in range(blocks):
        part = labels.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == n)
        held = part.agg(F.collect_list(F.struct("label", "prompts")).alias("labels")).withColumn("block", F.lit(n))
        met = images.select("image", "vector", F.lit(n).alias("i_block")).join(F.broadcast(held), F.col("i_block") == F.col("block"))
        scored = met.select("image", "vector", F.explode("labels").alias("l")).select("image", F.col("l.label").alias("label"), best(F.col("l.prompts")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def accepted(scores: DataFrame, threshold: float, most: int) -> DataFrame:
    """Of each image the labels at or above the threshold, best first, then by label, at most so many."""
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("score"), "label"))
    return scores.where(F.col("score") >= threshold).withColumn("place", place).where(F.col("place") <= most)


def label_statistics(accepted_labels: DataFrame, salts: int = 64) -> DataFrame:
    """Per label: number of images, mean and greatest score, the first three images. These are found among the
    first three of each of ``salts`` parts, so a frequent label's images are not gathered."""
    salted = accepted_labels.withColumn("salt", F.pmod(F.xxhash64("image"), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy("label", "salt").orderBy("image"))
    firsts = F.slice(F.array_sort(F.collect_list(F.when(F.col("part_place") <= 3, F.col("image")))), 1, 3)
    return salted.withColumn("part_place", place).groupBy("label").agg(
        F.count("*").alias("n"), rounded(F.avg("score")).alias("mean_score"), F.max("score").alias("max_score"), F.array_join(firsts, ",").alias("examples"),
    )
