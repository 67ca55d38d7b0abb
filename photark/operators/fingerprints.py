"""Content identity from samples of a file, and what is known of files by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one sample, and size up to which a file is read whole.
SAMPLE, WHOLE = 16384, 65536


def sample_plan(size: Column) -> Column:
    """Array of (offset, length): nothing of an empty file, all of one up to WHOLE bytes, else four samples
    at the start, at a third, at two thirds and at the end."""
    n = size.cast("long")
    part = lambda offset, length: F.struct(offset.cast("long").alias("offset"), length.cast("long").alias("length"))
    thirds = F.call_function("div", n, F.lit(3).cast("long"))
    two_thirds = F.call_function("div", n * 2, F.lit(3).cast("long"))
    four = F.array(part(F.lit(0), F.lit(SAMPLE)), part(thirds, F.lit(SAMPLE)), part(two_thirds, F.lit(SAMPLE)), part(n - SAMPLE, F.lit(SAMPLE)))
    return F.when(n == 0, F.array().cast("array<struct<offset:bigint,length:bigint>>")).when(n <= WHOLE, F.array(part(F.lit(0), n))).otherwise(four)


def fingerprint(content: Column) -> Column:
    """SHA-256 over size, sample length, number of samples, and each sample with its offset, as hex; numbers are
    written as decimal text with separators. Reading past the end is an error."""
    size = F.octet_length(content)
    plan = sample_plan(size)
    pieces = F.transform(plan, lambda s: F.concat(s["offset"].cast("string").cast("binary"), F.lit(":").cast("binary"), F.substr(content, s["offset"].cast("int") + 1, s["length"].cast("int"))))
    head = F.concat_ws(":", size.cast("string"), F.lit(str(SAMPLE)), F.size(plan).cast("string"), F.lit("")).cast("binary")
    return F.sha2(F.aggregate(pieces, head, lambda a, x: F.concat(a, x)), 256)


def duplicates(files: DataFrame, fingerprint: str, path: str) -> DataFrame:
    """Fingerprints of more than one path: how many, and the least."""
    return files.groupBy(fingerprint).agg(F.count("*").alias("n_paths"), F.min(path).alias("first_path")).where("n_paths > 1")


def missing(files: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Files whose key, nulls included, is not known: what is left to compute, each key once."""
    k = known.select([F.col(c).alias("k_" + c) for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col("k_" + c))
    return files.join(k, same, "left_anti").dropDuplicates(on)
