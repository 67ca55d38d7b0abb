"""Directory listings of images and the text that pages and files carry about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that a library lists.
EXTENSIONS = ("jpg", "jpeg", "png", "tiff", "tif", "webp", "avif", "exr", "dng", "cr2", "cr3", "arw", "nef", "orf", "raf", "rw2", "3fr")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_images(spark: SparkSession, root: str, skip_unreadable: bool = False) -> DataFrame:
    """path, name, modified_at (ms), size of the images under root, newest first, then by path. Bodies are not read; files of
    no bytes are left out, as Spark's reader leaves them out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", skip_unreadable).load(root)
    found = found.where(extension(F.col("path")).isin(*EXTENSIONS))
    rows = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_millis("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    return rows.orderBy(F.coalesce("modified_at", F.lit(0)).desc(), "path")


def media_type(content: Column) -> Column:
    """MIME type by the first bytes, null if unknown."""
    head = F.hex(F.substring(content, 1, 16))
    brand = F.substring(head, 17, 8)
    known = {"FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "762F3101": "image/x-exr"}
    brands = {"63727820": "image/x-canon-cr3", "63723320": "image/x-canon-cr3", "61766966": "image/avif", "61766973": "image/avif", "68656963": "image/heic", "68656978": "image/heic", "6D696631": "image/heif", "6D736631": "image/heif"}
    out = F.when(head.startswith("52494646") & (brand == "57454250"), "image/webp")
    for magic, kind in known.items():
        out = out.when(head.startswith(magic), kind)
    for code, kind in brands.items():  # a box of its kind comes first
        out = out.when((F.substring(head, 9, 8) == "66747970") & (brand == code), kind)
    return out


def preview_images(html: Column) -> Column:
    """Contents of all og:image tags in page order, wherever in the tag they stand, with ampersands decoded; empty ones are left
    out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<[^<>]*og:image[^>]*>"), F.lit(0))
    found = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)content=(["'])(.*?)\1""", 2))
    return F.transform(F.filter(found, lambda u: u != ""), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def chosen_preview(html: Column, index: Column) -> Column:
    """The index-th preview image (from 1), the last one if there are fewer, null if there are none."""
    found = preview_images(html)
    return F.when(F.size(found) > 0, F.element_at(found, F.least(F.greatest(index, F.lit(1)), F.size(found))))
