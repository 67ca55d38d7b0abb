"""Registered queries over files: identity by BLAKE3, and containers, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from photark.operators import identity as idy
from photark.sources import containers
from photark.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with SQL that gives the same rows if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def content_digest(spark, sf_dir):
    """Content fingerprints of all texts: of whole ones up to 64 KiB, of four samples of longer ones."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", idy.content_message(F.col("text").cast("binary")).alias("message"))
    return idy.digests(d, "message", "fingerprint")


@query()
def whole_digest(spark, sf_dir):
    """BLAKE3 of whole texts that come in pieces of 4096 bytes."""
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return idy.piece_digests(idy.in_pieces(d, "doc_id", "content", 4096), "doc_id", 4096)


@query()
def etag_digest(spark, sf_dir):
    """Identity of objects by size and content tag, where the tag tells the content."""
    d = t.table(spark, sf_dir, "documents")
    fits = (F.coalesce(F.col("source"), F.lit("")) != "src1") & (F.col("lang") != "")
    message = F.when(fits, idy.tag_message(F.col("n_chars"), F.concat(F.lit('"'), "lang", F.lit('"')), b"object-etag-v1"))
    return idy.digests(d.select("doc_id", message.alias("message")), "message", "identity")


@query()
def source_identity(spark, sf_dir):
    """Ids of object sources: customers as endpoints, with segment, nation and no prefix."""
    c = t.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.lit(None).cast("string").alias("prefix"))
    return idy.source_identity(c, ["c_name", "c_mktsegment", "c_nationkey", "prefix"], "source_id").select("c_custkey", "source_id")


@query()
def pixel_keys(spark, sf_dir):
    """Texture keys: vectors as rows of eight pixels."""
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(8).alias("width"), F.expr("size(embedding) div 8").alias("height"))
    return idy.pixel_keys(e, "embedding", "width", "height", "key").select("vec_id", "key")


@query("SELECT p_partkey, lower(hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)::UBIGINT)) AS font_id FROM part")
def font_ids(spark, sf_dir):
    """Ids of fonts by their bytes: names of parts as fonts."""
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("bytes"))
    found = idy.content_ids(p, "bytes", "font_id")
    return found.select("p_partkey", F.ltrim(F.col("font_id"), F.lit("0")).alias("font_id"))


def _bytes(n, size, big=True):
    """A whole number, a literal or a column, as bytes."""
    if isinstance(n, int):
        return F.lit(n.to_bytes(size, "big" if big else "little"))
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(digits if big else F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def _entry(tag, kind, value, big):
    """A directory entry of one value, in the first bytes of its field."""
    wide = F.concat(_bytes(value, 2, big), F.unhex(F.lit("0000"))) if kind == 3 else _bytes(value, 4, big)
    return F.concat(_bytes(tag, 2, big), _bytes(kind, 2, big), _bytes(1, 4, big), wide)


def _directories(orientation, width, height, big):
    """Directories' bytes with one directory: width, height, eight bits of grey as they are, orientation."""
    head = F.unhex(F.lit("4D4D002A00000008" if big else "49492A0008000000"))
    entries = [_entry(256, 4, width, big), _entry(257, 4, height, big), _entry(258, 3, 8, big), _entry(259, 3, 1, big), _entry(262, 3, 1, big), _entry(274, 3, orientation, big)]
    return F.concat(head, _bytes(len(entries), 2, big), *entries, _bytes(0, 4, big))


def _segment(marker, content):
    return F.concat(F.unhex(F.lit("FF" + marker)), _bytes(F.octet_length(content) + 2, 2), content)


def _chunk(kind, content):
    return F.concat(_bytes(F.octet_length(content), 4), F.lit(kind.encode()), content, F.unhex(F.lit("00000000")))


SPACE = "CASE lang WHEN 'de' THEN 'adobe_rgb' WHEN 'fr' THEN 'display_p3' WHEN 'es' THEN 'prophoto_rgb' ELSE 'srgb' END"


@query(f"""SELECT doc_id, CASE WHEN octet_length(encode(text)) % 9 > 0 AND doc_id % 4 <> 3 THEN octet_length(encode(text)) % 9 END::INTEGER AS orientation,
CASE doc_id % 4 WHEN 0 THEN {SPACE} WHEN 1 THEN CASE WHEN lang = 'en' THEN 'custom' ELSE {SPACE} END ELSE 'unknown' END AS color_space,
CASE doc_id % 4 WHEN 1 THEN '16-bit' WHEN 3 THEN 'Unknown' ELSE '8-bit' END AS bit_depth,
CASE WHEN doc_id % 4 = 2 THEN n_chars + 1 END AS width, CASE WHEN doc_id % 4 = 2 THEN doc_id // 4 END AS height FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def containers_described(spark, sf_dir):
    """Texts become files, by doc_id in turn a JPEG, a PNG and a TIFF file with directories in both byte orders, profiles and the text as
    their data, and a file cut off in its head; they are read back from their bytes."""
    d = t.table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    text = F.col("text").cast("binary")
    value = (F.octet_length("text") % 9).cast("long")
    kind, big = F.col("doc_id") % 4, F.octet_length("text") % 2 == 0
    width, height = F.col("n_chars") + 1, F.expr("doc_id div 4")
    tags = F.when(big, _directories(value, width, height, True)).otherwise(_directories(value, width, height, False))
    tags = F.when(value > 0, tags).otherwise(F.unhex(F.lit("49492A00")))  # none: cut off after its first bytes
    name = F.create_map(*[F.lit(x) for x in ("de", "Adobe RGB (1998)", "fr", "Display P3", "es", "ProPhoto RGB", "en", "Own")])[F.col("lang")]
    wide = F.unhex(F.regexp_replace(F.hex(name.cast("binary")), "(..)", "00$1"))  # as double bytes
    profile = F.concat(F.unhex(F.lit("00" * 16)), F.lit(b"RGB "), F.unhex(F.lit("00" * 108)), wide)
    jpeg = F.concat(F.unhex(F.lit("FFD8")), _segment("E0", F.lit(b"JFIF\0")), _segment("E2", F.concat(F.lit(b"ICC_PROFILE\0\1\1"), profile)), _segment("E1", F.concat(F.lit(b"Exif\0\0"), tags)), F.unhex(F.lit("FFDA0002")), text)
    ihdr = F.concat(_bytes(width, 4), _bytes(height, 4), F.unhex(F.lit("1002000000")))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), _chunk("IHDR", ihdr), _chunk("iCCP", F.concat(name.cast("binary"), F.unhex(F.lit("0000")), profile)), _chunk("eXIf", tags), _chunk("IDAT", text))
    plain = F.when(value > 0, tags).otherwise(_directories(0, width, height, True))
    cut = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    ending = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "png", "tif", "tif")]), (kind + 1).cast("int"))
    content = F.when(kind == 0, jpeg).when(kind == 1, png).when(kind == 2, F.concat(plain, text)).otherwise(cut)
    files = d.select("doc_id", F.concat(F.lit("a."), ending).alias("path"), content.alias("content"))
    out = containers.described(files)
    image = F.try_element_at("images", F.col("best_image") + 1)
    return out.select("doc_id", F.nullif("orientation", F.lit(0)).alias("orientation"), "color_space", "bit_depth", image["width"].alias("width"), image["height"].alias("height"))
