"""Identity by BLAKE3, ranged reads and container parsers: published vectors, a plain version, handmade bytes, truncations."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photark.functions import blake3, containers
from photark.operators import identity
from photark.plans import files as plans
from photark.sources import containers as container_source
from photark.sources import ranges

#: Published digests of the bytes 0, 1, ..., 250, 0, 1, ... of these lengths.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}
M = 0xFFFFFFFF


def counted(n):
    return bytes(i % 251 for i in range(n))


def plain(data):
    """BLAKE3 one word at a time, by recursion."""
    start = [int(x) for x in blake3.START]

    def compress(h, block, counter, size, flags):
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*h, *start[:4], counter & M, counter >> 32, size, flags]

        def g(a, b, c, d, x, y):
            for add, r1, r2 in ((x, 16, 12), (y, 8, 7)):
                v[a] = (v[a] + v[b] + add) & M
                v[d] ^= v[a]
                v[d] = (v[d] >> r1 | v[d] << (32 - r1)) & M
                v[c] = (v[c] + v[d]) & M
                v[b] ^= v[c]
                v[b] = (v[b] >> r2 | v[b] << (32 - r2)) & M

        for _ in range(7):
            for i in range(4):
                g(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
            for i in range(4):
                g(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
            m = [m[i] for i in blake3.NEXT]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, first, root):
        if len(part) <= 1024:
            h, blocks = start, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, b in enumerate(blocks):
                h = compress(h, b, first, len(b), (i == 0) + (2 + root if i == len(blocks) - 1 else 0))
            return h
        half = 1024
        while 2 * half < len(part):
            half *= 2
        both = node(part[:half], first, 0) + node(part[half:], first + half // 1024, 0)
        return compress(start, struct.pack("<16I", *both), 0, 64, 4 + root)

    return struct.pack("<8I", *node(data, 0, 8)).hex()


def test_published_vectors():
    assert [d.hex() for d in blake3.tops([counted(n) for n in VECTORS])] == list(VECTORS.values())
    assert plain(counted(1025)) == VECTORS[1025]


def test_lengths_against_the_plain_version():
    data = [bytes((i * i + n) % 256 for i in range(n)) for n in (2, 63, 64, 65, 128, 1000, 2047, 3072, 3073, 4096, 5000, 7169, 8193, 65537)]
    assert [d.hex() for d in blake3.tops(data)] == [plain(d) for d in data]


def test_digests_of_columns(spark):
    rows = [(i, counted(n)) for i, n in enumerate(VECTORS)] + [(90, None), (91, counted(1025))]
    df = spark.createDataFrame(rows, "id int, message binary").withColumn("digest", F.lit("old")).repartition(3)
    got = {r["id"]: r["digest"] for r in identity.digests(df, "message", "digest").collect()}
    assert got == dict(enumerate(VECTORS.values())) | {90: None, 91: VECTORS[1025]}
    assert identity.digests(df.limit(0), "message", "d").count() == 0


@pytest.mark.parametrize("piece", [1024, 4096])
def test_digests_of_pieces(spark, piece):
    lengths = [0, 1, 1024, 1025, 4096, 4097, 5 * 4096, 102400]
    df = spark.createDataFrame([(None if n == 1 else n, counted(n)) for n in lengths] + [(-1, None)], "id int, content binary")
    pieces = identity.in_pieces(df, "id", "content", piece).repartition(5)
    got = {r["id"]: r["digest"] for r in identity.piece_digests(pieces, "id", piece).collect()}
    assert got == {None if n == 1 else n: d.hex() for n, d in zip(lengths, blake3.tops([counted(n) for n in lengths]), strict=True)}
    assert identity.piece_digests(pieces.limit(0), "id", piece).count() == 0
    for wrong in (pieces.where("at <> 1 or id <> 102400"), pieces.unionByName(pieces.where("at = 1 and id = 102400")), pieces.withColumn("data", F.when(F.col("at") == 1, F.lit(b"x")).otherwise(F.col("data")))):
        with pytest.raises(Exception, match="pieces missing, repeated or of a wrong length"):
            identity.piece_digests(wrong, "id", piece).collect()
    with pytest.raises(ValueError, match="power of two"):
        identity.piece_digests(pieces, "id", 3000)


def framed(data):
    n = len(data)
    plan = [] if n == 0 else [(0, n)] if n <= 65536 else [(o, 16384) for o in (0, n // 3, 2 * n // 3, n - 16384)]
    return struct.pack("<QII", n, 16384, len(plan)) + b"".join(struct.pack("<Q", o) + data[o : o + k] for o, k in plan)


def test_content_fingerprints(spark):
    lengths = [0, 1, 1024, 65536, 65537, 400_000]
    df = spark.createDataFrame([(n, counted(n)) for n in lengths] + [(-1, None)], "id int, content binary").select("id", identity.content_message(F.col("content")).alias("m"))
    got = {r["id"]: r["f"] for r in identity.digests(df, "m", "f").collect()}
    assert got == {n: d.hex() for n, d in zip(lengths, blake3.tops([framed(counted(n)) for n in lengths]), strict=True)} | {-1: None}


def test_tags_and_sources(spark):
    df = spark.createDataFrame([(1, 300, ' "ab"c"" '), (2, 2**40, "ab")], "id int, size long, tag string")
    got = [r["f"] for r in identity.digests(df.select("id", identity.tag_message(F.col("size"), F.col("tag"), b"dom").alias("m")), "m", "f").orderBy("id").collect()]
    assert got == [plain(b"dom\0" + struct.pack("<Q", n) + t) for n, t in ((300, b'ab"c'), (2**40, b"ab"))]
    df = spark.createDataFrame([("e", "b", None, "p")], "a string, b string, c string, d string")
    assert identity.source_identity(df, ["a", "b", "c", "d"], "id").first()["id"] == plain(b"e\nb\n\np")[:16]


def test_pixel_keys(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 2, 1), (2, [0.5, 1.0], 1, 2), (3, [0.5, 1.0], 2, 1), (4, None, 0, 0)], "id int, p array<float>, w int, h int")
    got = {r["id"]: r["key"] for r in identity.pixel_keys(df, "p", "w", "h", "key").collect()}
    assert got[1] == got[3] == plain(struct.pack("<IIff", 2, 1, 0.5, 1.0)) != got[2] and got[4] is None


def test_ranged_reads_take_samples_only(spark, tmp_path):
    class Counting(ranges.LocalFile):
        """Writes down how much is read."""
    
        def __init__(self, path):
            super().__init__(path)
            self.log = path + ".read"
    
        def read_range(self, offset, length):
            data = super().read_range(offset, length)
            with open(self.log, "a") as log:
                log.write(f"{len(data)}\n")
            return data

    for name, n in (("a", 1_000_000), ("b", 70), ("c", 0)):
        (tmp_path / name).write_bytes(counted(n))
    files = spark.createDataFrame([(str(tmp_path / p), n) for p, n in (("a", 1_000_000), ("b", 70), ("c", 0))] + [(None, 5)], "path string, size long")
    read = ranges.samples(files, Counting)
    got = identity.digests(read.select("path", identity.sampled_message(F.col("size"), F.col("samples")).alias("m")), "m", "f")
    found = {(r["path"] or "-")[-1]: r["f"] for r in got.collect()}
    assert found == {"a": plain(framed(counted(1_000_000))), "b": plain(framed(counted(70))), "c": plain(framed(b"")), "-": None}
    assert sum(map(int, (tmp_path / "a.read").read_text().split())) == 4 * 16384
    with pytest.raises(Exception, match="asked for 16384 bytes at 983616, got 0"):
        ranges.read_ranges(spark.createDataFrame([(str(tmp_path / "b"), [(983616, 16384)])], "path string, ranges array<struct<offset:bigint,length:bigint>>")).collect()


def entry(order, tag, kind, values):
    form = {1: "B", 2: "s", 3: "H", 4: "I"}[kind]
    data = values if kind == 2 else struct.pack(f"{order}{len(values)}{form}", *values)
    return tag, kind, len(values), data


def tiff(order, *chain, more=()):
    """Directories of (tag, type, values), and those that the first one names."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))
    links = []

    def put(entries, extra=None):
        start = len(out)
        entries = [entry(order, *e) for e in entries] + ([entry(order, 330, 4, [0] * len(extra))] if extra else [])
        spare = start + 2 + 12 * len(entries) + 4
        body, tail = struct.pack(order + "H", len(entries)), b""
        for tag, kind, n, data in entries:
            if len(data) > 4:
                field, tail = struct.pack(order + "I", spare + len(tail)), tail + data
            else:
                field = data.ljust(4, b"\0")
            if tag == 330:
                links.append(start + len(body) + 8)
            body += struct.pack(order + "HHI", tag, kind, n) + field
        out.extend(body + b"\0\0\0\0" + tail)
        return start, start + len(body)

    last = 4
    for i, entries in enumerate(chain):
        at, end = put(entries, more if i == 0 else None)
        out[last : last + 4] = struct.pack(order + "I", at)
        last = end
    if more:
        starts = [put(m)[0] for m in more]
        where = links[0] if len(more) == 1 else struct.unpack_from(order + "I", out, links[0])[0]
        out[where : where + 4 * len(more)] = struct.pack(f"{order}{len(more)}I", *starts)
    return bytes(out)


BIG = [(256, 4, [4000]), (257, 3, [3000]), (258, 3, [8, 8, 8]), (259, 3, [7]), (262, 3, [6]), (306, 2, b"2020:01:01 00:00:00\0"), (9999, 4, [1])]
SMALL = [(254, 4, [1]), (256, 3, [160]), (257, 3, [120]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (274, 3, [3])]


@pytest.mark.parametrize("order", "<>")
def test_directories(order):
    data = tiff(order, SMALL, BIG, more=[[(256, 3, [10]), (259, 3, [7])], [(256, 3, [11])]])
    found = containers.images(data)
    assert [(i["width"], i["height"], i["kind"], i["orientation"]) for i in found] == [(160, 120, "rgb", 3), (4000, 3000, "jpeg", 3), (10, None, None, 3), (11, None, None, 3)]
    assert containers.best_image(data) == 1 and containers.orientation(data) == 3 and containers.bit_depth(data) == "8-bit"
    assert containers.directories(data)[1]["date"] == ["2020:01:01 00:00:00"] and found[1]["bits"] == [8, 8, 8]
    for n in range(len(data)):  # cut off anywhere: no error, nothing invented
        cut = data[:n]
        assert containers.orientation(cut) in (None, 3) and len(containers.images(cut)) <= 4 and containers.bit_depth(cut) in ("8-bit", "Unknown")


def test_directories_that_go_round():
    data = bytearray(tiff("<", SMALL, BIG))
    end = 8 + 2 + 12 * len(SMALL)
    data[end : end + 4] = struct.pack("<I", 8)  # the first one follows itself
    assert len(containers.images(bytes(data))) == 1
    far = tiff("<", *[SMALL] * 15)
    assert len(containers.images(far)) == containers.MOST_DIRECTORIES
    assert containers.images(b"II+\0" + far[4:]) == [] == containers.images(b"")  # long directories, and none


def segment(marker, content):
    return bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content


def chunk(kind, content):
    return struct.pack(">I", len(content)) + kind + content + b"crc!"


def jpeg(*parts):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0") + b"".join(parts) + b"\xff\xda\0\2 image \xff\xe1\0\x0cExif\0\0II"


def png(*parts):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 16, 2, 0, 0, 0)) + b"".join(parts) + chunk(b"IDAT", b"x") + chunk(b"sRGB", b"\0")


def box(kind, content):
    return struct.pack(">I", len(content) + 8) + kind + content


ROTATED = tiff(">", [(274, 3, [6])])


def test_orientation_in_every_container():
    cr3 = box(b"ftyp", b"crx \0\0\0\1") + box(b"moov", box(b"uuid", b"u" * 16 + box(b"CNCV", b"v") + box(b"CMT1", ROTATED)))
    webp = b"RIFF\0\0\0\0WEBP" + b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(ROTATED)) + ROTATED
    for data in (ROTATED, jpeg(segment(0xE1, b"http://xmp"), segment(0xE1, b"Exif\0\0" + ROTATED)), png(chunk(b"eXIf", ROTATED)), webp, cr3):
        assert containers.orientation(data) == 6
        assert all(containers.orientation(data[:n]) in (None, 6) for n in range(len(data)))
    assert containers.orientation(jpeg()) is None and containers.orientation(tiff("<", [(256, 3, [6])])) is None and containers.orientation(b"") is None
    assert containers.orientation(tiff("<", [(274, 2, b"6\0")])) is None  # not a number


def test_color_spaces():
    icc = lambda name, wide: b"\0" * 16 + b"RGB " + (name.encode("utf-16-be") if wide else name.encode())
    for name, want in (("Adobe RGB (1998)", "adobe_rgb"), ("AdobeRGB", "adobe_rgb"), ("Display P3", "display_p3"), ("P3 D65", "display_p3"), ("ROMM RGB", "prophoto_rgb"), ("ProPhoto", "prophoto_rgb"), ("sRGB IEC", "srgb"), ("else", "srgb")):
        for wide in (False, True):
            assert containers.color_space(jpeg(segment(0xE2, b"ICC_PROFILE\0\1\1" + icc(name, wide))), "jpg") == want
    assert containers.color_space(jpeg(segment(0xE2, b"MPF\0")), "jpeg") == "srgb"
    assert containers.color_space(jpeg(segment(0xE2, b"ICC_PROFILE\0\1\1short")), "jpg") == "unknown"
    for name, want in ((b"Adobe RGB", "adobe_rgb"), (b"DISPLAY P3", "display_p3"), (b"romm", "prophoto_rgb"), (b"sRGB", "srgb"), (b"own", "custom")):
        assert containers.color_space(png(chunk(b"tEXt", b"P3"), chunk(b"iCCP", name + b"\0\0zip")), "png") == want
    assert containers.color_space(png(chunk(b"iCCP", b"Adobe, no zero")), "png") == "custom"
    assert containers.color_space(png(chunk(b"gAMA", b"\0\0\0\1")), "png") == "srgb"
    assert containers.color_space(png(), "png") == containers.color_space(ROTATED, "tif") == containers.color_space(b"", "png") == "unknown"


def test_bit_depths():
    def exr(*types):
        channels = b"".join(b"C%d\0" % i + struct.pack("<IB3xII", t, 0, 1, 1) for i, t in enumerate(types)) + b"\0"
        attribute = lambda name, kind, value: name + b"\0" + kind + b"\0" + struct.pack("<I", len(value)) + value
        return b"\x76\x2f\x31\x01\2\0\0\0" + attribute(b"owner", b"string", b"me") + attribute(b"channels", b"chlist", channels) + b"\0"

    assert [containers.bit_depth(exr(t)) for t in (0, 1, 2, 7)] == ["32-bit integer", "16-bit float", "32-bit float", "Unknown"]
    assert containers.bit_depth(exr(1, 2)) == "16-bit float" and containers.bit_depth(exr(1)[:30]) == "Unknown"
    assert containers.bit_depth(png()) == "16-bit" and containers.bit_depth(png()[:20]) == "Unknown" and containers.bit_depth(jpeg()) == "8-bit"
    assert containers.bit_depth(tiff("<", [(258, 3, [32]), (339, 3, [3])])) == "32-bit float"
    assert [containers.bit_depth(tiff(">", [(258, 3, [b, b, b])])) for b in (8, 16, 12)] == ["8-bit", "16-bit", "Unknown"]


def test_described_rows(spark):
    rows = [("x/a.JPG", jpeg(segment(0xE1, b"Exif\0\0" + ROTATED)), 1), ("b.tif", tiff("<", SMALL, BIG), 2), ("c.png", None, 3), (None, b"\0", 4), ("e.jpg", b"\xff\xd8\xff\xe1\xff\xff", 5)]
    df = spark.createDataFrame(rows, "path string, content binary, orientation int")
    got = container_source.described(df).collect()
    assert [(r["orientation"], r["color_space"], r["bit_depth"], len(r["images"] or ()), r["best_image"]) for r in got] == [(6, "srgb", "8-bit", 0, None), (3, "unknown", "8-bit", 2, 1), (None, None, None, 0, None), (None, "unknown", "Unknown", 0, None), (None, "srgb", "8-bit", 0, None)]
    assert container_source.described(df.limit(0)).count() == 0


def test_queries_without_sql(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, text, n_chars, source, lang FROM documents").fetchall()
    for name, message in (("content_digest", lambda d: framed(d[1].encode())), ("whole_digest", lambda d: d[1].encode())):
        got = {r["doc_id"]: tuple(r.asDict().values())[1] for r in plans.QUERIES[name](spark, sf_dir).collect()}
        want = [d for d in docs if d[1] is not None]
        assert got == dict(zip((d[0] for d in want), (x.hex() for x in blake3.tops([message(d) for d in want])), strict=True)) | ({d[0]: None for d in docs if d[1] is None} if name == "content_digest" else {})
    got = {r["doc_id"]: r["identity"] for r in plans.etag_digest(spark, sf_dir).collect()}
    assert got == {d[0]: plain(b"object-etag-v1\0" + struct.pack("<Q", d[2]) + d[4].encode()) if d[3] != "src1" and d[4] else None for d in docs}
    got = {r["c_custkey"]: r["source_id"] for r in plans.source_identity(spark, sf_dir).collect()}
    assert got == {r[0]: plain("\n".join([r[1], r[2], str(r[3]), ""]).encode())[:16] for r in duck.execute("SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer").fetchall()}
    got = {r["vec_id"]: r["key"] for r in plans.pixel_keys(spark, sf_dir).collect()}
    assert got == {i: plain(struct.pack("<II", 8, len(e) // 8) + struct.pack(f"<{len(e)}f", *e)) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}


def test_fnv(spark):
    def plain_fnv(data):
        h = identity.FNV_START
        for b in data:
            h = (h ^ b) * identity.FNV_FACTOR % 2**64
        return f"{h:016x}"

    assert [plain_fnv(x) for x in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]  # published
    rows = [(i, counted(n)) for i, n in enumerate((0, 1, 5, 5, 300, 4097))] + [(9, None)]
    got = {r["i"]: r["x"] for r in identity.content_ids(spark.createDataFrame(rows, "i int, c binary"), "c", "x").collect()}
    assert got == {i: None if c is None else plain_fnv(c) for i, c in rows}


def test_batches_are_hashed_in_slices():
    rng = random.Random(1)
    sizes = [0, 9 << 20, *[rng.randrange(300_000) for _ in range(100)]]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *[b"x" * n for n in sizes]], pa.binary()), pa.array(range(len(sizes) + 1))], names=["message", "i"])
    got = list(identity.sliced(iter([batch, batch.slice(0, 0)]), "message"))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert len(got) > 4 and all(b.num_rows == 1 or sum(len(m or b"") for m in b.column("message").to_pylist()) <= identity.SLICE for b in got)
