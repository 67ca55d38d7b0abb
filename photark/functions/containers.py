"""What image files say about themselves, read from their bytes: chains of segments, chunks, directories and boxes.

Every walk is bounded: it goes forward only, or through at most MOST_DIRECTORIES directories, each once. What is cut off or
points outside the file counts as absent. No pixels are decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

MOST_DIRECTORIES = 10  # in a chain
MOST_ENTRIES = 4096  # values of one entry

#: Tags of a directory, bytes of each of its types from 1, compressions and colour models.
TAGS = {254: "subfile", 256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 274: "orientation", 306: "date", 330: "more", 339: "format"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
UNCOMPRESSED, OLD_JPEG, JPEG, GREY, YCBCR = 1, 6, 7, 1, 6

#: Names in colour profiles, in the order in which they are looked for.
PROFILES = (("adobe_rgb", ("Adobe RGB", "AdobeRGB")), ("display_p3", ("Display P3", "P3 D65")), ("prophoto_rgb", ("ProPhoto", "ROMM")))
PROFILE_NAMES = (("adobe_rgb", ("adobe",)), ("display_p3", ("p3",)), ("prophoto_rgb", ("prophoto", "romm")), ("srgb", ("srgb",)))


def directory(data: bytes, at: int, order: str) -> tuple[dict[str, list], int]:
    """The known entries of the directory at ``at``, and where the next one is (0: nowhere). Entries of other types, and those whose
    values lie outside, are left out; a directory that is cut off ends where the data does."""
    found: dict[str, list] = {}
    if at < 8 or at + 2 > len(data):
        return found, 0
    (n,) = struct.unpack_from(order + "H", data, at)
    for entry in range(at + 2, min(at + 2 + 12 * n, len(data) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if tag not in TAGS or kind not in TYPES or not 0 < count <= MOST_ENTRIES:
            continue
        form = f"{order}{count}{TYPES[kind]}"
        place = entry + 8
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + struct.calcsize(form) <= len(data):
            values = struct.unpack_from(form, data, place)
            found[TAGS[tag]] = [values[0].split(b"\0")[0].decode("latin-1")] if kind == 2 else list(values)
    end = at + 2 + 12 * n
    return found, struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0


def directories(data: bytes) -> list[dict[str, list]]:
    """The chained directories, then those the first one names as its own; none if the header fits no byte order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        return []
    (at,) = struct.unpack_from(order + "I", data, 4)
    out, seen = [], set()
    while at and at not in seen and len(out) < MOST_DIRECTORIES:
        seen.add(at)
        found, following = directory(data, at, order)
        out.append(found)
        at = following
    for at in (out[0].get("more", []) if out else [])[:MOST_DIRECTORIES]:
        if isinstance(at, int) and at not in seen:
            seen.add(at)
            out.append(directory(data, at, order)[0])
    return out


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, content) of a JPEG file's segments before its image data."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2:
            return
        if at + 2 + size <= len(data):
            yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def chunks(data: bytes, start: int, big: bool) -> Iterator[tuple[bytes, bytes]]:
    """(kind, content) of PNG chunks (big: length, kind, content, checksum) or RIFF chunks (kind, length, content, even length);
    one that is cut off ends the walk."""
    at = start
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big") if big else int.from_bytes(data[at + 4 : at + 8], "little")
        kind = data[at + 4 : at + 8] if big else data[at : at + 4]
        if at + 8 + size > len(data):
            return
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size if big else 8 + size + size % 2


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes in a range; one that is cut off ends the walk."""
    at = start
    while at + 8 <= end:
        size, head, kind = int.from_bytes(data[at : at + 4], "big"), 8, data[at + 4 : at + 8]
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def is_png(data: bytes) -> bool:
    return data[:8] == b"\x89PNG\r\n\x1a\n"


def is_webp(data: bytes) -> bool:
    return data[:4] == b"RIFF" and data[8:12] == b"WEBP"


def is_exr(data: bytes) -> bool:
    return data[:4] == b"\x76\x2f\x31\x01"


def is_cr3(data: bytes) -> bool:
    return data[4:8] == b"ftyp" and data[8:12] in (b"crx ", b"cr3 ")


def exif(data: bytes) -> bytes:
    """The directories' bytes that a JPEG, PNG, WebP, TIFF or CR3 file holds, empty if it has none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    found: Iterator[bytes] = iter(())
    if data[:2] == b"\xff\xd8":
        found = (c[6:] for m, c in segments(data) if m == 0xE1 and c[:6] == b"Exif\0\0")
    elif is_png(data):
        found = (c for k, c in chunks(data, 8, True) if k == b"eXIf")
    elif is_webp(data):
        found = (c[6:] if c[:6] == b"Exif\0\0" else c for k, c in chunks(data, 12, False) if k == b"EXIF")
    elif is_cr3(data):
        inner = ((s + 16, e) for k, s, e in boxes(data, 0, len(data)) if k == b"moov" for k, s, e in boxes(data, s, e) if k == b"uuid")
        found = (data[s:e] for a, b in inner for k, s, e in boxes(data, a, b) if k == b"CMT1")
    return next(found, b"")


def orientation(data: bytes) -> int | None:
    """The orientation in the first directory."""
    own = directories(exif(data))[:1]
    value = own[0].get("orientation", [None])[0] if own else None
    return value if isinstance(value, int) else None


def profile_space(profile: bytes) -> str:
    """The colour space of a profile by the names in it, single- or double-byte; sRGB if it has none of them."""
    if len(profile) < 20:
        return "unknown"
    text = profile.replace(b"\0", b"").decode("latin-1")
    return next((space for space, names in PROFILES if any(n in text for n in names)), "srgb")


def color_space(data: bytes, extension: str) -> str:
    """By the file's extension: of a JPEG file by its profile (none: sRGB), of a PNG file by its first chunk that tells, of others
    unknown."""
    if extension in ("jpg", "jpeg"):
        signature = b"ICC_PROFILE\0"
        profiles = (c[len(signature) + 2 :] for m, c in segments(data) if m == 0xE2 and c.startswith(signature))
        found = next(profiles, None)
        return "srgb" if found is None else profile_space(found)
    if extension == "png":
        for kind, content in chunks(data, 8, True):
            if kind in (b"sRGB", b"gAMA"):
                return "srgb"
            if kind == b"iCCP":
                name, zero, _ = content.partition(b"\0")
                lower = name.decode("utf-8", "ignore").lower()
                return next((space for space, names in PROFILE_NAMES if zero and any(n in lower for n in names)), "custom")
            if kind == b"IDAT":
                break
    return "unknown"


def exr_samples(data: bytes) -> int | None:
    """The sample type of an EXR file's channels (0 whole, 1 half, 2 float), the first one's if they differ."""
    at = 8
    while at < len(data) and data[at]:
        name, _, rest = data[at : at + 256].partition(b"\0")
        kind, _, _ = rest.partition(b"\0")
        at += len(name) + len(kind) + 2
        size = int.from_bytes(data[at : at + 4], "little")
        value = data[at + 4 : at + 4 + size]
        if kind == b"chlist":
            end = value.find(b"\0")
            return int.from_bytes(value[end + 1 : end + 5], "little") if 0 < end <= len(value) - 5 else None
        at += 4 + size
    return None


def bit_depth(data: bytes) -> str:
    """How a decoder would hold the samples."""
    if is_exr(data):
        return {0: "32-bit integer", 1: "16-bit float", 2: "32-bit float"}.get(exr_samples(data), "Unknown")
    if is_png(data):
        head = next((c for k, c in chunks(data, 8, True) if k == b"IHDR"), b"")
        return {16: "16-bit"}.get(head[8], "8-bit") if len(head) > 8 else "Unknown"
    if data[:2] == b"\xff\xd8" or is_webp(data):
        return "8-bit"
    found = directories(data)[:1]
    if found and "bits" in found[0]:
        bits, floats = found[0]["bits"][0], found[0].get("format", [1])[0] == 3
        return "32-bit float" if floats and bits == 32 else {8: "8-bit", 16: "16-bit"}.get(bits, "Unknown")
    return "Unknown"


def images(data: bytes) -> list[dict]:
    """The images that a TIFF file's directories describe. kind: rgb if stored as it is, jpeg if a picture of 8 bits that a
    browser shows, else null."""
    out = []
    found = directories(data)
    first = found[0].get("orientation", [1])[0] if found else 1
    for d in found:
        one = {n: d[n][0] if n in d else None for n in ("width", "height", "compression", "photometric", "subfile")}
        bits = d.get("bits", [])
        shown = (one["photometric"], len(bits), bits[:1]) in ((YCBCR, 3, [8]), (GREY, 1, [8]))
        kind = "rgb" if one["compression"] == UNCOMPRESSED else "jpeg" if one["compression"] in (OLD_JPEG, JPEG) and shown else None
        out.append(one | {"bits": bits, "orientation": d.get("orientation", [first])[0], "kind": kind})
    return out


def best_image(data: bytes) -> int | None:
    """The place of the largest image that can be shown, the first of equal ones."""
    found = [(-(i["width"] or 0) * (i["height"] or 0), n) for n, i in enumerate(images(data)) if i["kind"]]
    return min(found)[1] if found else None
