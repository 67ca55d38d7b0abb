"""Brute-force versions of the operators, in plain Python."""

import hashlib
import zlib
from array import array

import xxhash

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    words = (text or "").encode().translate(UP).split()
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []


def simhash(text, k):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeats(texts, span=100):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) of each text, in order."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - span + 1):
            w = data[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(docs, tau, per_edit):
    """doc_id -> text of (doc_id, text) rows without lines that come after another of their class."""
    lines = {}
    for d, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r"):
                lines.setdefault(line, (d, n))
    names = sorted(lines, key=lines.get)
    g = Groups(range(len(names)))
    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            allowed = min(tau, max(len(a), len(b)) // per_edit)
            if abs(len(a) - len(b)) <= allowed and edits(a, b) <= allowed:
                g.link(i, j)
    first = {line for i, line in enumerate(names) if g.root(i) == i}
    out = {}
    for d, text in docs:
        out[d] = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if not x.strip(" \t\r") or (x in first and lines[x] == (d, n)))
    return out


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())
