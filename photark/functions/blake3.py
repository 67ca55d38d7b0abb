"""BLAKE3-256 over many byte strings at once: each step of the compression runs over all chunks of a batch.

Published in "BLAKE3: one function, fast everywhere" (O'Connor, Aumasson, Neves, Wilcox-O'Hearn, 2020).
"""

from __future__ import annotations

import numpy as np

#: Initial state, order of message words in the next round, bytes of a chunk and of a block, flags.
START = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
NEXT = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK, BLOCK = 1024, 64
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8

SLICE = 4096  # chunks compressed together: their state stays in a core's cache


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _mixed(a, b, c, d, first, second):
    a = a + b + first
    d = _turned(d ^ a, 16)
    c = c + d
    b = _turned(b ^ c, 12)
    a = a + b + second
    d = _turned(d ^ a, 8)
    c = c + d
    return a, _turned(b ^ c, 7), c, d


def compress(chained: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8 x n) from old ones (8 x n), blocks (16 x n words), chunk numbers, lengths and flags (n each)."""
    n = chained.shape[1]
    a, b, c = chained[:4], chained[4:], np.repeat(START[:4, None], n, 1)
    d = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)])
    for _ in range(7):
        a, b, c, d = _mixed(a, b, c, d, words[0:8:2], words[1:8:2])
        b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]  # columns become diagonals
        a, b, c, d = _mixed(a, b, c, d, words[8::2], words[9::2])
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        words = words[NEXT]
    return np.concatenate([a ^ c, b ^ d])


def _chunks(data: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values of chunks: data is n x CHUNK bytes, padded with zeros; alone marks those that are a whole tree."""
    out = np.repeat(START[:, None], len(lengths), 1)
    last = np.maximum(lengths - 1, 0) // BLOCK
    words = data.view("<u4").reshape(len(lengths), CHUNK // BLOCK, 16)
    for at in range(int(last.max(initial=-1)) + 1):
        own = np.flatnonzero(last >= at)
        ends = last[own] == at
        flags = CHUNK_START * (at == 0) + ends * (CHUNK_END + ROOT * alone[own])
        size = np.where(ends, lengths[own] - at * BLOCK, BLOCK)
        out[:, own] = compress(out[:, own], np.ascontiguousarray(words[own, at].T), numbers[own], size, flags)
    return out


def parents(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Chaining values of the parents of nodes (8 x n each)."""
    n = len(root)
    return compress(np.repeat(START[:, None], n, 1), np.concatenate([left, right]), np.zeros(n, np.int64), np.full(n, BLOCK), PARENT + ROOT * root)


def _trees(chained: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The top node of each tree of ``counts`` leaves in a row; whole marks trees whose top is a root. Level by level,
    neighbours join, and one without a neighbour goes up as it is."""
    while (counts > 1).any():
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        of, last = np.repeat(counts, counts), np.repeat(whole, counts)
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < of))
        up = chained[:, at % 2 == 0]
        places = (np.cumsum(at % 2 == 0) - 1)[left]
        up[:, places] = parents(chained[:, left], chained[:, left + 1], (of[left] == 2) & last[left])
        chained, counts = up, (counts + 1) // 2
    return chained


def tops(contents: list[bytes], first: list[int] | None = None, whole: list[bool] | None = None) -> list[bytes]:
    """32 bytes each: the digests of contents; or, of pieces that begin at chunk ``first`` of something longer and are not
    the ``whole`` of it, the chaining values of their trees."""
    sizes = np.array([len(c) for c in contents], np.int64)
    counts = np.maximum(-(-sizes // CHUNK), 1)
    is_whole = np.array(whole, bool) if whole is not None else np.ones(len(contents), bool)
    starts = np.cumsum(counts) - counts
    nodes = np.zeros((8, int(counts.sum())), np.uint32)
    data = np.zeros(int(counts.sum()) * CHUNK, np.uint8)
    for content, start in zip(contents, starts.tolist(), strict=True):
        data[start * CHUNK : start * CHUNK + len(content)] = np.frombuffer(content, np.uint8)
    at = np.arange(counts.sum()) - np.repeat(starts, counts)
    lengths = np.minimum(np.repeat(sizes, counts) - at * CHUNK, CHUNK)
    numbers = at + np.repeat(np.array(first if first is not None else [0] * len(contents), np.int64), counts)
    alone = np.repeat((counts == 1) & is_whole, counts)
    data = data.reshape(-1, CHUNK)
    for s in (slice(i, i + SLICE) for i in range(0, len(at), SLICE)):
        nodes[:, s] = _chunks(data[s], lengths[s], numbers[s], alone[s])
    top = np.ascontiguousarray(_trees(nodes, counts, is_whole).T).astype("<u4")
    return [row.tobytes() for row in top]
