"""Spelling variants: words one edit apart, by a forward and a reversed dictionary.

One inserted, deleted or replaced character leaves a half of a word as it is. So near words lie in one block of a
dictionary sorted by first halves, or in one of a dictionary of reversed words sorted by last halves. The blocks are
scanned as ranges of these dictionaries. A block of more than a few words is cut again the same way: of what its words
do not share yet, one edit leaves a half as it is. Each pair of near words is found in one block only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photark.llm.common import discard, materialise, partitions, read

RUNS = re.compile("[a-zÀ-ÿ]+")
HELD = 200_000  # words that a task counts before it hands them on
CROWD = 32  # words of a block that are compared with each other
BLOCK = ["m", "head", "tail", "key"]


def word_counts(docs: DataFrame, least_length: int, least_count: int, change: Callable[[str | None, str], str] | None = None) -> DataFrame:
    """(word, n) of maximal runs of letters (ASCII and U+00C0 to U+00FF), only A-Z lower-cased, over all of docs (doc_id,
    text). ``change`` may replace a document's word by another one; lengths are those after it. Null texts have no words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = Counter(RUNS.findall((text.as_py() or "").encode().lower().decode()))  # bytes.lower() is A-Z only
                for word, n in own.items():
                    word = change(doc_id, word) if change else word
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def keyed(rows: DataFrame) -> DataFrame:
    """What a block's words share: their first ``head`` characters and their last ``tail`` ones, the latter backwards."""
    return rows.withColumn("key", F.expr("concat(left(word, head), ' ', reverse(right(word, tail)))"))


def halved(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks that come of its own: m - head - tail characters of the shorter words are not shared; of
    these the first half joins the head, or else the rest joins the tail. The second kind of block leaves out pairs that
    are in the first: those with ``most`` or more first characters in common."""
    x = F.expr("head + (m - head - tail) div 2").cast("int")
    two = F.array(
        F.struct(x.alias("head"), F.col("tail"), F.col("most")),
        F.struct(F.col("head"), (F.col("m") - x).alias("tail"), F.least("most", x).alias("most")),
    )
    return keyed(rows.select("word", "n", "m", F.explode(two).alias("b")).select("word", "n", "m", "b.*"))


def blocks(words: DataFrame) -> DataFrame:
    """(word, n, m, head, tail, most, key): blocks of shared heads and tails, all of at most CROWD words, or with a single
    character not shared. m is the length of the shorter words: each word is also in blocks of words one shorter."""
    length = F.char_length("word").cast("int")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m >= 1")
    rows = halved(rows.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(2**31 - 1).alias("most")))
    done, last = [], None
    while True:
        sizes = rows.groupBy(*BLOCK).count().where((F.col("count") > CROWD) & (F.col("m") - F.col("head") - F.col("tail") > 1))
        large = materialise(sizes.select(*BLOCK, F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return rows if not done else _union([*done, rows])
        marked = materialise(rows.join(large, BLOCK, "left"), "marked")
        discard(large)
        done.append(marked.where("large is null").select("word", "n", "m", "head", "tail", "most", "key"))
        rows = halved(marked.where("large").drop("key", "large"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edit_at(u: str, v: str, at: int) -> int:
    """How many first characters u and v have in common if v differs from u by one replaced or one more character, else -1.
    They have ``at`` in common at least, and v is not shorter than u."""
    n = len(u)
    while at < n and u[at] == v[at]:
        at += 1
    return at if u[at + (len(v) == n) :] == v[at + 1 :] else -1


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs within each block, both ways; a block's rows follow each other."""
    now, own = None, []

    def pairs() -> Iterator[tuple[str, str, int]]:
        m, head, most = (now[0], now[1], own[0][2]) if own else (0, 0, 0)
        short, long = [w for w in own if len(w[0]) == m], [w for w in own if len(w[0]) > m]
        for i, (u, n, _) in enumerate(short):
            for v, k, _ in short[i + 1 :] + long:
                if -1 < edit_at(u, v, head) < most:
                    yield u, v, k
                    yield v, u, n

    def flush(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

    found: list[tuple[str, str, int]] = []
    for batch in batches:
        for word, n, most, *block in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "most", *BLOCK)), strict=True):
            if block != now:
                found += pairs()
                now, own = block, []
                if len(found) > 50_000:
                    yield flush(found)
                    found = []
            own.append((word, n, most))
    found += pairs()
    yield flush(found)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words of (word, n) that differ by one inserted, deleted or replaced character, both ways."""
    order = [F.col(c) for c in BLOCK]
    ranged = blocks(words).repartitionByRange(partitions(words.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(scanned, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each word's form's form and so on, to the last. Each turn doubles the steps taken."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        grown = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        if grown.where("moved").isEmpty():
            return grown.select("word", "root")
        now = grown


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of words (word, n; each word once): how many words differ from it by exactly one
    inserted, deleted or replaced character; of these the one with the largest n (ties: the first in code-point order) if
    that n is at least ``ratio`` times the word's; and where forms lead in the end, the word itself if it has none.

    Words may be of any length from 1; null words and null n take no part. ratio is over 1, so forms make no circle.
    """
    words = materialise(words.where("word is not null and word <> '' and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("far", -F.col("best.minus") >= ratio * F.col("n"))
    form = lambda c: F.when(F.col("far"), c)
    found = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.near")).alias("form"), form(-F.col("best.minus")).alias("form_n")), "variants")
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def one_letter_less(doc_id: str | None, word: str) -> str:
    """The word, without one letter where 31 divides the crc32 of ``<doc_id>:<word>``; a null doc_id counts as empty."""
    h = zlib.crc32(f"{doc_id or ''}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op11_spelling(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs, 7, 2, one_letter_less)).select("word", "form", "root", "n", "n_near", "form_n")
