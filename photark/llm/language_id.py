"""Language identification by interpolated Kneser-Ney models of characters.

Every language's words are counted over all of its texts; its n-grams come from these counts by joins and aggregates.
The probabilities, and what each context leaves to shorter ones, are kept in arrays sorted by hash, of at most SLOTS
entries an order and kind, so that a language's model has a bound (ORDER * 2 * SLOTS * 8 bytes) at every size of the
corpus; n-grams of one slot share its greater value. A text gets the language whose cross-entropy per character is
least. How sure that is, and above which cross-entropy a text is unlike all languages, is learned from labelled texts
that the models have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photark.llm.common import materialise, read

ORDER = 5
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
BEFORE, AFTER = "^", "$"  # no letters: the characters before and after a word
CALIBRATION = 4_000  # labelled texts, about, that learn how sure a judgement is
HELD = 200_000  # words, or 20 times as many characters, that a task holds
CHUNK = 1 << 20  # characters judged at a time
WORDS, LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters (str.isalpha) of the lower-cased text; null has none."""
    found = WORDS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (lang, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()
        characters = 0

        def flush() -> pa.RecordBatch:
            keys, counts = list(held), list(held.values())
            held.clear()
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                for word, n in Counter(words_of(text.as_py())).items():
                    held[lang, word] += n
                    characters += len(word)
                if len(held) >= HELD or characters >= 100 * HELD:
                    characters = 0
                    yield flush()
        yield flush()

    return docs.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, n). Of ``order`` characters: how often each occurs, in words with what is before and after them.
    Of fewer: how many different characters come before it, the continuation count."""
    padded = F.concat(F.lit(BEFORE * (order - 1)), F.col("word"), F.lit(AFTER))
    at = F.sequence(F.lit(1), F.char_length("word") + 1)
    own = words.select("lang", "n", padded.alias("padded"), F.explode(at).alias("at")).select("lang", "n", F.expr(f"substring(padded, at, {order})").alias("gram"))
    full = materialise(own.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    longer = full.select("lang", F.explode(F.sequence(F.lit(1), F.lit(order - 1))).alias("size"), "gram").selectExpr("lang", "size", "right(gram, size + 1) AS gram").distinct()
    fewer = longer.selectExpr("lang", "size", "right(gram, size) AS gram").groupBy("lang", "size", "gram").agg(F.count("*").alias("n"))
    return materialise(full.select("lang", F.lit(order).alias("size"), "gram", "n").unionByName(fewer), "counts")


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, kind, value) with value in bits: kind p is the interpolated probability of a gram's last character
    after the others, kind b, of a gram that goes before, the share left to the shorter one. The empty gram's p is that of a
    character that the language doesn't have.

    Each order's discount is n1 / (n1 + 2 n2) from the numbers of grams counted once and twice; a half where one of them is 0."""
    once = counts.groupBy("lang", "size").agg(F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
    discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    counts = counts.join(F.broadcast(once.select("lang", "size", discount.alias("d"))), ["lang", "size"]).withColumn("context", F.expr("left(gram, size - 1)"))
    contexts = counts.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), F.count("*").alias("followers"), F.first("d").alias("d"))
    contexts = materialise(contexts.select("lang", "size", "context", "total", (F.col("d") * F.col("followers") / F.col("total")).alias("left"), "followers"), "contexts")
    direct = counts.join(contexts, ["lang", "size", "context"]).select("lang", "size", "gram", F.expr("greatest(n - d, 0D) / total").alias("direct"), "left", "followers")
    direct = materialise(direct, "direct")
    # below the single characters: all that the language has, and one more, are equally likely
    shorter = contexts.where("size = 1").select("lang", F.lit("").alias("rest"), (1 / (F.col("followers") + 1)).alias("p"))
    bits = lambda c: F.log2(c).alias("value")
    out = [contexts.where("size = 1").select("lang", F.lit(0).alias("size"), F.lit("").alias("gram"), F.lit("p").alias("kind"), bits(F.col("left") / (F.col("followers") + 1)))]
    for size in range(1, order + 1):
        own = direct.where(F.col("size") == size).withColumn("rest", F.expr("right(gram, size - 1)"))
        own = materialise(own.join(shorter, ["lang", "rest"]).select("lang", "gram", (F.col("direct") + F.col("left") * F.col("p")).alias("p")), f"p{size}")
        out.append(own.select("lang", F.lit(size).alias("size"), "gram", F.lit("p").alias("kind"), bits(F.col("p"))))
        shorter = own.select("lang", F.col("gram").alias("rest"), "p")
    out.append(contexts.where("size > 1").select("lang", "size", F.col("context").alias("gram"), F.lit("b").alias("kind"), bits(F.col("left"))))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """For each place, the slot of the ``size`` characters that end there (code points; wrong for the first size - 1 places)."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(size - 1, -1, -1):
        h[back:] += codes[: len(codes) - back] + np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def slotted(rows: DataFrame) -> DataFrame:
    """(lang, size, kind, slot, value), one row a slot."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("gram").to_pylist()
            ends = np.cumsum([len(g) for g in grams], dtype=np.int64)
            sizes, codes, slots = np.diff(ends, prepend=0), codes_of("".join(grams)), np.zeros(len(grams), np.int32)
            for size in set(sizes.tolist()) - {0}:
                own = sizes == size
                slots[own] = hashes(codes, size)[ends[own] - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lang", "size", "kind")), pa.array(slots, pa.int32()), b.column("value")], names=["lang", "size", "kind", "slot", "value"])

    out = rows.select("lang", "size", "kind", "gram", "value").mapInArrow(hashed, "lang string, size int, kind string, slot int, value double")
    return out.groupBy("lang", "size", "kind", "slot").agg(F.max("value").cast("float").alias("value"))


class Models:
    """Sorted hash arrays of each language, in the order of their names."""

    def __init__(self, table: pa.Table, order: int):
        self.order = order
        frame = table.to_pandas().sort_values(["lang", "kind", "size", "slot"])
        self.langs = sorted(frame["lang"].unique())
        self.arrays = {key: (own["slot"].to_numpy(np.uint32), own["value"].to_numpy(np.float32)) for key, own in frame.groupby(["lang", "kind", "size"])}

    def looked_up(self, lang: str, kind: str, size: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which slots the array has, and their values."""
        keys, values = self.arrays.get((lang, kind, size), (np.zeros(0, np.uint32), np.zeros(0, np.float32)))
        if not len(keys):
            return np.zeros(len(slots), bool), np.zeros(len(slots))
        at = np.minimum(np.searchsorted(keys, slots), len(keys) - 1)
        return keys[at] == slots, values[at].astype(np.float64)

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word (and of its end) under each language: a row a word."""
        if not words:
            return np.zeros((0, len(self.langs)))
        before = self.order - 1
        codes = codes_of("".join(BEFORE * before + w + AFTER for w in words))
        ends = np.cumsum([len(w) + self.order for w in words])
        predicted = np.ones(len(codes), bool)
        for i in range(before):
            predicted[np.concatenate([[0], ends[:-1]]) + i] = False
        places = np.flatnonzero(predicted)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
        slots = {size: hashes(codes, size) for size in range(1, self.order + 1)}
        out = np.zeros((len(words), len(self.langs)))
        for column, lang in enumerate(self.langs):
            total, open_ = np.zeros(len(places)), np.arange(len(places))
            for size in range(self.order, 0, -1):
                hit, value = self.looked_up(lang, "p", size, slots[size][places[open_]])
                total[open_[hit]] += value[hit]
                open_ = open_[~hit]
                if size > 1:
                    hit, value = self.looked_up(lang, "b", size, slots[size - 1][places[open_] - 1])
                    total[open_[hit]] += value[hit]
            total[open_] += self.arrays[lang, "p", 0][1][0]
            out[:, column] = -np.add.reduceat(total, starts)
        return out


class Judge:
    """Cross-entropies of texts; words met before are remembered, within a bound."""

    def __init__(self, models: Models):
        self.models, self.known, self.rows, self.characters = models, {}, np.zeros((0, len(models.langs))), 0

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if self.known and (len(self.known) + len(new) > HELD or self.characters > 20 * HELD):
            self.known, self.rows, self.characters = {}, self.rows[:0], 0
            new = list(words)
        first = len(self.known)
        self.known.update((w, first + i) for i, w in enumerate(new))
        self.rows = np.concatenate([self.rows, self.models.bits(new)])
        self.characters += sum(map(len, new))

    def entropies(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int] | None]:
        """Bits per character (a word's end counts as one) under each language and the number of characters; None without letters."""
        at = 0
        while at < len(texts):
            counts, size = [], 0
            while at < len(texts) and size < CHUNK:
                counts.append(Counter(words_of(texts[at])))
                size += len(texts[at] or "")
                at += 1
            self.learn(set().union(*counts))
            for own in counts:
                n = np.array(list(own.values()), np.float64)
                total = sum((len(w) + 1) * c for w, c in own.items())
                yield (n @ self.rows[[self.known[w] for w in own]] / total, total) if own else None


def judged(docs: DataFrame, models) -> DataFrame:
    """docs with best (lang), bits and margin (of the second language to the best, in bits per character) and characters; all null
    for texts without letters. Columns of these names are replaced. ``models`` is broadcast."""
    names = ["best", "bits", "margin", "characters"]
    docs = docs.drop(*names)
    shape = T.StructType([*docs.schema.fields, T.StructField("best", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("characters", T.LongType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(models.value)
        langs = judge.models.langs
        for batch in batches:
            out: list[tuple] = []
            for found in judge.entropies(batch.column("text").to_pylist() if langs else [None] * batch.num_rows):
                if found is None:
                    out.append((None,) * 4)
                    continue
                bits, total = found
                two = np.sort(bits)[:2]
                out.append((langs[int(np.argmin(bits))], float(two[0]), float(two[-1] - two[0]), total))
            new = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=shape.names)

    return docs.mapInArrow(scored, shape)


def sureness(margin, characters):
    """What the chance of a right judgement is learned from: the logarithm of the whole text's margin in bits."""
    return F.log1p(margin * characters) if not isinstance(margin, np.ndarray) else np.log1p(margin * characters)


def calibrate(rows: list[tuple[str, str, float, float, int]], rejected: float) -> tuple[float, float, dict[str, float]]:
    """From (lang, best, bits, margin, characters) of unseen texts: slope and intercept of the logistic chance that a
    judgement is right (targets smoothed by the numbers of right and wrong ones), and each language's greatest bits per
    character, which all but the share ``rejected`` of its rightly judged texts keep."""
    right = np.array([r[0] == r[1] for r in rows], bool)
    x = sureness(np.array([r[3] for r in rows], float), np.array([r[4] for r in rows], float))
    target = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
    design, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50 if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    limits = {lang: float(np.quantile([r[2] for r in rows if r[0] == r[1] == lang], 1 - rejected)) for lang in {r[0] for r, ok in zip(rows, right, strict=True) if ok}}
    return float(w[0]), float(w[1]), limits


def identify(docs: DataFrame, learn: DataFrame, calibration: int = CALIBRATION, order: int = ORDER, rejected: float = 0.005) -> DataFrame:
    """docs (with text; all rows and columns) with language, bits, chance and accepted, in place of columns of those names.

    learn: rows with doc_id, text and lang, those with a null of text or lang count for nothing. About ``calibration``
    of them, by hash of doc_id, learn how sure a judgement is; all others are counted. language: the one of the least bits
    per character (ties: the first by name), null for null texts, texts without letters, or if nothing is learned. chance: of
    being right, 0 to 1. accepted: chance at least a half, and no more bits than the language's own texts have, but for the
    share ``rejected`` of them; languages without texts in the calibration have no such limit. Repeats, ties and the order
    of rows change nothing.
    """
    spark = docs.sparkSession
    learn = learn.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = int((1 << 30) * min(0.1, calibration / max(learn.select("doc_id", "lang").count(), 1)))
    aside = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1 << 30)) < share, F.lit(False))
    words = materialise(word_counts(learn.where(~aside)), "words")
    table = slotted(probabilities(gram_counts(words, order), order)).toArrow()  # at most 2 * ORDER * SLOTS rows a language
    models = spark.sparkContext.broadcast(Models(table, order))
    sample = judged(learn.where(aside), models).where("best is not null").select("lang", "best", "bits", "margin", "characters").collect()
    slope, intercept, limits = calibrate([tuple(r) for r in sample], rejected)

    names = ["language", "bits", "chance", "accepted"]
    kept = [c for c in docs.columns if c not in names]
    found = judged(docs.select(F.struct("*").alias("row_"), "text"), models)
    chance = 1 / (1 + F.exp(-(slope * sureness(F.col("margin"), F.col("characters")) + intercept)))
    chance = F.when(F.col("best").isNull(), 0.0).otherwise(chance)
    limit = F.coalesce(*[F.when(F.col("best") == lang, F.lit(v)) for lang, v in sorted(limits.items())], F.lit(float("inf")))
    accepted = F.col("best").isNotNull() & (chance >= 0.5) & (F.col("bits") <= limit)
    return found.select(*[F.col("row_").getField(c).alias(c) for c in kept], F.col("best").alias("language"), "bits", chance.alias("chance"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def op13_language_id(spark, sf_dir) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.where(~held_out))
    return found.select("doc_id", "held_out", F.coalesce("language", F.lit("und")).alias("lang_pred"), F.round("chance", 6).alias("score"), "accepted")
