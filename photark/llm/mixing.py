"""Mixing sources to target weights by weighted fair queueing.

Each source is shuffled by a seeded hash. A document's virtual finish time is the number of
words its source has served once it is through, divided by the source's target; documents (and their
repeats) of all sources are range-sorted by it into one queue, which is cut where the total budget ends.
A document in service at time 1, when its source has had its target, is two packets, so that a long one
neither waits for its end nor takes others' words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import boxed, materialise, partitions, prefix_sums, read, unboxed

PACKETS = "array<struct<virtual_finish: double, source_rank: int, ends: bigint, words: bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, size), one row a source.

    Weights repeat over the sources by code point, null last. Targets share the whole size by
    weight; one above max_repeats times its source stops there, and the excess goes to the others
    by weight until none is above. By ascending max_repeats * size / weight this takes one pass:
    a source stops while the level left by those before it would lift it above its stop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    stop = (max_repeats * F.col("source_size")).alias("stop")
    per = per.select("source", rank.alias("source_rank"), "source_size", weight.alias("weight"), stop)
    by = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("stop").over(before), F.lit(0)).alias("stopped"), F.sum("weight").over(after).alias("sharing"),
    )
    level = (F.col("total") - F.col("stopped")).cast("double") / F.col("sharing")
    per = per.select("*", level.alias("level"), (F.col("stop") < level * F.col("weight")).alias("above"))
    final = F.max(F.when(~F.col("above"), F.col("level"))).over(everything)
    return per.select(
        "source", "source_rank", "source_size", F.when(F.col("above"), F.col("stop").cast("double")).otherwise(final * F.col("weight")).alias("target")
    )


def packets(docs: DataFrame, seed: str, max_repeats: int) -> DataFrame:
    """docs (doc_id, source, size, any more columns) with source_rank, source_size, target, served (words of the source before
    this document, in its shuffled order) and packets: what may be sent of each copy, as (virtual_finish, source_rank, ends, words).

    A copy in service when its source has had its target is two packets, cut there; a source's
    packets after the first beyond its target can't be reached, as each source goes under its target by less than a word."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    ordered = docs.withColumn("shuffle_key", key)
    order = [F.col("source"), F.col("shuffle_key"), F.col("doc_id"), F.col("size")]
    summed = prefix_sums(ordered, order, "size", "served", "source").drop("shuffle_key")
    t = targets(docs, max_repeats=max_repeats).withColumnRenamed("source", "of")
    joined = summed.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    goal = F.floor("target").cast("long")

    def of_copy(e: Column) -> Column:
        start = e * F.col("source_size") + F.col("served")
        end = start + F.col("size")
        packet = lambda a, b: F.struct((b / F.col("target")).alias("virtual_finish"), F.col("source_rank").alias("source_rank"), b.alias("ends"), (b - a).alias("words"))
        both = F.array(packet(start, F.least(end, goal)), packet(F.greatest(start, goal), end))
        return F.when(start <= goal, F.filter(both, lambda p: p["words"] > 0)).otherwise(F.array().cast(PACKETS))

    copies = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), of_copy))
    return joined.withColumn("packets", F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(F.array().cast(PACKETS)))


def schedule(docs: DataFrame, seed: str = "mix", max_repeats: int = 3) -> DataFrame:
    """docs (doc_id, source, size, any more columns but those added) with source_rank, source_size, target, and sent: the packets
    that go before the total budget (the size of all documents) is used up, in the order of all packets by virtual finish
    time, then source, then place in the source; the packet in which it ends is cut there.

    Ties of the shuffle go by doc_id and size; rows without doc_id shuffle as one id. Documents of
    size 0 send nothing. An empty table gives an empty one. Equal rows are separate documents.
    """
    made = materialise(packets(docs, seed, max_repeats), "packets")
    order = ["virtual_finish", "source_rank", "ends"]
    queue = prefix_sums(made.select(F.explode("packets").alias("p")).select("p.*"), [F.col(c) for c in order], "words", "sent_before")
    budget = made.agg(F.sum("size")).first()[0] or 0
    last = queue.where(F.col("sent_before") < budget).orderBy(F.desc("sent_before")).first()  # of all packets, the one that the budget ends in
    if last is None:
        return made.withColumn("sent", F.col("packets")).drop("packets", "served")
    place = lambda p: F.struct(*[p[c].alias(c) for c in order])
    end = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in zip(order, ("double", "int", "long"), strict=True)])
    words = lambda p: F.when(place(p) == end, F.least(p["words"], F.lit(budget - last["sent_before"]))).otherwise(p["words"])
    sent = F.transform(F.filter("packets", lambda p: place(p) <= end), lambda p: p.withField("words", words(p)))
    return made.withColumn("sent", sent).drop("packets", "served")


def mix(docs: DataFrame, seed: str = "mix", max_repeats: int = 3) -> DataFrame:
    """The mix of documents (doc_id, text, source, any more columns): a row for each copy of which words are taken,
    range-sorted by virtual finish time, with ``virtual_finish`` and ``taken_words``; a copy cut
    by the end of the budget has taken_words below its size and keeps its whole text.

    Rows equal in doc_id, source and text share their copies between them. Columns of these two names are replaced.
    """
    texts = boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), version=F.xxhash64("text"), size=words(F.col("text")))
    keys = ["doc_id", "source", "version", "size"]
    plan = schedule(materialise(texts.select(keys), "sizes"), seed, max_repeats)

    def of_copy(e: Column) -> Column:
        own = F.filter("sent", lambda p: F.call_function("div", p["ends"] - 1, F.col("source_size")) == e)
        count = F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["words"])
        return F.struct(F.array_max(F.transform(own, lambda p: p["virtual_finish"])).alias("virtual_finish"), count.alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), of_copy), lambda c: c["words"] > 0)
    plan = plan.select(*keys, copies.alias("copies")).where(F.size("copies") > 0)
    number = F.lit(1)
    if not plan.groupBy(*keys).count().where("count > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    plan = plan.withColumn("number", number).select(*[F.col(c).alias("m_" + c) for c in (*keys, "number")], "copies")
    texts = texts.withColumn("number", number)
    on = F.lit(True)
    for c in (*keys, "number"):
        on = on & F.col(c).eqNullSafe(F.col("m_" + c))
    out = texts.join(plan, on).withColumn("copy", F.explode("copies"))
    out = unboxed(out, docs.columns, virtual_finish=F.col("copy.virtual_finish"), taken_words=F.col("copy.words"))
    return materialise(out, "mixed", compression="zstd").repartitionByRange(partitions(docs.sparkSession), "virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def op8_mixing(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    plan = schedule(materialise(docs, "sizes"))
    taken = F.aggregate("sent", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_rank,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS stop FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source IS NULL, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
       / sum(weight) OVER (ORDER BY stop / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
  FROM w
), t AS (
  SELECT source, source_rank, source_size, CASE WHEN stop < level * weight THEN stop::DOUBLE
         ELSE max(CASE WHEN stop >= level * weight THEN level END) OVER () * weight END AS target FROM l
), p AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, t.source_rank, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix:', d.doc_id)), d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, e * source_size + served AS starts, e * source_size + served + size AS ends FROM p, (VALUES (0), (1), (2)) AS copy(e) WHERE size > 0 AND target > 0
), k AS (
  SELECT id, source_rank, target, starts, least(ends, goal) AS ends FROM c WHERE starts < goal
  UNION ALL SELECT id, source_rank, target, greatest(starts, goal), ends FROM c WHERE starts <= goal AND ends > goal
), q AS (
  SELECT id, ends - starts AS words, coalesce(sum(ends - starts) OVER (ORDER BY ends / target, source_rank, ends
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_before FROM k
), b AS (
  SELECT id, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - sent_before)))::BIGINT AS taken FROM q GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN b USING (id)
"""
