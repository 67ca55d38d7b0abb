"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits are grouped by correlation into m partitions. Thresholds t_i >= -1 (-1: not used) with
sum(t_i + 1) = distance + 1 are enough: two fingerprints within the distance differ by at most
t_i in some used partition. Dynamic programming gives the thresholds the least estimated cost,
probes and candidates, from counts of all fingerprints; m is chosen likewise. Each fingerprint
probes a partition's index with all values within t_i of its own, and candidates are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photark.llm.common import binary, boxed, components, discard, few, materialise, partitions, read, unboxed

#: A probe is written, sorted and read; a candidate is a comparison of two numbers.
ROW_COST = 20
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes, k: int) -> Iterator[bytes]:
    """k-word shingles with repeats; fewer words are one shingle, none give none."""
    words = text.translate(LOWER).split()
    if not words:
        return iter(())
    return map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else iter([b" ".join(words)])


def fingerprint(text: bytes, k: int) -> int:
    """As a signed 64-bit number; the majority of each bit over the shingles' XXH64."""
    return majority([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)])


def majority(hashes: list[int] | np.ndarray, block: int = 1 << 16) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = np.array(hashes[at : at + block], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, version, fp) of docs (doc_id, text, any more columns), one row a row; version is the text's
    hash; null text has no shingle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, k) for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(fps, pa.int64())], names=["doc_id", "version", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return materialise(rows.mapInArrow(made, "doc_id long, version long, fp long"), "fingerprints")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and for all bits a, b the rows that have both set; one row of 64 x 64 a task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            raw = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + (bits.T @ bits)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))], names=["n", "both"])

    per = fps.select("fp").mapInArrow(counted, "n long, both array<long>")
    total = per.select("n", F.posexplode("both").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    both = np.zeros(64 * 64)
    for r in total:
        both[r["at"]] = r["x"]
    return int(total[0]["n"]) if total else 0, both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        first = max(left, key=lambda b: (corr[b, left].max() if len(left) > 1 else 0, -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def value(bits: list[int]) -> Column:
    """These bits of fp, each in its place."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = distance + 1; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for per in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for more in range(distance + 2 - spent):
                new = (cost + per[more], [*ts, more - 1])
                if spent + more not in step or new < step[spent + more]:
                    step[spent + more] = new
        best = step
    return best[distance + 1]


def plan(distinct: DataFrame, distance: int, partitions: tuple[int, ...] = (2, 3, 4, 5, 6)) -> list[tuple[list[int], int]]:
    """The used partitions (bits, threshold) for a self-join of all distinct fingerprints."""
    n, both = bit_moments(distinct)
    layouts = {m: group_bits(n, both, m) for m in partitions}
    keys = [(m, i, bits) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    each = distinct.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), value(bits).alias("v")) for j, (_, _, bits) in enumerate(keys)])).alias("e"))
    sizes = each.groupBy("e.j", "e.v").agg(F.count("*").cast("double").alias("c")).groupBy("j").agg(F.sum(F.col("c") * F.col("c")).alias("pairs")).collect()
    pairs = {r["j"]: r["pairs"] for r in sizes}
    p = np.diag(both) / max(n, 1)
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            off = np.zeros(len(bits) + 1)  # chance of so many differing bits
            off[0] = 1
            for b in bits:
                q = 2 * p[b] * (1 - p[b])
                off[1:] = off[1:] * (1 - q) + off[:-1] * q
                off[0] *= 1 - q
            same = pairs.get(keys.index((m, i, bits)), 0.0)
            row = [0.0]
            for t in range(distance + 1):
                probes = n * sum(comb(len(bits), x) for x in range(t + 1))
                row.append(ROW_COST * (probes + n) + same * off[: t + 1].sum() / max(off[0], 1e-30))
            costs.append(row)
        cost, ts = allocate(costs, distance)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def links(distinct: DataFrame, distance: int, hot: int = 2000) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints that differ in at most ``distance`` bits.

    A fingerprint has at most C(64, <= distance) others so near, so links stay in proportion.
    A bucket of more than ``hot`` fingerprints is probed by its other bits too: these again differ
    by at most the distance, so of distance + 1 parts of them one is equal.
    """
    if distinct.isEmpty():
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    chosen = plan(distinct, distance)
    index, probe = [], []
    for j, (bits, t) in enumerate(chosen):
        flips = [sum(1 << b for b in c) for e in range(t + 1) for c in combinations(bits, e)]
        signed = [f - (1 << 64) if f >> 63 else f for f in flips]
        v = value(bits)
        index.append(distinct.select("fp", F.lit(j).alias("j"), v.alias("v")))
        probe.append(distinct.select("fp", F.lit(j).alias("j"), F.explode(F.array(*[v.bitwiseXOR(F.lit(s)) for s in signed])).alias("v")))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    indexed = union(index)
    crowded = indexed.groupBy("j", "v").count().where(F.col("count") > hot).select(F.col("j").alias("hj"), F.col("v").alias("hv"))
    crowded = materialise(few(crowded), "crowded")

    def parts(j: int) -> Column:
        rest = [b for b in range(64) if b not in chosen[j][0]]
        return F.array(*[F.struct(F.lit(s).alias("s"), value(rest[s :: distance + 1]).alias("w")) for s in range(distance + 1)])

    def split(rows: DataFrame) -> DataFrame:
        whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w")))
        fine = parts(0)
        for j in range(1, len(chosen)):
            fine = F.when(F.col("j") == j, parts(j)).otherwise(fine)
        joined = rows.join(crowded, (F.col("j") == F.col("hj")) & (F.col("v") == F.col("hv")), "left")
        e = joined.select("fp", "j", "v", F.explode(F.when(F.col("hj").isNull(), whole).otherwise(fine)).alias("e"))
        return e.select("fp", "j", "v", F.col("e.s").alias("s"), F.col("e.w").alias("w"))

    left, right = (split(indexed), split(union(probe))) if not crowded.isEmpty() else (indexed, union(probe))
    on = [c for c in left.columns if c != "fp"]
    a = left.withColumnRenamed("fp", "a")
    b = right.withColumnRenamed("fp", "b").select("b", *[F.col(c).alias("p_" + c) for c in on])
    condition = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    for c in on:
        condition = condition & (F.col(c) == F.col("p_" + c))
    return a.join(b, condition).select("a", "b").distinct()


def rooted(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, first, n, root) of each distinct fingerprint: the least doc_id that has it, the number of rows, and its component."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance))
    owned = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    return materialise(owned, "roots")


def near_duplicates(docs: DataFrame, k: int = 3, distance: int = 2) -> DataFrame:
    """One row a row of docs (doc_id, text, any more columns): doc_id, fp, component_id, the least
    doc_id reachable over links. Null and empty texts share the fingerprint zero, which links like
    any other; rows without doc_id belong to a component but do not name it (one of such rows alone
    has none); repeated rows repeat their result; no rows give none."""
    fps = fingerprints(docs, k)
    owned = rooted(fps, distance)
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(owned.join(least, "root").select(F.col("fp").alias("of"), "n", "component_id"), "components")
    # a fingerprint of more than 1 row in 100,000 would crowd a task: there are under 100,000 of them, so they are broadcast
    often = named.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(named.where(F.col("n") * 100_000 > often))
    few = fps.join(frequent, F.col("fp") == F.col("of"), "left").where("of is null").select("doc_id", "fp")
    found = [fps.join(frequent, F.col("fp") == F.col("of")), few.join(named, F.col("fp") == F.col("of"))]
    return found[0].select("doc_id", "fp", "component_id").unionByName(found[1].select("doc_id", "fp", "component_id"))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, version, fp, sid, size, bits, has): fp, the fingerprint; has, the sorted hashes of the
    text's different shingles; sid, a hash of these; bits, for each of 512 classes of hashes, if it has an odd number of them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                hashes = [np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(t, k)), "<u8") for t in binary(part, "text")]
                fps = pa.array([majority(h) for h in hashes], pa.int64())
                sets = [np.unique(h.view("<i8")) for h in hashes]
                sid = [xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) for h in sets]
                odd = [np.packbits(np.bincount(h & 511, minlength=512) & 1, bitorder="little").view("<i8") for h in sets]
                columns = [part.column("doc_id"), part.column("version"), fps, pa.array(sid, pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "fp", "sid", "size", "bits", "has"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return materialise(rows.mapInArrow(made, "doc_id long, version long, fp long, sid long, size int, bits array<long>, has array<long>"), "shingle-sets")


def prefixes(sets: DataFrame, similarity: float, common: np.ndarray) -> DataFrame:
    """(v, place, sid, size): the first shingles of each set, by hash with the sorted ``common`` ones last, without which
    fewer than ``similarity`` of the set are left: of two sets so similar, the first shared one is among both.
    Equal sets give theirs once a task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                new = []
                for i in part.column("sid").to_pylist():
                    new.append(i not in seen)
                    seen.add(i)
                part = part.filter(pa.array(new, pa.bool_()))
                v = part.column("has").flatten().to_numpy()
                size = part.column("size").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                last = np.zeros(len(v), bool)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, v), len(common) - 1)] == v
                order = np.argsort(2 * row + last, kind="stable")
                place = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
                chosen = place < (size - np.ceil(similarity * size - 1e-9) + 1)[row]
                columns = [v[order][chosen], place[chosen].astype(np.int32), part.column("sid").to_numpy()[row[chosen]], size[row[chosen]].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["v", "place", "sid", "size"])

    return sets.select("sid", "size", "has").mapInArrow(made, "v long, place int, sid long, size int")


def index(sets: DataFrame, similarity: float, rounds: int = 2, often: int = 16, most: int = 200_000) -> DataFrame:
    """The prefixes of sets, without shingles that only one holds. Shingles that many prefixes hold go last in the order, which any order may do; this
    only makes fewer pairs share one."""
    common = np.zeros(0, np.int64)
    for _ in range(rounds):
        counts = prefixes(sets, similarity, common).groupBy("v").count().where(F.col("count") > often)
        found = [r["v"] for r in counts.orderBy(F.desc("count"), "v").limit(most).select("v").collect()]
        common = np.union1d(common, np.array(found, np.int64))
    rows = prefixes(sets, similarity, common).repartition(partitions(sets.sparkSession), "v").dropDuplicates(["v", "sid"])
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("v"))).where("n > 1").drop("n")
    out = materialise(shared, "prefixes")
    return out


def reaches(similarity: float) -> Column:
    """If two sets of which a shingle is the first shared one (at place and p_place) can be so similar."""
    shared = F.least(F.col("size") - F.col("place"), F.col("p_size") - F.col("p_place"))
    return shared + 1e-9 >= similarity / (1 + similarity) * (F.col("size") + F.col("p_size"))


def alike(similarity: float) -> Column:
    """If two sets (bits and size, p_bits and p_size) can be so similar: what differs in bits differs in the sets."""
    differ = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("p_bits")[i])) for i in range(8)), F.lit(0))
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("p_size")) + 1e-9


def candidates(named: DataFrame, nodes: DataFrame, similarity: float, crowd: int = 1000) -> DataFrame:
    """Pairs (a < b) of sets of different roots that share a shingle of their prefixes and can be so similar.

    A shingle of more than ``crowd`` prefixes is dealt in blocks, and each two of these are a task's work."""
    by = Window.partitionBy("v")
    several = named.withColumns({"n": F.count("*").over(by), "low": F.min("root").over(by), "high": F.max("root").over(by)}).where("low < high")
    held = several.drop("low", "high").join(nodes.select("sid", "bits"), "sid")
    held = materialise(held.withColumn("blocks", F.expr(f"cast((n - 1) div {crowd} + 1 as int)")).drop("n"), "crowded-prefixes", compression="zstd")
    own, every = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"), F.explode(F.expr("sequence(0, blocks - 1)"))
    left = held.withColumn("x", own).withColumn("y", every)
    right = held.withColumn("y", own).withColumn("x", every)
    right = right.select(*[F.col(c).alias("p_" + c) for c in right.columns])
    same = (F.col("v") == F.col("p_v")) & (F.col("x") == F.col("p_x")) & (F.col("y") == F.col("p_y"))
    pairs = left.join(right, same & (F.col("sid") < F.col("p_sid")) & (F.col("root") != F.col("p_root")) & reaches(similarity) & alike(similarity))
    asked = materialise(few(pairs.select(F.col("sid").alias("a"), F.col("p_sid").alias("b")).distinct()), "asked")
    discard(held)
    return asked


def near(asked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the different pairs (a, b) whose sets are so similar."""
    ids = asked.select(F.explode(F.array("a", "b")).alias("asked")).distinct()
    held = materialise(sets.select("sid", "has").join(ids, F.col("sid") == F.col("asked"), "left_semi").dropDuplicates(["sid"]), "asked-sets")
    compared = asked.join(held.select(F.col("sid").alias("a"), F.col("has").alias("a_has")), "a").join(held.select(F.col("sid").alias("b"), F.col("has").alias("b_has")), "b")
    both = F.size(F.array_intersect("a_has", "b_has"))
    out = materialise(few(compared.where(both + 1e-9 >= similarity * (F.size("a_has") + F.size("b_has") - both)).select("a", "b")), "near")
    discard(held)
    return out


def beside(named: DataFrame, nodes: DataFrame, similarity: float, turn: int, neighbours: int = 4) -> DataFrame:
    """Pairs (a < b) of sets of different roots, among the nearest ``neighbours`` of those that share a prefix's shingle, in
    an order of the turn's own."""
    order = Window.partitionBy("v").orderBy(F.xxhash64(F.lit(turn), "sid"))
    one = F.struct(*[F.col(c).alias("p_" + c) for c in ("sid", "size", "place", "root")])
    rows = named.select("*", F.array(*[F.lag(one, j).over(order) for j in range(1, neighbours + 1)]).alias("before"))
    rows = rows.select("sid", "size", "place", "root", F.inline(F.filter("before", lambda p: p.isNotNull())))
    pairs = rows.where((F.col("root") != F.col("p_root")) & reaches(similarity))
    pairs = pairs.select(F.least("sid", "p_sid").alias("a"), F.greatest("sid", "p_sid").alias("b")).distinct()
    left = nodes.select(F.col("sid").alias("a"), "size", "bits")
    right = nodes.select(F.col("sid").alias("b"), F.col("size").alias("p_size"), F.col("bits").alias("p_bits"))
    return pairs.join(left, "a").join(right, "b").where(alike(similarity)).select("a", "b")


def labelled(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """indexed with the root of each set: its component over the near pairs found, else itself."""
    joined = indexed.join(components(found), F.col("sid") == F.col("node"), "left")
    return materialise(joined.select(*indexed.columns, F.coalesce("root", "sid").alias("root")), "rooted-prefixes")


def pairs_left(named: DataFrame) -> int:
    """Number of pairs of different roots that share a shingle, counted for each shingle."""
    per = named.groupBy("v", "root").agg(F.count("*").cast("double").alias("c")).groupBy("v").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
    return int(per.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0)


def fingerprint_pairs(sets: DataFrame, nodes: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Pairs of sets whose fingerprints are equal or within the distance, one of each fingerprint, that can be so similar."""
    owners = materialise(sets.groupBy("fp").agg(F.min("sid").alias("owner")), "fingerprint-owners")
    same = sets.select("fp", "sid").distinct().join(owners, "fp").where("sid <> owner").select(F.least("sid", "owner").alias("a"), F.greatest("sid", "owner").alias("b"))
    linked = links(owners.select("fp"), distance).join(owners.toDF("a", "x"), "a").join(owners.toDF("b", "y"), "b")
    pairs = same.unionByName(linked.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    left = nodes.select(F.col("sid").alias("a"), "size", "bits")
    right = nodes.select(F.col("sid").alias("b"), F.col("size").alias("p_size"), F.col("bits").alias("p_bits"))
    return pairs.join(left, "a").join(right, "b").where(alike(similarity)).select("a", "b")


def rooted_near(sets: DataFrame, nodes: DataFrame, distance: int, similarity: float) -> DataFrame:
    """(of, root) of each set that is near another: its component over all near pairs.

    Pairs by fingerprints come first, then sets beside each other in the lists of shared shingles, in changing order, for as
    long as a turn joins a good part of what it compares and more pairs than the root of the rows, and more are left than rows: a dense group needs
    few of its pairs. Then all pairs that these did not join are compared, so none that joins two components is left out."""
    found = near(materialise(few(fingerprint_pairs(sets, nodes, distance, similarity)), "asked"), sets, similarity)
    indexed = index(sets, similarity)
    named = labelled(indexed, found)
    rows, turn = named.count(), 0
    while pairs_left(named) > rows:
        turn += 1
        asked = materialise(few(beside(named, nodes, similarity, turn)), "beside")
        more = near(asked, sets, similarity)
        found, before = found.unionByName(more), named
        named = labelled(indexed, found)
        n = more.count()
        done = n * n <= rows or 4 * n < asked.count()
        discard(before, asked)
        if done:
            break
    asked = candidates(named, nodes, similarity)
    rest = near(asked, sets, similarity)
    discard(indexed, named, asked)
    return components(found.unionByName(rest)).select(F.col("node").alias("of"), "root")


def keep_first(docs: DataFrame, k: int, distance: int, similarity: float) -> DataFrame:
    """Of each group of near copies among docs (doc_id, text, any more columns) one row: groups join texts whose shingle
    sets have a Jaccard similarity of at least ``similarity``, and what is joined to those.

    Texts whose fingerprints are within ``distance`` bits are compared first, as op9 finds them. At
    that similarity most pairs differ in more bits, so all others that share a shingle of their prefixes are
    compared too, and no pair is missed. The first, by doc_id (null first) and the text's hash, stays. Of
    equal rows one stays; null, empty and other texts without words are equal; no rows give none.
    """
    sets = shingle_sets(docs, k)
    grouped = sets.groupBy("sid").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min(F.struct("doc_id", "version")).alias("first"))
    nodes = materialise(grouped, "sets")
    roots = rooted_near(sets, nodes, distance, similarity)
    owned = nodes.select("sid", "first").join(roots, F.col("sid") == F.col("of"), "left")
    stays = owned.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    rows = materialise(sets.select("doc_id", "version"), "near-rows")
    kept = only(docs, rows, stays)
    discard(sets, nodes)  # what is left to do reads docs and the ids of copies
    return kept


def only(docs: DataFrame, rows: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of docs (doc_id and text's hash in rows) that are the first of a row of stays (first), each once."""
    stays = stays.select(F.col("first.doc_id").alias("s_doc"), F.col("first.version").alias("s_version"))
    same = F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("version") == F.col("s_version"))
    later = materialise(rows.join(stays, same, "left_anti").distinct().select(F.col("doc_id").alias("l_doc"), F.col("version").alias("l_version")), "near-copies")
    held = boxed(docs, doc=F.col("doc_id").cast("long"), version=F.xxhash64("text"))
    kept = held.join(later, F.col("doc").eqNullSafe(F.col("l_doc")) & (F.col("version") == F.col("l_version")), "left_anti")
    if not rows.groupBy("doc_id", "version").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc", "version"])
    return unboxed(kept, docs.columns)


def op9_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), k=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
