"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

Equal lines are counted once. Of two lines within ``tau`` edits, the shorter one's tau + 1 segments
can't all be hit, so one of them stands in the longer line, at a place that the two lengths
bound. Segments go to an index by length, number and content; each line probes it with the
substrings of its own that could be one. A segment that many lines share is joined with segments of
what these lines have beside it, and so on. Candidates are verified by banded bit-parallel edit
distance: what both lines share at either end is taken off, then one word of 2 tau + 1 bits a
column holds the differences along the band's diagonals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.llm.common import boxed, components, discard, materialise, read, unboxed

LETTERS = "etaonirshl"
BITS = 6  # of a long, for each letter's count
LINES = 1 << 31  # more than a text has
COUNTS = "struct<letters: bigint, low: bigint, high: bigint>"
#: Ids of candidate lines are broadcast up to this number (16 MB), and shuffled with the lines beyond it.
MOST_BROADCAST = 2_000_000


def piece(length: Column, j: Column, parts: Column) -> tuple[Column, Column]:
    """0-based start and length of the j-th (from 0) of so many segments, the last ones longer by one."""
    short = F.call_function("div", length, parts).cast("int")
    longer = (length - short * parts).cast("int")  # so many have one more
    start = short * j + F.greatest(F.lit(0), j - parts + longer)
    return start.cast("int"), (short + F.when(j >= parts - longer, 1).otherwise(0)).cast("int")


def split(rows: DataFrame) -> DataFrame:
    """One step of the partition, of the rows that are ``open``. Each row is a stretch of a line, from ``at`` (0-based) on, ``n`` long, that is to be
    within ``t`` edits of a stretch ``m`` long (of the line itself where it is the shorter one, so m = n).

    A shorter stretch's t + 1 segments can't all be hit. Where segment j is not, with j edits at most
    before it and t - j after it, it stands in the longer stretch moved by at most j from the start
    and t - j from the end. The key takes the segment in; the longer of the two stretches beside it
    remains, with the edits of its side."""
    each = rows.withColumn("j", F.explode(F.expr("if(open, sequence(0, t), array(0))")))
    low, high = F.expr("greatest(-j, n - m - t + j)"), F.expr("least(j, n - m + t - j)")
    moves = F.when(F.col("indexed") | ~F.col("open"), F.array(F.lit(0))).when(low <= high, F.sequence(low, high))
    each = each.withColumn("e", F.explode(moves))
    start, size = piece(F.col("m"), F.col("j"), F.col("t") + 1)
    each = each.withColumns({"start": start, "size": size})
    key = F.xxhash64("key", "j", F.col("line").substr(F.col("at") + F.col("start") + F.col("e") + 1, F.col("size")))
    after = F.expr("m - start - size >= start")
    moved = lambda name, right, left: F.when(~F.col("open"), F.col(name)).when(after, F.expr(right)).otherwise(F.expr(left)).cast("int").alias(name)
    more = [c for c in rows.columns if c == "counts"]
    return each.select(
        *more, F.when(F.col("open"), key).otherwise(F.col("key")).alias("key"), "indexed", "open", "id", "line",
        moved("at", "at + start + e + size", "at"), moved("n", "n - start - e - size", "start + e"),
        moved("m", "m - start - size", "start"), moved("t", "t - j", "j"),
    )


def stretches(lines: DataFrame, tau: int, per_edit: int, indexed: bool) -> DataFrame:
    """Whole lines as rows of split(): each once for the index, and as the longer one for each possible difference in length;
    where it is longer by some, its id is told by -1 - id."""
    frames = []
    for t in range(1, tau + 1):
        most = F.lit(True) if t == tau else F.col("len") < (t + 1) * per_edit
        if indexed:
            own = lines.where((F.col("len") >= max(t * per_edit - t, t + 1)) & most).withColumn("m", F.col("len"))
            frames.append(own.select(F.xxhash64(F.lit(t), "m").alias("key"), F.lit(True).alias("indexed"), F.lit(True).alias("open"), "id", "line", F.lit(0).alias("at"), F.col("len").alias("n"), "m", F.lit(t).alias("t")))
        else:
            own = lines.where((F.col("len") >= max(t * per_edit, t + 1)) & most).withColumn("less", F.explode(F.expr(f"sequence(0, {t})")))
            own = own.withColumn("m", F.col("len") - F.col("less"))
            marked = F.when(F.col("less") > 0, -1 - F.col("id")).otherwise(F.col("id"))
            frames.append(own.where(f"m >= {t + 1}").select(F.xxhash64(F.lit(t), "m").alias("key"), F.lit(False).alias("indexed"), F.lit(True).alias("open"), marked.alias("id"), "line", F.lit(0).alias("at"), F.col("len").alias("n"), "m", F.lit(t).alias("t")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def crowded(rows: DataFrame, least: int, level: int) -> DataFrame:
    """(hot_key, n): the keys that over ``least`` open indexed stretches have."""
    found = rows.where("indexed and open and m > t").groupBy("key").agg(F.count("*").alias("n"))
    return materialise(found.where(F.col("n") > least).select(F.col("key").alias("hot_key"), F.col("n").alias("hot_n")), f"hot-segments-{level}")


def parted(lines: DataFrame, tau: int, per_edit: int, several: int, hot: int) -> DataFrame:
    """Index and probes as (key, indexed, id, counts).

    Rows of keys that over ``several`` lines have carry counts of their line's letters and letter pairs. Those of
    over ``hot`` lines are split further by what remains of them, as often as need be until that is too short."""
    index = split(stretches(lines, tau, per_edit, True))
    keys = crowded(index, several, 0)
    rows = index.unionByName(split(stretches(lines, tau, per_edit, False)))
    columns = ["key", "indexed", "id", "counts"]
    if keys.isEmpty():
        return rows.withColumn("counts", F.lit(None).cast(COUNTS)).select(columns)
    rows = rows.join(keys, F.col("key") == F.col("hot_key"), "left").withColumn("counts", F.when(F.col("hot_key").isNotNull(), counts(F.col("line"))))
    heavy = keys.where(F.col("hot_n") > hot)
    if heavy.isEmpty():
        return rows.select(columns)
    out, level = rows.where(F.coalesce("hot_n", F.lit(0)) <= hot).select(columns), 1
    rows = split(rows.where(F.col("hot_n") > hot).drop("hot_key", "hot_n"))
    while True:
        rows = materialise(rows, "hot-stretches", compression="zstd")
        keys = crowded(rows, hot, level)
        if keys.isEmpty():
            return out.unionByName(rows.select(columns))
        again = rows.join(keys, (F.col("key") == F.col("hot_key")) & F.col("open") & (F.col("m") > F.col("t")), "left")
        rows = split(again.withColumn("open", F.col("hot_key").isNotNull()).drop("hot_key", "hot_n"))
        level += 1


def counts(line: Column) -> Column:
    """letters() of the line, and the two bits of the number, modulo 4, of neighbouring letters in each of 64 classes of such pairs."""
    chars = F.split(line, "")
    classes = F.zip_with(chars, F.slice(chars, F.lit(2), F.char_length(line)), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(64)).cast("int"))

    def count(state: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), c)
        return F.struct(state["low"].bitwiseXOR(bit).alias("low"), state["high"].bitwiseXOR(state["low"].bitwiseAND(bit)).alias("high"))

    zero = F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    return F.aggregate(classes, zero, count, lambda s: F.struct(letters(line).alias("letters"), s["low"].alias("low"), s["high"].alias("high")))


def pairs_apart(a: Column, b: Column) -> Column:
    """At least so many letter pairs differ; one edit changes 4 at most."""
    odd = a["low"].bitwiseXOR(b["low"])
    two = a["high"].bitwiseXOR(b["high"]).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two)


def letters(line: Column) -> Column:
    """Counts of frequent letters, up to 63 each, in one long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
        out = out + F.shiftleft(F.least(n, F.lit((1 << BITS) - 1)).cast("long"), BITS * i)
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """Sum of the counts' differences; one edit changes it by 2 at most."""
    out = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        at = lambda c, i=i: F.shiftright(c, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))
        out = out + F.abs(at(a) - at(b))
    return out


def shared(a: Column, b: Column, end: bool) -> Column:
    """Number of characters at the start (or end) that a and b share, by bisection."""
    most = F.least(F.char_length(a), F.char_length(b))
    take = (lambda s, n: F.right(s, n)) if end else (lambda s, n: F.left(s, n))
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda p: F.pow(F.lit(2), p).cast("int"))
    grow = lambda n, step: F.when((n + step <= most) & (take(a, n + step) == take(b, n + step)), n + step).otherwise(n)
    return F.aggregate(F.filter(steps, lambda s: s <= most), F.lit(0), grow)


def edit_distance(pairs: DataFrame, tau: int) -> DataFrame:
    """pairs (with strings x, y) and ``distance``, right where it is at most tau, else above tau.

    With rows for x and columns for y, bit k of a column's words is row j - tau + k; vp and vn mark
    rows where the distance rises or falls from the row above. at_bottom follows the band's last row,
    and the rises below x's last row are taken off it in the end.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    rest = pairs.withColumn("head", shared(F.col("x"), F.col("y"), False))
    rest = rest.withColumns({"x": F.col("x").substr(F.col("head") + 1, F.char_length("x")), "y": F.col("y").substr(F.col("head") + 1, F.char_length("y"))})
    rest = rest.withColumn("tail", shared(F.col("x"), F.col("y"), True))
    cut = lambda c: F.left(F.col(c), F.char_length(c) - F.col("tail"))
    rest = rest.withColumns({"x": cut("x"), "y": cut("y")})
    chars = lambda c: F.filter(F.split(F.col(c), ""), lambda ch: ch != "")
    rest = rest.withColumns({"m": F.char_length("x"), "n": F.char_length("y"), "xs": chars("x"), "ys": chars("y")})

    def same(ch: Column, j: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(width):
            hit = F.coalesce(F.get("xs", j - tau + k) == ch, F.lit(False))
            out = out + F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        return out

    columns = F.transform("ys", same)

    def step(state: Column, eq: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
        hn = d0.bitwiseAND(vp)
        moved = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
            moved.bitwiseAND(hp).alias("vn"),
            (state["at_bottom"] + 1 - F.shiftright(d0, width - 1).bitwiseAND(F.lit(1))).alias("at_bottom"),
        )

    first = ((1 << (tau + 1)) - 1) << (width - tau - 1)
    start = F.struct(F.lit(first).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).cast("long").alias("at_bottom"))
    # the words now stand one column on: of their rows, those from x's end to the last followed
    mask = F.lit((1 << 2 * tau) - 1).cast("long") - F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("m") - F.col("n") + tau).cast("int")) + 1
    banded = F.aggregate(columns, start, step, lambda s: s["at_bottom"] - F.bit_count(s["vp"].bitwiseAND(mask)) + F.bit_count(s["vn"].bitwiseAND(mask)))
    far = F.abs(F.col("m") - F.col("n")) > tau
    out = F.when(far, F.lit(tau + 1)).when((F.col("m") == 0) | (F.col("n") == 0), F.greatest("m", "n")).otherwise(banded).cast("int")
    return rest.withColumn("distance", out).select(*[c for c in pairs.columns if c not in ("x", "y")], "distance")


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def document_key(docs: DataFrame) -> Column:
    """A number that orders docs by doc_id, null first, and tells texts of one doc_id apart by 30 bits of their hash."""
    number = F.coalesce(F.col("doc_id").cast("long").cast("decimal(20,0)") + F.lit(str((1 << 63) + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (number.cast("decimal(38,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.xxhash64("text").bitwiseAND(F.lit((1 << 30) - 1))).cast("decimal(30,0)")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, first, line, len) of each different line that is not blank; first is the number of its first
    place, the document's key times 2^31 plus the line's number in it. ids are fixed once written."""
    parts = docs.select(document_key(docs).alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "line")).where(~blank(F.col("line")))
    place = (F.col("doc") * F.lit(LINES).cast("decimal(10,0)")).cast("decimal(38,0)") + F.col("n")
    # a decimal, unlike a struct, can be updated in place, so lines are grouped without sorting them
    found = parts.groupBy("line").agg(F.min(place.cast("decimal(38,0)")).alias("first"))
    found = found.select(F.monotonically_increasing_id().alias("id"), "first", "line")
    return materialise(found.withColumn("len", F.char_length("line")), "lines", compression="zstd")


def near_lines(lines: DataFrame, tau: int, per_edit: int, several: int = 12, hot: int = 200) -> DataFrame:
    """All pairs (a, b) of ids of different lines within tau edits and within one for each per_edit characters of the longer."""
    rows = parted(lines, tau, per_edit, several, hot)
    index = rows.where("indexed").select("key", F.col("id").alias("a"), F.col("counts").alias("x"))
    probe = rows.where("not indexed").select(F.col("key").alias("p_key"), F.col("id").alias("b"), F.col("counts").alias("y"))
    shorter = (F.col("b") < 0) | (F.col("a") < F.col("b"))
    x, y = F.col("x"), F.col("y")
    alike = x.isNull() | ((letters_apart(x["letters"], y["letters"]) <= 2 * tau) & (pairs_apart(x, y) <= 4 * tau))
    own = F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b"))
    pairs = index.join(probe, (F.col("key") == F.col("p_key")) & shorter & alike).select("a", own.alias("b"))
    pairs = materialise(pairs.distinct(), "line-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if 2 * pairs.count() <= MOST_BROADCAST:
        asked = F.broadcast(asked)
    texts = materialise(lines.select("id", "line").join(asked, "id", "left_semi").withColumn("c", letters(F.col("line"))), "candidate-lines")
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("c").alias("a_c")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("c").alias("b_c"))
    allowed = F.least(F.lit(tau), F.call_function("div", F.greatest(F.char_length("x"), F.char_length("y")), F.lit(per_edit)))
    compared = pairs.join(left, "a").join(right, "b").where(letters_apart(F.col("a_c"), F.col("b_c")) <= 2 * tau)
    # written before it is filtered: a filter would be pushed down with a copy of all of the above
    checked = materialise(edit_distance(compared.select("a", "b", "x", "y", allowed.alias("allowed")), tau), "line-distances")
    discard(pairs, texts)
    return checked.where("distance <= allowed").select("a", "b")


def kept_lines(docs: DataFrame, tau: int, per_edit: int) -> DataFrame:
    """(doc, kept: line numbers) of the lines that come first in their class, by document key
    and number; lines are in a class if near ones link them."""
    lines = distinct_lines(docs)
    roots = components(near_lines(lines, tau, per_edit))
    firsts = lines.select("id", "first")
    linked = roots.join(firsts, F.col("node") == F.col("id")).select("id", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    later = linked.join(least, "root").where("first <> least").select("id")
    kept = firsts.join(later, "id", "left_anti")
    n = (F.col("first") % F.lit(LINES).cast("decimal(10,0)")).cast("int").alias("n")
    kept = kept.select("first", n).select(((F.col("first") - F.col("n")) / F.lit(LINES).cast("decimal(10,0)")).cast("decimal(30,0)").alias("doc"), "n")
    found = materialise(kept.groupBy("doc").agg(F.collect_list("n").alias("kept")), "kept-lines")
    discard(lines)
    return found


def dedup(docs: DataFrame, tau: int = 2, per_edit: int = 10) -> DataFrame:
    """docs (doc_id, text, any more columns) with text without repeated lines, and n_lines, n_removed.

    A line stays where it comes first in its class, over all documents by doc_id (null first). Two lines
    are near if at most tau edits make one the other, and at most one for each per_edit characters of
    the longer: so 2 edits from 20 characters on, 1 from 10 on, and shorter lines have to be equal.
    Blank lines (only spaces, tabs or carriage returns) stay and count in n_lines. A null text stays
    null with 0 lines. Rows equal in doc_id and text count as one document and get the same result.
    Columns named n_lines or n_removed are replaced; any other name may occur.
    """
    kept = kept_lines(docs.select("doc_id", "text"), tau, per_edit)
    rows = boxed(docs, doc=document_key(docs), whole=F.split("text", "\n"))
    joined = rows.join(kept.withColumnRenamed("doc", "k_doc"), F.col("doc") == F.col("k_doc"), "left")
    stays = F.filter("whole", lambda x, i: blank(x) | F.coalesce(F.array_contains("kept", i), F.lit(False)))
    joined = joined.withColumn("kept_whole", stays)
    count = lambda n: F.when(F.col("whole").isNull(), 0).otherwise(n).cast("long")
    return unboxed(joined, docs.columns, text=F.array_join("kept_whole", "\n"), n_lines=count(F.size("whole")), n_removed=count(F.size("whole") - F.size("kept_whole")))


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
