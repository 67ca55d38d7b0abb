"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

The URLs that a rule decides are the labelled ones. The trees are trained on a bounded sample of
them and judge the rest by length, depth, digit ratio, entropy, parameter counts and the block
rates of the host's suffixes in the sample. In training a URL's rates are those of the other folds, so
that no URL sees its own label in them, and one fold has none, so that the trees can do without.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photark.llm.common import materialise, read

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_LIST = 64  # so many rules are one expression; more are joined
FOLDS = 4
FEATURES = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "dashes", "top_rate", "site_rate"]


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path, else null; of equal
    length, block goes first, then the greater rule. For a short list, which becomes one expression."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):  # the last fits first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def looked_up(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, ruled) of different places (host, path) that a rule of (verdict, host, path) fits, chosen as decided()
    does; for any number of rules.

    A host is looked up by its suffixes of as many labels as a rule's host may have. What is found tells which lengths its
    rules' paths have, and the path's beginnings of these lengths are looked up with the host: both are joins on equal keys."""
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    labels = known.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 0
    lengths = known.groupBy("r_host").agg(F.collect_set(F.char_length("r_path")).alias("lengths"))
    depth = F.greatest(F.lit(1), F.least(F.lit(labels), F.size(F.split("host", r"\."))))
    each = places.select("host", "path", F.explode(F.sequence(F.lit(1), depth)).alias("n"))
    suffixes = each.withColumn("r_host", F.expr("substring_index(host, '.', -n)")).drop("n")
    begun = suffixes.join(lengths, "r_host").select("host", "path", "r_host", F.explode(F.filter("lengths", lambda k: k <= F.char_length("path"))).alias("k"))
    hits = begun.withColumn("r_path", F.expr("left(path, k)")).join(known, ["r_host", "r_path"])
    name = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.char_length(name).alias("n"), (F.col("r_verdict") == "block").alias("b"), name.alias("rule"), F.col("r_verdict").alias("ruled")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.ruled")


def ruled(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame) -> DataFrame:
    """urls (host, path, ...) with rule and ruled. rules are tuples or, in any number, a table (verdict, host, path)."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= SHORT_LIST:
            rule, verdict = decided(rules)
            return urls.withColumns({"rule": rule, "ruled": verdict})
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    found = looked_up(urls.select("host", "path").distinct(), rules)
    return urls.join(found, ["host", "path"], "left")


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the lexical features and the host's suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.char_length(url)
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    share = lambda c: (n - F.char_length(F.replace(url, c))) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda c, of: (F.char_length(c) - F.char_length(F.replace(c, F.lit(of)))).cast("double")
    labels = F.split("host", r"\.")
    return urls.select(
        "*", n.cast("double").alias("length"), F.char_length("host").cast("double").alias("host_length"),
        F.char_length("path").cast("double").alias("path_length"), F.size(labels).cast("double").alias("labels"),
        count(F.col("path"), "/").alias("depth"), (F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1))).alias("digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"), count(query, "=").alias("parameters"), F.char_length(query).cast("double").alias("query_length"),
        count(url, "-").alias("dashes"), F.element_at(labels, -1).alias("top"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("site"),
    )


def rates(sample: DataFrame, by: str, smooth: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Smoothed block rates of each suffix: of all rows, and for each fold but the first of the rows of the other folds. At most a
    row, or FOLDS, for each row of the bounded sample. Rows of the first fold go without, as urls of unknown suffixes do."""
    rate = lambda blocked, n: ((blocked + smooth / 2) / (n + smooth)).alias(f"{by}_rate")
    own = sample.groupBy(by, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    whole = own.groupBy(by).agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    others = own.where("fold > 0").join(whole, by).select(by, "fold", rate(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n")))
    return whole.select(by, rate(F.col("all_blocked"), F.col("all_n"))), others


def rated(features: DataFrame, tables: list[DataFrame]) -> DataFrame:
    for t in tables:
        features = features.join(F.broadcast(t), t.columns[:-1], "left").fillna(0.5, [t.columns[-1]])
    return features


def judge(pages: DataFrame, rules=RULES, most_labelled: int = 20_000, trees: int = 15, depth: int = 4) -> DataFrame:
    """One row a row of pages (page_id, url, any more columns): page_id, host, path, rule, verdict, score.

    score is the trees' probability of block, null where a rule decides. Null urls and urls without
    ``://`` have empty host and path, and are judged by the trees too. Training takes at most about
    ``most_labelled`` labelled urls, chosen by hash; where all labels agree, they are the verdict,
    and without any the verdict is allow. A score of 0.5 is a block; of rules of equal length block goes first. Urls of any
    length are judged whole. Repeated rows repeat their result.
    """
    urls = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = ruled(urls, rules)
    kinds = {r["ruled"]: r["count"] for r in urls.where("ruled is not null").groupBy("ruled").count().collect()}
    out = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        given = F.coalesce("ruled", F.lit(next(iter(kinds), "allow")))
        return urls.select(*out, given.alias("verdict"), F.lit(None).cast("double").alias("score"))
    kept = int((1 << 30) * min(1.0, most_labelled / sum(kinds.values())))
    labelled = urls.where("ruled is not null").where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < kept)
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sample = lexical(labelled.select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("label"), fold.alias("fold")))
    sample = materialise(sample, "labelled-urls")
    by_suffix = [rates(sample, "top"), rates(sample, "site")]
    tables, others = ([materialise(t, "suffix-rates") for t in ts] for ts in zip(*by_suffix, strict=True))
    steps = [VectorAssembler(inputCols=FEATURES, outputCol="features"), GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, labelCol="label", cacheNodeIds=False)]
    train = materialise(rated(sample, others).select("label", *FEATURES).coalesce(4), "url-features")
    model = Pipeline(stages=steps).fit(train)
    judged = model.transform(rated(lexical(urls), tables))
    score = F.when(F.col("ruled").isNull(), vector_to_array("probability")[1])
    return judged.select(*out, F.coalesce("ruled", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op1_url_filter(spark, sf_dir) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
