"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from photark.llm import common, line_dedup, media_chunks, mixing, packing, registry, simhash, suffix_dedup, token_store, topk, toxicity, url_filter
from photark.llm.tokens import Encoder

WORDS = "the of and anly where thre ouen retith énon là über straße 12 345 x, y. (z) !!! Ab ABC don't".split()


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n"]) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string, extra string, fp string, key long"):
    """Rows of (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [(i, text(rng, rng.choice([3, 40, 200]))) for i in range(40)]
    long = text(rng, 3000)
    copies = [(100 + i, base[5][1]) for i in range(6)] + [(120, base[7][1] + base[8][1]), (121, "start " + base[7][1])]
    return [*base, *copies, (200, None), (201, ""), (202, long), (203, long[:9000]), (204, "a"), (205, "=" * 3000), (206, " \n\n "), (207, base[9][1].upper()), (208, "a <|endoftext|> b<|startoftext|>, <|EndOfText|>"), (209, "x" * 120 + "<|endoftext|>")]


@pytest.fixture(scope="module")
def odd(rows):
    """Also repeated rows, equal doc_ids and rows without one."""
    return [*rows, rows[0], (3, "another text under a doc_id that is taken"), (None, "no id at all, " * 20), (None, None)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    g = brute.Groups(range(200))
    for a, b in pairs:
        g.link(a, b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: g.root(n) for p in pairs for n in p if p[0] != p[1]} | {n: r for n, r in got.items() if g.root(n) == r and n not in got}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(g, i, i % 7) for g in (None, "a", "b") for i in range(50)], "g string, i int, v long")
    got = common.prefix_sums(df, [F.col("g"), F.col("i")], "v", "before", "g").collect()
    assert len(got) == 150 and all(r["before"] == sum(i % 7 for i in range(r["i"])) for r in got)


# 1: URL filter


def test_rules(spark):
    urls = {
        "https://www.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/x?y=1#z": ("a.net", "/es/x", "net/es/", "block"),
        "http://a.com": ("a.com", "", None, None),
        "http://a.com?x=/": ("a.com", "", None, None),
        "no scheme/en/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "x://y://z/": ("y:", "//z/", None, None),
    }
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.where("url = ''")).collect()} == {"allow"}


def test_trees_learn_labelled_urls(spark):
    """On urls whose rule is withheld, the trees agree with it."""
    rng = random.Random(2)
    urls = [f"http://{rng.choice('abcd')}{i}.{t}/{p}/{i}" for i in range(400) for t, p in [rng.choice([("com", "x"), ("net", "es"), ("net", "fr")])]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("allow", "com", "/"), ("block", "net", "/es/"))
    held = url_filter.judge(df, rules).where("rule is null and host like '%.net'").collect()
    assert held and np.mean([r["verdict"] == "block" for r in held]) > 0.9


# 2: line dedup


def test_edit_distance(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x = [rng.choice("abé") for _ in range(rng.randint(0, 14))]
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        rows.append((i, "".join(x), "".join(y)))
    for tau in (1, 2, 3):
        got = {r["i"]: r["distance"] for r in line_dedup.edit_distance(spark.createDataFrame(rows, "i int, x string, y string"), tau).collect()}
        for i, x, y in rows:
            want = brute.edits(x, y)
            assert got[i] == want if want <= tau else got[i] > tau


def test_line_dedup(spark, rows):
    rng = random.Random(6)
    lines = [text(rng, 9).replace("\n", " ") for _ in range(30)]
    docs = list(rows)
    for d in range(300, 340):
        own = [rng.choice(lines) for _ in range(4)]
        at = rng.randrange(4)
        own[at] = own[at][: rng.randint(0, 30)] + rng.choice(["", "q", "qq", "qqq"]) + own[at][rng.randint(30, 33) :]
        docs.append((d, "\n".join(own)))
    got = {r["doc_id"]: r for r in line_dedup.dedup(table(spark, docs)).collect()}
    want = brute.line_dedup(docs, 2, 10)
    for d, t in docs:
        assert got[d]["text"] == want[d], d
        assert got[d]["n_lines"] == (0 if t is None else t.count("\n") + 1)
        assert got[d]["extra"] == "x"
    assert line_dedup.dedup(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize(("several", "hot"), [(500, 500), (1, 500), (1, 1)])
def test_near_lines_of_frequent_segments(spark, several, hot):
    """Lines that share two thirds, or all but a word, in groups; short ones, and of all lengths around the limits."""
    rng = random.Random(11)
    start, end = "a common beginning of lines ", " and a common end of these lines"
    lines = {start + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) + end for _ in range(40)}
    lines |= {start + text(rng, 3).replace("\n", " ") for _ in range(20)} | {text(rng, 3).replace("\n", " ") + end for _ in range(20)}
    lines |= {"".join(rng.choice("ab") for _ in range(n)) for n in range(3, 25) for _ in range(4)} | {"x" * n for n in range(3, 30)}
    lines = sorted(lines)
    rows = [(i, x, len(x)) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "id long, line string, len int")
    want = {
        (a, b) if (len(x), a) < (len(y), b) else (b, a)
        for a, x in enumerate(lines) for b, y in enumerate(lines[:a])
        if abs(len(x) - len(y)) <= 2 and brute.edits(x, y) <= min(2, max(len(x), len(y)) // 10)
    }
    assert len(want) > 100
    assert {(r["a"], r["b"]) for r in line_dedup.near_lines(df, 2, 10, several, hot).collect()} == want


def test_line_dedup_blank_lines_and_clashing_names(spark):
    docs = [(1, "aaa\n\t\nbbb"), (2, "ccc\n\t\n \r\nbbb"), (3, None)]
    df = spark.createDataFrame([(d, t, 7, "k", "v", 9) for d, t in docs], "doc_id long, text string, n_lines int, kept string, k_doc string, version int")
    got = line_dedup.dedup(df)
    assert got.columns == [*df.columns, "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["kept"]) for r in got.collect()} == {1: ("aaa\n\t\nbbb", 3, 0, "k"), 2: ("ccc\n\t\n \r", 4, 1, "k"), 3: (None, 0, 0, "k")}


def test_line_dedup_repeated_rows(spark, odd):
    got = line_dedup.dedup(table(spark, odd)).collect()
    assert len(got) == len(odd)
    assert len({r["text"] for r in got if r["doc_id"] == 0}) == 1


# 3 and 5: tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_whole_texts(name):
    parts = [*"aé\n\t.,'!_1ß日", "É", "e\u0301", "  ", "\n\n", "\r\n", "'s", "...", "###", "İ", "Σ", "\u00a0", "\u3000", "\x1c", "\x00", "<|endoftext|>", "the", " of", "\u200d", "😀"]
    e = Encoder(public_tokenizers.path(name), keep=100)
    rng = random.Random(4)
    for _ in range(1500):
        t = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        for x, ids in zip(t, e.encode(t), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_unknown_tokenizers_encode_whole_texts_and_wide_ids_need_four_bytes(spark, tmp_path):
    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    k.pre_tokenizer = pre_tokenizers.Split(" of ", "isolated")
    k.save(str(tmp_path / "own.json"))
    e = Encoder(str(tmp_path / "own.json"))
    t = "one of them\n of those , x"
    assert e.kind is None and np.frombuffer(e.encode([t])[0], "<u4").tolist() == k.encode(t, add_special_tokens=False).ids
    k.add_tokens([f"own{i}" for i in range(20_000)])
    k.save(str(tmp_path / "wide.json"))
    docs = table(spark, [(1, "own19999 and own1"), (2, None)])
    with pytest.raises(ValueError, match="4 bytes"):
        token_store.write(docs, str(tmp_path / "wide.json"), 1, width=2)
    shards, shared = token_store.write(docs, str(tmp_path / "wide.json"), 1)
    want = {1: [*k.encode("own19999 and own1", add_special_tokens=False).ids, 1], 2: [1]}
    assert max(want[1]) > 65_535
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.contents(shards, shared).collect()} == {d: brute.crc(ids) for d, ids in want.items()}


def ids_of(name, t, end):
    k = Tokenizer.from_file(public_tokenizers.path(name))
    return [*k.encode(t or "", add_special_tokens=False).ids, end]


def test_token_store(spark, odd):
    shards, shared = token_store.write(table(spark, odd), public_tokenizers.path("word_bpe_49k.json"), 2, shard_bytes=2000)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.contents(shards, shared).collect()))
    start = 0
    for (s, d, n, c), (want_d, t) in zip(got, sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())), strict=True):
        ids = ids_of("word_bpe_49k.json", t, 2)
        assert (s, d, n, c) == (start, want_d, len(ids), brute.crc(ids))
        start += n
    blob = shards.first()["blob"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Shard(blob, shared + b"x")
    one = token_store.Shard(blob, shared)
    assert len(one.ids(len(one.index) - 1)) == one.index[-1]["n_ids"]
    empty, none = token_store.write(table(spark, odd).limit(0), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_store.contents(empty, none).count() == 0


def test_packing(spark, odd):
    got = packing.pack(table(spark, odd), public_tokenizers.path("byte_bpe_50k.json"), 1).toPandas()
    want = sorted((d is not None, d or 0, brute.crc(ids_of("byte_bpe_50k.json", t, 1))) for d, t in odd)
    assert len(want) == len(odd)
    total = sum(len(ids_of("byte_bpe_50k.json", t, 1)) for _, t in odd)
    assert got["length"].sum() == total
    texts = {}
    for d, t in odd:
        texts.setdefault(d, []).append(ids_of("byte_bpe_50k.json", t, 1))
    for r in got.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(ids) == r.doc_tokens and brute.crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts[d])
    padding = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["length"].cumsum() - s["length"]).tolist() == s["offset"].tolist()
        n = s["length"].sum()
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding <= 0.02 * total
    assert packing.pack(table(spark, odd).limit(0), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0


def test_cuts_cover():
    for n in [*range(1, 700), 2047, 2048, 2049, 5000, 123457]:
        pieces = list(packing.cuts(n, 2048, 128))
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p[1] for p in pieces) == n and all(k * m <= 2048 for _, m, k in pieces)


# 4: toxicity


def test_chain_on_held_out_rows(spark):
    rng = random.Random(8)
    bad, junk = ["vilex" + c for c in "abcdefgh"], ["%%%", "###"]
    docs, labels = [], []
    for i in range(600):
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        words = [rng.choice(WORDS) for _ in range(30)] + [rng.choice(bad)] * toxic + junk * low
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(low), int(toxic)))
    given = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, low_quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(table(spark, [*docs, (900, None), (901, "")]), given).collect()}
    assert len(got) == 602 and got[900]["p_toxic"] < 0.5 and got[900]["extra"] == "x"
    right = [(got[i]["p_toxic"] >= 0.5) == bool(t) and (got[i]["p_low_quality"] >= 0.5) == bool(q) for i, q, t in labels if i % 3 == 0]
    assert np.mean(right) > 0.97
    none = toxicity.classify(table(spark, docs[:5]), given.limit(0))
    assert {round(r["p_toxic"]) for r in none.collect()} == {0}


def test_rows_out_of_fold_are_not_scored_by_their_own_model(spark):
    """What one fold teaches is the opposite of what the other does: each row's probability is the other fold's."""
    from pyspark.ml.linalg import Vectors

    rows = [(f, Vectors.sparse(2, [x], [1.0]), float(x == f), f"{f}{x}") for f in (0, 1) for x in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, ["fold", "features", "toxic", "name"])
    models = [toxicity.fit(df.where(F.col("fold") != f), "toxic", 1e-4) for f in (0, 1)]
    got = {r["name"]: r["p"] for r in toxicity.out_of_fold(df, models, "p").select("name", "p").distinct().collect()}
    assert got["00"] < 0.05 and got["01"] > 0.95 and got["10"] > 0.95 and got["11"] < 0.05
    same = toxicity.out_of_fold(df, [20.0, -20.0], "p")
    assert {r["name"][0]: round(r["p"]) for r in same.collect()} == {"0": 1, "1": 0}


def test_scores_equal_the_chain_worked_out_by_hand(spark, odd):
    """The probabilities of all rows, repeated ones too, from the words, weights and earlier probabilities."""
    known = {t: i for i, t in enumerate(sorted({"the", "of", "4wher", "5straß", "!!!", "über", "unused"}))}
    rng = np.random.default_rng(5)
    models = [(np.concatenate([rng.normal(size=len(known)), np.zeros(0)]), -0.3), (np.concatenate([rng.normal(size=len(known)), [1.5]]), 0.2)]
    for w, _ in models:
        w[known["unused"]] = 0
    got = toxicity.score(table(spark, odd), (known, models), ("a", "b")).collect()
    assert len(got) == len(odd)
    for r in got:
        present = [known[t] for t in toxicity.terms(r["text"]) if t in known]
        first = 1 / (1 + np.exp(-(models[0][0][present].sum() - 0.3)))
        second = 1 / (1 + np.exp(-(models[1][0][present].sum() + 1.5 * first + 0.2)))
        assert r["p_a"] == pytest.approx(first) and r["p_b"] == pytest.approx(second)


# 6: suffix dedup


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_suffix_dedup(spark, rows, batches):
    got = {r["doc_id"]: r for r in suffix_dedup.remove(table(spark, rows), batches).collect()}
    ordered = sorted(rows)
    for (d, _), want in zip(ordered, brute.repeats([t for _, t in ordered]), strict=True):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) == want, d


def test_suffix_dedup_overlaps_and_edges(spark):
    rng = random.Random(9)
    letters = "".join(rng.choice("ab") for _ in range(400))
    docs = [(0, letters), (1, "x" + letters[50:150] + "y" + letters[51:151] + letters[149:249]), (2, letters[10:109]), (3, "abc" * 100), (4, "é" * 120), (5, letters[:130] + letters[200:330])]
    docs += [(6 + i, letters[i : i + 100 + i] + "".join(rng.choice("abc") for _ in range(60)) + letters[200 - i : 310]) for i in range(20)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove(table(spark, docs)).collect()}
    assert [got[d] for d, _ in docs] == brute.repeats([t for _, t in docs])


def test_suffix_dedup_odd_rows(spark, odd):
    got = suffix_dedup.remove(table(spark, odd)).collect()
    ordered = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = sorted((d is not None, d or 0, w) for (d, _), w in zip(ordered, brute.repeats([t for _, t in ordered]), strict=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in got) == want
    assert suffix_dedup.remove(table(spark, odd).limit(0)).count() == 0


# 7: media chunks


def test_media(spark, odd):
    stored = media_chunks.store(table(spark, odd))
    assert stored.objects.where("kind = 'recipe'").count() >= 7 and stored.pool.count() == stored.pool.select("digest").distinct().count()
    got = media_chunks.describe(media_chunks.load(stored)).collect()
    want = []
    for d, t in odd:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        media = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        want.append((d is not None, d or 0, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *r[1:7]) for r in got) == sorted(want)


def test_media_moves_all_when_the_filter_is_full(spark, rows):
    a = media_chunks.describe(media_chunks.load(media_chunks.store(table(spark, rows), bits=64)))
    b = media_chunks.describe(media_chunks.load(media_chunks.store(table(spark, rows))))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cut():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(100_000))
    chunks = media_chunks.cut(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= media_chunks.MOST and min(map(len, chunks[:-1])) >= media_chunks.LEAST
    moved = media_chunks.cut(b"some bytes before" + data)
    assert len(set(chunks) & set(moved)) > 0.8 * len(chunks)
    assert b"".join(media_chunks.cut(bytes(20_000))) == bytes(20_000)


# 8: mixing


def test_mixing(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice(["a", "b", "c", "B", None, "é"]) if i % 3 else "hot", rng.randint(0, 300)) for i in range(400)]
    sizes += [(900, "tiny", 1), (901, "empty", 0)]
    docs = spark.createDataFrame(sizes, "doc_id long, source string, size long")
    got = {r["doc_id"]: r for r in mixing.schedule(docs).collect()}
    names = sorted({s for _, s, _ in sizes if s is not None}, key=lambda s: s.encode()) + [None]
    size = {n: sum(z for _, s, z in sizes if s == n) for n in names}
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, stopped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[n] for n in stopped)
        level = left / sum(weight[n] for n in names if n not in stopped)
        above = {n for n in names if n not in stopped and level * weight[n] > 3 * size[n]}
        if not above:
            break
        stopped |= above
    for n in names:
        target = 3 * size[n] if n in stopped else level * weight[n]
        own = [got[d] for d, s, _ in sizes if s == n]
        assert all(abs(r["target"] - target) < 1e-6 * max(target, 1) for r in own)
        assert abs(sum(p["words"] for r in own for p in r["sent"]) - target) <= len(names)
        assert all(sum(p["words"] for p in r["sent"]) <= 3 * r["size"] for r in own)
    sent = sorted((p["virtual_finish"], p["source_rank"], p["ends"]) for r in got.values() for p in r["sent"])
    assert sum(p["words"] for r in got.values() for p in r["sent"]) == total
    waiting = mixing.packets(docs, "mix", 3).select(F.explode("packets").alias("p")).select("p.*").collect()
    assert sent == sorted((p["virtual_finish"], p["source_rank"], p["ends"]) for p in waiting)[: len(sent)] and len(sent) < len(waiting)
    assert mixing.schedule(docs.limit(0)).count() == 0


def test_mix_rows(spark, odd):
    docs = table(spark, odd).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 4))
    docs = docs.withColumns({c: F.lit(5) for c in ("rows", "copies", "size", "version", "packets", "sent", "target", "p", "row_", "m_size")})
    out = mixing.mix(docs)
    got = out.collect()
    assert [r["virtual_finish"] for r in got] == sorted(r["virtual_finish"] for r in got)
    assert {r["extra"] for r in got} == {"x"} and out.columns[: len(docs.columns)] == docs.columns
    words = sum(len((t or "").encode().split()) for _, t in odd)
    assert sum(r["taken_words"] for r in got) == words


# 9: SimHash


@pytest.mark.parametrize("hot", [2000, 2])
def test_simhash_links(spark, hot):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, 2**64 - 1}
    for b in base:
        fps |= {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for _ in range(5)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps if 0 <= f < 2**64)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for distance in (2, 4):
        want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
        assert {(r["a"], r["b"]) for r in simhash.links(df, distance, hot).collect()} == want


def test_allocation():
    cost, ts = simhash.allocate([[0, 5, 9, 50], [0, 1, 2, 3], [0, 9, 99, 999]], 2)
    assert sum(t + 1 for t in ts) == 3 and (cost, ts) == (3, [-1, 2, -1])


def test_simhash(spark, rows):
    docs = [*rows, *[(400 + i, rows[20][1].replace("the", "thé", i)) for i in range(4)]]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, docs)).collect()}
    fp = {d: brute.simhash(t, 3) for d, t in docs}
    g = brute.Groups(fp)
    for a in fp:
        for b in fp:
            if bin(fp[a] ^ fp[b]).count("1") <= 2:
                g.link(a, b)
    for d in fp:
        assert (got[d]["fp"] % 2**64, got[d]["component_id"]) == (fp[d], g.root(d))
    assert simhash.near_duplicates(table(spark, docs).limit(0)).count() == 0


def test_keep_first(spark, odd):
    got = simhash.keep_first(table(spark, odd), 5, 3, 0.8).collect()
    sets = [frozenset(brute.shingles(r["text"], 5)) for r in got]
    assert len(set(sets)) == len(sets)
    kept = set(sets)
    for _, t in odd:  # what went is near something that stayed
        s = frozenset(brute.shingles(t, 5))
        assert s in kept or any(len(s & k) >= 0.8 * len(s | k) for k in kept)
    assert all(r["extra"] == "x" for r in got)


def planted(base, changed):
    """base with a word of each of these numbers changed."""
    return " ".join(f"x{i}y" if i in changed else w for i, w in enumerate(base.split()))


def test_keep_first_finds_all_near_pairs(spark):
    rng = random.Random(8)
    docs = []
    for n in range(120):  # up to six neighbouring words changed: similarities of 0.81 to 0.90
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(100))
        start = rng.randrange(5, 80)
        docs += [(2 * n, base), (2 * n + 1, planted(base, {start + i for i in range(n % 7)}))]
    sets = {d: frozenset(brute.shingles(t, 5)) for d, t in docs}
    pairs = {(d, d + 1) for d in range(0, 240, 2) if len(sets[d] & sets[d + 1]) >= 0.8 * len(sets[d] | sets[d + 1])}
    bands = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    assert sum(0.8 <= x < 0.9 for x in bands) > 50
    kept = {r["doc_id"] for r in simhash.keep_first(table(spark, docs), 5, 3, 0.8).collect()}
    assert kept == set(sets) - {b for _, b in pairs}


def test_keep_first_keeps_one_of_a_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = [(50, base), (10, planted(base, range(20, 24))), (20, planted(base, range(70, 74))), (60, "other words " * 9)]
    sets = {d: frozenset(brute.shingles(t, 5)) for d, t in docs}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(50, 10) >= 0.8 and alike(50, 20) >= 0.8 and alike(10, 20) < 0.8
    assert sorted(r["doc_id"] for r in simhash.keep_first(table(spark, docs), 5, 3, 0.8).collect()) == [10, 60]


# 10: top-k


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * rng.uniform(0.1, 3)]) for i in range(700)]
    rows += [(800 + i, rows[100][1]) for i in range(15)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(1000, [0.5, 2.0]), (1001, [1.0, 1.0]), (1100, []), (1200, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, part int").repartition(3)
    got = {}
    for r in topk.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q, v in usable.items():
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable.items() if i != q and len(w) == len(v))[:10]
            assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)], q
    assert topk.search(df.limit(0)).count() == 0


def test_topk_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_nth"], r["rank"], r["vec_id"]) for r in topk.search(df).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1)]


# SQL


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()[want.columns]
    assert sorted(map(tuple, got.astype(object).values.tolist())) == sorted(map(tuple, want.astype(object).values.tolist()))
