"""URL rules in any number and trees on urls that no rule decides."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photark.llm import registry, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def by_rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def some_urls(rng):
    hosts = ["example.com", "www.example.com", "a.b.c.d.e.net", "x.net", "net", "WWW.Example.COM", "org", "q.org", ".net", "a..net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/es/1', '/fr/x/y', '/é/ü', '?a=/en/', '#/es/'])}" for _ in range(300)]
    return [*urls, None, "", "no scheme", "://", "x://net/es/" + "y" * 500_000, "http://" + "a." * 20_000 + "net/fr/", urls[0], urls[0]]


@pytest.mark.parametrize("many", [0, 300])
def test_rules_against_brute_force(spark, many):
    rng = random.Random(many)
    rules = [*url_filter.RULES, ("allow", "net", "/fr/"), ("block", "b.c.d.e.net", "/"), ("allow", "org", ""), ("block", "org", "")]
    rules += [(rng.choice(["allow", "block"]), rng.choice(["net", "x.net", "example.com", f"h{i}.org"]), f"/{rng.choice(['en', 'es', 'fr', 'é'])}{'x' * (i % 7)}") for i in range(many)]
    urls = some_urls(rng)
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filter.host(F.col("url")).alias("host"), url_filter.path(F.col("url")).alias("path"))
    got = url_filter.ruled(df, tuple(rules)).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(r["url"])
        assert (r["host"], r["path"]) == (host, path) and (r["rule"], r["ruled"]) == by_rule(host, path, rules)
    assert url_filter.ruled(df.limit(0), tuple(rules)).count() == 0


def pages_dir(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit("x"), "host": F.lit(1), "fold": F.lit(2)}).repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    return f"file://{tmp_path}"


def test_op1_against_brute_force(spark, tmp_path):
    """Every row as the rules say; the others by trees, which hold for urls like those that are blocked, and of a suffix that
    no rule knows."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(900):
        bad = i % 2
        site = f"{word(5)}.{'net' if bad else 'com'}" if i < 700 else f"{word(5)}.info"
        tail = f"{'es' if rng.random() < 0.5 else 'fr'}/{word(30)}?{'&'.join(f'{word(3)}={rng.randint(1, 10**6)}' for _ in range(6))}" if bad else f"{word(4)}"
        rows.append((i, f"http://{site}/{tail}"))
    rows += [(900 + i, u) for i, u in enumerate(some_urls(rng))] + [(None, rows[0][1])]
    got = registry.QUERIES["op1_url_filter"](spark, pages_dir(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, u in rows:
        host, path = parts(u)
        rule, verdict = by_rule(host, path, url_filter.RULES)
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (r["score"] is None) == (rule is not None)
        assert r["verdict"] == (verdict if rule else "block" if r["score"] >= 0.5 else "allow")
    unseen = [by[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(700, 900)]
    assert np.mean(unseen) > 0.9  # a suffix that no rule knows: by what the url looks like
    again = {r["page_id"]: tuple(r) for r in registry.QUERIES["op1_url_filter"](spark, pages_dir(spark, tmp_path / "again", rows)).collect()}
    assert again == {i: tuple(r) for i, r in by.items()}


def test_rates_leave_out_a_row_s_own_fold(spark):
    rows = [("a", 0, 1.0), ("a", 0, 1.0), ("a", 1, 0.0), ("b", 2, 1.0)]
    whole, others = url_filter.rates(spark.createDataFrame(rows, "top string, fold int, label double"), "top", 2.0)
    assert {r["top"]: r["top_rate"] for r in whole.collect()} == {"a": 3 / 5, "b": 2 / 3}
    assert {(r["top"], r["fold"]): r["top_rate"] for r in others.collect()} == {("a", 1): 3 / 4, ("b", 2): 0.5}
