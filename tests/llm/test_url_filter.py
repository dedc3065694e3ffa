import random
from collections import Counter

import pytest

from strandline.llm import url_filter

RULES = "host string, path string, verdict string"
URLS = "id long, url string, rule string, host int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h), len(p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "none"
    *_, block, rule = max(fits)
    return host, path, rule, "block" if block else "allow"


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    names = ["", "a", "b", "aa", "com", "org", "x-1", "é", "a:80"]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randrange(1, 5)))
    path = lambda: r.choice(["", "/", "//"]) + "/".join(r.choice(["", "en", "en1", "e", "fr", "1", "123"]) for _ in range(r.randrange(0, 4)))
    rules = [(h, path(), r.choice(["allow", "block"])) for _ in range(150) if (h := host())]
    rules += [("a", "/en", "allow"), ("a", "/en", "block"), ("a", "/en", "allow"), ("com", None, "allow")]
    urls = [f"{r.choice(['http', 'HTTPS', 'a://b'])}://{host().upper() if r.random() < 0.3 else host()}{path()}{r.choice(['', '?q=/en/1', '#://a/en', '?'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "://", "://a", "http://A/en\n\n/1", "http://a.com", "http://com?x", "x://" + "a." * 3000 + "com/" + "en/" * 3000] + ["http://a/en/1"] * 40
    return rules, urls


@pytest.mark.parametrize("limit", [0, 10_000])
def test_equals_brute_force(spark, case, limit, monkeypatch):
    rules, urls = case
    monkeypatch.setattr(url_filter, "RULES", limit)
    table = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(urls)], URLS).repartition(4)
    got = {r["id"]: tuple(r)[2:] for r in url_filter.judge(table, spark.createDataFrame(rules, RULES), default="none").collect()}
    assert len(got) == len(urls)
    plain = [(h, p or "", v) for h, p, v in rules]
    assert [got[i] for i in range(len(urls))] == [brute(u, plain) for u in urls]
    assert len(Counter(v[3] for v in got.values())) == 3


def test_longer_host_before_longer_path(spark):
    rules = spark.createDataFrame([("com", "/a/b/c/", "allow"), ("x.com", "/a", "block"), ("com", "/a/b", "block")], RULES)
    urls = spark.createDataFrame([("http://x.com/a/b/c/d",), ("http://y.com/a/b/c/d",), ("http://y.com/a/bc",)], "url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.judge(urls, rules).collect()] == [("x.com/a", "block"), ("com/a/b/c/", "allow"), ("com/a/b", "block")]


def test_edges(spark):
    none, some = spark.createDataFrame([], RULES), spark.createDataFrame([(None,), ("http://a/",)], "url string")
    assert [tuple(r) for r in url_filter.judge(some, none).collect()] == [(None, "", "", None, "allow"), ("http://a/", "a", "/", None, "allow")]
    assert url_filter.judge(spark.createDataFrame([], "url string"), spark.createDataFrame([("a", "/", "block")], RULES)).collect() == []
    for bad in [(None, "/", "block"), ("", "/", "block"), ("a", "/", "deny"), ("a", "/", None)]:
        with pytest.raises(ValueError):
            url_filter.judge(some, spark.createDataFrame([bad], RULES))


def test_very_deep_rules_travel(spark):
    """A trie deeper than a pickle may be: the rules are sent, and each worker builds it."""
    rules = spark.createDataFrame([("a." * 2000 + "com", "/" + "x/" * 3000, "block")], RULES)
    urls = spark.createDataFrame([("http://b." + "a." * 2000 + "com/" + "x/" * 3000 + "y",), ("http://" + "a." * 2000 + "com/" + "x/" * 2999,)], "url string")
    assert [r["verdict"] for r in url_filter.judge(urls, rules).collect()] == ["block", "allow"]
