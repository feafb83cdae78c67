import random

import pytest

from chatloom.llm.url_filter import filter_urls, rules_table

HOSTS = ["com", "a.com", "b.a.com", "ba.com", "c.b.a.com", "org", "x.org", "a.com:80", ""]
PATHS = ["/", "/a", "/a/", "/a/b", "/ab", "", "/a/b/c"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def verdict(url, rules):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def urls(seed, n):
    rng = random.Random(seed)
    made = [rng.choice(["http", "https", "HTTP"]) + "://" + rng.choice(HOSTS).upper() * 1 + rng.choice(PATHS) + rng.choice(["", "?q=/a", "#f", "?x#y"]) for _ in range(n)]
    made += [f"http://h{i}.c.b.a.com/a/{i}" for i in range(40)] + ["http://a.com/a/b"] * 30  # a hot host, a hot url
    return made + [None, "", "nothing", "://", "://a.com", "http://É.a.com/é/ü", "http://a.com/\n/x", "http://a..com/", "http://.com/", "x://y://a.com/"]


@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h in HOSTS for p in PATHS if h and rng.random() < 0.5}.values())
    rules += [("É.a.com".lower(), "/é/", "block")]
    made = urls(seed, 150)
    pages = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate(made)], "page_id bigint, url string, host string, _at string")
    got = filter_urls(pages.repartition(3), rules_table(spark, rules)).collect()
    assert len(got) == len(made)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(made[r["page_id"]], rules), made[r["page_id"]]
        assert r["_at"] == "x"


def test_disagreeing_rules_and_hosts_in_capitals(spark):
    rules = rules_table(spark, [("A.com", "/", "allow"), ("a.com", "/", "block"), ("", "/", "block")])
    pages = spark.createDataFrame([("http://a.com/",), ("http://b.com/",)], "url string")
    assert {r["url"]: r["verdict"] for r in filter_urls(pages, rules).collect()} == {"http://a.com/": "block", "http://b.com/": "allow"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string")
    assert filter_urls(none, rules_table(spark, [("com", "/", "block")])).count() == 0
    one = spark.createDataFrame([("http://a.com/",)], "url string")
    assert filter_urls(one, rules_table(spark, [])).first()["verdict"] == "allow"
