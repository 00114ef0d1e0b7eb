"""URL verdicts against a plain walk over labels, on hosts of many labels, entries that disagree, odd dots, empty tables and clashing names."""

import random
import time

from wayline.llm import urlfilter

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[len(host) :].split("?")[0].split("#")[0]
    labels, best = host.split("."), None
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        for h, p, verdict in rules:
            if host and h and h.lower() == suffix and path.startswith(p or ""):
                best = max(best or (), (len(h) + len(p or ""), len(h), h.lower() + (p or ""), verdict))
    return host, path, best[2] if best else None, best[3] if best else default


def test_equals_a_plain_walk(spark):
    draw = random.Random(1)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "", "block"), ("a.b", None, "allow"), (".b", "/x", "block"), ("B.net", "/y/z", "allow"), ("", "/", "block"), (None, "/", "block"), ("é.net", "/", "allow")]
    label = lambda: draw.choice(["a", "b", "net", "example", "", "é", "NET", "xnet", "example.net"])
    urls = [f"{draw.choice(['http', 'x'])}://{'.'.join(label() for _ in range(draw.randrange(1, 6)))}{draw.choice(['', '/', '/en/q', '/x?y', '/y/z#k', '?/en/', '#'])}" for _ in range(400)] + [None, "", "no", "://", "http://net"]
    pages = spark.createDataFrame([(i, u, "clash", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, length int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)} and len({v[2] for v in got.values()}) >= 5


def test_hosts_of_many_labels_cost_no_more(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/", "allow")], RULES)

    def took(labels):
        pages = spark.createDataFrame([(1, "http://" + "a." * labels + "net/x"), (2, "http://b." + "c." * labels + "net/x")], "page_id long, url string")
        began = time.time()
        got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules).collect()}
        assert got == {1: "allow", 2: "block"}
        return time.time() - began

    took(1)
    few = min(took(1) for _ in range(2))
    assert took(200_000) < few + 3


def test_empty_tables(spark):
    rules = spark.createDataFrame([("net", "/", "block")], RULES)
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in urlfilter.judge(pages, rules.limit(0)).collect()] == [(1, "a.net", "/", None, "allow")]
