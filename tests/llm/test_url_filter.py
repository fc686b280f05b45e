import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import url_filter as uf
from plumbline.llm.queries import RULES

PAGES = [
    (1, "http://WWW.Example.com/en/x?a=/b"), (2, "https://a.example.com/en/"), (3, "https://a.example.com"), (4, "x://notexample.com/en/"),
    (5, "http://m.b.net/es/1"), (6, "http://b.net/esx"), (7, None), (8, "no scheme"), (9, ""), (10, "a://b://c/d#e?f"), (11, "http://h.co.uk:80/q"),
    (12, "http://u@bad.org/1"), (12, "http://u@bad.org/1"), (None, "http://good.org/"), (13, "http://bad.org/" + "y" * 200_000),
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group(0)


def plain_rule(host, path):
    fits = []
    for kind, rule in RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, kind))
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_reputation(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string").select("page_id", F.lit(1).alias("Verdict"), "url", F.lit(2).alias("_host"))
    outcomes = [("http://bad.org/%d" % i, 1) for i in range(60)] + [("http://good.org/%d" % i, i % 20 == 0) for i in range(200)]
    outcomes += [("http://few.org/", 1)]
    known = spark.createDataFrame([(u, int(b)) for u, b in outcomes], "url string, bad int")
    got = uf.judge(pages, known, RULES)
    assert got.columns == ["page_id", "url", "_host", "host", "path", "rule", "verdict", "bad_rate", "bad_bound"]
    rows = got.collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r.host, r.path) == plain(r.url)
        rule, kind = plain_rule(r.host, r.path)
        assert r.rule == rule
        assert r.verdict == (kind or ("block" if r.bad_bound > uf.LIMIT else "allow"))
    assert {r.verdict for r in rows if r.host == "bad.org"} == {"block"}
    assert {r.verdict for r in rows if r.host == "good.org"} == {"allow"}
    assert uf.judge(pages.limit(0), known, RULES).count() == 0
    assert {r.bad_rate for r in uf.judge(pages, known.limit(0), RULES).collect()} == {0.0}


def test_shrinkage(spark):
    rows = [("a.x.org", 1)] + [(f"h{i}.x.org", int(i % 10 == 0)) for i in range(300)] + [("u.x.org", None), ("v.y.com", None)]
    rows += [("b.x.org", 1)] * 50
    found = {r.host: r for r in uf.reputation(spark.createDataFrame(rows, "host string, bad bigint")).collect()}
    assert 0.1 < found["a.x.org"].bad_rate < found["b.x.org"].bad_rate < 1
    assert found["u.x.org"].bad_bound < found["b.x.org"].bad_bound


@pytest.mark.parametrize("host,domain,suffix", [("a.b.example.com", "example.com", "com"), ("w.a.co.uk", "a.co.uk", "co.uk"), ("disco.uk", "disco.uk", "uk"), ("localhost", "localhost", "localhost"), ("", "", "")])
def test_registered_domain(host, domain, suffix):
    m = re.search(uf.DOMAIN, host)
    assert (m.group(0), m.group(2)) == (domain, suffix)
