import re

import pytest

from conflictlake.llm import url_cascade as U


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for say, rule in U.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (say, rule)
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [None, "", "no scheme", "http://", "x://NET/", "x://net", "x://net?q=/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "https://xnet/a", "http://é.ORG/fr/ü#",
        "http://org/fr", "a://b://c.net/d", "http://www.example.com/de/1", "http://example.com/den", "x:\n://a.net/\nb?c", "http://a.net/" + "p" * 50_000]


@pytest.mark.parametrize("literal", [1 << 23, 0])
def test_verdicts(spark, monkeypatch, literal):
    monkeypatch.setattr(U, "LITERAL_BITS", literal)
    monkeypatch.setattr(U, "PART_BITS", 1 << 12)
    urls = URLS + [f"http://{h}/{d}/{i}" for i in range(400) for h in ("a.example.net", "b.example.com") for d in ("en", "de")] + URLS[:9]
    pages = spark.createDataFrame([(i, u, "h", "p", True) for i, u in enumerate(urls)], "page_id long, url string, host string, path string, listed boolean")
    got = {r["page_id"]: tuple(r[1:]) for r in U.judge(pages, keep=["page_id"]).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark, monkeypatch):
    """With almost no bits a key, many levels are needed, and membership stays exact."""
    monkeypatch.setattr(U, "BITS_PER_KEY", 2)
    keys = spark.range(3000).selectExpr("'h' as host", "cast(id as string) as path", "id % 3 = 0 as listed")
    levels = U.build(keys)
    assert len(levels) > 3
    out = U.member(keys, levels, "found")
    assert out.where("found <> listed").count() == 0


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, keep=["page_id"]).collect() == []
