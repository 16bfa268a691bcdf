"""URL judgement against plain Python."""

import re

from ebbtide.llm import urls

URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "https://example.org/es/x", "http://Example.ORG/en/1",
        "http://example.org/en/2", "http://b.example.org/en/17?q", "http://xexample.org/es/", "http://a.com/fr/", "http://a.com/de/x#y",
        "http://casino.net/", "http://casinos.net/", "http://cheap-pills.net", "http://free.net/", "http://free.net/free/free",
        "http://a.net/?q=free+bets", "ftp://u:p@Host.COM:80/de/", "http://ÄRGER.com/fr/é", "a://b://c/d", "http://a.net\n/x", "x" * 9000,
        "://?a", "://#/", "http://a.net/ADULT", "http://a.net/adultery"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", tail).group()
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    terms = set(re.findall(r"[a-z0-9]+", (url or "").lower()))
    bad = terms & set(urls.STRICT) or len(terms & set(urls.SOFT)) > 1
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0]
    return host, path, None, "block" if bad else "allow"


def test_odd_urls(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)] * 2, "page_id long, url string, html string, rule string")
    out = urls.judge(pages).collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id]), URLS[r.page_id]
    assert urls.judge(pages.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: judged(r.url) for r in pages.collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()} == want
    assert {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}
