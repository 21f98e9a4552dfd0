import re

import pytest

from evidoc.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://example.org/es/x", "https://sub.Example.ORG/en/12", "http://example.org/en/2", "http://org", "http://org/", "http://x.com/fr/1", "http://x.com/de/1",
    "http://com/de/", "http://notcom/de/", "http://example.org?q=/es/", "http://example.org#/es/", "ftp://a.example.org/es/?x#y", "://", "http:///path", "http://cheap-pills.net/", "http://net/cheap-pills/now",
    "http://a.b/?phpsessid=1", "http://a.b/casino/win/bonus", "http://a.b/casino/win/bonuses", "http://example.edu/casino/a/bonus", "http://casino.example.edu/x", "http://a.b/robots.txt", "http://a.b/click/track?x=1&affid=7", "a http://b.com/de/x://c", "http://münchen.net/ÄÖ?Ü", "HTTP://X.COM/FR/",
    "http://xcheap-pills.net/", "http://example.org/es/x",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, name, verdict = max(fits)
        return host, path, name, verdict
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    hits = [p for p in urlfilter.PATTERNS if re.search(urlfilter.expression(p), low, re.S)]
    return host, path, None, "block" if hits and not any(p.startswith("@@") for p in hits) else "allow"


def test_report_equals_trying_every_pattern(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.report(pages).collect()}
    assert got == {k: brute(u) for k, u in enumerate(URLS)}


def test_patterns_are_indexed_by_their_rarest_token():
    own = urlfilter.Filter((), ("/warez/*/keygen/",), {"warez": 5, "keygen": 2})
    assert list(own.index) == ["keygen"]
    with pytest.raises(ValueError):
        urlfilter.Filter((), ("*abc*",), {})


def test_patterns_by_rule_and_from_a_table(spark):
    assert len(urlfilter.PATTERNS) > 400 and all(urlfilter.whole_tokens(p) for p in urlfilter.PATTERNS)
    rules = spark.createDataFrame([("||bad.",), ("/worse/",), ("/worse/",), (None,)], "pattern string")
    own = urlfilter.table_patterns(rules)
    assert own == ("/worse/", "||bad.")
    pages = spark.createDataFrame([(1, "http://x.net/worse/1"), (2, "http://bad.net/"), (3, "http://x.net/casino/a/bonus")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.report(pages, patterns=own).collect()} == {1: "block", 2: "block", 3: "allow"}
    with pytest.raises(ValueError):
        urlfilter.table_patterns(rules, most=1)


def test_very_long_urls(spark):
    long = "http://a.net/" + "x/" * 500_000 + "casino/z/bonus"
    pages = spark.createDataFrame([(1, long), (2, long + "es"), (3, "http://" + "sub." * 50_000 + "example.org/es/x")], "page_id long, url string")
    assert {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.report(pages).collect()} == {1: ("block", None), 2: ("allow", None), 3: ("block", "example.org/es/")}


def test_null_ids_and_empty(spark):
    pages = spark.createDataFrame([(None, "http://x.com/de/1"), (None, None)], "page_id long, url string")
    assert sorted(r["verdict"] for r in urlfilter.report(pages).collect()) == ["allow", "block"]
    assert urlfilter.report(pages.limit(0)).count() == 0
