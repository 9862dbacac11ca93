import pytest

from symgraph.llm import urls


def brute_rule(host, path):
    best = None
    for h, p, v in urls.DEFAULT_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


CASES = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1"),
    ("https://EXAMPLE.com/en/77?x=1#y", "example.com", "/en/77"),
    ("x://example.net/de/8", "example.net", "/de/8"),
    ("http://q.net/de/1", "q.net", "/de/1"),
    ("http://notcom/en/1", "notcom", "/en/1"),
    ("http://com/en/", "com", "/en/"),
    ("http://h.org?q", "h.org", ""),
    ("nothing", "", ""),
    (None, "", ""),
    ("http:///en/", "", "/en/"),
    ("a://b://c/d", "b:", "//c/d"),
    ("http://É.com/en/ß", "É.com", "/en/ß"),
]


@pytest.mark.parametrize("literal", [True, False])
def test_hosts_paths_rules(spark, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr(urls, "MAX_LITERAL_RULES", 1)
    df = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(CASES)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, (_, host, path) in enumerate(CASES):
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), CASES[i]


def test_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://a.fr/1", link("http://x.com/en/1")),  # alias of a blocked url without a page
        (2, "http://a.fr/2", "<META content='0; url=/1' http-equiv=refresh>"),  # alias by chain
        (3, "http://b.fr/1", link("//x.com/en/2")),
        (4, "http://b.fr/2", link("http://b.fr/1") + link("http://example.com/en/7")),  # an allowed alias wins
        (5, "http://x.net/de/1", link("http://x.com/en/9")),  # its own rule wins
        (6, "http://c.fr/1", "canonical" + "x" * 100000),
        (7, "http://c.fr/2", None),
        (8, None, link("http://x.com/en/1")),
        (1, "http://a.fr/1", ""),
        (9, "https://a.fr/1#frag", ""),  # the same url but for scheme and fragment
        (10, "http://d.fr/1", ""),
    ]
    df = spark.createDataFrame([(*p, "host") for p in pages], "page_id long, url string, html string, host string")
    moved = spark.createDataFrame([("http://d.fr/1", "http://a.fr/2"), (None, "http://a.fr/2")], "source string, target string")
    got = sorted((r.page_id, r.verdict) for r in urls.judge(df, moved).collect())
    blocked = {1, 2, 9, 10}
    assert got == sorted((p[0], "block" if p[0] in blocked else "allow") for p in pages)
    assert urls.judge(df.limit(0)).count() == 0
