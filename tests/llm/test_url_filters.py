from venuelake.llm import url_filters as u


def brute(url):
    """The contract, read plainly."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = []
    for verdict, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [
    "https://a.example.com/en/7", "https://a.example.com/en/71?x=1", "https://a.example.com/en/8", "http://EXAMPLE.COM/en/7#t", "http://notexample.com/en/7", "http://com/en/", "http://x.com/en",
    "http://b.net/de/8", "http://b.example.net/de/88/x", "http://example.net/de/9", "http://org/es/1", "http://a.org/ES/1", "http://a.org?/es/", "http://a.org#/es/", "no scheme.com/en/7", "://", "http://",
    "http://u:p@a.example.com:80/en/7", "http://ÉX.example.com/en/7", "http://www.cheap-pills.example.com/fr/1", "http://www.cheap-pills.example.com/en/71", "http://cheappills.example.com/", "", None, "http://a.com/en/\n?z", "x" * 100_000 + "://a.com/en/",
]


def test_against_the_contract(spark):
    rows = [(i, url, "clash", 1) for i, url in enumerate([*URLS, URLS[0]])]
    got = u.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(rows[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    by_url = {rows[r.page_id][1]: r for r in got}
    assert by_url["http://www.cheap-pills.example.com/fr/1"].verdict == "block"
    assert by_url["http://www.cheap-pills.example.com/en/71"].verdict == "allow"
    assert by_url["http://cheappills.example.com/"].verdict == "allow"


def test_only_candidate_rules_run(spark):
    rules = [u.host_path_rule("block", f"site{i}.example/x/") for i in range(500)]
    by_token, always = u.index_rules(rules, {"example": 10, "x": 9})
    assert not always and len(by_token) == 500 and all(len(v) == 1 for v in by_token.values())
    assert u.judge("a.site7.example", "/x/1", by_token, always, "allow") == ("site7.example/x/", "block")


def test_rules_without_a_token_still_run(spark):
    rule = u.host_path_rule("block", "é.ü/")
    assert rule.tokens == ()
    pages = spark.createDataFrame([(1, "http://a.é.ü/q"), (2, "http://ü/")], "page_id long, url string")
    assert [r.rule for r in u.filter_urls(pages, [rule], []).orderBy("page_id").collect()] == ["é.ü/", None]


def test_empty_table(spark):
    assert u.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
