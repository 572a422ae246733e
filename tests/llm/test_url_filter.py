from snapscope.llm import url_filter
from snapscope.llm.queries import URL_RULES

URLS = {
    "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "https://badexample.com/de/x": ("badexample.com", "/de/x", None, None),
    "https://www.example.com/de/x": ("www.example.com", "/de/x", "example.com/de/", "block"),
    "https://example.com/den": ("example.com", "/den", None, None),
    "ftp://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.net": ("x.net", "", None, None),
    "http://x.net?/": ("x.net", "", None, None),
    "http://h.net#a://b/c": ("h.net", "", None, None),
    "x://a/b://c/d": ("a", "/b://c/d", None, None),
    "//no.scheme/x": ("", "", None, None),
    "": ("", "", None, None),
    None: ("", "", None, None),
    "http://ÄB.org/fr/é\nx": ("Äb.org", "/fr/é\nx", "org/fr/", "allow"),
    "http://" + "a" * 50_000 + ".net/": ("a" * 50_000 + ".net", "/", "net/", "block"),
}


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate([*URLS, None, "http://x.net"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, URL_RULES, url_filter.fit(url_filter.labelled_urls(spark))).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = URLS[u]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ((verdict,) if verdict else ("allow", "block"))


def test_model_tells_names_it_hasnt_seen(spark):
    weights = url_filter.fit(url_filter.labelled_urls(spark))
    bad = ["cheap-watches-shop", "mega-casino-online", "pills-store", "payday-loans-quick", "spam-mailer", "adult-cams"]
    good = ["city-museum", "weather-station", "gathering", "mathematics-school", "brotherhood", "riverside-farm"]
    pages = spark.createDataFrame([(i, f"https://www.{h}.example.com/en/{i}") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], weights).collect()}
    assert [got[i] for i in range(6)].count("block") >= 4 and [got[i] for i in range(6, 12)].count("allow") >= 4
    plan = url_filter.filter_urls(pages, [], weights)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_of_one_class_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    for labelled in (url_filter.labelled_urls(spark).limit(0), url_filter.labelled_urls(spark).where("label = 1")):
        assert url_filter.filter_urls(pages, [], url_filter.fit(labelled)).first().verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), URL_RULES, url_filter.fit(pages.selectExpr("url", "1 AS label").limit(0))).count() == 0
