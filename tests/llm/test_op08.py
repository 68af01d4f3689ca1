"""URL filter: rules, host parts and shrinkage."""

from pyspark.sql import functions as F

from medcorpus.llm.op08_urls import filter_urls, host_levels, rule_of, url_parts

URLS = {
    "http://WWW.Example.com/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
    "https://a.example.com/en/b": ("a.example.com", "/en/b", "example.com/en/", "block"),
    "https://example.com/fr/": ("example.com", "/fr/", "com/", "allow"),
    "https://notexample.net/es/x": ("notexample.net", "/es/x", "net/es/", "block"),
    "ftp://u.net/fr/": ("u.net", "/fr/", "net/fr/", "block"),
    "http://x.com?q=/en/": ("x.com", "", None, "allow"),
    "http://É.com/é ": ("É.com", "/é ", "com/", "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "a://b://c.net/es/": ("b:", "//c.net/es/", None, "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == dict(enumerate(URLS.values()))


def test_levels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("x.y.org",), ("org",), ("",)], "h string")
    got = df.select(F.struct(*host_levels(F.col("h")))).collect()
    assert [tuple(r[0]) for r in got] == [("b.co.uk", "co.uk"), ("y.org", "org"), ("org", "org"), ("", "")]


def test_reputation(spark):
    pages, bad = [], []
    for d in range(12):
        for k in range(40):
            pages.append((len(pages), f"https://h{k % 4}.d{d}.org/x"))
            bad.append((len(pages) - 1, int(d < 3 or (d == 5 and k % 4 == 1))))
    pages += [(900, "https://new.d0.org/"), (900, "https://h0.d0.org/"), (901, "https://h1.d5.org/"), (902, "https://h2.d5.org/")]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad + bad[:9] + [(None, 1), (3, None)], "page_id long, bad int")).collect()
    verdict = {}
    for r in got:
        verdict.setdefault(r.host, set()).add(r.verdict)
    assert len(got) == len(pages)
    assert verdict["h0.d0.org"] == {"block"} and verdict["h1.d5.org"] == {"block"} and verdict["h2.d5.org"] == {"allow"} and verdict["h0.d9.org"] == {"allow"}


def test_empty(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert url_parts and rule_of


def test_hosts_without_outcomes(spark):
    pages, bad = [], []
    for suffix in ("org", "bad", "net"):
        for d in range(12):
            for k in range(40):
                bad.append((len(pages), int(suffix == "bad" or (suffix == "org" and d < 3))))
                pages.append((len(pages), f"https://h{k % 4}.d{d}.{suffix}/x"))
    new = {"new.d0.org": "block", "new.d9.org": "allow", "new.other.org": "allow", "new.d1.bad": "block", "new.other.bad": "block", "new.other.net": "allow", "new.other.info": "allow"}
    pages += [(9000 + k, f"https://{host}/") for k, host in enumerate(new)] + [(9000, "https://new.d0.org/")]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")).collect()
    assert len(got) == len(pages)
    assert {r.host: r.verdict for r in got if r.page_id >= 9000} == new
    mean = {r.host: r.bad_mean for r in got}
    assert mean["new.d0.org"] > 0.9 > 0.5 > mean["new.other.org"] > mean["new.d9.org"] and mean["new.other.bad"] > 0.9 and abs(mean["new.other.info"] - (15 * 40 + 0.5) / (36 * 40 + 1)) < 1e-9


def test_very_long_urls_and_own_suffixes(spark):
    host, path = "a." * 40_000 + "example.com", "/en/" + "x" * 200_000
    pages = spark.createDataFrame([(1, f"http://{host}{path}"), (2, f"http://www.example.com{path}")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.verdict) for r in filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == {1: (host, path, "block"), 2: ("www.example.com", path, "allow")}
    own = spark.createDataFrame([("x.y.gov.pl",), ("x.y.co.uk",)], "h string").select(F.struct(*host_levels(F.col("h"), [f"s{k}.pl" for k in range(3000)] + ["gov.pl"]))).collect()
    assert [tuple(r[0]) for r in own] == [("y.gov.pl", "gov.pl"), ("co.uk", "uk")]
