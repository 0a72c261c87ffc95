from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clusterloom.engine import Engine
from clusterloom.errors import BlockedAddress, InvalidInput, Unavailable
from clusterloom.operators.merging import merge_plan, merge_similar, merge_sources
from clusterloom.operators.providers import CallableWriter
from clusterloom.operators.sinks import as_json, cluster_lines, event, link_lines, read_events, write_events, write_lines
from clusterloom.operators.site import duplicate_warnings, link_suggestions
from clusterloom.sources import fetching
from clusterloom.sources.crawl import candidates, crawl_stats, discover, site_links
from clusterloom.sources.robots import allowed_pages, rules_of
from clusterloom.sources.sitemaps import parsed, sitemap_urls

FETCHED = "url string, ok boolean, status int, final_url string, html string"


def test_robots(spark):
    files = [("a", "User-agent: *\nDisallow: /admin # x\nDisallow:\nUser-agent: Foo\nDisallow: /foo"), ("b", "User-agent: *\nUser-agent: Foo\nDisallow: /x"), ("c", None), ("d", "DISALLOW: /early\r\n USER-AGENT : * \r\ndisallow: /a:b\r\nDisallow: /a:b\r\nno colon\r\nDisallow: /c"), ("e", "")]
    rules = rules_of(spark.createDataFrame(files, "origin string, body string"))
    assert {r.origin: r.rules for r in rules.collect()} == {"a": ["/admin"], "d": ["/a:b", "/c"]}
    pages = spark.createDataFrame([("a", "/administrator"), ("a", "/x"), ("b", "/x"), ("z", "/admin")], "origin string, path string")
    assert {tuple(r) for r in allowed_pages(pages, rules).collect()} == {("a", "/x"), ("b", "/x"), ("z", "/admin")}


def test_sitemap_files(spark):
    xml = "<?xml version='1.0'?><urlset><url><loc> http://x/a?b=1&amp;c=2 </loc><image:loc>http://x/i</image:loc></url><!-- <loc>no</loc> --><url><loc><![CDATA[http://x/b]]></loc></url><loc></loc>"
    assert parsed(xml) == ("urlset", ["http://x/a?b=1&c=2", "http://x/b"])
    assert parsed("<sitemapindex><urlset/><loc>s</loc>")[0] == "index" and parsed(None) == ("unknown", []) and parsed("<html>")[0] == "unknown"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>s{i}</loc></sitemap>" for i in range(5)) + "</sitemapindex>"
    child = "<urlset><url><loc>{0}1</loc></url><url><loc>{0}2</loc></url></urlset>"
    files = spark.createDataFrame([("o", index), ("p", child.format("p")), ("q", "junk")], "origin string, body string")
    fetched = spark.createDataFrame([("s0", child.format("a")), ("s1", index), ("s2", child.format("c")), ("s3", child.format("d"))], "url string, body string")
    got = sorted(tuple(r) for r in sitemap_urls(files, fetched).collect())
    assert got == [("o", 1, "a1"), ("o", 2, "a2"), ("o", 3, "c1"), ("o", 4, "c2"), ("p", 1, "p1"), ("p", 2, "p2")]


def _home(n: int) -> str:
    return "".join(f"<a href='/p{i}'>x</a>" for i in range(n)) + "<a href='/p0'>again</a><a href='http://other.com/'>o</a>"


def test_links_are_followed_where_they_are_few(spark):
    homes = spark.createDataFrame([("http://a.com", "http://a.com/", _home(19)), ("http://b.com", "http://b.com/", _home(20))], "origin string, url string, html string")
    fetched = spark.createDataFrame([(f"http://{s}.com/p{i}", i != 1, 200, "", f"<a href='/deep{i}'>d</a><a href='/p1'>d</a>") for s in "ab" for i in range(20)], FETCHED)
    got = {}
    for r in site_links(homes, fetched).orderBy("ord").collect():
        got.setdefault(r.origin, []).append(r.url.split(".com")[1])
    assert got["http://b.com"] == [f"/p{i}" for i in range(20)]
    assert got["http://a.com"] == [f"/p{i}" for i in range(19)] + [f"/deep{i}" for i in range(10) if i != 1]


def test_candidates(spark):
    origins = spark.createDataFrame([("http://a.com",), ("http://b.com",)], "origin string")
    maps = spark.createDataFrame([("http://a.com", i, f"http://a.com/{i % 90}") for i in range(1, 100)] + [("http://a.com", 0, "http://evil.com/"), ("http://a.com", -1, "::")], "origin string, ord long, url string")
    links = spark.createDataFrame([("http://b.com", i, f"http://b.com/{i}") for i in range(1, 100)] + [("http://a.com", 1, "http://a.com/link")], maps.schema)
    rules = spark.createDataFrame([("http://a.com", ["/1"])], "origin string, rules array<string>")
    got = candidates(origins, maps, links, rules).orderBy("origin", "ord").collect()
    a = [r.url for r in got if r.origin == "http://a.com"]
    b = [r for r in got if r.origin == "http://b.com"]
    assert a[0] == "http://a.com/" and "http://a.com/1" not in a and "http://a.com/12" not in a and len(a) == 80 and len(set(a)) == 80
    assert len(b) == 60 and b[0].url == "http://b.com/" and {r.source for r in b} == {"links"}


@pytest.fixture(scope="module")
def fetched(spark):
    page = "<title>{0}</title><main>{1}</main>"
    rows = [
        ("http://s.com/", True, 200, "http://s.com/", "<title>Home</title><main>lawn garden seed</main>"), ("http://s.com/robots.txt", True, 200, "", "User-agent: *\nDisallow: /private"),
        ("http://s.com/sitemap.xml", True, 200, "", "<urlset>" + "".join(f"<url><loc>http://s.com/{p}</loc></url>" for p in ("a", "b", "c", "missing", "private/x", "my-slug.html", "a")) + "</urlset>"),
        ("http://s.com/a", True, 200, "http://s.com/a2", page.format("Lawn care", "lawn care spring mowing feeding grass")), ("http://s.com/b", True, 200, "http://s.com/b", page.format("Lawn feeding", "lawn care spring mowing feeding grass green")),
        ("http://s.com/c", False, 404, "http://s.com/c", ""), ("http://s.com/my-slug.html", True, 200, "http://s.com/my-slug.html", "<p></p>"), ("http://s.com/private/x", True, 200, "http://s.com/private/x", page.format("P", "secret")),
    ]
    return spark.createDataFrame(rows, FETCHED)


def test_discovery_and_engine(spark, fetched, tmp_path):
    pages, wanted = discover(fetched)
    got = {r.url: r for r in pages.collect()}
    assert set(got) == {"http://s.com/", "http://s.com/a2", "http://s.com/b", "http://s.com/my-slug.html"}
    assert (got["http://s.com/my-slug.html"].label, got["http://s.com/my-slug.html"].signal) == ("my slug", "my slug")
    assert tuple(crawl_stats(wanted, pages).first()) == ("http://s.com", "sitemap", 4, 2)
    engine = Engine()
    site = engine.cluster_site(fetched)
    clusters = site.clusters.orderBy("rank").collect()
    assert clusters[0].phrases == ["Lawn care", "Lawn feeding", "Home"] or set(clusters[0].phrases) >= {"Lawn care", "Lawn feeding"}
    assert {r.url_a for r in site.duplicates.collect()} == {"http://s.com/a2"}
    assert site.links.count() >= 2 and site.stats.count() == 1
    lines = [r.line for r in cluster_lines(site.clusters).orderBy("ord").collect()]
    assert lines[0] == "Klaster\tFraza główna\tFraza\tURL" and len(lines) == 5
    write_lines(link_lines(site.links), str(tmp_path / "links"))
    assert spark.read.text(str(tmp_path / "links")).first()[0] == "Klaster\tOd\tDo\tSugerowany anchor"
    assert json.loads(as_json(site.stats).first()[0])["discovered"] == 4
    assert engine.capabilities() == {"embeddings": False, "semantic": False, "merging": False, "ai_available": False}
    with pytest.raises(InvalidInput):
        engine.cluster_site(fetched.limit(0))
    writer = CallableWriter(lambda s, u: json.dumps({"clusters": [{"name": "All", "mainPhrase": "x", "phrases": [line.split(". ", 1)[1] for line in u.splitlines() if ". " in line]}]}))
    semantic = Engine(writer=writer).cluster_site(fetched, "semantic")
    assert sum(len(r.pages) for r in semantic.clusters.collect()) == 4


def test_link_plan(spark):
    kind = "origin string, cluster long, rank long, name string, main_phrase string, pages array<struct<phrase:string,url:string>>"
    rows = [("o", 0, 1, "n", "B", [("A", "u1"), ("B", "u2"), ("C", "u3")]), ("o", 1, 2, "n", "A", [("A", "u1")]), ("o", 2, 3, "n", "A", [("A", "u1"), ("B", "u1")]), ("o", 3, 4, "n", "Z", [("A", "v1"), ("B", "v2")])]
    got = [(r.cluster, r.from_url, r.to_url, r.anchor) for r in link_suggestions(spark.createDataFrame(rows, kind)).orderBy("cluster", "seq").collect()]
    assert got == [(0, "u2", "u1", "A"), (0, "u1", "u2", "B"), (0, "u2", "u3", "C"), (0, "u3", "u2", "B"), (3, "v1", "v2", "B"), (3, "v2", "v1", "A")]


def test_duplicates(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [("o", 1, "u1", "A", words(0, 10)), ("o", 2, "u2", "B", words(3, 23)), ("o", 3, "u3", "C", words(4, 24)), ("o", 4, "u4", "D", ""), ("p", 5, "u1", "A", words(0, 10)), ("o", 6, "u1", "A", words(0, 10))]
    pages = spark.createDataFrame(rows, "origin string, ord long, url string, label string, signal string")
    got = [(r.rank, r.url_a, r.url_b, round(r.similarity, 3)) for r in duplicate_warnings(pages).orderBy("rank").collect()]
    assert got == [(1, "u1", "u1", 1.0), (2, "u2", "u3", 0.95), (3, "u1", "u2", 0.7), (4, "u2", "u1", 0.7)]
    assert {r.rank for r in duplicate_warnings(pages, dedupe_final_url=True).collect()} == {1, 2, 3}


def test_merging(spark):
    rows = [(1, "a", "A", "12345"), (2, "b", "B", "123456789"), (3, "c", "C", "123456789"), (4, "b", "B2", None)]
    plan = merge_plan(spark.createDataFrame(rows, "ord long, url string, label string, content string")).first()
    assert (plan.primary_url, plan.primary_label, plan.redirect_from_urls, plan.n_sources) == ("b", "B", ["a", "c"], 4)
    fetched = spark.createDataFrame([("x", True, 200, "http://x/", "<title>X</title><p>one"), ("y", True, 200, "http://y/p-q", "<p>three more"), ("z", False, 404, "", ""), ("e", True, 200, "http://e/", "<nav>x</nav>")], FETCHED)
    urls = lambda *u: spark.createDataFrame(list(enumerate(u)), "ord long, url string")
    for bad in (urls("x"), urls("x", " x "), urls(*"xyabcde"), urls("x", "z"), urls("x", "gone"), urls("x", "e")):
        with pytest.raises(InvalidInput):
            merge_sources(bad, fetched)
    with pytest.raises(Unavailable):
        merge_similar(urls("x", "y"), fetched)
    asked = []
    page = merge_similar(urls("x", "y"), fetched, CallableWriter(lambda s, u: asked.append(u) or '{"title":"T","metaDescription":"M","content":"C"}'), "ctx")
    assert (page.primary_url, page.redirect_from_urls, page.title, page.sources) == ("http://y/p-q", ["http://x/"], "T", [("http://x/", "X"), ("http://y/p-q", "p q")])
    assert "SOURCE 2: p q (http://y/p-q)" in asked[0]


def test_events(spark, tmp_path):
    rows = [("status", "s", 1, 2, None), ("done", None, None, None, "{}")]
    kind = "type string, message string, fetched int, total int, result string"
    write_events(spark.createDataFrame(rows, kind), str(tmp_path / "ok"))
    assert read_events(spark, str(tmp_path / "ok")).count() == 2
    for i, bad in enumerate(([rows[0]], [("error", "boom", None, None, None)])):
        write_events(spark.createDataFrame(bad, kind), str(tmp_path / f"bad{i}"))
        with pytest.raises(ValueError):
            read_events(spark, str(tmp_path / f"bad{i}"))
    assert json.loads(event("status", message="m", fetched=None)) == {"type": "status", "message": "m"}


def test_fetching(spark):
    public = lambda name: ["8.8.8.8"]
    for url in ("ftp://x", "no", "http://localhost/", "http://a.localhost/", "http://127.0.0.1/"):
        with pytest.raises(BlockedAddress):
            fetching.guarded(url, (lambda n: [n]) if "127" in url else public)
    with pytest.raises(BlockedAddress):
        fetching.guarded("http://x/", lambda n: ["8.8.8.8", "10.0.0.1"])
    with pytest.raises(BlockedAddress):
        fetching.guarded("http://x/", lambda n: [])
    hops = {"http://x/": (301, {"location": "/y"}, []), "http://x/y": (200, {}, [b"ab", b"cd"]), "http://x/none": (302, {}, []), "http://x/loop": (302, {"location": "/loop"}, []), "http://x/in": (302, {"location": "http://inside/"}, [])}
    get = lambda url, a, s: (hops[url][0], hops[url][1], iter(hops[url][2]))
    look = lambda n: ["10.0.0.1"] if n == "inside" else ["8.8.8.8"]
    assert fetching.safe_fetch("http://x/", look_up=look, get=get) == (True, 200, "http://x/y", "abcd")
    assert fetching.safe_fetch("http://x/none", look_up=look, get=get)[:2] == (False, 302)
    for bad in ("loop", "in"):
        with pytest.raises(BlockedAddress):
            fetching.safe_fetch(f"http://x/{bad}", look_up=look, get=get)
    assert fetching.read_capped([b"abc", b"de", b"f"], 4) == b"abc"
    assert [fetching.concurrency(x) for x in ("", "x", "3.7", "99", "-1", "0.5")] == [8, 8, 3, 16, 8, 0]

    def fake(url):
        if url == "b":
            raise BlockedAddress("no")
        return True, 200, url + "!", "t"

    urls = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "url string")
    assert {tuple(r) for r in fetching.fetch_pages(urls, 2, fake).collect()} == {("a", True, 200, "a!", "t"), ("b", False, 0, "b", "")}
    chain = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(8)], "from_url string, to_url string")
    ends = {r.url: (r.final_url, r.hops) for r in fetching.follow_redirects(spark.createDataFrame([("u3",), ("u0",), ("x",)], "url string"), chain).collect()}
    assert ends["u3"] == ("u8", 5) and ends["u0"][0] is None and ends["x"] == ("x", 0)
    hosts = spark.createDataFrame([("a",), ("b",), ("c",), ("localhost",)], "host string")
    answers = spark.createDataFrame([("a", "8.8.8.8"), ("b", "8.8.8.8"), ("b", "::1"), ("localhost", "8.8.8.8")], "host string, ip string")
    assert {r.host for r in fetching.blocked_hosts(hosts, answers).where(F.col("blocked")).collect()} == {"b", "c", "localhost"}
