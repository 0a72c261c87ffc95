from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from clusterloom.functions import text as t
from clusterloom.functions import urls as u
from clusterloom.functions.html import Page, full_content, page_links, page_signal, signal_text
from clusterloom.functions.urls import resolve


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("phrase", "tokens"),
    [
        ("Foo_Bar baz-qux C++ x", ["foo", "bar", "baz-qux"]), ("jak często kosić trawnik", ["często", "kosić", "trawnik"]), ("i w na", []), ("", []), ("-- a--b", ["--", "a--b"]), ("TM™ ﬁne ①②", ["tmtm", "fine", "12"]),
        ("e\u0301te\u0301 caf\u00e9", ["\u00e9t\u00e9", "caf\u00e9"]), ("a\u00a0bc\u3000de", ["bc", "de"]), ("\U0001d400 \U00020000", ["\U00020000"]), ("bc bc BC", ["bc", "bc", "bc"]),
    ],
)
def test_tokens(spark, phrase, tokens):
    got = one(spark, t.tokenize(F.col("p")), p=phrase)
    assert [g.lower() for g in got] == tokens


def test_tokens_of_null_are_null(spark):
    assert spark.sql("select cast(null as string) p").select(t.tokenize(F.col("p"))).first()[0] is None


def test_stable_characters_are_stable():
    import re

    chars = [chr(c) for c in range(0x180) if re.match("[" + re.sub(r"\\x\{(\w+)\}", lambda m: "\\U" + m.group(1).zfill(8), t._STABLE) + "]", chr(c))]
    assert len(chars) > 300
    text = "".join(a + b for a in chars for b in chars[::7])
    assert unicodedata.normalize("NFKC", text) == text


def test_white_space(spark):
    assert one(spark, t.squeeze(F.col("p")), p=" \u00a0a \t\n b\u3000\ufeff") == "a b"
    assert one(spark, t.trim(F.col("p")), p="\u2003 x y \u2029") == "x y"


def test_small_functions(spark):
    forms = spark.createDataFrame([(n,) for n in (1, 2, 5, 12, 22, 112)], "n long").select(t.plural(F.col("n"), "one", "few", "many"))
    assert [r[0] for r in forms.collect()] == ["one", "few", "many", "many", "few", "many"]
    assert one(spark, t.capitalized(F.col("p")), p="ßab") == "SSab" and one(spark, t.capitalized(F.col("p")), p="zażółć") == "Zażółć"
    keys = spark.createDataFrame([("1.1.1.1 , 2", "3"), ("", " 3 "), (None, None), (None, ""), (" ", "x")], "f string, r string")
    assert [r[0] for r in keys.select(t.client_key(F.col("f"), F.col("r"))).collect()] == ["1.1.1.1", "3", "unknown", "unknown", ""]
    assert one(spark, t.clipped(F.col("p"), 3, "…"), p="abcd") == "abc…"


def test_url_columns(spark):
    for url, label in (("https://e.com/blog/my_first-post.html/", "my first post"), ("https://e.com/", "https://e.com/"), ("https://e.com", "https://e.com"), ("https://e.com/a.b.c?x=/y", "a.b")):
        assert one(spark, u.slug_label(F.col("p")), p=url) == label
    for path, skip in (("/a.PDF", True), ("/a.jpeg", True), ("/a.html", False), ("/pdf", False)):
        assert one(spark, u.is_skipped(F.col("p")), p=path) is skip and u.skipped(path) is skip


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("c", "http://ex.com/a/c"), ("../../d/./e", "http://ex.com/d/e"), ("//O.com:80/x#y", "http://o.com/x"), ("?q=\u00fc", "http://ex.com/a/b?q=%C3%BC"), ("#f", "http://ex.com/a/b?x"), ("https:foo", "https://foo/"), ("http:foo", "http://ex.com/a/foo"),
        ("a\\b", "http://ex.com/a/a/b"), ("ftp://x", None), ("javascript:1", None), ("http://[::1", None), ("/f\u00fcr ", "http://ex.com/f%C3%BCr"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://a b/", None), ("\thttp://E.x/\n", "http://e.x/"),
        ("http://u:p@h.x:81/", "http://h.x:81/"), ("/a/%2e%2E/b", "http://ex.com/b"), (".", "http://ex.com/a/"), ("http://1.2.3.4.5/", None), ("http://x:99999/", None), ("HTTPS://x:443", "https://x/"),
    ],
)
def test_resolve(href, want):
    found = resolve(href, resolve("HTTP://Ex.com:80/a/b?x#y"))
    assert (found and found.href) == want


def test_addresses(spark):
    v4 = {"172.15.0.1": False, "172.16.0.1": True, "100.64.0.1": True, "224.0.0.1": True, "8.8.8.8": False, "256.1.1.1": True, "": True, "1.2.3": True, "0.1.1.1": True, "a.b.c.d": True, "192.168.1.1": True, "169.254.169.254": True}
    v6 = {"::1": True, "::ffff:10.0.0.1": True, "fe80::1": True, "fd00::1": True, "2001:db8::1": False, "feb0::1": False, "::ffff:7f00:1": False, "FC00::": True}
    for ip, private in (v4 | v6 | {"x": True}).items():
        assert one(spark, u.private_address(F.col("p")), p=ip) is private
    for ip in ("feb0::1", "::ffff:7f00:1", "ff02::1"):
        assert one(spark, u.private_address(F.col("p"), True), p=ip) is True and u.is_private(ip)
    assert not u.is_private("8.8.8.8") and u.is_private("10.0.0.1") and u.is_private("x")


def test_page_parts():
    p = Page("<body><header><h1>T</h1></header><main><p>a</p><p>b</p></main></body>")
    assert (p.headings(), p.text(800), p.h1()) == (["T"], "ab", "T")
    p = Page("<html><head><title> x &amp; y </title><meta property='og:description' content=Y></head><body><noscript><h1>no</h1></noscript><script>var t='</p>';</script><h1>A<h2>B</h2><p>c<b>d</p>e</body>")
    assert (p.title(), p.description(), p.headings(), p.text(99)) == ("x & y", "Y", ["A", "B"], "ABcde")
    p = Page("<meta property='og:title' content='X'><meta name=description content=''><p>t")
    assert (p.title(), p.description(), p.text(9)) == ("X", "", "t")
    p = Page("<nav><article>no</article></nav><article>one<nav>x</nav></article><article>two</article>")
    assert p.text(99) == "one"
    assert Page("<h1>a</h1><h2> a </h2><h3>b</h3><h4>c</h4>").headings() == ["a", "b"]
    assert Page("").text(9) == "" and Page("<").title() == ""


def test_page_columns(spark):
    rows = [("<title>T</title><meta name=description content=D><h1>H</h1><main>" + "w " * 2000 + "</main>", "http://x.y/a/"), (None, None), ("", "no url"), ("<a href='b'>1</a><a href='#x'>2</a><a href='mailto:x'>3</a><a href='/c.pdf'>4</a><a>5</a><a href=''>6</a><a href='b'>7</a>", "http://x.y/a/")]
    df = spark.createDataFrame(rows, "html string, url string")
    signals = [r[0] for r in df.select(signal_text(page_signal("html"))).collect()]
    assert signals[0].startswith("T · D · H · w w") and len(signals[0]) == len("T · D · H · ") + 799
    assert signals[1:3] == ["", ""]
    assert [r[0] for r in df.select(page_links("html", "url")).collect()] == [[], [], [], ["http://x.y/a/b", "http://x.y/a/b"]]
    full = df.select(full_content("html").alias("c")).first()["c"]
    assert full["title"] == "T" and len(full["content"]) == 3999
    parts = spark.createDataFrame([("a" * 700, ["b" * 700], "c")], "t string, h array<string>, b string")
    cut = parts.select(signal_text(F.struct(F.col("t").alias("title"), F.lit(" ").alias("meta_description"), F.col("h").alias("headings"), F.col("t").alias("body_excerpt")))).first()[0]
    assert len(cut) == 1201 and cut.endswith("…")
