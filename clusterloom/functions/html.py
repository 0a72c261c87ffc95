"""What a page says: title, headings, description, body text and links.

A small tree-less parser on top of the standard library's tokenizer follows the
rules of HTML that decide which element a text belongs to: void elements, raw
text, headings that end each other, and end tags that close what is open above
their element.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.text import SPACES, clipped, trim
from clusterloom.functions.urls import Url, resolve, skipped

#: Elements that hold no content of the page (fixed values).
BOILERPLATE = frozenset("nav header footer script style noscript svg form aside iframe template".split())
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Inline elements: their end tags don't close blocks that are open inside (fixed values).
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
_BLANK = dict.fromkeys(SPACES, " ")

EXCERPT, CONTENT, SIGNAL = 800, 6_000, 1_200
JOINT, MORE = " · ", "…"


def squeeze(text: str) -> str:
    return " ".join(x for x in text.translate(_BLANK).split(" ") if x)


class Page(HTMLParser):
    """Collects the texts of a page in one pass."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.titles: list[list[str]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.live: list[tuple[str, list[str]]] = []
        self.meta: dict[str, str] = {}
        self.hrefs: list[str] = []
        self.hidden = self.sheltered = 0
        self.main: list[str] | None = None
        self.main_depth = 0
        self.body: list[str] = []
        self.in_head = False
        self.raw = ""
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.raw:
            return
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "meta":
            for key in (f"name={named.get('name')}", f"property={named.get('property')}"):
                self.meta.setdefault(key, named.get("content", ""))
        elif tag == "a" and "href" in named and not self.sheltered:
            self.hrefs.append(named["href"])
        if tag in VOID:
            return
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self._pop(len(self.open) - 1)
        self.open.append((tag, False))
        if tag in BOILERPLATE:
            self.hidden += 1
        if tag == "template":
            self.sheltered += 1
        if tag == "title":
            self.titles.append([])
        if tag in _HEADINGS[:3] and not self.sheltered:
            self.live.append((tag, []))
            self.found.append(self.live[-1])
            self.open[-1] = (tag, True)
        if tag in ("main", "article") and self.main is None and not self.hidden:
            self.main, self.main_depth = [], len(self.open)
        if tag in _RAW:
            self.raw = tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag != self.raw:
                return
            self.raw = ""
        if tag == "head":
            self.in_head = False
        if tag in _HEADINGS:
            at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] in _HEADINGS), -1)
        else:
            at = next((i for i in reversed(range(len(self.open))) if self.open[i][0] == tag), -1)
        if at < 0 or tag in ("html", "body"):
            return
        if tag in _INLINE and any(name not in _INLINE for name, _ in self.open[at + 1 :]):
            return
        self._pop(at)

    def _pop(self, at: int) -> None:
        for tag, heading in reversed(self.open[at:]):
            self.hidden -= tag in BOILERPLATE
            self.sheltered -= tag == "template"
            if heading:
                self.live.pop()
        del self.open[at:]
        if self.main_depth > len(self.open):
            self.main_depth = 0

    def handle_data(self, data: str) -> None:
        if self.titles and any(tag == "title" for tag, _ in self.open):
            self.titles[-1].append(data)
            return
        if not self.raw and not self.sheltered:
            for _, parts in self.live:
                parts.append(data)
        if self.hidden or self.raw or self.in_head:
            return
        if self.main_depth:
            self.main.append(data)
        self.body.append(data)

    def title(self) -> str:
        return (squeeze("".join(self.titles[0])) if self.titles else "") or squeeze(self.meta.get("property=og:title", ""))

    def h1(self) -> str:
        return next((squeeze("".join(parts)) for tag, parts in self.found if tag == "h1"), "")

    def description(self) -> str:
        return squeeze(self.meta.get("name=description", "")) or squeeze(self.meta.get("property=og:description", ""))

    def headings(self) -> list[str]:
        return list(dict.fromkeys(filter(None, (squeeze("".join(parts)) for _, parts in self.found))))

    def text(self, most: int) -> str:
        return squeeze("".join(self.body if self.main is None else self.main))[:most]

    def links(self, base: Url) -> Iterator[str]:
        """Absolute http(s) links in order, repeats included, without mail, telephone, anchors and files."""
        for href in self.hrefs:
            if href and not href.startswith(("mailto:", "tel:", "#")):
                url = resolve(href, base)
                if url and not skipped(url.path):
                    yield url.href


_SIGNAL = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "headings" else T.StringType()) for n in ("title", "h1", "meta_description", "headings", "body_excerpt")])


@F.pandas_udf(_SIGNAL)
def page_signal(html: pd.Series) -> pd.DataFrame:
    """The parts of a page that tell its topic; a null page has empty ones."""
    pages = [Page(h or "") for h in html]
    return pd.DataFrame(
        {"title": [p.title() for p in pages], "h1": [p.h1() for p in pages], "meta_description": [p.description() for p in pages], "headings": [p.headings() for p in pages], "body_excerpt": [p.text(EXCERPT) for p in pages]}
    )


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def full_content(html: pd.Series) -> pd.DataFrame:
    """Title and body text of a page, for merging."""
    pages = [Page(h or "") for h in html]
    return pd.DataFrame({"title": [p.title() for p in pages], "content": [p.text(CONTENT) for p in pages]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(html: pd.Series, url: pd.Series) -> pd.Series:
    """Links of a page, resolved against its URL."""
    bases = [resolve(u) if u else None for u in url]
    return pd.Series([list(Page(h or "").links(b)) if b else [] for h, b in zip(html, bases, strict=True)])


def signal_text(signal: Column) -> Column:
    """Title, description, headings and excerpt as one line, each text once, at most ``SIGNAL`` characters and a mark."""
    parts = F.concat(F.array(signal["title"], signal["meta_description"]), signal["headings"], F.array(signal["body_excerpt"]))
    told = F.array_distinct(F.filter(F.transform(parts, trim), lambda x: x != ""))
    return clipped(F.array_join(told, JOINT), SIGNAL, MORE)


__all__ = ["Page", "full_content", "page_links", "page_signal", "signal_text"]
