"""Sitemaps: their kind, their locations, and one level of an index."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.functions.html import squeeze

#: Child sitemaps of an index that are read.
CHILDREN = 3
_OUT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("locs", T.ArrayType(T.StringType()))])
_IGNORED = re.compile(r"<!--.*?(?:-->|\Z)|<\?.*?\?>", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_LOC = re.compile(r"<loc(?:\s[^>]*)?>(.*?)(?=</loc\s*>|\Z)", re.S)
_TAG = re.compile(r"<[^>]*>")


def parsed(xml: str | None) -> tuple[str, list[str]]:
    """Kind (index, urlset, unknown) and locations in order, repeats included.

    Malformed files are read as far as they go. Only unprefixed `loc` elements
    count, so that locations of images and videos don't.
    """
    body = _IGNORED.sub("", xml or "")
    plain: list[str] = []

    def keep(m: re.Match) -> str:
        plain.append(m.group(1))
        return f"\x00{len(plain) - 1}\x00"

    body = _CDATA.sub(keep, body)
    kind = "index" if re.search(r"<sitemapindex[\s/>]", body) else "urlset" if re.search(r"<urlset[\s/>]", body) else "unknown"
    texts = (unescape(_TAG.sub("", m)) for m in _LOC.findall(body))
    texts = (re.sub("\x00(\\d+)\x00", lambda m: plain[int(m.group(1))], t) for t in texts)
    return kind, [t for t in map(_trim, texts) if t]


def _trim(text: str) -> str:
    squeezed = squeeze(text)
    if not squeezed:
        return ""
    first, last = squeezed.split(" ")[0], squeezed.split(" ")[-1]
    return text[text.index(first) : text.rindex(last) + len(last)]


@F.pandas_udf(_OUT)
def sitemap(xml: pd.Series) -> pd.DataFrame:
    found = [parsed(x) for x in xml]
    return pd.DataFrame({"kind": [k for k, _ in found], "locs": [x for _, x in found]})


def sitemap_urls(files: DataFrame, fetched: DataFrame, children: int = CHILDREN) -> DataFrame:
    """(origin, ord, url): page locations of each origin's sitemap, in order, repeats included.

    ``files`` (origin, body) has the sitemap of each origin, ``fetched`` (url, body) what an
    index may refer to. Of an index the first ``children`` locations are read, and of these
    only plain URL sets; others and missing ones give nothing.
    """
    top = files.select("origin", sitemap(F.col("body")).alias("s"))
    own = top.where("s.kind = 'urlset'").select("origin", F.lit(0).alias("child"), F.posexplode("s.locs").alias("pos", "url"))
    index = top.where("s.kind = 'index'").select("origin", F.posexplode(F.slice("s.locs", 1, children)).alias("child", "at"))
    inner = index.join(fetched.select(F.col("url").alias("at"), "body").dropDuplicates(["at"]), "at").select("origin", "child", sitemap(F.col("body")).alias("s"))
    inner = inner.where("s.kind = 'urlset'").select("origin", "child", F.posexplode("s.locs").alias("pos", "url"))
    order = Window.partitionBy("origin").orderBy("child", "pos")
    return own.unionByName(inner).withColumn("ord", F.row_number().over(order).cast("long")).select("origin", "ord", "url")
