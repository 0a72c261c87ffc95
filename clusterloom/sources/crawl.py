"""Page discovery over a table of fetched pages, for many sites at once.

The input is ``fetched`` (url, ok, status, final_url, html), one row for each URL
that was fetched; a URL without a row counts as failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.html import page_links, page_signal, signal_text
from clusterloom.functions.urls import slug_label, url_parts
from clusterloom.plans.runtime import cut
from clusterloom.sources.robots import disallowed, rules_of
from clusterloom.sources.sitemaps import sitemap_urls

#: Pages of a site at most, by where they were found.
FROM_SITEMAP, FROM_LINKS = 80, 60
#: Links below which the first pages are followed once more, and how many of them.
SPARSE, EXPANDED = 20, 10


def links_of(pages: DataFrame) -> DataFrame:
    """(origin, url, ord, link): links of ``pages`` (origin, url, html) to their own origin, in order, repeats included."""
    found = pages.select("origin", "url", F.posexplode(page_links(F.col("html"), F.col("url"))).alias("ord", "link"))
    parts = found.withColumn("p", url_parts(F.col("link")))
    return parts.where("p.origin = origin").select("origin", "url", F.col("ord").cast("long").alias("ord"), "link")


def site_links(homes: DataFrame, fetched: DataFrame, sparse: int = SPARSE, expanded: int = EXPANDED) -> DataFrame:
    """(origin, ord, url): links of the home pages (origin, url, html), and one hop further where they are few."""
    first = links_of(homes).groupBy("origin", "link").agg(F.min("ord").alias("ord"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("origin").orderBy("ord")).cast("long"))
    few = ranked.groupBy("origin").count().where(F.col("count") < sparse).select("origin")
    hop = ranked.where(F.col("ord") <= expanded).join(few, "origin").withColumnRenamed("link", "url")
    opened = hop.join(fetched.where("ok").select("url", "html"), "url").select("origin", "url", "html", F.col("ord").alias("from"))
    second = links_of(opened).join(opened.select("origin", "url", "from"), ["origin", "url"]).select("origin", F.col("link").alias("url"), F.struct(F.lit(1), "from", "ord").alias("at"))
    both = ranked.select("origin", F.col("link").alias("url"), F.struct(F.lit(0), F.lit(0).cast("long"), "ord").alias("at")).union(second)
    least = both.groupBy("origin", "url").agg(F.min("at").alias("at"))
    return least.withColumn("ord", F.row_number().over(Window.partitionBy("origin").orderBy("at")).cast("long")).select("origin", "ord", "url")


def candidates(origins: DataFrame, sitemap: DataFrame, links: DataFrame, rules: DataFrame, from_sitemap: int = FROM_SITEMAP, from_links: int = FROM_LINKS) -> DataFrame:
    """(origin, source, ord, url) of the pages to fetch.

    A site with any sitemap location uses its sitemap, else its links. The home
    page comes first; each URL counts once, as it is written. URLs of another origin,
    disallowed ones and what can't be parsed are left out, then the first of each
    site are kept.
    """
    mapped = sitemap.select("origin").distinct().withColumn("source", F.lit("sitemap"))
    sited = origins.select("origin").distinct().join(mapped, "origin", "left").withColumn("source", F.coalesce("source", F.lit("links")))
    home = sited.select("origin", F.lit(0).cast("long").alias("ord"), F.concat("origin", F.lit("/")).alias("url"))
    given = sitemap.unionByName(links.join(mapped, "origin", "left_anti"))
    every = home.unionByName(given.select("origin", "ord", "url")).groupBy("origin", "url").agg(F.min("ord").alias("ord"))
    parsed = every.withColumn("p", url_parts(F.col("url"))).where("p.origin = origin").join(rules, "origin", "left")
    kept = parsed.where(~disallowed(F.col("p.path"), F.col("rules"))).join(sited, "origin")
    ranked = kept.withColumn("ord", F.row_number().over(Window.partitionBy("origin").orderBy("ord", "url")).cast("long"))
    most = F.when(F.col("source") == "sitemap", from_sitemap).otherwise(from_links)
    return ranked.where(F.col("ord") <= most).select("origin", "source", "ord", "url")


def materialize(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(origin, ord, url, label, signal) of the pages in ``wanted`` (origin, ord, url) that were fetched.

    Python parses only these pages. Several rows of ``fetched`` for one URL are several pages.
    """
    return described(wanted.join(fetched.where("ok").select("url", "final_url", "html"), "url"))


def described(got: DataFrame) -> DataFrame:
    """(origin, ord, url, label, signal) of fetched pages ``got`` (origin, ord, final_url, html), row by row.

    The URL is the final one. The label is title, first heading or slug; a page
    without any signal has its label for one.
    """
    got = got.withColumn("s", page_signal(F.col("html")))
    label = F.coalesce(F.nullif("s.title", F.lit("")), F.nullif("s.h1", F.lit("")), slug_label(F.col("final_url")))
    told = got.select("origin", "ord", F.col("final_url").alias("url"), label.alias("label"), signal_text(F.col("s")).alias("signal"))
    return told.withColumn("signal", F.coalesce(F.nullif("signal", F.lit("")), "label"))


def crawl_stats(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, source, discovered, skipped) for each site; a wanted page counts once, however many rows ``pages`` (origin, ord) has for it."""
    got = pages.groupBy("origin").agg(F.countDistinct("ord").alias("discovered"))
    tried = wanted.groupBy("origin").agg(F.first("source").alias("source"), F.count("*").alias("tried"))
    return tried.join(got, "origin", "left").select("origin", "source", F.coalesce("discovered", F.lit(0).cast("long")).alias("discovered"), (F.col("tried") - F.coalesce("discovered", F.lit(0))).alias("skipped"))


def discover(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, candidates) of all sites whose home page was fetched.

    Home pages, robots and sitemap files are rows of ``fetched`` with path ``/``,
    ``/robots.txt`` and ``/sitemap.xml``. Candidates are computed at once and kept:
    pages and statistics both build on them.
    """
    placed = fetched.withColumn("p", url_parts(F.col("url")))
    named = placed.where("ok").select(F.col("p.origin").alias("origin"), F.col("p.path").alias("path"), "url", "html")

    def at(path: str) -> DataFrame:
        """(origin, url, html): the row of that URL; where there are only others with its path, such as with a query, the least of these."""
        best = F.min(F.struct(F.col("url") != F.concat("origin", F.lit(path)), "url", "html")).alias("x")
        return named.where(F.col("path") == path).groupBy("origin").agg(best).select("origin", "x.url", "x.html")

    homes = at("/")
    rules = rules_of(at("/robots.txt").select("origin", F.col("html").alias("body")))
    maps = sitemap_urls(at("/sitemap.xml").select("origin", F.col("html").alias("body")), fetched.where("ok").select("url", F.col("html").alias("body")))
    maps = maps.join(homes.select("origin"), "origin", "left_semi")
    links = site_links(homes.select("origin", F.concat("origin", F.lit("/")).alias("url"), "html"), fetched)
    wanted = cut(candidates(homes, maps, links, rules))
    return materialize(wanted, fetched), wanted
