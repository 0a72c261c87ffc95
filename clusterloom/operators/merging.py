"""Plans the merging of near-duplicate pages into one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.errors import InvalidInput, Unavailable
from clusterloom.functions.html import full_content
from clusterloom.functions.text import trim
from clusterloom.functions.urls import slug_label
from clusterloom.operators.providers import Nothing, Writer, merging_prompt, parsed_page
from clusterloom.operators.similarity import ordered_distinct

#: Sources of a merge.
LEAST, MOST = 2, 6


@dataclass(frozen=True)
class MergedPage:
    primary_url: str
    primary_label: str
    redirect_from_urls: list[str]
    title: str
    meta_description: str
    content: str
    sources: list[tuple[str, str]]


def merge_plan(sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., primary_url, primary_label, redirect_from_urls, n_sources) from (by..., ord, url, label, content).

    The longest content is the primary source, the first on ties; the other URLs,
    in order, redirect to it. A null content has length 0.
    """
    key = list(by)
    sized = sources.withColumn("length", F.length(F.coalesce("content", F.lit(""))))
    best = F.min(F.struct((-F.col("length")).alias("shorter"), "ord", "url", "label")).alias("best")
    groups = (sized.groupBy(*key) if key else sized).agg(best, F.sort_array(F.collect_list(F.struct("ord", "url"))).alias("every"), F.count("*").alias("n_sources"))
    others = F.transform(F.filter("every", lambda x: ~x["url"].eqNullSafe(F.col("best.url"))), lambda x: x["url"])
    return groups.select(*key, F.col("best.url").alias("primary_url"), F.col("best.label").alias("primary_label"), others.alias("redirect_from_urls"), "n_sources")


def merge_sources(urls: DataFrame, fetched: DataFrame) -> DataFrame:
    """(ord, url, label, content) for requested ``urls`` (ord, url) from ``fetched`` (url, ok, status, final_url, html).

    Raises InvalidInput for fewer than two or more than six different URLs, a page
    that wasn't fetched and a page without content.
    """
    wanted = ordered_distinct(urls.withColumn("url", trim(F.col("url"))).where("url <> ''"), "url")
    n = wanted.count()
    if n < LEAST:
        raise InvalidInput("give at least two URLs to merge")
    if n > MOST:
        raise InvalidInput(f"too many URLs: {n}, at most {MOST}")
    found = wanted.join(fetched, "url", "left").withColumn("page", full_content(F.col("html")))
    label = F.coalesce(F.nullif(F.col("page.title"), F.lit("")), slug_label(F.col("final_url")))
    out = found.select("ord", F.col("url").alias("asked"), F.col("final_url").alias("url"), label.alias("label"), F.col("page.content").alias("content"), F.coalesce("ok", F.lit(False)).alias("ok"), "status")
    for row in out.where("not ok or content = ''").orderBy("ord").limit(1).collect():
        raise InvalidInput(f"{row['asked']} has no content to merge" if row["ok"] else f"{row['asked']} could not be fetched (status {row['status']})")
    return out.select("ord", "url", "label", "content")


def merge_similar(urls: DataFrame, fetched: DataFrame, writer: Writer | None = None, context: str | None = None) -> MergedPage:
    """One page from several: the plan, and a language model's text."""
    sources = merge_sources(urls, fetched)
    writer = writer or Nothing()
    if not writer.is_available():
        raise Unavailable("merging needs a language model")
    plan = merge_plan(sources).first()
    rows = sources.orderBy("ord").collect()  # at most MOST
    page = parsed_page(writer.answer(*merging_prompt([(r["label"], r["url"], r["content"]) for r in rows], context)))
    return MergedPage(plan["primary_url"], plan["primary_label"], plan["redirect_from_urls"], page["title"], page["metaDescription"], page["content"], [(r["url"], r["label"]) for r in rows])
