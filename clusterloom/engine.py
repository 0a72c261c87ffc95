"""The service functions: phrases, sites, merges, and what is available."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.errors import InvalidInput
from clusterloom.operators.clustering import Method, cluster_items, cluster_phrases
from clusterloom.operators.merging import MergedPage, merge_similar
from clusterloom.operators.providers import Embedder, Nothing, Writer
from clusterloom.operators.site import cluster_sites, distinct_signals, duplicate_warnings, expand, link_suggestions
from clusterloom.plans.runtime import cut
from clusterloom.sources.crawl import crawl_stats, discover


@dataclass(frozen=True)
class Phrases:
    method: Method
    clusters: DataFrame


@dataclass(frozen=True)
class Sites:
    """Clusters, suggested links, duplicate warnings and statistics, all by origin."""

    method: Method
    clusters: DataFrame
    links: DataFrame
    duplicates: DataFrame
    stats: DataFrame


@dataclass
class Engine:
    """Works on tables; providers are optional."""

    embedder: Embedder = field(default_factory=Nothing)
    writer: Writer = field(default_factory=Nothing)

    def capabilities(self) -> dict[str, bool]:
        return {"embeddings": self.embedder.is_available(), "semantic": self.writer.is_available(), "merging": self.writer.is_available(), "ai_available": self.embedder.is_available() or self.writer.is_available()}

    def cluster_phrases(self, phrases: DataFrame, method: Method = "lexical", context: str | None = None) -> Phrases:
        return Phrases(method, cluster_phrases(phrases, method, context, embedder=self.embedder, writer=self.writer))

    def cluster_site(self, fetched: DataFrame, method: Method = "lexical", context: str | None = None) -> Sites:
        """All sites of ``fetched`` at once for the lexical method, one site for the others; raises InvalidInput without any page.

        Pages and clusters are kept, as every result builds on them: a page is
        parsed once, and a site is clustered once.
        """
        found, wanted = discover(fetched)
        pages = cut(found)
        if pages.limit(1).count() == 0:
            raise InvalidInput("no page was found")
        if method == "lexical":
            clusters = cluster_sites(pages)
        else:
            origins = [r["origin"] for r in pages.select("origin").distinct().limit(2).collect()]
            if len(origins) > 1:
                raise InvalidInput("this method takes one site at a time")
            items = distinct_signals(pages, ()).select("ord", "phrase")
            told = cluster_items(items, method, context or origins[0], True, self.embedder, self.writer)
            named = told.withColumn("origin", F.lit(origins[0])).withColumn("cluster", F.col("rank"))
            clusters = expand(items, named, pages)
        clusters = cut(clusters)
        return Sites(method, clusters, link_suggestions(clusters), duplicate_warnings(pages), crawl_stats(wanted, pages))

    def merge_similar(self, urls: DataFrame, fetched: DataFrame, context: str | None = None) -> MergedPage:
        return merge_similar(urls, fetched, self.writer, context)
