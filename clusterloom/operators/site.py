"""Topic silos of sites: clusters of pages, internal links and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.text import token_set
from clusterloom.operators.clustering import grouped_lexically
from clusterloom.operators.naming import name_clusters
from clusterloom.operators.similarity import similar_pairs
from clusterloom.plans.ranking import numbered_by
from clusterloom.plans.runtime import cut

DUPLICATE = 0.7


def distinct_signals(pages: DataFrame, by: tuple[str, ...] = ("origin",)) -> DataFrame:
    """(by..., ord, phrase): each signal of a site once, at its first page."""
    return pages.groupBy(*by, F.col("signal").alias("phrase")).agg(F.min("ord").alias("ord"))


def site_groups(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(origin, ord, phrase, tokens, cluster, place): signals grouped by overlap of words within each site."""
    return grouped_lexically(distinct_signals(pages), by=("origin",), long_documents=True, most=most)


def expand(groups: DataFrame, named: DataFrame, pages: DataFrame) -> DataFrame:
    """(origin, cluster, rank, name, main_phrase, phrases, pages) with pages in place of signals.

    ``named`` are the clusters of ``groups``. Pages are in order of signals as the
    cluster lists them and then of ``ord``; the main phrase is the label of the
    first page of the main signal.
    """
    signals = named.select("origin", "cluster", F.posexplode("phrases").alias("pos", "signal"))
    rows = signals.join(pages, ["origin", "signal"])
    first = pages.groupBy("origin", "signal").agg(F.min(F.struct("ord", "label")).alias("f")).select("origin", F.col("signal").alias("main_phrase"), F.col("f.label").alias("main_label"))
    lists = rows.groupBy("origin", "cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "ord", "label", "url"))).alias("x"))
    listed = lists.select("origin", "cluster", F.transform("x", lambda p: F.struct(p["label"].alias("phrase"), p["url"].alias("url"))).alias("pages"))
    out = named.select("origin", "cluster", "rank", "name", "main_phrase").join(listed, ["origin", "cluster"]).join(first, ["origin", "main_phrase"])
    return out.select("origin", "cluster", "rank", "name", F.col("main_label").alias("main_phrase"), F.array_distinct(F.transform("pages", lambda p: p["phrase"])).alias("phrases"), "pages")


def link_suggestions(clusters: DataFrame, by: tuple[str, ...] = ("origin",)) -> DataFrame:
    """(by..., cluster, rank, name, seq, from_url, from_label, to_url, to_label, anchor).

    The pillar is the first page labelled with the main phrase, else the first
    page. It links to each page of another URL, and each of these links back.
    """
    labels = F.transform("pages", lambda p: p["phrase"])
    at = F.greatest(F.array_position(labels, F.col("main_phrase")), F.lit(1)).cast("int")
    led = clusters.where("size(pages) > 1").withColumn("pillar", F.element_at("pages", at))
    spokes = led.select(*by, "cluster", "rank", "name", "pillar", F.posexplode(F.filter("pages", lambda p: p["url"] != F.col("pillar.url"))).alias("pos", "spoke"))

    def link(a: str, b: str, nth: int):
        return F.struct((F.col("pos") * 2 + nth).cast("long").alias("seq"), F.col(f"{a}.url").alias("from_url"), F.col(f"{a}.phrase").alias("from_label"), F.col(f"{b}.url").alias("to_url"), F.col(f"{b}.phrase").alias("to_label"), F.col(f"{b}.phrase").alias("anchor"))

    return spokes.select(*by, "cluster", "rank", "name", F.inline(F.array(link("pillar", "spoke", 0), link("spoke", "pillar", 1))))


def duplicate_warnings(pages: DataFrame, threshold: float = DUPLICATE, by: tuple[str, ...] = ("origin",), dedupe_final_url: bool = False) -> DataFrame:
    """(by..., rank, url_a, label_a, url_b, label_b, similarity): pages of a site whose words overlap.

    ``dedupe_final_url`` leaves out pairs of one URL, which redirects can lead to.
    """
    key = list(by)
    sets = pages.select(*key, "ord", token_set(F.col("signal")).alias("tokens"))
    pairs = similar_pairs(sets, threshold, "overlap", by)
    a = pages.select(*key, F.col("ord").alias("i"), F.col("url").alias("url_a"), F.col("label").alias("label_a"))
    b = pages.select(*key, F.col("ord").alias("j"), F.col("url").alias("url_b"), F.col("label").alias("label_b"))
    named = lambda found: found.join(a, [*key, "i"]).join(b, [*key, "j"])
    order = [F.desc("similarity"), F.col("i"), F.col("j")]
    if key:
        out = named(pairs).where("url_a <> url_b") if dedupe_final_url else named(pairs)
        ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))
    else:  # numbered while they have no texts, so that these travel no more than they must
        kept = named(pairs).where("url_a <> url_b").select("i", "j", "similarity") if dedupe_final_url else pairs
        ranked = named(numbered_by(cut(kept), order, "rank"))
    return ranked.select(*key, "rank", "url_a", "label_a", "url_b", "label_b", "similarity")


def cluster_sites(pages: DataFrame) -> DataFrame:
    """(origin, cluster, rank, name, main_phrase, phrases, pages) for ``pages`` (origin, ord, url, label, signal)."""
    groups = site_groups(pages)
    return expand(groups, name_clusters(groups, ("origin",)), pages)
