"""Queries over a small web made from the pages: discovery as a whole, its parts, redirects, contents and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.functions.html import full_content, page_links
from clusterloom.functions.urls import origin
from clusterloom.operators.merging import merge_plan, merge_sources
from clusterloom.operators.site import cluster_sites, distinct_signals
from clusterloom.operators.sinks import as_json, cluster_lines, read_events, write_events
from clusterloom.plans.runtime import checkpoint_dir
from clusterloom.queries import _PAGES, _SITES, _part, kept_pages, query, read_pages, table
from clusterloom.sources.crawl import crawl_stats, discover
from clusterloom.sources.fetching import blocked_hosts, follow_redirects

_LINK = r"""CASE WHEN starts_with(h, '/') THEN origin || array_to_string(list_transform(string_split(h, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END), '') END"""
#: The web in SQL: each site's kind by its least page_id, its pages in order, and those that were fetched.
_WEB = f"""{_PAGES},
web AS (SELECT sig.*, html, row_number() OVER (PARTITION BY origin ORDER BY page_id) - 1 AS k, min(page_id) OVER (PARTITION BY origin) % 4 AS kind FROM sig JOIN (SELECT page_id, html FROM pages) USING (page_id)),
site AS (SELECT DISTINCT origin, kind FROM web WHERE kind < 3),
got AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN origin || '/moved/' || page_id ELSE url END AS final FROM web WHERE page_id % 5 <> 0)"""
_FOUND = f"""l1 AS (SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY min(k)) AS r, link FROM (SELECT origin, k, regexp_replace(url, '#.*$', '') AS link FROM web WHERE kind = 1) GROUP BY origin, link),
l2 AS (SELECT origin, r, n, {_LINK} AS link FROM (
  SELECT l1.origin, r, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href="([^"]+)"', 1), 1) AS n
  FROM l1 JOIN got ON got.url = l1.link WHERE r <= 10 AND (SELECT count(*) FROM l1 c WHERE c.origin = l1.origin) < 20)),
cd AS (
  SELECT origin, origin || '/' AS url, 0 AS a, 0 AS b, 0 AS c FROM site
  UNION ALL SELECT origin, url, 1, k % 4, k FROM web WHERE kind = 0 AND k % 4 < 3
  UNION ALL SELECT origin, url, 1, 0, k FROM web WHERE kind = 2
  UNION ALL SELECT origin, link, 1, 0, r FROM l1
  UNION ALL SELECT origin, link, 2, r, n FROM l2
), one AS (SELECT origin, url, min((a, b, c)) AS o FROM cd GROUP BY ALL),
ok AS (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY o) AS ord FROM one JOIN site USING (origin)
  WHERE NOT (kind = 0 AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/de/')) AND NOT (kind = 2 AND starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/fr/'))
), wanted AS (SELECT origin, CASE WHEN kind = 1 THEN 'links' ELSE 'sitemap' END AS source, ord, url FROM ok WHERE ord <= CASE WHEN kind = 1 THEN 60 ELSE 80 END)"""


def web(spark: SparkSession, sf: str) -> DataFrame:
    """``fetched`` for many sites: some with a sitemap index of four children, some with links only and no robots file, some with a plain sitemap, some whose home page failed."""
    pages = read_pages(spark, sf).withColumn("origin", origin(F.col("url")))
    first = Window.partitionBy("origin")
    pages = pages.withColumn("k", F.row_number().over(first.orderBy("page_id")) - 1).withColumn("kind", F.min("page_id").over(first) % 4)
    own = pages.select(
        "url", (F.col("page_id") % 5 != 0).alias("ok"), F.when(F.col("page_id") % 7 == 0, F.concat("origin", F.lit("/moved/"), "page_id")).otherwise(F.col("url")).alias("final_url"), "html"
    )
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    sites = pages.groupBy("origin", "kind").agg(F.sort_array(F.collect_list(F.struct("k", escaped.alias("url")))).alias("x"))

    def locs(rows) -> F.Column:
        return F.concat(F.lit("<urlset>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<url><loc>"), r["url"], F.lit("</loc></url>"))), ""), F.lit("</urlset>"))

    def file(rows: DataFrame, path: str, body, ok=True) -> DataFrame:
        url = F.concat("origin", F.lit(path))
        return rows.select(url.alias("url"), F.lit(ok).alias("ok") if isinstance(ok, bool) else ok.alias("ok"), url.alias("final_url"), body.alias("html"))

    anchors = F.array_join(F.transform("x", lambda r: F.concat(F.lit('<a href="'), r["url"], F.lit('">p</a>'))), "")
    odd = '<title>Home</title><a href="mailto:a@b.c">m</a><a href="#top">t</a><a href="/file.pdf">f</a><a href="http://elsewhere.test/q">e</a>'
    indexed = sites.where("kind = 0")
    def child(i: int) -> DataFrame:
        return file(indexed, f"/map{i}.xml", locs(F.filter("x", lambda r: r["k"] % 4 == i)))

    index = F.concat(F.lit("<?xml version='1.0'?><sitemapindex>"), *(F.concat(F.lit("<sitemap><loc>"), "origin", F.lit(f"/map{i}.xml</loc></sitemap>")) for i in range(4)), F.lit("</sitemapindex>"))
    rule = F.when(F.col("kind") == 0, "User-agent: *\nDisallow: /de/").otherwise("User-agent: x\nDisallow: /en/\nUser-agent: *\nDisallow: /fr/ # none")
    parts = [
        own, file(sites, "/", F.concat(F.lit(odd), F.when(F.col("kind") == 1, anchors).otherwise("")), F.col("kind") < 3), file(sites.where("kind <> 1"), "/robots.txt", rule),
        file(sites.where("kind = 1"), "/robots.txt", F.lit("User-agent: *\nDisallow: /"), False), file(indexed, "/sitemap.xml", index), file(sites.where("kind = 2"), "/sitemap.xml", locs("x")), *map(child, range(4)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("ok"), 200).otherwise(404))


@query(f"WITH {_WEB}, {_FOUND} SELECT * FROM wanted")
def discovered_candidates(spark, sf):
    """What discovery would fetch, from home pages, robots files, sitemaps with children, and links over two hops."""
    return discover(web(spark, sf))[1]


@query(
    f"""WITH {_WEB}, {_FOUND} SELECT w.origin, ord, final AS url, label, signal FROM wanted w JOIN got USING (url)
UNION ALL SELECT origin, ord, url, 'Home', 'Home' || CASE WHEN kind = 1 THEN ' · mtfe' || repeat('p', (SELECT count(*) FROM web WHERE web.origin = w.origin)) ELSE ' · mtfe' END FROM wanted w JOIN site USING (origin) WHERE url = origin || '/'"""
)
def discovered_pages(spark, sf):
    """Pages of all sites as discovery leaves them: failed ones gone, final URLs, labels and signals."""
    return discover(web(spark, sf))[0]


@query(f"WITH {_WEB}, {_FOUND} SELECT origin, source, count(*) FILTER (url IN (SELECT url FROM got) OR url = origin || '/') AS discovered, count(*) FILTER (url NOT IN (SELECT url FROM got) AND url <> origin || '/') AS skipped FROM wanted GROUP BY origin, source")
def discovery_stats(spark, sf):
    pages, wanted = discover(web(spark, sf))
    return crawl_stats(wanted, pages)


@query(f"WITH {_PAGES} SELECT page_id, pos, {_LINK} AS link FROM (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1), 1)::INTEGER - 1 AS pos FROM sig JOIN (SELECT page_id, html FROM pages) USING (page_id))")
def page_link_lists(spark, sf):
    """The links themselves, resolved, in order, repeats included."""
    return table(spark, sf, "pages").select("page_id", F.posexplode(page_links(F.col("html"), F.col("url"))).alias("pos", "link"))


_CONTENT = f"""ct AS (SELECT page_id, url, {_part("<title>", "</title>")} AS title, {_part("<article>", "</article>")}[1:6000] AS content FROM pages)"""


@query(f"WITH {_CONTENT} SELECT page_id, title, content FROM ct")
def full_contents(spark, sf):
    return read_pages(spark, sf).select("page_id", full_content(F.col("html")).alias("c")).select("page_id", "c.title", "c.content")


@query(
    """WITH h AS (SELECT event_id, 'h' || event_id AS host, user_id % 4 AS n, event_id % 5 AS kind FROM events)
SELECT CASE WHEN kind = 4 THEN 'x' || event_id || '.LocalHost' ELSE host END AS host, kind = 4 OR n = 0 OR kind = 1 AND n > 1 OR kind = 2 AS blocked FROM h"""
)
def blocked_names(spark, sf):
    """Hosts by their addresses: none, one private among public ones, only public ones, and local names."""
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("n"), (F.col("event_id") % 5).alias("kind"))
    hosts = e.withColumn("host", F.when(F.col("kind") == 4, F.concat(F.lit("x"), "event_id", F.lit(".LocalHost"))).otherwise(F.concat(F.lit("h"), "event_id")))
    ip = F.when((F.col("kind") == 1) & (F.col("i") == 1), "10.1.2.3").when(F.col("kind") == 2, "fe80::1").otherwise("8.8.8.8")
    answers = hosts.where("n > 0").select("host", "kind", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).select("host", ip.alias("ip"))
    return blocked_hosts(hosts.select("host"), answers, strict=False)


@query("SELECT 'u' || event_id AS url, CASE WHEN event_id % 9 <= 5 THEN 'u' || event_id || '>' || (event_id % 9) END AS final_url, (event_id % 9 > 5)::INTEGER * 6 + (event_id % 9 <= 5)::INTEGER * (event_id % 9)::INTEGER AS hops FROM events WHERE event_id % 9 > 0 UNION ALL SELECT 'u' || event_id, 'u' || event_id, 0 FROM events WHERE event_id % 9 = 0")
def redirect_chains(spark, sf):
    """Chains of none to eight redirects, of which five are followed."""
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 9).cast("int").alias("n"))
    name = lambda i: F.when(i == 0, F.concat(F.lit("u"), "event_id")).otherwise(F.concat(F.lit("u"), "event_id", F.lit(">"), i))
    steps = e.where("n > 0").select("event_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select(name(F.col("i")).alias("from_url"), name(F.col("i") + 1).alias("to_url"))
    return follow_redirects(e.select(F.concat(F.lit("u"), "event_id").alias("url")), steps)


@query(f"WITH {_PAGES} SELECT origin, signal AS phrase, min(page_id) AS ord FROM sig GROUP BY ALL")
def site_signals(spark, sf):
    return distinct_signals(kept_pages(spark, sf))


@query(f"WITH RECURSIVE {_PAGES}, {_SITES} SELECT name || chr(9) || main_label || chr(9) || label || chr(9) || url AS line FROM pz JOIN nc USING (g, cluster) JOIN ml USING (g, cluster) UNION ALL SELECT 'Klaster' || chr(9) || 'Fraza główna' || chr(9) || 'Fraza' || chr(9) || 'URL'")
def site_export(spark, sf):
    """Clusters of all sites as lines with a URL column."""
    return cluster_lines(cluster_sites(kept_pages(spark, sf))).select("line")


@query(f"WITH RECURSIVE {_PAGES}, {_SITES} SELECT '{{\"origin\":' || to_json(g) || ',\"rank\":' || rank || ',\"name\":' || to_json(name) || ',\"main_phrase\":' || to_json(main_label) || '}}' AS json FROM nc JOIN ml USING (g, cluster)")
def site_json(spark, sf):
    """Clusters of all sites as JSON objects."""
    return as_json(cluster_sites(kept_pages(spark, sf)).select("origin", "rank", "name", "main_phrase"))


@query("SELECT 'status' AS type, 'p' || page_id AS message, page_id::INTEGER AS fetched, (SELECT count(*) FROM pages)::INTEGER AS total, NULL::VARCHAR AS result FROM pages UNION ALL SELECT 'done', NULL, NULL, NULL, '{}'")
def event_stream(spark, sf):
    """Progress events written as JSON lines and read back, with the check that the stream ended well."""
    pages = table(spark, sf, "pages")
    n = pages.agg(F.count("*").cast("int").alias("total"))
    status = pages.crossJoin(F.broadcast(n)).select(F.lit("status").alias("type"), F.concat(F.lit("p"), "page_id").alias("message"), F.col("page_id").cast("int").alias("fetched"), "total", F.lit(None).cast("string").alias("result"))
    done = spark.range(1).select(F.lit("done").alias("type"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("int").alias("fetched"), F.lit(None).cast("int").alias("total"), F.lit("{}").alias("result"))
    path = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    write_events(status.unionByName(done), path)
    return read_events(spark, path)


@query(
    f"""WITH {_CONTENT}, s AS (SELECT *, row_number() OVER (ORDER BY page_id) AS ord FROM ct ORDER BY page_id LIMIT 6)
SELECT arg_min(url, (-length(content), ord)) AS primary_url, arg_min(title, (-length(content), ord)) AS primary_label, array_to_string(list_filter(list(url ORDER BY ord), lambda x: x <> arg_min(url, (-length(content), ord))), '|') AS redirects, count(*) AS n_sources FROM s"""
)
def merged_sources(spark, sf):
    """The plan of a request to merge the first six pages, the most that a request takes."""
    pages = table(spark, sf, "pages")
    asked = pages.orderBy("page_id").limit(6).select(F.col("page_id").alias("ord"), "url")
    fetched = pages.select("url", F.lit(True).alias("ok"), F.lit(200).alias("status"), F.col("url").alias("final_url"), "html")
    plan = merge_plan(merge_sources(asked, fetched))
    return plan.select("primary_url", "primary_label", F.array_join("redirect_from_urls", "|").alias("redirects"), "n_sources")


_MESSY = [
    ("/a/../b/./c?q#f", "https://e.com/b/c?q"), ("b", "https://e.com/x/b"), ("../b", "https://e.com/b"), ("//o.com", "https://o.com/"), ("?q", "https://e.com/x/y?q"), ("HTTP://O.Com:80/P", "http://o.com/P"), ("https://o.com:443", "https://o.com/"), ("https://o.com:8443/", "https://o.com:8443/"),
    ("/sp ace/é", "https://e.com/sp%20ace/%C3%A9"), ("javascript:x", None), ("ftp://o.com/", None), ("http://", None), ("", "https://e.com/x/y"), ("#f", "https://e.com/x/y"), ("/%7Ea", "https://e.com/%7Ea"), ("http://o.com/a//b", "http://o.com/a//b"), ("\\b", "https://e.com/b"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {'NULL' if u is None else repr(u)})" for h, u in _MESSY) + ") t(href, url)")
def resolved_urls(spark, sf):
    """Hrefs of all kinds, resolved as the web platform does against https://e.com/x/y."""
    from clusterloom.functions.urls import resolve

    base = resolve("https://e.com/x/y")
    rows = [(h, u.href if (u := resolve(h, base)) else None) for h, _ in _MESSY]
    return spark.createDataFrame(rows, "href string, url string")


