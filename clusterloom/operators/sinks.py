"""Exports: tab-separated lines, JSON, and progress events as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headers as spreadsheets of users expect them (fixed values).
CLUSTER_HEADER = ("Klaster", "Fraza główna", "Fraza")
LINK_HEADER = ("Klaster", "Od", "Do", "Sugerowany anchor")


def cluster_lines(clusters: DataFrame, with_urls: bool | None = None) -> DataFrame:
    """(ord, line): header and a line for each page, or each phrase of a cluster without pages.

    ``clusters`` has rank, name, main_phrase, phrases and perhaps pages
    (array of phrase, url). There is a URL column if any cluster has pages;
    nothing is quoted. A page list decides this with one pass unless ``with_urls`` says it.
    """
    has = "pages" in clusters.columns
    if with_urls is None:
        with_urls = has and clusters.where("size(pages) > 0").limit(1).count() > 0
    flat = F.transform("phrases", lambda p: F.struct(p.alias("phrase"), F.lit(None).cast("string").alias("url")))
    if has:
        flat = F.when(F.size("pages") > 0, F.transform("pages", lambda p: F.struct(p["phrase"].alias("phrase"), p["url"].alias("url")))).otherwise(flat)
    rows = clusters.select("rank", "name", "main_phrase", F.posexplode(flat).alias("pos", "p"))
    line = F.concat_ws("\t", "name", "main_phrase", F.col("p.phrase"), F.col("p.url"))
    body = rows.select(F.struct("rank", F.col("pos").cast("long").alias("pos")).alias("ord"), line.alias("line"))
    return _with_header(body, [*CLUSTER_HEADER, *(["URL"] if with_urls else [])])


def link_lines(links: DataFrame) -> DataFrame:
    """(ord, line) of suggested links (rank, seq, name, from_url, to_url, anchor)."""
    line = F.concat_ws("\t", "name", "from_url", "to_url", "anchor")
    return _with_header(links.select(F.struct("rank", F.col("seq").cast("long").alias("pos")).alias("ord"), line.alias("line")), LINK_HEADER)


def _with_header(body: DataFrame, header: Iterable[str]) -> DataFrame:
    first = body.sparkSession.range(1).select(F.struct(F.lit(0).cast("long").alias("rank"), F.lit(-1).cast("long").alias("pos")).alias("ord"), F.lit("\t".join(header)).alias("line"))
    return first.unionByName(body.withColumn("ord", F.struct(F.col("ord.rank").cast("long").alias("rank"), F.col("ord.pos").alias("pos"))))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file in order."""
    lines.orderBy("ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def as_json(rows: DataFrame) -> DataFrame:
    """(json) with one object a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def write_events(events: DataFrame, path: str) -> None:
    """Progress events (type, message, fetched, total, result) as JSON lines."""
    events.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def event(kind: str, **fields: object) -> str:
    """One line of a progress stream."""
    return json.dumps({"type": kind} | {k: v for k, v in fields.items() if v is not None}, ensure_ascii=False) + "\n"


def read_events(spark, path: str) -> DataFrame:
    """Events of a stream that ended; raises ValueError if it has an error or no result."""
    events = spark.read.schema("type string, message string, fetched int, total int, result string").json(path)
    ends = {r["type"]: r["message"] for r in events.where("type in ('done', 'error')").limit(10).collect()}
    if "error" in ends:
        raise ValueError(ends["error"])
    if "done" not in ends:
        raise ValueError("the stream ended without a result")
    return events
