"""Guarded fetching of pages. Nothing in the library fetches by itself: a job opts in by calling ``fetch_pages``."""

from __future__ import annotations

import http.client
import os
import socket
import ssl
import time
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.errors import BlockedAddress
from clusterloom.functions.urls import is_private, private_address, resolve

REDIRECTS, SECONDS, BYTES = 5, 8.0, 3_000_000
#: Pages fetched at once: default and most.
AT_ONCE, MOST_AT_ONCE = 8, 16
AGENT = "clusterloom/1.0"
SCHEMA = "url string, ok boolean, status int, final_url string, html string"


def concurrency(setting: str | None = None) -> int:
    """CRAWL_CONCURRENCY, rounded down, at most ``MOST_AT_ONCE``; unset and no positive number mean the default."""
    raw = os.environ.get("CRAWL_CONCURRENCY", "") if setting is None else setting
    try:
        value = float(raw)
    except ValueError:
        return AT_ONCE
    return min(int(value), MOST_AT_ONCE) if 0 < value < float("inf") else AT_ONCE


def read_capped(chunks: Iterable[bytes], most: int) -> bytes:
    """Chunks up to ``most`` bytes; the one that goes beyond is dropped whole, and what follows."""
    out, total = [], 0
    for chunk in chunks:
        total += len(chunk)
        if total > most:
            break
        out.append(chunk)
    return b"".join(out)


def guarded(url: str, look_up: Callable[[str], list[str]]) -> list[str]:
    """The public addresses of a URL's host; raises BlockedAddress for anything else."""
    parsed = resolve(url)
    if parsed is None:
        raise BlockedAddress("no http or https URL")
    name = urlsplit(parsed.href).hostname or ""
    if name == "localhost" or name.endswith(".localhost"):
        raise BlockedAddress("localhost is not allowed")
    try:
        found = look_up(name)
    except OSError as e:
        raise BlockedAddress(f"{name} can't be resolved") from e
    if not found or any(is_private(a) for a in found):
        raise BlockedAddress(f"{name} is in a network that isn't allowed")
    return found


def _look_up(name: str) -> list[str]:
    return list(dict.fromkeys(str(x[4][0]) for x in socket.getaddrinfo(name, None, proto=socket.IPPROTO_TCP)))


def _get(url: str, address: str, seconds: float) -> tuple[int, dict[str, str], Iterator[bytes]]:
    """One request to an address that has been checked, so that a second look-up can't lead elsewhere."""
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    sock = socket.create_connection((address, port), timeout=seconds)
    if parts.scheme == "https":
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
    conn = http.client.HTTPConnection(parts.hostname, port, timeout=seconds)
    conn.sock = sock
    conn.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": AGENT, "Host": parts.netloc})
    response = conn.getresponse()
    return response.status, {k.lower(): v for k, v in response.getheaders()}, iter(lambda: response.read(65_536), b"")


def safe_fetch(url: str, seconds: float = SECONDS, most: int = BYTES, look_up: Callable = _look_up, get: Callable = _get) -> tuple[bool, int, str, str]:
    """(ok, status, final URL, text); every hop is checked anew, up to ``REDIRECTS`` redirects."""
    now, until = url, time.monotonic() + seconds
    for _ in range(REDIRECTS + 1):
        address = guarded(now, look_up)[0]
        status, headers, chunks = get(now, address, max(0.1, until - time.monotonic()))
        if 300 <= status < 400:
            if not (target := headers.get("location")):
                return False, status, now, ""
            moved = resolve(target, resolve(now))
            if moved is None:
                raise BlockedAddress("a redirect leads to no http or https URL")
            now = moved.href
            continue
        return 200 <= status < 300, status, now, read_capped(chunks, most).decode(errors="replace")
    raise BlockedAddress("too many redirects")


def fetch_pages(urls: DataFrame, at_once: int | None = None, fetch: Callable = safe_fetch) -> DataFrame:
    """(url, ok, status, final_url, html) for distinct ``urls`` (url), ``at_once`` at a time; failures have ok = false."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for url in pdf["url"]:
                try:
                    ok, status, final, text = fetch(url)
                except (BlockedAddress, OSError, http.client.HTTPException):
                    ok, status, final, text = False, 0, url, ""
                rows.append((url, ok, status, final, text))
            yield pd.DataFrame(rows, columns=["url", "ok", "status", "final_url", "html"])

    return urls.where("url is not null").select("url").distinct().repartition(max(1, at_once or concurrency())).mapInPandas(run, SCHEMA)


def follow_redirects(urls: DataFrame, redirects: DataFrame, most: int = REDIRECTS) -> DataFrame:
    """(url, final_url, hops) over a table of redirects (from_url, to_url); null where a chain is longer than ``most``."""
    step = redirects.select(F.col("from_url").alias("final_url"), F.col("to_url")).dropDuplicates(["final_url"])
    now = urls.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"))
    for _ in range(most + 1):
        #: the size of a table made by exploding is guessed too low; it must not go to every executor by way of the driver
        moved = now.join(step.hint("merge"), "final_url", "left")
        now = moved.select("url", F.coalesce("to_url", "final_url").alias("final_url"), (F.col("hops") + F.when(F.col("to_url").isNotNull(), 1).otherwise(0)).alias("hops"))
    return now.select("url", F.when(F.col("hops") <= most, F.col("final_url")).alias("final_url"), "hops")


def blocked_hosts(hosts: DataFrame, answers: DataFrame, strict: bool = True) -> DataFrame:
    """(host, blocked) for ``hosts`` (host) and name service ``answers`` (host, ip): no answer or any that isn't public."""
    judged = answers.groupBy("host").agg(F.bool_or(private_address(F.col("ip"), strict)).alias("bad"))
    local = (F.lower("host") == "localhost") | F.lower("host").endswith(".localhost")
    return hosts.join(judged, "host", "left").select("host", (local | F.coalesce("bad", F.lit(True))).alias("blocked"))
