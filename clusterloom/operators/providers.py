"""What comes from outside: embeddings and language models, behind interfaces that work offline.

No provider has a network connection of its own. A table provider answers from
a DataFrame, a callable one from a function; without one, a method that needs
it is unavailable.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.errors import Unavailable


class Embedder(Protocol):
    model: str

    def is_available(self) -> bool: ...

    def embed(self, texts: DataFrame) -> DataFrame:
        """(text, embedding) for the rows (text) of ``texts``."""
        ...


class Writer(Protocol):
    def is_available(self) -> bool: ...

    def answer(self, system: str, user: str) -> str:
        """The reply of a language model, a JSON object."""
        ...


class TableEmbedder:
    """Looks embeddings up in a DataFrame (text, embedding)."""

    def __init__(self, table: DataFrame, model: str = "table") -> None:
        self.table, self.model = table, model

    def is_available(self) -> bool:
        return True

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.join(self.table.select("text", "embedding").dropDuplicates(["text"]), "text")


class CallableWriter:
    def __init__(self, ask: Callable[[str, str], str]) -> None:
        self.ask = ask

    def is_available(self) -> bool:
        return True

    def answer(self, system: str, user: str) -> str:
        return self.ask(system, user)


class Nothing:
    """Stands for a provider that isn't configured."""

    model = "none"

    def is_available(self) -> bool:
        return False

    def embed(self, texts: DataFrame) -> DataFrame:
        raise Unavailable("no embedding provider is configured")

    def answer(self, system: str, user: str) -> str:
        raise Unavailable("no language model is configured")


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(text, hash): the distinct texts whose vector for ``model`` is not in ``cache`` (model, hash, embedding)."""
    wanted = texts.where("text is not null").select("text").distinct().withColumn("hash", F.sha2("text", 256))
    return wanted.join(cache.where(F.col("model") == model).select("hash"), "hash", "left_anti").select("text", "hash")


def embedded(texts: DataFrame, embedder: Embedder, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with their embedding, cache with the new vectors); raises if the provider leaves a text out."""
    if not embedder.is_available():
        raise Unavailable("no embedding provider is configured")
    missing = cache_misses(texts, cache, embedder.model)
    new = embedder.embed(missing.select("text")).select(F.lit(embedder.model).alias("model"), F.sha2("text", 256).alias("hash"), F.col("embedding").cast("array<double>").alias("embedding"))
    full = cache.unionByName(new)
    known = full.where(F.col("model") == embedder.model).select("hash", "embedding").dropDuplicates(["hash"])
    out = texts.withColumn("hash", F.sha2("text", 256)).join(known, "hash", "left").drop("hash")
    return out.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("no vector for a text"))).otherwise(F.col("embedding"))), full


def numbered_list(phrases: list[str]) -> str:
    return "\n".join(f"{i}. {p}" for i, p in enumerate(phrases, 1))


def clustering_prompt(phrases: list[str], context: str | None, pages: bool) -> tuple[str, str]:
    """System and user message that ask a model for clusters."""
    subject = "Every item sums up one page of a web site: its title, description and headings." if pages else "Every item is a search phrase."
    system = (
        f"You group content into topic clusters. {subject} Group by meaning and intent. Each item goes into exactly one cluster, unchanged. "
        'Answer only with a JSON object {"clusters":[{"name":"...","mainPhrase":"...","phrases":["..."]}]}.'
    )
    about = f'Context of the site or topic: "{context.strip()}".' if context and context.strip() else "No context is given; group by the items alone."
    return system, f"{about}\n\nGroup these items:\n\n{numbered_list(phrases)}"


def merging_prompt(sources: list[tuple[str, str, str]], context: str | None) -> tuple[str, str]:
    """System and user message that ask a model to merge (label, url, content) sources into one page."""
    system = (
        "You consolidate overlapping pages into one. Keep every fact of each source once, invent nothing, write in the language of the sources. "
        'Answer only with a JSON object {"title":"...","metaDescription":"...","content":"..."}, content in Markdown.'
    )
    about = f'Context: "{context.strip()}".\n\n' if context and context.strip() else ""
    blocks = "\n\n".join(f"--- SOURCE {i}: {label} ({url}) ---\n{content}" for i, (label, url, content) in enumerate(sources, 1))
    return system, f"{about}{len(sources)} pages to merge:\n\n{blocks}"


def parsed_clusters(reply: str) -> list[dict]:
    """The clusters of a reply; raises ValueError unless it has at least one and each has at least one phrase."""
    found = _object(reply).get("clusters")
    if not isinstance(found, list) or not found:
        raise ValueError("the reply has no clusters")
    for c in found:
        strings = isinstance(c, dict) and isinstance(c.get("name"), str) and isinstance(c.get("mainPhrase"), str)
        if not strings or not isinstance(c.get("phrases"), list) or not c["phrases"] or not all(isinstance(p, str) for p in c["phrases"]):
            raise ValueError("a cluster of the reply has another format")
    return found


def parsed_page(reply: str) -> dict[str, str]:
    """Title, description and content of a reply; raises ValueError if one is missing."""
    found = _object(reply)
    if not all(isinstance(found.get(k), str) for k in ("title", "metaDescription", "content")):
        raise ValueError("the reply has another format")
    return {k: found[k] for k in ("title", "metaDescription", "content")}


def _object(reply: str) -> dict:
    if not reply:
        raise ValueError("the model gave no reply")
    try:
        found = json.loads(reply)
    except json.JSONDecodeError as e:
        raise ValueError("the reply is no JSON") from e
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    return found
