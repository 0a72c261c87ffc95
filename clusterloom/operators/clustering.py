"""Clustering of phrases by words, vectors or a language model."""

from __future__ import annotations

import os
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.errors import InvalidInput, Unavailable
from clusterloom.functions.text import tokenize, trim
from clusterloom.operators.naming import name_clusters
from clusterloom.operators.providers import Embedder, Nothing, Writer, clustering_prompt, embedded, parsed_clusters
from clusterloom.operators.reconcile import numbered, reconcile
from clusterloom.operators.similarity import ordered_distinct
from clusterloom.operators.upgma import cluster_each

Method = Literal["lexical", "embeddings", "semantic"]
#: Phrases of a request, and the similarities from which groups merge.
MAX_PHRASES, LEXICAL, EMBEDDING = 500, 0.24, 0.55


def method_of(name: object, strict: bool = False) -> Method:
    """The method of that name; another name means lexical, or an error if ``strict``."""
    if name in ("lexical", "embeddings", "semantic"):
        return name
    if strict and name is not None:
        raise InvalidInput(f"unknown method {name!r}")
    return "lexical"


def embedding_threshold(setting: str | None = None) -> float:
    """EMBEDDING_SIMILARITY_THRESHOLD as a number; unset, 0 and no number mean the default."""
    raw = os.environ.get("EMBEDDING_SIMILARITY_THRESHOLD", "") if setting is None else setting
    try:
        value = float(raw)
    except ValueError:
        return EMBEDDING
    return value if value and value == value else EMBEDDING


def parse_phrases(raw: DataFrame, text: str = "text") -> DataFrame:
    """(ord, phrase): phrases of pasted texts (ord, text), split at line ends and commas, each once."""
    pieces = raw.select("ord", F.posexplode(F.split(F.col(text), "\r?\n|,")).alias("pos", "phrase")).withColumn("phrase", trim(F.col("phrase"))).where("phrase <> ''")
    return pieces.groupBy("phrase").agg(F.min(F.struct("ord", "pos")).alias("ord"))


def requested_phrases(requests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ord, phrase): phrases of requests (by..., at, body) whose JSON body has an array ``phrases``.

    Only strings count, trimmed and not empty, each once for a ``by`` at its first place: ``at`` and the place in the
    array. A body without such an array has none.
    """
    items = F.from_json("body", "phrases array<string>", {"mode": "PERMISSIVE"})["phrases"]
    rows = requests.select(*by, "at", F.posexplode(items).alias("pos", "phrase")).withColumn("phrase", trim(F.col("phrase"))).where("phrase <> ''")
    return rows.groupBy(*by, "phrase").agg(F.min(F.col("at") + F.col("pos")).alias("ord")).select(*by, "ord", "phrase")


def cleaned(phrases: DataFrame) -> DataFrame:
    """(ord, phrase): trimmed, without empty ones and nulls, each once at its first place."""
    return ordered_distinct(phrases.withColumn("phrase", trim(F.col("phrase"))).where("phrase <> ''"), "phrase").select("ord", "phrase")


def counted(phrases: DataFrame, most: int = MAX_PHRASES) -> int:
    """The number of phrases; raises InvalidInput for none and for more than ``most``."""
    n = phrases.count()
    if n == 0:
        raise InvalidInput("give at least one phrase")
    if n > most:
        raise InvalidInput(f"too many phrases: {n}, at most {most}")
    return n


def grouped_lexically(items: DataFrame, by: tuple[str, ...] = (), long_documents: bool = False, threshold: float = LEXICAL, most: int | None = MAX_PHRASES) -> DataFrame:
    """(by..., ord, phrase, tokens, cluster, place) of ``items`` (by..., ord, phrase).

    Similarity is Jaccard, or overlap for long documents, of distinct tokens. A
    phrase without tokens is alone.
    """
    key = list(by)
    told = items.select(*key, "ord", "phrase", tokenize(F.col("phrase")).alias("tokens"))
    one = told if key else told.withColumn("_all", F.lit(0))
    groups = cluster_each(one, key or ["_all"], threshold, "overlap" if long_documents else "jaccard", most)
    return told.join(groups, [told[k].eqNullSafe(groups[k]) for k in [*key, "ord"]]).select(told["*"], "cluster", "place")


def grouped_by_vectors(items: DataFrame, threshold: float | None = None, most: int = MAX_PHRASES) -> DataFrame:
    """(ord, phrase, tokens, cluster, place) of ``items`` (ord, phrase, embedding), by cosine."""
    told = items.select("ord", "phrase", tokenize(F.col("phrase")).alias("tokens"))
    t = embedding_threshold() if threshold is None else threshold
    groups = cluster_each(items.select("ord", "embedding").withColumn("_all", F.lit(0)), ["_all"], t, "cosine", most)
    return told.join(groups.select("ord", "cluster", "place"), "ord")


def semantic_clusters(spark: SparkSession, phrases: list[str], writer: Writer, context: str | None, pages: bool) -> DataFrame:
    """(cluster_ord, name, main_phrase, phrases, rank) as a language model proposes, made to fit the input."""
    if not writer.is_available():
        raise Unavailable("no language model is configured")
    found = parsed_clusters(writer.answer(*clustering_prompt(phrases, context, pages)))
    proposal = spark.createDataFrame([(i, c["name"], c["mainPhrase"], c["phrases"]) for i, c in enumerate(found)], "cluster_ord long, name string, main_phrase string, phrases array<string>")
    return numbered(reconcile(proposal, spark.createDataFrame(list(enumerate(phrases)), "ord long, phrase string")))


def cluster_items(items: DataFrame, method: Method, context: str | None = None, pages: bool = False, embedder: Embedder | None = None, writer: Writer | None = None, cache: DataFrame | None = None) -> DataFrame:
    """(name, main_phrase, phrases, rank) of ``items`` (ord, phrase), distinct and few."""
    spark = items.sparkSession
    if method == "semantic":
        ordered = [r["phrase"] for r in items.orderBy("ord").limit(MAX_PHRASES + 1).collect()]
        return semantic_clusters(spark, ordered, writer or Nothing(), context, pages).select("name", "main_phrase", "phrases", "rank")
    if method == "embeddings":
        store = cache if cache is not None else spark.createDataFrame([], "model string, hash string, embedding array<double>")
        with_vectors, _ = embedded(items.withColumn("text", F.col("phrase")), embedder or Nothing(), store)
        groups = grouped_by_vectors(with_vectors)
    else:
        groups = grouped_lexically(items, long_documents=pages)
    return name_clusters(groups).select("name", "main_phrase", "phrases", "rank")


def cluster_phrases(phrases: DataFrame, method: Method = "lexical", context: str | None = None, **providers) -> DataFrame:
    """Clusters of the phrases of a request (ord, phrase); see ``cluster_items``."""
    items = cleaned(phrases)
    counted(items)
    return cluster_items(items, method, context, **providers)
