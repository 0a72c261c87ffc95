"""A corpus pipeline of operators in clusterloom.llm, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clusterloom.llm.decontam import clean
from clusterloom.llm.lang_id import confident
from clusterloom.llm.mixing import mixed
from clusterloom.llm.near_dedup import keep_one
from clusterloom.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of no main one, go."""
    return confident(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five words, similarity 0.8) stays."""
    return keep_one(docs, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """80 percent of the tokens stay, as the target weights say, each document at most once."""
    return mixed(docs, 80)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its place there."""
    return shard(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Language identification and near-duplicates are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
