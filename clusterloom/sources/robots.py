"""Robots rules: the Disallow prefixes that hold for every agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.text import trim


def disallow_rules(files: DataFrame) -> DataFrame:
    """(origin, rule) from (origin, body), one file for each origin, each rule once.

    A line's comment is cut off. The last User-agent line before a Disallow line
    says whether it holds; a value may have colons, an empty one is none. A null
    body has no rules.
    """
    lines = files.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("n", "raw"))
    line = trim(F.element_at(F.split("raw", "#"), 1))
    parted = lines.select("origin", "n", line.alias("line")).where("line <> ''")
    key = F.lower(trim(F.element_at(F.split("line", ":"), 1)))
    value = trim(F.when(F.instr("line", ":") > 0, F.substring("line", F.instr("line", ":") + 1, F.length("line"))).otherwise(F.lit("")))
    parted = parted.select("origin", "n", key.alias("key"), value.alias("value"))
    so_far = Window.partitionBy("origin").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(so_far)
    ruled = parted.withColumn("agent", agent).where((F.col("key") == "disallow") & (F.col("value") != "") & (F.col("agent") == "*"))
    return ruled.groupBy("origin", F.col("value").alias("rule")).agg(F.min("n").alias("n")).select("origin", "rule", "n")


def rules_of(files: DataFrame) -> DataFrame:
    """(origin, rules): the rules of an origin in order of first occurrence."""
    return disallow_rules(files).groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("n", "rule"))).alias("x")).select("origin", F.col("x.rule").alias("rules"))


def disallowed(path: Column, rules: Column) -> Column:
    """Whether a path starts with one of the rules; null rules forbid nothing."""
    return F.coalesce(F.exists(rules, lambda r: F.startswith(path, r)), F.lit(False))


def allowed_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (origin, path, ...) that no rule (origin, rules) of their origin forbids."""
    joined = pages.join(rules, "origin", "left")
    return joined.where(~disallowed(F.col("path"), F.col("rules"))).drop("rules")
