"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host + path with literal tokens that every
match contains whole. Of these the rarest in the table at hand indexes the rule,
so that a URL's tokens fetch the few rules that can fit and only those are run.
A rule without a literal is fetched by every URL. Rules are a table: a short one becomes part of an
expression, so that one map-only pass judges all URLs; a long one, of millions, is
indexed and joined on the token without ever being collected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.plans.runtime import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules the index is part of the expression; more are joined.
INLINE = 1_000
EVERY = ""
RULE = "name string, verdict string, pattern string, literals array<string>, rank int"


class Rule(NamedTuple):
    """``rank`` orders rules that fit: sites before patterns; within it the longest wins, then a block, then the name."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with the rule's."""
    host, slash, path = site.partition("/")
    path = slash + path
    host = host.translate(str.maketrans(_UPPER, _LOWER))
    #: the last piece of a path can be the start of a longer one, so it is no literal
    pieces = re.split("[^a-z0-9]+", host) + re.split("[^a-z0-9]+", path.translate(str.maketrans(_UPPER, _LOWER)))[:-1]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(filter(None, pieces))), 1)


def pattern_rule(verdict: str, name: str, pattern: str, literals: Sequence[str]) -> Rule:
    return Rule(name, verdict, pattern, tuple(literals), 0)


#: The sites that the query judges, as they are stated (fixed values).
SITES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: What else the query blocks: shop and link-farm hosts.
PATTERNS = [
    ("block", "cheap goods", r"^[^/]*\bcheap-[a-z]+\.", ("cheap",)),
    ("block", "link farm", r"^[^/]*\bspam-farm\.", ("spam", "farm")),
    ("block", "casino", r"^[^/]*\b(?:online-)?casino\b", ("casino",)),
    ("block", "pills", r"^[^/]*\bpills\b", ("pills",)),
]
RULES = [site_rule(*x) for x in SITES] + [pattern_rule(*x) for x in PATTERNS]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER), F.regexp_extract(url, parts, 2)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(F.split(F.translate(F.concat(host, path), _UPPER, _LOWER), "[^a-z0-9]+"), F.array(F.lit(EVERY))))


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules of a list as a table, read from one literal, without a Python worker."""
    listed = json.dumps([{"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "literals": list(r.literals), "rank": r.rank} for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<struct<{RULE}>>")))


def indexed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(_token, _rule): ``rules`` by their rarest literal in ``pages`` (_tokens, ...), the first by name on ties; '' for those without a literal."""
    literals = rules.select(F.struct("rank", F.length("name").alias("length"), "verdict", "name", "pattern").alias("_rule"), F.explode_outer("literals").alias("_token"))
    asked = literals.where("_token is not null").select("_token").distinct()
    counts = pages.select(F.explode("_tokens").alias("_token")).join(asked, "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("n"))
    told = literals.join(counts, "_token", "left").select("_rule", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_token", F.lit(EVERY)).alias("_token")).alias("x"))
    return told.groupBy("_rule").agg(F.min("x").alias("x")).select("x._token", "_rule")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = tuple(RULES), inline: int = INLINE) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, verdict and reason.

    ``rules`` is a table (see ``RULE``) or a list. ``rule`` names the site rule that decides, ``reason`` whatever rule does; a
    URL that none fits is allowed. A null URL or one without `://` has an empty
    host and path, which no rule with a host fits. Equal rules count once. Columns of these names in
    ``pages`` give way to the new ones; repeated rows stay as they are.
    """
    host, path = split_url(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict", "reason", "_tokens", "_subject", "_best", "_all").withColumn("host", host).withColumn("path", path)
    tokens = pages.withColumn("_tokens", _tokens(F.col("host"), F.col("path")))
    table = rules if isinstance(rules, DataFrame) else rules_table(pages.sparkSession, rules)
    subject = F.concat("host", "path")
    few = table.limit(inline + 1).count() <= inline
    if few:
        index: dict[str, list] = {}
        for r in indexed(tokens, table).collect():  # at most ``inline``
            index.setdefault(r["_token"], []).append(F.struct(*(F.lit(v).alias(n) for n, v in r["_rule"].asDict().items())))
        fetched = F.array().cast("array<struct<rank:int,length:int,verdict:string,name:string,pattern:string>>")
        if index:
            by_token = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*rs))))
            known = F.array(*map(F.lit, sorted(index)))
            fetched = F.flatten(F.transform(F.array_intersect("_tokens", known), lambda t: F.element_at(by_token, t)))
        best = F.array_max(F.filter(fetched, lambda r: F.regexp_like(subject, r["pattern"])))
        judged = tokens.withColumn("_best", best)
    else:
        wanted = tokens.select(subject.alias("_subject"), F.explode("_tokens").alias("_token")).distinct()
        fits = wanted.join(cut(indexed(tokens, table)), "_token").where(F.regexp_like(F.col("_subject"), F.col("_rule.pattern"))).groupBy("_subject").agg(F.max("_rule").alias("_best"))
        judged = tokens.withColumn("_subject", subject).join(cut(fits), "_subject", "left").drop("_subject")
    return judged.select(
        *[c for c in pages.columns],
        F.when(F.col("_best.rank") == 1, F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"),
        F.col("_best.name").alias("reason"),
    )


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "reason")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), site AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE
    WHEN regexp_matches(host, '\bspam-farm\.') THEN 'link farm'
    WHEN regexp_matches(host, '\bcheap-[a-z]+\.') THEN 'cheap goods'
    WHEN regexp_matches(host, '\b(online-)?casino\b') THEN 'casino'
    WHEN regexp_matches(host, '\bpills\b') THEN 'pills' END AS pattern
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN rule WHEN pattern = 'link farm' AND regexp_matches(host, '\bcheap-[a-z]+\.') THEN 'cheap goods' ELSE pattern END AS reason
FROM site
"""
