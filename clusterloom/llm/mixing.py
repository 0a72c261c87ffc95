"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the sources of a language of a domain. A token budget runs down the
tree: a node's budget is shared among its children by weight, none gets more
than it can give (its tokens times the epochs allowed), and what one leaves its
siblings get, by weight. A child's limit is the sum of what lies under it, so
shortages are made up among siblings first and only then among the siblings of
an ancestor. Each leaf then gives whole epochs and, of the next one, a prefix
in the order of a seeded hash.

A leaf may hold any share of all rows: its rows are summed in 4,096 pieces of
hash order first, and only the piece in which the prefix ends is looked at
closer. The prefix is then one bound on the hash for each leaf, and rows are
taken by comparing with it; no row is ever ordered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.plans.runtime import cut

LEVELS = ("domain", "lang", "source")
#: Hex digits of the hash that name a piece.
PIECE = 3
#: Leaves that are broadcast at most (some 100 bytes each); more are joined by a shuffle.
FEW = 50_000
#: Weights of the query, in whole numbers up to 10,000; a name that isn't listed weighs 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 5, "reference": 3, "forum": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 4},
}
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """Domain by the number that ends a source's name; a name without one is the web's."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "reference").otherwise("forum")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    listed = weights.get(level) or {}
    if not listed:
        return F.lit(1).cast("long")
    table = F.create_map(*(x for name, w in listed.items() for x in (F.lit(name), F.lit(w).cast("long"))))
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1).cast("long"))


def _exact(column: str) -> Column:
    """A whole number of up to 38 digits, so that tokens times weights can't overflow."""
    return F.col(column).cast("decimal(38,0)")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to rows (parent..., name, weight, cap, given): ``given`` shared by weight up to each cap.

    Children are filled in order of cap / weight. One is full if its cap is no
    more than its share of what those before it leave; what the full ones leave
    is shared among the others, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*parent)
    rows = children.withColumns({"_w": F.sum("weight").over(group), "_wb": F.coalesce(F.sum("weight").over(before), F.lit(0)), "_cb": F.coalesce(F.sum("cap").over(before), F.lit(0))})
    rows = rows.withColumn("_full", _exact("cap") * (_exact("_w") - _exact("_wb")) <= (_exact("given") - _exact("_cb")) * _exact("weight"))
    full = lambda x: F.coalesce(F.sum(F.when(F.col("_full"), F.col(x))).over(group), F.lit(0))
    rows = rows.withColumns({"_cf": full("cap"), "_wf": full("weight")})
    part = "((cast(given as decimal(38,0)) - cast(_cf as decimal(38,0))) * cast(weight as decimal(38,0))) div (cast(_w as decimal(38,0)) - cast(_wf as decimal(38,0)))"
    return rows.withColumn("budget", F.expr(f"cast(case when _full then cap else {part} end as long)")).drop("_w", "_wb", "_cb", "_full", "_cf", "_wf")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens); ``budget`` is an expression over ``total``.

    Tokens of all leaves times ``epochs`` fit in a long (9e18); products with weights have 38 digits.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    given = total.select(budget.cast("long").alias("given"))
    for depth, level in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        children = caps.groupBy(*path).agg(F.sum("cap").alias("cap"))
        children = children.join(given, parent) if parent else children.join(F.broadcast(given))
        shared = share(children.withColumn("weight", _weight(level, weights)), parent or [F.lit(0)], level)
        given = shared.select(*path, F.col("budget").alias("given"))
    return leaves.join(given, list(LEVELS)).withColumnRenamed("given", "budget")


def _name(docs: DataFrame) -> Column:
    """What a row is hashed by: its doc_id, without one its text. Rows that share a doc_id are told apart by their number of tokens."""
    return F.coalesce(docs["doc_id"].cast("long").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(docs["text"], F.lit("")))))


def _hash(epoch: Column, seed: str) -> Column:
    """32 digits of a seeded checksum, and the tokens so that rows of one name and different length are different units."""
    return F.concat(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("name"))), F.lpad(F.col("tokens").cast("string"), 20, "0"))


def _placed(docs: DataFrame, domain: Column | None) -> DataFrame:
    source, lang = F.coalesce(docs["source"], F.lit("")), F.coalesce(docs["lang"], F.lit(""))
    told = domain_of(docs["source"]) if domain is None else domain
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), told.alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens(docs["text"]).alias("tokens"), _name(docs).alias("name"))


def _few(leaves: DataFrame) -> tuple[DataFrame, bool]:
    """``leaves`` (cut), marked for broadcast if their number is known to be small, so that a hot leaf's rows stay where they are."""
    few = leaves.limit(FEW + 1).count() <= FEW
    return (F.broadcast(leaves) if few else leaves), few


def prefixes(rows: DataFrame, budget_percent: int, epochs: int, weights: Mapping[str, Mapping[str, int]], seed: str) -> DataFrame:
    """(domain, lang, source, whole, bound): whole epochs of each leaf, and the greatest hash of the prefix taken of the next; '' takes none.

    ``rows`` has domain, lang, source, tokens and name. One row a leaf.
    """
    path = list(LEVELS)
    leaves = rows.groupBy(*path).agg(F.sum("tokens").alias("tokens"))
    given = leaf_budgets(leaves, F.expr(f"cast(cast(total as decimal(38,0)) * {budget_percent} div 100 as long)"), epochs, weights)
    given = given.select(*path, F.expr("case when tokens = 0 then 0 else budget div tokens end").alias("whole"), F.expr("case when tokens = 0 then 0 else budget % tokens end").alias("left"))
    given = cut(given)
    wholes, few = _few(given.select(*path, "whole"))
    mine = rows.join(wholes, path).select(*path, _hash(F.col("whole"), seed).alias("hash"), "tokens")
    mine = mine.withColumn("piece", F.substring("hash", 1, PIECE))
    #: after a shuffle by leaf an exchange of its own lets the hot ones be split
    mine = mine if few else mine.repartition(*path, "piece")
    sums = mine.groupBy(*path, "piece").agg(F.sum("tokens").alias("here"))
    before = Window.partitionBy(*path).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = sums.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).join(given.select(*path, "left"), path)
    fits = F.col("before") + F.col("here") <= F.col("left")
    #: pieces that fit give the bound at first ("~" is after all digits); the one after them may move it
    ends = cut(pieces.groupBy(*path).agg(F.concat(F.max(F.when(fits, F.col("piece"))), F.lit("~")).alias("bound"), F.min(F.when(~fits, F.col("piece"))).alias("piece"), F.min(F.when(~fits, F.col("before"))).alias("before"), F.min("left").alias("left")))
    ending = ends.where("piece is not null").select(*path, "piece", "before", "left")
    units = mine.join(_few(ending.select(*path, "piece"))[0], [*path, "piece"]).groupBy(*path, "hash").agg(F.sum("tokens").alias("here"))
    so_far = Window.partitionBy(*path).orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = units.withColumn("sum", F.sum("here").over(so_far)).join(ending.select(*path, "before", "left"), path).where(F.col("before") + F.col("sum") <= F.col("left"))
    moved = inside.groupBy(*path).agg(F.max("hash").alias("further"))
    bounds = ends.select(*path, "bound").join(moved, path, "left").select(*path, F.coalesce("further", "bound", F.lit("")).alias("bound"))
    return cut(given.select(*path, "whole").join(bounds, path))


def mixture(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: str = SEED, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, epoch), one row for each time that a row of ``docs`` is taken.

    Tokens are the runs of `[^\\x20\\x09-\\x0D]` of the whole text. The budget is
    ``budget_percent`` of all tokens of ``docs``. The prefix of an epoch is the
    longest that stays within what is left of the leaf's budget; rows without
    tokens cost nothing. Null lang and source are named ''. A row is hashed by its
    doc_id, one without by its text; rows of a leaf that share this and their
    number of tokens are taken together or not at all. Other columns are
    ignored; an empty table gives an empty result.
    """
    path = list(LEVELS)
    rows = cut(_placed(docs, domain))
    placed = rows.join(_few(prefixes(rows, budget_percent, epochs, weights, seed))[0], path)
    times = F.col("whole") + F.when(_hash(F.col("whole"), seed) <= F.col("bound"), 1).otherwise(0)
    times = placed.withColumn("times", times)
    return times.where("times > 0").select("doc_id", *path, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))


def mixed(docs: DataFrame, budget_percent: int = 80, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` in the mixture of at most one epoch; columns as they were.

    Every row is judged for itself, by its own hash and the bound of its leaf.
    """
    bounds = prefixes(cut(_placed(docs, None)), budget_percent, 1, WEIGHTS, seed)
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = [F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]
    rows = docs.select(*own, domain_of(docs["source"]).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source"), n_tokens(docs["text"]).alias("tokens"), _name(docs).alias("name"))
    placed = rows.join(_few(bounds)[0], list(LEVELS)).where((F.col("whole") > 0) | (_hash(F.col("whole"), seed) <= F.col("bound")))
    return placed.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_sql(table: str, budget_percent: int, epochs: int) -> str:
    """DuckDB SQL for ``mixture`` over ``table``, with the query's weights."""

    def case(level: str) -> str:
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"

    steps, given = [], f"SELECT (sum(tokens) * {budget_percent} // 100)::BIGINT AS given FROM leaves"
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN g{depth} USING ({parent})" if parent else f"CROSS JOIN g{depth}"
        steps.append(f"g{depth} AS ({given})")
        steps.append(
            f"""c{depth} AS (SELECT *, cap * (w - wb) <= (given - cb) * weight AS filled FROM (
  SELECT *, sum(weight) OVER ({by}) AS w, coalesce(sum(weight) OVER o, 0) AS wb, coalesce(sum(cap) OVER o, 0) AS cb
  FROM (SELECT {path}, sum(tokens)::BIGINT * {epochs} AS cap, ({case(level)})::BIGINT AS weight FROM leaves GROUP BY {path}) {join}
  WINDOW o AS ({by} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
        )
        given = f"""SELECT {path}, (CASE WHEN filled THEN cap ELSE (given - coalesce(sum(cap) FILTER (filled) OVER ({by}), 0)) * weight
    // (w - coalesce(sum(weight) FILTER (filled) OVER ({by}), 0)) END)::BIGINT AS given FROM c{depth}"""
    return rf"""
WITH d AS (
  SELECT *, CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'forum' END AS domain
  FROM (SELECT doc_id, coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, ''))) AS name, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM {table})
), leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(steps)}, g3 AS ({given}), q AS (
  SELECT d.*, CASE WHEN l.tokens = 0 THEN 0 ELSE g3.given // l.tokens END AS whole, CASE WHEN l.tokens = 0 THEN 0 ELSE g3.given % l.tokens END AS rest
  FROM d JOIN leaves l USING (domain, lang, source) JOIN g3 USING (domain, lang, source)
), r AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || name), tokens) <= rest AS more FROM q
)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, (whole + more::INT)::BIGINT)) AS epoch FROM r
"""


OP6_SQL = mix_sql("documents", BUDGET_PERCENT, EPOCHS)
