"""Names, pillars and order of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.functions.text import capitalized

#: Tokens in a name.
NAMED_BY = 2


def name_clusters(grouped: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., cluster, name, main_phrase, phrases, size, rank) from rows (by..., cluster, place, ord, phrase, tokens).

    ``tokens`` are those of the phrase in order, repeats included. The name is the
    two tokens that most members have, by Unicode collation on ties, or the first
    member if none has any. The pillar is the member with the fewest tokens, then
    characters, then the first. ``phrases`` are sorted by code point. Clusters are
    ranked by size, on ties in their own order.
    """
    key = [*by, "cluster"]
    seen = grouped.select(*key, "place", F.posexplode(F.array_distinct("tokens")).alias("at", "token"))
    often = seen.groupBy(*key, "token").agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("first"))
    order = Window.partitionBy(*key).orderBy(F.desc("n"), F.expr("token COLLATE UNICODE"), "first")
    top = often.withColumn("r", F.row_number().over(order)).where(F.col("r") <= NAMED_BY)
    names = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("r", capitalized(F.col("token")).alias("word")))).alias("words"))
    names = names.select(*key, F.array_join(F.col("words.word"), " ").alias("named"))
    pillar = F.struct(F.size("tokens").alias("tokens"), F.length("phrase").alias("length"), "place", "phrase")
    groups = grouped.groupBy(*key).agg(
        F.min(pillar).alias("pillar"), F.min(F.struct("place", "phrase")).alias("first"), F.array_sort(F.collect_list("phrase")).alias("phrases"), F.count("*").alias("size")
    )
    same = [groups[k].eqNullSafe(names[k]) for k in key]
    out = groups.join(names, same, "left").select(*(groups[k] for k in key), F.coalesce("named", "first.phrase").alias("name"), F.col("pillar.phrase").alias("main_phrase"), "phrases", "size")
    #: groups are counted, not rows: at most as many as a clustering allows
    ranks = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return out.withColumn("rank", F.row_number().over(ranks.orderBy(F.desc("size"), "cluster")).cast("long"))
