"""Makes a proposed grouping fit its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Name of the cluster of what no other has (fixed value).
LEFTOVER = "Inne"


def reconcile(proposal: DataFrame, phrases: DataFrame, leftover: str = LEFTOVER) -> DataFrame:
    """(cluster_ord, name, main_phrase, phrases) in order of cluster_ord.

    ``proposal`` (cluster_ord, name, main_phrase, phrases) may invent, repeat or
    leave out phrases of ``phrases`` (ord, phrase; distinct). A phrase belongs to
    the first cluster that names it, where repeats stay; unknown ones go. The main
    phrase is the proposed one if kept, else the first kept. Clusters without a
    phrase go. What no cluster has, in input order, is the last cluster.
    """
    named = proposal.select("cluster_ord", F.posexplode("phrases").alias("pos", "phrase"))
    known = named.join(phrases.select("phrase"), "phrase", "left_semi")
    first = known.groupBy("phrase").agg(F.min("cluster_ord").alias("cluster_ord"))
    kept = known.join(first, ["phrase", "cluster_ord"])
    lists = kept.groupBy("cluster_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase"))).alias("x")).select("cluster_ord", F.col("x.phrase").alias("phrases"))
    main = F.when(F.array_contains("phrases", F.col("proposed")), F.col("proposed")).otherwise(F.col("phrases")[0])
    clusters = lists.join(proposal.select("cluster_ord", "name", F.col("main_phrase").alias("proposed")), "cluster_ord").select("cluster_ord", "name", main.alias("main_phrase"), "phrases")
    rest = phrases.join(first, "phrase", "left_anti").agg(F.sort_array(F.collect_list(F.struct("ord", "phrase"))).alias("x")).where("size(x) > 0")
    last = proposal.agg((F.coalesce(F.max("cluster_ord"), F.lit(-1)) + 1).cast(proposal.schema["cluster_ord"].dataType).alias("cluster_ord"))
    rest = rest.crossJoin(F.broadcast(last)).select("cluster_ord", F.lit(leftover).alias("name"), F.col("x")[0]["phrase"].alias("main_phrase"), F.col("x.phrase").alias("phrases"))
    return clusters.unionByName(rest)


def numbered(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``rank`` by cluster_ord."""
    return clusters.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster_ord")).cast("long"))
