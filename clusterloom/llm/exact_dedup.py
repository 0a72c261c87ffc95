"""Exact dedup by content sort.

Texts are compared without their whitespace. Sampled splitters deal the rows
into ranges of (start of the normalised text, content hash, doc_id, tie); each range
is sorted externally, so that equal texts are adjacent, and every row is
compared in full with its predecessor. The doc_id in the splitters, and for rows
that share or lack one a tie that differs from row to row, lets a group
of copies that holds much of the table span many ranges; its runs are stitched
where a range ends and the next begins, which concerns at most two runs a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.llm.words import id_of, key_of
from clusterloom.plans.runtime import cut

#: Characters of the normalised text that splitters compare; what they leave equal the hash and the doc_id divide.
HEAD = 48
#: Ranges at most, and rows sampled for splitters: at least ``SAMPLED``, else four a range. Both bound what the driver holds (about 20 MB at most).
RANGES, SAMPLED = 16_384, 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keyed(docs: DataFrame) -> DataFrame:
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(docs).alias("key"), norm.alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    return rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("h", F.xxhash64("norm"))


def _splitters(docs: DataFrame, ranges: int) -> list:
    """Keys at even distances in a sample whose size doesn't depend on the table's.

    They only say where ranges begin; results are the same for any sample.
    """
    rows, wanted = docs.count(), max(SAMPLED, 4 * ranges)
    some = docs.where(F.rand(11) < wanted / rows) if rows > wanted else docs
    sample = _keyed(some).select("head", "h", "key", "tie").limit(2 * wanted).collect()
    sample = sorted((r["head"].encode(), r["head"], r["h"], r["key"], r["tie"]) for r in sample)
    step = len(sample) / ranges
    return [sample[int(i * step)][1:] for i in range(1, ranges)] if len(sample) >= ranges else [x[1:] for x in sample[1:]]


def exact_groups(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text, ...).

    A null text counts as empty, and all texts without other than whitespace
    characters are equal. The row with the most code points before normalising
    stays, then the smallest doc_id, null last; of rows that tie in both, which
    are alike in every compared respect, exactly one is kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or min(RANGES, 4 * partitions)
    splits = _splitters(docs, ranges)
    table = F.array(*(F.struct(F.lit(a).alias("head"), F.lit(b).cast("long").alias("h"), F.lit(c).cast("long").alias("key"), F.lit(d).cast("long").alias("tie")) for a, b, c, d in splits)) if splits else None
    if table is None:
        placed = keyed.withColumn("range", F.lit(0))
    else:
        mine = F.struct("head", "h", "key", "tie")
        steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
        search = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(splits)) & (F.try_element_at(table, at + step) <= mine), at + step).otherwise(at)
        )
        placed = keyed.withColumn("range", search)
    order = Window.partitionBy("range").orderBy("head", "h", "norm", "key", "tie")
    same = F.lag("norm").over(order).eqNullSafe(F.col("norm"))
    runs = placed.select("doc_id", "key", "length", "range", F.sha2("norm", 256).alias("text_sha256"), same.alias("same"), F.row_number().over(order).alias("place"))
    by_place = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(by_place))
    within = Window.partitionBy("range", "run")
    best = F.struct((-F.col("length")).alias("shorter"), F.col("key"), F.col("place"))
    rows = cut(
        runs.select(
            "doc_id", "text_sha256", "range", "run", "place", F.min(best).over(within).alias("best"), F.count("*").over(within).alias("size"), (F.col("run") == F.max("run").over(Window.partitionBy("range"))).alias("ends")
        )
    )
    # At most two runs a range touch its ends; those that continue over an end are stitched.
    touching = rows.where("ends or run = 1").groupBy("range", "run").agg(F.first("text_sha256").alias("text"), F.first("best").alias("best"), F.first("size").alias("size"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("range", "run")
    chained = touching.withColumn("chain", F.sum(F.when(F.lag("text").over(in_order).eqNullSafe(F.col("text")), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("chain")
    stitched = chained.select(
        "range", "run", F.min(F.struct("best.shorter", "best.key", "range", "best.place")).over(chain).alias("all_best"), F.sum("size").over(chain).alias("all_size")
    )
    joined = rows.join(F.broadcast(stitched), ["range", "run"], "left")
    winner = F.coalesce("all_best", F.struct("best.shorter", "best.key", F.col("range"), "best.place"))
    out = joined.withColumn("winner", winner)
    return out.select(
        "doc_id",
        id_of(F.col("winner.key")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        ((F.col("winner.range") == F.col("range")) & (F.col("winner.place") == F.col("place"))).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS len FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-len, doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""
