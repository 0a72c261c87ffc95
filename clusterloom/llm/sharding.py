"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots once and for all. Bytes are summed
per slot, and a slot-to-shard map, not the records, decides where a slot lives.
The map is stored under a version number. Placing records loads the last version, edits
it where bytes have shifted or shards were added, and stores the next one, in
which only moved slots differ. Whatever a slot map needs is bounded by the number of
slots, so it may meet in one task and be broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterloom.llm.words import key_of
from clusterloom.plans.runtime import checkpoint_dir, cut

SLOTS, SHARDS = 4_096, 8
#: Records of a slot that are numbered in one task; more are numbered in pieces.
PIECE = 1_000_000


def slot_of(slots: int = SLOTS) -> Column:
    """By doc_id and text, so that rows which share an id spread out; rows without an id by a number of their own."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id"), F.col("tie")), F.col("text_crc32"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, key, size, text_crc32, tie, vslot) for every row; ``tie`` numbers the rows as they are read."""
    text = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key_of(docs).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")
    )
    return out.withColumn("vslot", slot_of(slots))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for every slot, empty ones too."""
    found = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(found), "vslot", "left").na.fill(0, ["bytes", "rows"])


def _deal(pool: DataFrame, loads: Column) -> DataFrame:
    """(vslot, shard): the pool's slots (vslot, bytes), largest first, each to the shard with the least bytes so far."""
    packed = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot")))
    start = F.struct(loads.alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("dealt"))

    def give(acc: Column, slot: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loads = F.transform(acc["loads"], lambda x, i: F.when(i == to, x - slot["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(acc["dealt"], F.array(F.struct(slot["vslot"].alias("vslot"), to.alias("shard")))).alias("dealt"))

    return pool.agg(F.aggregate(packed, start, give)["dealt"].alias("dealt")).select(F.inline("dealt"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: (vslot, shard, version), as many slots for each shard, whatever they will hold."""
    vslot = F.col("id").cast("int")
    return spark.range(slots).select(vslot.alias("vslot"), (vslot % shards).alias("shard"), F.lit(1).alias("version"))


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version for new sizes and ``shards`` (as many as before, or more).

    Each shard keeps its slots, largest first, as long as they fit in an equal
    share of all bytes. The others are dealt, largest first, to the shards with the
    least bytes; if there are more shards than before, only to the new ones, so
    that no slot moves between old ones.
    """
    now = slot_map.join(F.broadcast(sizes.select("vslot", "bytes")), "vslot")
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    share = F.broadcast(sizes.agg(F.sum("bytes").alias("total")))
    now = now.withColumn("so_far", F.sum("bytes").over(order)).join(share)
    now = cut(now.withColumn("keeps", (F.col("so_far") * shards <= F.col("total")) | (F.col("bytes") == 0)))
    rows = now.groupBy("shard").agg(F.sum(F.when(F.col("keeps"), F.col("bytes")).otherwise(0)).alias("bytes")).collect()  # one a shard
    loads = {r["shard"]: r["bytes"] for r in rows}
    old = max(loads) + 1
    #: an old shard takes nothing while there are new ones: it counts as full
    full = 2**62 if shards > old else 0
    moved = _deal(now.where("not keeps"), F.array(*(F.lit(loads.get(i, 0) + (full if i < old else 0)).cast("long") for i in range(shards))))
    stay = now.join(F.broadcast(moved.withColumnRenamed("shard", "to")), "vslot", "left")
    return stay.select("vslot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def store_map(slot_map: DataFrame, folder: str) -> int:
    """Writes a version beside the earlier ones; returns its number."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.select("vslot", "shard").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version, the last one by default."""
    every = spark.read.parquet(folder)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select("vslot", "shard", "version")


def current_map(spark: SparkSession, folder: str, sizes: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The map to place records by: the last version in ``folder``, edited for ``sizes`` and ``shards`` and stored as the next where that moves a slot.

    An empty or missing folder gets the first version before it is edited.
    """
    try:
        now = load_map(spark, folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        store_map(first_map(spark, shards, slots), folder)
        now = load_map(spark, folder)
    now = cut(now)
    after = cut(rebalanced(now, sizes, shards))
    if after.join(now, ["vslot", "shard"], "left_anti").limit(1).count():
        store_map(after, folder)
    return load_map(spark, folder)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version) for every row of ``docs`` (doc_id, text, ...).

    ``slot`` counts the rows of a shard from 0 without gaps. The law is `bytes`:
    slots are dealt so that shards get nearly equal sizes. ``maps`` is the folder
    of the stored map; without one a new folder beside the checkpoints starts with version 1. A null text has no
    bytes. Rows that agree in doc_id and text share a virtual slot but have places of their own;
    rows without a doc_id are spread over all slots. Other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    recs = cut(records(docs, slots))
    sizes = cut(slot_bytes(recs, slots))
    chosen = current_map(spark, maps or f"{checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}", sizes, shards, slots)
    placed = chosen.join(F.broadcast(sizes), "vslot").withColumn("pieces", F.ceil(F.col("rows") / PIECE).cast("int"))
    #: a piece of a slot is numbered in one task; a slot has one unless its records are many
    pieced = recs.join(F.broadcast(placed.select("vslot", "shard", "version", "pieces")), "vslot").withColumn("piece", F.pmod(F.xxhash64("tie"), F.greatest("pieces", F.lit(1))).cast("int"))
    counts = pieced.groupBy("shard", "vslot", "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("vslot", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("vslot", "piece").orderBy("key", "size", "text_crc32", "tie")) - 1
    numbered = pieced.withColumn("inside", inside).join(F.broadcast(offsets), ["vslot", "piece"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version"
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH RECURSIVE tb AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM tb),
raw AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes
  FROM documents
), r AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM raw, tab),
d AS MATERIALIZED (SELECT *, (('0x' || md5(doc_id || ':' || crc)[1:8])::BIGINT % {SLOTS})::INTEGER AS vslot FROM r),
s AS (SELECT v.i::INTEGER AS vslot, (v.i % {SHARDS})::INTEGER AS home, coalesce(sum(size), 0)::BIGINT AS b FROM range({SLOTS}) v(i) LEFT JOIN d ON d.vslot = v.i GROUP BY ALL),
k AS MATERIALIZED (SELECT *, sum(b) OVER (PARTITION BY home ORDER BY b DESC, vslot ROWS UNBOUNDED PRECEDING) * {SHARDS} <= sum(b) OVER () OR b = 0 AS keeps FROM s),
m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY b DESC, vslot) AS k, vslot, b FROM k WHERE NOT keeps),
deal AS (
  SELECT 0::BIGINT AS k, NULL::INTEGER AS vslot, NULL::INTEGER AS shard, (SELECT list(x ORDER BY h) FROM (SELECT h.i AS h, coalesce(sum(b) FILTER (keeps), 0)::BIGINT AS x FROM range({SHARDS}) h(i) LEFT JOIN k ON home = h.i GROUP BY 1)) AS loads
  UNION ALL
  SELECT m.k, m.vslot, (list_position(loads, list_min(loads)) - 1)::INTEGER, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + m.b ELSE x END)
  FROM deal JOIN m ON m.k = deal.k + 1
), final AS (SELECT k.vslot, coalesce(deal.shard, home) AS shard FROM k LEFT JOIN deal ON deal.vslot = k.vslot)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY vslot, doc_id, size, crc) - 1 AS slot, NULL::INTEGER AS grown_shard, vslot, CASE WHEN (SELECT count(*) FROM final JOIN k USING (vslot) WHERE shard <> home) > 0 THEN 2 ELSE 1 END::INTEGER AS version
FROM d JOIN final USING (vslot)
"""
