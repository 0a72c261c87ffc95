"""Chat formatting after cumulative-snapshot collapse.

Chat services log a conversation anew after each turn. A rolling hash over its
turns names every prefix of a conversation; those that equal a proper prefix of
another conversation, or all of an equal one with a smaller id, are taken out by
anti-joins. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _framed(value: Column) -> Column:
    """Text after its length, so that neighbouring values can't run into each other."""
    return F.concat(F.char_length(value).cast("string"), F.lit(":"), value)


def _rolled(turns: Column) -> Column:
    """Hash of each prefix: of the hash before it and one more turn."""

    def step(done: Column, turn: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(F.sha2(F.concat(last, F.lit("|"), _framed(turn["role"]), _framed(turn["text"])), 256)))

    return F.aggregate(turns, F.array().cast("array<string>"), step)


def render(turns: Column) -> Column:
    """ChatML; markers inside a text are broken up so that they end no turn."""
    def plain(x: Column) -> Column:
        return F.replace(x, F.lit("<|"), F.lit("< |"))

    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(END + "\n"))), "")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes, n_turns); turns in order of turn (null first), role, text; null role and text are empty.

    A row without conv_id is a conversation of one turn; equal ones are one.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    logged = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.where("conv_id is null").select(F.col("conv_id"), F.struct(F.lit(None).cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text")).alias("t"))
    alone = alone.distinct().select("conv_id", F.array("t").alias("turns"))
    both = logged.unionByName(alone)
    return both.withColumn("hashes", _rolled(F.col("turns"))).withColumn("n_turns", F.size("turns").cast("long"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, turns) of the maximal conversations of ``turns`` (conv_id, turn, role, text, ...).

    ``n_logged`` counts the conversations equal to it, itself included; the
    smallest conv_id stands for them (any before none). Repeated turn numbers and repeated rows
    are turns in order of role and text. Other columns are ignored; an
    empty table gives an empty result. All turns of one conversation meet in
    one task, as they do in its rendering; equal openings don't.
    """
    convs = conversations_of(turns)
    whole = convs.select("conv_id", "n_turns", F.element_at("hashes", -1).alias("hash"))
    heads = whole.groupBy("n_turns", "hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    inner = convs.select(F.posexplode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("at", "hash"))
    prefixes = inner.select((F.col("at") + 1).cast("long").alias("n_turns"), "hash").distinct()
    maximal = heads.join(prefixes, ["n_turns", "hash"], "left_anti")
    own = convs.select(F.col("conv_id").alias("_conv"), "turns", F.element_at("hashes", -1).alias("_hash"))
    return maximal.join(own, (F.col("hash") == F.col("_hash")) & F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "n_turns", "n_logged", "turns")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    kept = collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return kept.select("conv_id", "n_turns", "n_logged", render(F.col("turns")).alias("text"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY k) AS turns,
         string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
  FROM n GROUP BY conv_id
), heads AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged, turns, any_value(text) AS text FROM c GROUP BY n_turns, turns
), prefixes AS (
  SELECT DISTINCT c.turns[1:k.k] AS turns FROM c, (SELECT DISTINCT k FROM n) k WHERE k.k < c.n_turns
)
SELECT conv_id, n_turns, n_logged, text FROM heads WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = heads.turns)
"""
