"""MinHash near-dedup with odd sketches.

A document's set holds its distinct five-word shingles. Equal sets are one
class from the start. Classes meet in bands of three MinHash values; a bucket
with several classes is compared in blocks of bounded size, by odd sketches:
the MinHash sample of a set (all of it up to ``SAMPLE`` shingles, else those
whose hash lies under a power of two that its size fixes) is folded into a
bitmap of parities. XOR of two bitmaps is the bitmap of the symmetric
difference, and its population count estimates that difference most precisely
where sets are nearly equal. No pair is emitted for being in one bucket. First
each block of a bucket is compared in itself, which takes time in proportion to
the bucket, and gives the forest of its best estimates; these are confirmed on
full sets and joined into components. As every band deals a family into other
blocks, what is linked is one component by then. Only buckets that hold several
components are looked at again: their largest component against the other
rows, and these among each other, never the largest within itself; all pairs of different
components that the estimate can't rule out are confirmed. Every accepted link is
confirmed on full sets, and no link of different components that met in a
bucket remains untried.

At similarity 0.85, 20 bands of 3 miss a pair with probability 5e-9, at 0.8
with 6e-7. Estimates rule out pairs only ``SIGMAS`` deviations off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.words import WordHashes, binary, id_of, key_of, mix, only_once, row_key, signed, windows, without
from clusterloom.plans.components import connected_components
from clusterloom.plans.runtime import cut, rekeyed

SHINGLE, BANDS, ROWS = 5, 20, 3
#: Shingles that a sketch samples at most before it takes the next coarser rate, and its bits.
SAMPLE, BITS = 512, 1024
#: Classes in a block; a task holds two blocks at a time.
BLOCK = 512
SIGMAS = 6.0
_SEEDS = mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of hashed ``words``; fewer than k words are one shingle."""
    if not len(words):
        return words
    return np.unique(mix(windows(words, min(k, len(words)))))


def level_of(n: int) -> int:
    """The sampling rate of a set of ``n``: one in 2**level."""
    return max(0, int(n - 1).bit_length() - SAMPLE.bit_length() + 1) if n > SAMPLE else 0


def odd_sketch(s: np.ndarray, level: int) -> np.ndarray:
    """Parities of the sampled shingles, by slot, as 64-bit words."""
    if level:
        s = s[s >> np.uint64(64 - level) == 0]
    slots = np.bincount((mix(s) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS)
    return np.packbits((slots & 1).astype(np.uint8)).view(np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """One hash a band, over ``ROWS`` MinHash values each."""
    least = np.empty(BANDS * ROWS, np.uint64)
    for at in range(0, len(s), 8192):
        part = s[at : at + 8192]
        now = (part[None, :] * _SEEDS[:, None]).min(axis=1)
        least = np.minimum(least, now) if at else now
    rows = mix(least.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64))
    folded = rows[:, 0] ^ mix(rows[:, 1] + np.uint64(1)) ^ mix(rows[:, 2] + np.uint64(2))
    return mix(folded + np.arange(BANDS, dtype=np.uint64))


def _profile(k: int):
    out = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("level", pa.int32()), ("bands", pa.list_(pa.int64())), ("near", pa.binary()), ("far", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for text in binary(batch, "text"):
                s = shingles(hashes.of(text.lower() if text else None), k)
                if not len(s):
                    got = (0, 0, 0, 0, None, None, None)
                else:
                    level = level_of(len(s))
                    #: of the whole sorted set, so that sets are equal if their digests are
                    s1, s2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                    got = (len(s), s1, s2, level, signed(minhash(s)), odd_sketch(s, level).tobytes(), odd_sketch(s, level + 1).tobytes())
                for column, value in zip(rows, got, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("key")), *(pa.array(c, f.type) for c, f in zip(rows, list(out)[2:], strict=True))], schema=out
            )

    return run


def _sets(k: int):
    out = pa.schema([("key", pa.int64()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(t.lower() if t else None), k).tobytes() for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(sets, pa.binary())], schema=out)

    return run


def _estimates(left: dict, right: dict, threshold: float) -> np.ndarray:
    """Estimated similarity of each pair of two blocks; -1 where it is safely below ``threshold``."""
    na, nb = left["n"][:, None].astype(float), right["n"][None, :].astype(float)
    la, lb = left["level"][:, None], right["level"][None, :]
    out = np.full((len(left["n"]), len(right["n"])), -1.0)
    sized = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (abs(la - lb) <= 1)
    for a, b, here in (("near", "near", la == lb), ("far", "near", la < lb), ("near", "far", la > lb)):
        rows, cols = np.nonzero(sized & here)
        for at in range(0, len(rows), 65536):
            r, c = rows[at : at + 65536], cols[at : at + 65536]
            level = np.maximum(left["level"][r], right["level"][c])
            odd = np.bitwise_count(left[a][r] ^ right[b][c]).sum(axis=1).astype(float)
            odd = np.minimum(odd, BITS / 2 * 0.98)
            rate = 0.5**level
            total = left["n"][r] + right["n"][c]
            diff = -BITS / 2 * np.log1p(-2 * odd / BITS)
            #: the largest symmetric difference that a link may have, and what its estimate may stray by
            most = total * (1 - threshold) / (1 + threshold) * rate
            odds = BITS / 4 * np.expm1(4 * most / BITS) - most
            stray = SIGMAS * np.sqrt(np.where(level > 0, most * (1 - rate), 0.0) + odds + 0.05) + 1
            est = (total - diff / rate) / (total + diff / rate)
            out[r, c] = np.where(diff <= most + stray, est, -1.0)
    return out


def _forest(est: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[int]:
    """Pairs of the spanning forest of greatest estimates."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    kept = []
    for i in np.argsort(-est, kind="stable"):
        a, b = top(int(rows[i])), top(int(cols[i]))
        if a != b:
            parent[a] = b
            kept.append(int(i))
    return kept


def _compare(threshold: float, forest: bool):
    """Kernel over rows sorted by (bucket, bi, bj): candidate pairs of each pair of blocks."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(group: dict) -> tuple[np.ndarray, np.ndarray]:
        bi, bj = int(group["bi"][0]), int(group["bj"][0])
        parts = []
        for block in dict.fromkeys((bi, bj)):
            here = group["block"] == block
            parts.append({k: v[here] for k, v in group.items()})
        left, right = parts[0], parts[-1]
        est = _estimates(left, right, threshold)
        if bi == bj:
            est[np.tril_indices(len(est))] = -1.0
        est[left["key"][:, None] == right["key"][None, :]] = -1.0
        est[left["component"][:, None] == right["component"][None, :]] = -1.0
        r, c = np.nonzero(est >= 0)
        a, b = left["key"][r], right["key"][c]
        if forest and len(a) > 1:
            kept = _forest(est[r, c], a, b)
            a, b = a[kept], b[kept]
        return np.minimum(a, b), np.maximum(a, b)

    def numbers(table: pa.Table) -> dict:
        group = {k: table.column(k).to_numpy() for k in ("bucket", "bi", "bj", "block", "key", "n", "level", "component")}
        for k in ("near", "far"):
            group[k] = np.frombuffer(b"".join(table.column(k).to_pylist()), np.uint64).reshape(len(table), BITS // 64)
        return group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            if not len(whole):
                return
            group = numbers(whole)
            new = np.zeros(len(whole), bool)
            for k in ("bucket", "bi", "bj"):
                new[1:] |= group[k][1:] != group[k][:-1]
            cuts = [0, *np.nonzero(new)[0].tolist(), len(whole)]
            found = [pairs({k: v[s:e] for k, v in group.items()}) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for k in ("bucket", "bi", "bj"):
                v = batch.column(batch.schema.get_field_index(k)).to_numpy()
                same &= v == v[-1]
            #: where the last group of this batch begins; the next batch may continue it
            last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from finish(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[held[-1].num_rows - 1] != batch.column(batch.schema.get_field_index(k))[0] for k in ("bucket", "bi", "bj")):
                yield from finish(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def _confirm(threshold: float):
    """Pairs whose full sets are similar enough, in whole numbers."""
    percent = round(threshold * 100)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("left", "right")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            pairs = [batch.column(batch.schema.get_field_index(k)).filter(pa.array(keep, pa.bool_())) for k in ("a", "b")]
            yield pa.RecordBatch.from_arrays(pairs, schema=out)

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.85, k: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """(doc_id, key, n_shingles, component) for every row of ``docs`` (doc_id, text, ...).

    Words are runs of `[^\\x20\\x09-\\x0D]` after lower-casing A-Z. Documents are
    linked if 100 * intersection >= 100 * threshold * union of their sets
    (``threshold`` in whole hundredths); ``component`` is the least key that links
    lead to. A null text or one without words has the empty set and no link.
    Documents without a doc_id come last, each text is one of its own. Rows that share a doc_id are one
    document with several texts: a link of one is a link of all; ``key`` (whole
    numbers) tells documents apart in place of doc_id. Other columns are
    ignored, an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (key_of(docs) if key is None else key).alias("key"))
    profiles = cut(base.mapInArrow(_profile(k), "doc_id long, key long, n long, s1 long, s2 long, level int, bands array<long>, near binary, far binary"))

    filled = profiles.where("n > 0")
    #: of the rows of a class that share the least key, any will do: their sets are equal
    least = F.min(F.struct("key", "level", "bands", "near", "far")).alias("least")
    classes = cut(filled.groupBy("n", "s1", "s2").agg(least).select("n", "s1", "s2", "least.*"))
    heads = classes.select("n", "s1", "s2", F.col("key").alias("head"))
    copies = filled.select("key", "n", "s1", "s2").join(heads, ["n", "s1", "s2"]).where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    member = classes.select("key", F.explode("bands").alias("bucket"))
    #: buckets with the same members are one; their count and sums of two hashes tell
    buckets = (
        member.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.sum(F.xxhash64("key").bitwiseAND(0xFFFFFFFF)).alias("h1"), F.sum(F.xxhash64("key", F.lit(7)).bitwiseAND(0xFFFFFFFF)).alias("h2"))
        .where("size > 1")
        .groupBy("size", "h1", "h2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    seats = cut(member.join(buckets, "bucket").select("key", "bucket", "blocks"))
    met = seats.select("key").distinct()
    sets = cut(base.select("key", "text").join(met.hint("shuffle_hash"), "key", "left_semi").mapInArrow(_sets(k), "key long, members binary").where("length(members) > 0").distinct())
    own = classes.select("key", "n", "level", "near", "far")

    def dealt(rows: DataFrame, kept: bool) -> DataFrame:
        """Candidate pairs of ``rows`` (key, bucket, component, block, bi, bj)."""
        spread = rows.join(own, "key").select("bucket", "bi", "bj", "block", "key", "n", "level", "component", "near", "far")
        spread = spread.repartition(F.col("bucket"), F.col("bi"), F.col("bj")).sortWithinPartitions("bucket", "bi", "bj")
        return spread.mapInArrow(_compare(threshold, kept), "a long, b long").distinct()

    def place(blocks: str) -> Column:
        """The block of a row, another one in each band."""
        return F.pmod(F.xxhash64("key", "bucket"), F.greatest(F.col(blocks), F.lit(1))).cast("int")

    def within() -> DataFrame:
        """Blocks in themselves; no links yet, so every class is a component."""
        at = seats.withColumn("component", F.col("key")).withColumn("block", place("blocks"))
        return dealt(at.withColumns({"bi": F.col("block"), "bj": F.col("block")}), True)

    def across(component: DataFrame) -> DataFrame:
        """Blocks of rows outside a bucket's largest component, with each other and with that component's blocks."""
        at = seats.join(component, seats["key"] == component["node"], "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
        parts = at.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
        #: ties are broken, as a stage that is run again must deal rows as before
        largest = parts.groupBy("bucket").agg(F.max(F.struct("rows", "component")).alias("x"), F.sum("rows").alias("rows"), F.count("*").alias("parts")).where("parts > 1")
        largest = largest.select("bucket", F.col("x.component").alias("most"), F.col("x.rows").alias("in_most"), "rows")
        sides = largest.select("bucket", "most", F.ceil(F.col("in_most") / BLOCK).cast("int").alias("there"), F.ceil((F.col("rows") - F.col("in_most")) / BLOCK).cast("int").alias("here"))
        at = at.join(rekeyed(sides, "bucket"), "bucket")
        inside = F.col("component") == F.col("most")
        #: blocks of the largest component count down from -1
        at = at.withColumn("block", F.when(inside, -1 - place("there")).otherwise(place("here")))
        others = F.sequence(F.when(inside, 0).otherwise(-F.col("there")), F.col("here") - 1)
        at = at.withColumn("other", F.explode(others))
        return dealt(at.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}), False)

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("key").alias("a"), F.col("members").alias("left"))
        right = sets.select(F.col("key").alias("b"), F.col("members").alias("right"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm(threshold), "u long, v long").distinct()

    first = cut(within())
    links = cut(confirmed(first).union(copies.distinct()))
    component = connected_components(links)
    rest = across(component).join(first, ["a", "b"], "left_anti")
    component = connected_components(links.union(confirmed(rest)))
    return profiles.join(component, profiles["key"] == component["node"], "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs, 0.85)
    return out.select("doc_id", "n_shingles", id_of("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-copies; columns as they were.

    Each row is judged on its own text, also those without a doc_id and those
    that share one. The row of the least doc_id stays, null last. Of rows that
    agree in doc_id and text one stays, whatever else they hold, unless they have no words:
    rows without words are no copies and all stay.
    """
    rows = cut(near_duplicates(docs, threshold, key=row_key(docs)).select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "key", "n_shingles", "component"))
    stays = rows.groupBy("component").agg(F.min(F.struct("id", "key"))["key"].alias("stays")).select("stays")
    each = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n"))
    gone = each.join(stays, F.col("key") == F.col("stays"), "left_anti").select(F.col("key").alias("_gone"))
    left = without(docs, gone)
    return only_once(left, each.where("rows > 1 and n > 0").select(F.col("key").alias("_once")))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
pairs AS MATERIALIZED (
  SELECT p.doc_id AS u, q.doc_id AS v FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))
), both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT doc_id, doc_id AS top FROM s UNION SELECT v, top FROM reach JOIN both_ways ON doc_id = u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
