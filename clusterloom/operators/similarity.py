"""Similarity of token sets and vectors, pair by pair.

Pairs of sets come from their common tokens, not from comparing all with all,
and a prefix filter keeps frequent tokens out of it: two sets that are similar
enough share one of the rarest tokens of the smaller one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterloom.plans.runtime import cut

#: Vectors compared at once; blocks that vectors are dealt to at most, each vector going once to each; vectors that a block may have before there are more blocks.
TILE, BLOCKS, LARGEST = 1_024, 24, 32_768

#: Tokens that have a rank, the most frequent ones; all that is sent to every task.
FREQUENT = 1_048_576
#: Tokens of sets that are compared in one task, blocks that more are dealt to, tokens that a block may have before there are more blocks.
ONE_BLOCK, SET_BLOCKS, BLOCK_TOKENS = 131_072, 8, 8_388_608
#: Tokens of the sets of a tile, about; sets compared with one at once; common tokens of heads counted at once; tokens by which heads are longer than they must be.
TILE_TOKENS, AT_ONCE, MET_AT_ONCE, MORE = 262_144, 1_024, 1_000_000, 3


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens in all tokens; 0 if a set is empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / total)


def overlap(a: Column, b: Column) -> Column:
    """Share of common tokens in the smaller set; 0 if a set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.least(F.size(a), F.size(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in index order; 0 if a norm is 0. A shorter ``b`` gives null, the tail of a longer one is ignored."""
    x, y = a.cast("array<double>"), F.slice(b.cast("array<double>"), F.lit(1), F.greatest(F.size(a), F.lit(1)))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    dot, na, nb = add(F.zip_with(x, y, lambda s, t: s * t)), add(F.transform(x, lambda s: s * s)), add(F.transform(y, lambda s: s * s))
    return F.when(F.size(a) > F.size(b), F.lit(None).cast("double")).when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


METRICS = {"jaccard": jaccard, "overlap": overlap}


def similar_pairs(sets: DataFrame, threshold: float, metric: str = "overlap", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., i, j, similarity) of pairs i < j of ``sets`` (by..., ord, tokens) with similarity >= ``threshold`` > 0.

    Exact. A set of m tokens shares at least ceil(t * m) of them with a set that
    is no smaller, hence one of its m - ceil(t * m) + 1 first in any order of all tokens. For Jaccard the
    same holds for the larger set, so that only the first of both meet. Tokens become numbers that are
    ordered by rarity, and only numbers travel: for ``overlap`` each set to a bounded number of blocks,
    for ``jaccard`` so the heads of sets, and whole ones once to each tile of sets that they are compared with; never a set with each pair. Null and
    empty sets have no pair, nor has a null in ``by``; repeated ``ord`` values are different rows of one number and no pair.
    """
    keys = list(by)
    told = cut(sets.dropna(subset=keys).select(*keys, "ord", F.array_distinct("tokens").alias("tokens"), F.monotonically_increasing_id().alias("row")).where("size(tokens) > 0"))
    pairs = _jaccard_pairs if metric == "jaccard" else _overlap_pairs
    return pairs(told, _numbers(told), threshold, keys)


def _numbers(told: DataFrame, seed: int = 0) -> DataFrame:
    """(..., m, ids, same, least): the tokens of ``told`` as ascending numbers, the rarest first.

    The most frequent tokens have their rank, all others a negative hash; where two tokens have one hash, another
    hash is taken. ``same`` is a digest of the set, ``least`` its smallest hash, which similar sets mostly share.
    """
    key = lambda token: F.xxhash64(F.lit(seed), token).bitwiseOR(F.lit(-(2**63)))
    often = cut(told.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often")).select(key(F.col("token")).alias("key"), "often"))
    found = often.agg(F.count("*"), F.countDistinct("key")).first()
    if found[0] != found[1]:
        return _numbers(told, seed + 1)
    least, n = 1, 0
    for r in often.groupBy("often").count().orderBy(F.desc("often")).toLocalIterator():
        n += r["count"]
        if n > FREQUENT or r["often"] == 1:
            least = r["often"]
            break
    top = often.where(F.col("often") > least).toPandas().sort_values(["key"])
    hashes, order = top["key"].to_numpy(dtype=np.int64), np.lexsort((top["key"], top["often"]))
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))

    def ranked(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            flat, m = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(m)
            starts, ids = ends - m, flat
            if len(hashes):
                near = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                ids = np.where(hashes[near] == flat, ranks[near], flat)
            ids = ids[np.lexsort((ids, np.repeat(np.arange(len(m)), m)))]
            same = [hashlib.blake2b(ids[s:e].tobytes(), digest_size=16).digest() for s, e in zip(starts, ends, strict=True)]
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same, pa.binary()), pa.array(np.minimum.reduceat(flat, starts))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "same", "least"])

    hashed = told.withColumn("m", F.size("tokens")).withColumn("ids", F.transform("tokens", key)).drop("tokens")
    schema = T.StructType([*hashed.schema.fields, T.StructField("same", T.BinaryType()), T.StructField("least", T.LongType())])
    return hashed.mapInArrow(ranked, schema)


def _first(m, threshold: float):
    """Tokens of a set of ``m`` of which a similar set that is no smaller has one. 1e-9 keeps the rounding of t * m from making them too few."""
    return m - (F.ceil(m * threshold - 1e-9).cast("int") if isinstance(m, Column) else np.ceil(m * threshold - 1e-9).astype(int)) + 1


def _overlap_pairs(told: DataFrame, numbers: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Sets are compared in blocks, each set of a pair of blocks with the larger ones that have one of its first tokens."""
    kind = numbers.schema["ord"].dataType
    found = [T.StructField("i", kind), T.StructField("j", kind), T.StructField("similarity", T.DoubleType())]
    pairs = _blockwise(numbers, told.select(*keys, F.size("tokens").alias("n")), keys, found, lambda x, y, side: x.larger(y, threshold, side))
    return pairs.where("i <> j").select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "similarity")


def _blockwise(sets: DataFrame, sizes: DataFrame, keys: list[str], fields: list[T.StructField], compare) -> DataFrame:
    """(by..., ``fields``) that ``compare`` finds for two blocks of ``sets`` (by..., ord, row, m, ids); ``sizes`` (by..., n) has their tokens.

    Each pair of blocks is compared in one task, which keeps an index of a block's tokens. Blocks are so few that what
    is shuffled grows with the sets and not with their square.
    """
    size = F.sum("n").alias("all")
    sets = sets.join(sizes.groupBy(*keys).agg(size), keys) if keys else sets.withColumn("all", F.lit(sizes.agg(size).first()[0] or 0))
    blocks = F.when(F.col("all") <= ONE_BLOCK, 1).otherwise(F.greatest(F.lit(SET_BLOCKS), F.ceil(F.col("all") / BLOCK_TOKENS))).cast("int")
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*keys, "ord", "m", "ids", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    schema = T.StructType([*(dealt.schema[k] for k in keys), *fields])

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, flat = np.unique(np.concatenate(pdf["ids"].to_list()), return_inverse=True)
        n = pdf["ids"].map(len)
        pdf = pdf.assign(n=n, start=n.cumsum() - n, ids=None).sort_values("m", kind="stable")
        x, y = (_Indexed(pdf[pdf["block"] == b], flat, len(words)) for b in key[-2:])
        found = [compare(x, x, None)] if key[-2] == key[-1] else [compare(x, y, "left"), compare(y, x, "right")]
        out = {f.name: np.concatenate(v) for f, v in zip(fields, zip(*found, strict=True), strict=True)}
        return pd.DataFrame({**{k: pd.Series([v] * len(out[fields[0].name]), dtype=object) for k, v in zip(keys, key, strict=False)}, **out})

    return dealt.groupBy(*keys, "bi", "bj").applyInPandas(compared, schema)


class _Indexed:
    """Sets of a block, smallest first, and where each token occurs in them."""

    def __init__(self, sets: pd.DataFrame, flat: np.ndarray, words: int) -> None:
        self.ord, self.m, self.n = (sets[c].to_numpy() for c in ("ord", "m", "n"))
        self.start = np.append(0, np.cumsum(self.n))
        self.flat = flat[np.repeat(sets["start"].to_numpy() - self.start[:-1], self.n) + np.arange(self.start[-1])].astype(np.int32)
        self.places = np.repeat(np.arange(len(self.m), dtype=np.int32), self.n)[np.argsort(self.flat, kind="stable")]
        self.posts = np.append(0, np.cumsum(np.bincount(self.flat, minlength=words)))

    def _lows(self, other: _Indexed, side: str | None) -> np.ndarray:
        """For each set the first of ``other`` that is larger, or as large if ``side`` is left; without a side the next one."""
        return np.arange(1, len(self.m) + 1) if side is None else np.searchsorted(other.m, self.m, side)

    def larger(self, other: _Indexed, threshold: float, side: str | None) -> tuple[np.ndarray, ...]:
        """(ord, ord of the other, overlap) where it is at least ``threshold``."""
        marks, out, lows, firsts = np.zeros(len(self.posts) - 1, dtype=np.int32), [], self._lows(other, side), _first(self.m, threshold)
        for k in np.flatnonzero(lows < len(other.m)):
            tokens = self.flat[self.start[k] : self.start[k + 1]]
            met = np.concatenate([other.places[other.posts[t] : other.posts[t + 1]] for t in tokens[: firsts[k]]])
            met = np.unique(met[met >= lows[k]])
            marks[tokens] = 1
            for at in range(0, len(met), AT_ONCE):
                some = met[at : at + AT_ONCE]
                n = other.n[some]
                begin = np.cumsum(n) - n
                both = np.add.reduceat(marks[other.flat[np.repeat(other.start[some] - begin, n) + np.arange(begin[-1] + n[-1])]], begin)
                share = both / self.m[k]
                enough = share >= threshold
                out.append((np.full(enough.sum(), self.ord[k]), other.ord[some[enough]], share[enough]))
            marks[tokens] = 0
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (self.ord[:0], other.ord[:0], np.empty(0))

    def alike(self, other: _Indexed, threshold: float, side: str | None) -> tuple[np.ndarray, ...]:
        """(ord, ord of the other) of sets, given by their heads, that have enough common tokens in these to be similar."""
        out, lows, highs = [], self._lows(other, side), np.searchsorted(other.m, self.m / threshold + 1e-6, "right")
        many = np.diff(other.posts)[self.flat]
        upto = np.append(0, np.cumsum(many))
        ends, k = upto[self.start], 0
        while k < len(self.m):
            till = max(k + 1, int(np.searchsorted(ends, ends[k] + MET_AT_ONCE, "right")) - 1)
            s, e = self.start[k], self.start[till]
            met = other.places[np.repeat(other.posts[self.flat[s:e]] - (upto[s:e] - upto[s]), many[s:e]) + np.arange(upto[e] - upto[s])]
            one = np.repeat(np.repeat(np.arange(k, till), self.n[k:till]), many[s:e])
            fits = (met >= lows[one]) & (met < highs[one])
            pairs, both = np.unique(one[fits] * len(other.m) + met[fits], return_counts=True)
            one, met = np.divmod(pairs, max(1, len(other.m)))
            m, n = self.m[one], other.m[met]
            #: all common tokens up to the end of one of the heads are in both, so that only the rest of that set can have more
            enough = both + np.maximum(m - self.n[one], n - other.n[met]) >= (m + n) * (threshold / (1 + threshold)) - 1e-9
            out.append((self.ord[one[enough]], other.ord[met[enough]]))
            k = till
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (self.ord[:0], other.ord[:0])


def _jaccard_pairs(told: DataFrame, numbers: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Heads of sets are compared in blocks, sets that can be similar in tiles. Equal sets count as one until the end. Sets with one ``least`` are a tile, or several if there are many tokens."""
    members = cut(numbers.select(*keys, "ord", "row", "m", "same", "least"))
    kinds = cut(members.groupBy(*keys, "same").agg(F.min("row").alias("first"), F.first("m").alias("m"), F.first("least").alias("least")))
    sizes = kinds.groupBy("least").agg(F.sum("m").alias("all"))
    tile = F.hash("least", F.pmod(F.xxhash64("first"), F.ceil(F.col("all") / TILE_TOKENS)))
    tiles = cut(kinds.join(sizes, "least").select(F.col("first").alias("row"), tile.alias("tile")))
    kept = cut(numbers.select(*keys, "row", "m", "ids").join(tiles.select("row"), "row"))

    head = F.least(F.col("m"), _first(F.col("m"), threshold) + MORE)
    #: half of a hash will do here: where two tokens look alike, a pair more is compared and none is lost
    short = lambda i: F.when(i < 0, F.shiftright(i, 32)).otherwise(i).cast("int")
    heads = kept.select(*keys, F.col("row").alias("ord"), "row", "m", F.transform(F.slice("ids", F.lit(1), head), short).alias("ids"))
    fields = [T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]
    pairs = cut(_blockwise(heads, kept.select(*keys, head.alias("n")), keys, fields, lambda x, y, side: x.alike(y, threshold, side)).select("x", "y"))
    for s in "xy":
        pairs = pairs.join(tiles.select(F.col("row").alias(s), F.col("tile").alias(f"t{s}")), s)
    pairs = cut(pairs.select("x", "y", F.least("tx", "ty").alias("ti"), F.greatest("tx", "ty").alias("tj")))

    needed = pairs.select("ti", "tj", F.explode(F.array("x", "y")).alias("row")).distinct()
    held = needed.join(kept.select("row", "ids"), "row").select("ti", "tj", F.col("row").alias("x"), F.lit(None).cast("long").alias("y"), "ids")
    asked = pairs.select("ti", "tj", "x", "y", F.lit(None).cast("array<long>").alias("ids"))
    met = held.union(asked).repartition("ti", "tj").sortWithinPartitions("ti", "tj", F.col("y").isNotNull(), "x")
    scored = cut(met.mapInArrow(lambda batches: _scored(batches, threshold), "x long, y long, similarity double"))

    named = members.join(kinds.select(*keys, "same", "first"), [*keys, "same"]).select(*keys, "ord", "row", "first")
    a = named.select(*keys, F.col("first").alias("x"), F.col("ord").alias("a"))
    b = named.select(F.col("first").alias("y"), F.col("ord").alias("b"))
    apart = scored.join(a, "x").join(b, "y")
    copies = named.select(*keys, "first", F.col("row").alias("row_a"), F.col("ord").alias("a")).join(named.select("first", F.col("row").alias("row_b"), F.col("ord").alias("b")), "first").where("row_a < row_b")
    found = apart.select(*keys, "a", "b", "similarity").union(copies.select(*keys, "a", "b", F.lit(1.0).alias("similarity")))
    return found.where("a <> b").select(*keys, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "similarity")


def _scored(batches, threshold: float):
    """(x, y, similarity) of the pairs asked for, from rows in order of tiles: first the sets of a pair of tiles, then the pairs asked for."""
    tile, held = None, {}
    for batch in batches:
        ti, tj, x = (batch.column(k).to_numpy() for k in range(3))
        asked = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        y = batch.column(3).fill_null(0).to_numpy()
        lists = batch.column(4)
        flat, m = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(m)
        cuts = np.flatnonzero((np.diff(ti) != 0) | (np.diff(tj) != 0) | (np.diff(asked) != 0) | (asked[1:] & (np.diff(x) != 0))) + 1
        out = []
        for s, e in zip([0, *cuts], [*cuts, len(x)], strict=True) if len(x) else ():
            if (ti[s], tj[s]) != tile:
                tile, held = (ti[s], tj[s]), {}
            if not asked[s]:
                held |= {x[k]: flat[ends[k] - m[k] : ends[k]].copy() for k in range(s, e)}
                continue
            one = held[x[s]]
            for k in range(s, e, AT_ONCE):
                others = [held[v] for v in y[k : min(k + AT_ONCE, e)]]
                size = np.array([len(v) for v in others])
                every = np.concatenate(others)
                both = np.add.reduceat((one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every).astype(np.int64), np.cumsum(size) - size)
                share = both / (len(one) + size - both)
                pas = np.flatnonzero(share >= threshold)
                out.append((x[k + pas], y[k + pas], share[pas]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], ["x", "y", "similarity"])


def sharing_pairs(sets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., i, j, jaccard, overlap) of all pairs i < j with a common token; all others have similarity 0."""
    keys = list(by)
    tokens = sets.select(*keys, "ord", F.size("tokens").alias("m"), F.explode(F.array_distinct("tokens")).alias("token"))
    a = tokens.select(*keys, "token", F.col("ord").alias("i"), F.col("m").alias("mi"))
    b = tokens.select(*keys, "token", F.col("ord").alias("j"), F.col("m").alias("mj"))
    both = a.join(b, [*keys, "token"]).where("i < j").groupBy(*keys, "i", "j").agg(F.count("*").alias("c"), F.max("mi").alias("mi"), F.max("mj").alias("mj"))
    return both.select(*keys, "i", "j", (F.col("c") / (F.col("mi") + F.col("mj") - F.col("c"))).alias("jaccard"), (F.col("c") / F.least("mi", "mj")).alias("overlap"))


def cosine_pairs(vectors: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(i, j, similarity) of pairs i < j of ``vectors`` (ord, embedding) with cosine >= ``threshold``.

    Blocks of vectors meet in pairs, each pair of blocks in one task as matrix
    products of ``tile`` vectors with ``tile``; what it returns is only what passes. There are
    no more than ``BLOCKS`` blocks until these would be larger than ``LARGEST``, so that what is shuffled
    grows with the vectors and not with their square. Vectors of
    different length are no pair; a null vector has none. An ``ord`` occurs once.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.where("embedding is not null").select(F.col("ord").cast("long").alias("ord"), (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("embedding"))
    n = rows.count()
    blocks = max(1, min(-(-n // tile), BLOCKS), -(-n // LARGEST))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted(set(pdf["embedding"].map(len))):
            same = pdf[pdf["embedding"].map(len) == size]
            left, right = (same[same["block"] == b] for b in key)
            x, y = (np.stack(p["embedding"].to_list()).astype(float) if len(p) else np.empty((0, size)) for p in (left, right))
            nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
            ox, oy = left["ord"].to_numpy(), right["ord"].to_numpy()
            for a in range(0, len(x), tile):
                for b in range(0, len(y), tile):
                    na, nb = nx[a : a + tile], ny[b : b + tile]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim = np.where((na[:, None] == 0) | (nb[None] == 0), 0.0, x[a : a + tile] @ y[b : b + tile].T / (na[:, None] * nb[None]))
                    r, c = np.nonzero(sim >= threshold)
                    i, j = ox[r + a], oy[c + b]
                    keep = (i < j) if key[0] == key[1] else (i != j)
                    out.append(pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "similarity": sim[r, c][keep]}))
        if not out:
            return pd.DataFrame({"i": np.empty(0, np.int64), "j": np.empty(0, np.int64), "similarity": np.empty(0)})
        return pd.concat(out)

    return dealt.groupBy("bi", "bj").applyInPandas(product, "i long, j long, similarity double")


def ordered_distinct(rows: DataFrame, value: str, ord_: str = "ord") -> DataFrame:
    """(value, ord): each value once, at the place of its first occurrence; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(ord_).alias(ord_))

