"""Word and window hashes of whole texts, vectorised per document."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.plans.runtime import cut

#: Documents without an id are ordered by a hash of their text, from here to the greatest whole number.
NAMELESS = 2**63 - 2**61
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def key_of(docs: DataFrame) -> Column:
    """A total order of documents: by doc_id; those without one come last, each text for itself.

    Every doc_id below ``NAMELESS`` comes before them. Rows without an id share a key only if their texts are equal.
    """
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1) - F.xxhash64(docs["text"]).bitwiseAND(2**61 - 1))


def id_of(key: str | Column) -> Column:
    """The doc_id that a key stands for, null for a document without one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key < NAMELESS, key)


def row_key(docs: DataFrame) -> Column:
    """A key of each row of ``docs``: a hash of doc_id and text. Only rows that agree in both share it."""
    return F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"].cast("long"), docs["text"].isNull(), docs["text"])


#: Row keys that are broadcast at most (8 bytes each); more are joined by a shuffle.
FEW = 200_000


def few(keys: DataFrame) -> DataFrame:
    """``keys`` kept, and marked for broadcast if they were counted to be few, so that texts needn't be shuffled."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` isn't in ``keys`` (one column), whatever else ``docs`` has."""
    keys = few(keys)
    return docs.join(keys, row_key(docs) == keys[keys.columns[0]], "left_anti")


def only_once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with one row, any of them, for each ``row_key`` in ``keys`` (one column); all other rows as they are."""
    keys = cut(keys)
    if not keys.limit(1).count():
        return docs
    names = [f"_{i}" for i in range(len(docs.columns))]
    listed = docs.select(row_key(docs).alias("_key"), F.struct(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True))).alias("_row"))
    one = listed.join(keys, listed["_key"] == keys[keys.columns[0]], "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return without(docs, keys).toDF(*names).unionByName(one).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


#: What separates words (fixed values).
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time, up to the next space; bounds the tables of powers.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(a: np.ndarray, k: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values, by doubling."""
    m = len(a) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    done, out, width, part, power = 0, None, 1, a, odd
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out = part[:m].copy() if out is None else out * power + part[done : done + m]
                done += width
            if done == k:
                return out
            part = part[:-width] * power + part[width:] if len(part) > width else part[:0]
            power = power * power
            width *= 2


def second(a: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same windows, independent of ``windows``."""
    return windows(mix(a ^ _ODD2), k, _ODD2)


class WordHashes:
    """64-bit hashes of a text's words, all words at once.

    Bytes get random values and the place of a byte in the text a power of an odd
    number; differences of running sums, divided by the power of the first place,
    are polynomial hashes of the words, wherever they stand.
    """

    def __init__(self) -> None:
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD2)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        while len(self.powers) < n:
            m = len(self.powers)
            self.powers = np.concatenate([self.powers, self.powers * np.uint64(pow(int(_ODD), m, 1 << 64))])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(pow(int(_ODD), -m, 1 << 64))])

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the runs of other than white space, in order."""
        if not text:
            return np.empty(0, np.uint64)
        if len(text) <= PIECE:
            return self._piece(text)
        parts, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(self._piece(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _piece(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        self._reach(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=total[1:])
        return mix((total[end] - total[start]) * self.inverse[start])


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def binary(batch: pa.RecordBatch, name: str) -> Iterable[bytes | None]:
    """A text column as UTF-8 bytes, without a detour over str."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
