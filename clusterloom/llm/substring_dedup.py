"""Removal of passages that occur earlier, by relative Lempel-Ziv parsing.

The dictionary of a document is all text before it, each passage at its first
occurrence. It is indexed in blocks that
its content delimits: the windows of ``WINDOW`` words around one minimiser (the
least hash of ``GRAM`` words in a window) form a block, so that equal passages
fall into equal blocks wherever they stand. The index holds, for each
minimiser, the least and greatest document that has it, the place of the block in the least, and whether the blocks
around it differ. A document is then parsed greedily into factors (place, reference document,
place there, words), each the longest match from its place on:

* a minimiser that earlier documents have in one form only: the whole block is
  a match, no window of it is looked at again, and the next block prolongs it if it
  follows there as well;
* one whose blocks differ between documents: a factor may begin or end there, so
  the windows at this boundary are looked up themselves, each at its first occurrence;
* a repetition inside the document: the document's own beginning is the reference.

As every window has one place in the dictionary, a match can go on in one way
only, and the longest one is found by following it. After a factor the parse goes on with the first
window that the dictionary has and that isn't in the factor; the two may overlap, so that no
match over a factor's boundary is missed. A factor has at least one window and so ``WINDOW`` words; its words go. Only
index entries and boundary windows are shuffled,
and the texts once, by a key of the row; minima are combined before the shuffle, so that a
passage which a third of all documents share is one row per task. Windows are
equal if two 64-bit hashes are, blocks if the minimiser and a 64-bit hash are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.words import WordHashes, binary, key_of, mix, row_key, second, signed, windows
from clusterloom.plans.runtime import cut, rekeyed

WINDOW, GRAM = 20, 8
_STEP = np.uint64(0xD1342543DE82EF95)


class Parse:
    """Windows, minimisers and blocks of one document's hashed words."""

    powers = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray, window: int, gram: int) -> None:
        self.words, self.window = words, window
        self.full = windows(words, window)
        self.least = self._slide(mix(windows(words, gram)), window - gram + 1)

    @staticmethod
    def _slide(a: np.ndarray, width: int) -> np.ndarray:
        """Minimum of every ``width`` consecutive values, by doubling."""
        n, have = len(a) - width + 1, 1
        if n <= 0:
            return a[:0]
        while 2 * have <= width:
            a = np.minimum(a[:-have], a[have:])
            have *= 2
        return np.minimum(a[:n], a[width - have : width - have + n])

    def starts(self) -> np.ndarray:
        """Places where blocks begin."""
        return np.concatenate([[0], np.nonzero(self.least[1:] != self.least[:-1])[0] + 1]) if len(self.least) else np.empty(0, np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimiser, hash and first place of each block, distinct in the first two."""
        start = self.starts()
        if not len(start):
            return self.least, self.least, start
        longest = int(np.diff(np.append(start, len(self.least))).max())
        while len(Parse.powers) < longest:
            Parse.powers = np.concatenate([Parse.powers, Parse.powers * np.multiply.reduce(np.full(len(Parse.powers), _STEP))])
        within = np.arange(len(self.least)) - np.repeat(start, np.diff(np.append(start, len(self.least))))
        whole = mix(np.add.reduceat(mix(self.full) * Parse.powers[within], start))
        least = self.least[start]
        if len(np.unique(least)) == len(least):
            return least, whole, start
        first = np.unique(np.stack([least, whole], axis=1), axis=0, return_index=True)[1]
        return least[first], whole[first], start[first]

    def references(self, key: int, blocks: list | None, found: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window whether the dictionary has it, and the document and place where.

        ``blocks`` are (minimiser, document, place of the block there), ``found`` (window, document, place there).
        """
        doc, place = np.full(len(self.full), key, np.int64), np.arange(len(self.full))
        first, which = np.unique(self.full, return_index=True, return_inverse=True)[1:]
        place = first[which].astype(np.int64)
        known = place != np.arange(len(self.full))
        if blocks:
            h, ref, at = _looked_up(self.least, blocks)
            start = self.starts()
            offset = np.arange(len(self.least)) - np.repeat(start, np.diff(np.append(start, len(self.least))))
            known, doc, place = known | h, np.where(h, ref, doc), np.where(h, at + offset, place)
        if found:
            h, ref, at = _looked_up(self.full, found)
            known, doc, place = known | h, np.where(h, ref, doc), np.where(h, at, place)
        return known, doc, place

    def factors(self, known: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, reference document, place there, words) of each factor, in order."""
        at = np.flatnonzero(known)
        if not len(at):
            return at, at, at, at
        goes_on = (np.diff(at) == 1) & (np.diff(doc[at]) == 0) & (np.diff(place[at]) == 1)
        begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        length = np.diff(np.append(begin, len(at))) + self.window - 1
        first = at[begin]
        return first, doc[first], place[first], length

    def covered(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which words the factors hold."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        return np.cumsum(edge[:-1]) > 0


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _in(values: np.ndarray, listed: list | None) -> np.ndarray:
    return np.isin(values, np.array(listed, np.int64).view(np.uint64)) if listed else np.zeros(len(values), bool)


def _looked_up(values: np.ndarray, listed: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which ``values`` are listed (h, first, at), and their ``first`` and ``at``."""
    h, first, at = (np.array([x[c] for x in listed], np.int64) for c in ("h", "first", "at"))
    order = np.argsort(h.view(np.uint64))
    h, first, at = h.view(np.uint64)[order], first[order], at[order]
    i = np.minimum(np.searchsorted(h, values), len(h) - 1)
    return h[i] == values, first[i], at[i]


def _index(window: int, gram: int):
    out = pa.schema([("h", pa.int64()), ("b", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            parts, held = [], 0
            for key, row, text in zip(_column(batch, "key"), _column(batch, "row"), binary(batch, "text"), strict=True):
                h, b, at = Parse(hashes.of(text), window, gram).blocks()
                if len(h):
                    parts.append((signed(h), signed(b), at.astype(np.int64), np.full(len(h), key, np.int64), np.full(len(h), row, np.int64)))
                    held += len(h)
                if held > 200_000:
                    yield table(parts)
                    parts, held = [], 0
            if parts:
                yield table(parts)

    def table(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=out)

    return run


def _boundaries(window: int, gram: int):
    out = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for key, row, text, asked in zip(_column(batch, "key"), _column(batch, "row"), binary(batch, "text"), _column(batch, "asked"), strict=True):
                p = Parse(hashes.of(text), window, gram)
                here = np.nonzero(_in(p.least, asked))[0]
                if not len(here):
                    continue
                here = here[np.unique(p.full[here], return_index=True)[1]]
                w1, w2 = signed(p.full[here]), signed(second(p.words, window)[here])
                n = len(here)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(here.astype(np.int64)), pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, row, np.int64))], schema=out)

    return run


def _cut_out(window: int, gram: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.string()), ("factors", pa.string())]
    out = pa.schema([*fields, ("kept_text", pa.string())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, key, text, blocks, found in zip(_column(batch, "doc_id"), _column(batch, "key"), binary(batch, "text"), _column(batch, "blocks"), _column(batch, "found"), strict=True):
                words = (text or b"").split()
                p = Parse(hashes.of(text), window, gram)
                gone, told = np.zeros(len(words), bool), ""
                if len(p.full):
                    parts = p.factors(*p.references(key, blocks, found))
                    if len(parts[0]):
                        gone = p.covered(parts[0], parts[3])
                        told = ",".join(f"{s}:{d}:{t}:{n}" for s, d, t, n in zip(*(x.tolist() for x in parts), strict=True))
                kept = b" ".join(words) if not told else b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                edge = np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0]
                spans = ",".join(f"{s}:{e}" for s, e in zip(edge[::2], edge[1::2], strict=True))
                rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, told, *([kept.decode()] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans, factors[, kept_text]) for every row of ``docs`` (doc_id, text, ...).

    Words are runs of `[^\\x20\\x09-\\x0D]`, unchanged; ``spans`` are the removed
    word ranges, ``factors`` place:document:place there:words of each match. A null or empty text has no words, one of fewer than ``window``
    words loses none. Rows without a doc_id come after all others, in an order of their texts' hashes, which names them in ``factors``. Rows that share a
    doc_id stand at one place in the order: none of them is earlier than
    another. Other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), key_of(docs).alias("key"), row_key(docs).alias("row"))
    entries = base.select("key", "row", "text").mapInArrow(_index(window, gram), "h long, b long, at long, key long, row long")
    index = entries.groupBy("h").agg(F.min("key").alias("first"), F.min_by("at", "key").alias("at"), F.max("key").alias("last"), F.min("b").alias("x"), F.max("b").alias("y"))
    index = index.where("first < last").select("h", "first", "at", (F.col("x") != F.col("y")).alias("differ"))
    hits = entries.select("h", "key", "row").join(rekeyed(index, "h"), "h").where("differ or key > first")
    told = F.collect_set(F.when(~F.col("differ"), F.struct("h", "first", "at")))
    asked = cut(hits.groupBy("row").agg(told.alias("blocks"), F.collect_set(F.when(F.col("differ"), F.col("h"))).alias("asked")))
    checked = cut(
        base.select("key", "row", "text").join(asked.where("size(asked) > 0").select("row", "asked").hint("shuffle_hash"), "row").mapInArrow(_boundaries(window, gram), "w1 long, w2 long, at long, key long, row long")
    )
    first = checked.groupBy("w1", "w2").agg(F.min("key").alias("first"), F.min_by("at", "key").alias("there"), F.max("key").alias("last")).where("first < last").select("w1", "w2", "first", "there")
    found = checked.join(rekeyed(first, "w1", "w2"), ["w1", "w2"]).where("key > first").groupBy("row").agg(F.collect_set(F.struct(F.col("w1").alias("h"), "first", F.col("there").alias("at"))).alias("found"))
    told = asked.select("row", "blocks").join(found, "row", "left")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string, factors string" + (", kept_text string" if with_text else "")
    return base.join(told.hint("shuffle_hash"), "row", "left").select("doc_id", "key", "text", "blocks", "found").mapInArrow(_cut_out(window, gram, with_text), out)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM w)),
k AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, row_number() OVER o AS r, first_value(doc_id) OVER o AS ref, first_value(i) OVER o AS there FROM p WINDOW o AS (PARTITION BY h ORDER BY doc_id, i)) WHERE r > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM k),
g AS (SELECT doc_id, count(*) AS gone FROM m GROUP BY doc_id),
e AS (SELECT doc_id, string_agg((s - 1) || ':' || t, ',' ORDER BY s) AS spans FROM (SELECT doc_id, min(pos) AS s, max(pos) AS t FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m) GROUP BY doc_id, run) GROUP BY doc_id),
f AS (SELECT doc_id, string_agg((s - 1) || ':' || ref || ':' || (t - 1) || ':' || (n + 19), ',' ORDER BY s) AS factors FROM (
  SELECT doc_id, ref, min(i) AS s, min(there) AS t, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ref, there - i ORDER BY i) AS run FROM k) GROUP BY doc_id, ref, there - i, run) GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w) x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = x.doc_id AND m.pos = x.pos) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(spans, '') AS spans, coalesce(factors, '') AS factors
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id)
"""
