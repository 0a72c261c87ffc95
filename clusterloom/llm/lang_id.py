"""Language identification of code-switched text by a linear-chain CRF.

Each word is labelled. Affixes, character n-grams and, for words of the training
sample, the word itself score the labels of a word; learned transitions score
neighbours. Runs without white space of more than ``PIECE`` bytes are cut into
consecutive pieces, each a word of its own. Forward-backward gives the posterior of each word's label, whose
mean over a text's words is the text's distribution of languages.

The model is fitted on the driver to a bounded sample of labelled texts; there
whole segments of different languages are strung together so that transitions
are learned from switches. Labelling is a map over the table: emissions are looked
up per word, then all texts of a batch advance together, one word a step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.words import binary, key_of
from clusterloom.plans.runtime import small_batches

#: Sampled texts of a label, of all labels together (but at least ``FEW`` of each), and the characters of a text's sampled segment: what bounds the driver's sample.
TEXTS, ALL_TEXTS, FEW, SEGMENT_CHARS = 300, 14_400, 20, 6_000
#: Training chains computed at a time and their words; labels that each such portion of chains is meant for; weights; passes.
CHAINS, CHAIN, PER_PORTION, SLOTS, PASSES = 1_000, 60, 48, 1 << 16, 30
#: Words a worker remembers, words labelled at a time, and new words scored at a time.
REMEMBERED, AT_ONCE, PORTION = 300_000, 300_000, 4_096
#: Bytes of a word; what is longer is labelled piece by piece.
PIECE = 48
UNKNOWN = "und"


def pieces(word: bytes) -> list[bytes]:
    """``word`` in consecutive pieces of at most ``PIECE`` bytes, cut between characters."""
    out, at = [], 0
    while len(word) - at > PIECE:
        end = at + PIECE
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return [*out, word[at:]]


def features(word: str, listed: set[str] | None = None) -> list[int]:
    """Slots of a lower-cased word's features: affixes, n-grams with boundaries, and itself if listed."""
    core = word.strip("\"'.,;:!?()[]{}|*#$%&<>")
    raw = core.encode()
    seen = [b"p" + raw[:1], b"p" + raw[:2], b"p" + raw[:3], b"s" + raw[-1:], b"s" + raw[-2:], b"s" + raw[-3:], b"s" + raw[-4:]]
    bound = b"^" + raw + b"$"
    seen += [bound[i : i + 3] for i in range(len(bound) - 2)]
    if listed is None or core in listed:
        seen.append(b"w" + raw)
    crc = zlib.crc32
    return [crc(x) & (SLOTS - 1) for x in seen]


def _forward_backward(emit: np.ndarray, step: np.ndarray, starts: Sequence[int], active: Sequence[int]) -> np.ndarray:
    """Posteriors of chains laid out by time: rows starts[t] : starts[t] + active[t] hold word t of the longest chains."""
    alpha = np.empty_like(emit)
    last = emit[: active[0]] / emit[: active[0]].sum(axis=1, keepdims=True)
    alpha[: active[0]] = last
    for s, n in zip(starts[1:], active[1:], strict=True):
        last = (last[:n] @ step) * emit[s : s + n]
        last /= last.sum(axis=1, keepdims=True)
        alpha[s : s + n] = last
    back = np.ones((active[-1], emit.shape[1]), emit.dtype)
    turned = step.T.copy()
    for t in range(len(active) - 2, -1, -1):
        s, n, after = starts[t], active[t], active[t + 1]
        nxt = (emit[starts[t + 1] : starts[t + 1] + after] * back) @ turned
        nxt /= nxt.sum(axis=1, keepdims=True)
        if n > after:
            back = np.ones((n, emit.shape[1]), emit.dtype)
            back[:after] = nxt
        else:
            back = nxt
        alpha[s : s + n] *= back
    return alpha / alpha.sum(axis=1, keepdims=True)


class Model:
    """Labels, feature weights (slots x labels), transition scores and the listed words."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, listed: set[str]) -> None:
        self.labels, self.weights, self.moves, self.listed = labels, weights, moves, listed

    def scores(self, words: list[str]) -> np.ndarray:
        """Sums of the weights of each word's features (word, label)."""
        slots = [features(w, self.listed) for w in words]
        first = np.cumsum([0, *map(len, slots[:-1])])  # no word is without features
        return np.add.reduceat(self.weights[np.fromiter(chain.from_iterable(slots), np.int64)], first, axis=0)


def expected(score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors (time, chain, label), expected transitions (label, label) and the log of the partition functions' product.

    ``score`` (time, chain, label) are the words' scores of chains of one length. Only two
    steps' joint posteriors exist at a time; they are summed over chains at once.
    """
    n = len(score)
    top = score.max(axis=2, keepdims=True)
    emit, step = np.exp(score - top), np.exp(moves)
    alpha, log_z = np.empty_like(emit), float(top.sum())
    for t in range(n):
        now = emit[t] if t == 0 else (alpha[t - 1] @ step) * emit[t]
        total = now.sum(axis=1, keepdims=True)
        alpha[t] = now / total
        log_z += float(np.log(total).sum())
    post, back, joint = np.empty_like(emit), np.ones_like(emit[0]), np.zeros_like(step)
    for t in range(n - 1, -1, -1):
        node = alpha[t] * back
        post[t] = node / node.sum(axis=1, keepdims=True)
        if t:
            after = emit[t] * back
            before = alpha[t - 1] / ((alpha[t - 1] @ step) * after).sum(axis=1, keepdims=True)
            joint += step * (before.T @ after)
            back = after @ step.T
            back /= back.sum(axis=1, keepdims=True)
    return post, joint, log_z


class Training:
    """Chains of words with their labels, and the gradient of their likelihood."""

    def __init__(self, x: np.ndarray, y: np.ndarray, index: np.ndarray, k: int) -> None:
        #: words (time, chain) and labels; ``index`` has each word's slots, filled up with ``SLOTS``
        self.x, self.y, self.index, self.k = x, y, index, k
        self.moved = np.zeros((k, k))
        np.add.at(self.moved, (y[:-1].ravel(), y[1:].ravel()), 1)

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the log-likelihood by weights (SLOTS + 1, k) and moves, and the log-likelihood; a portion of chains at a time."""
        by_word = np.zeros((len(self.index), self.k))
        for column in self.index.T:
            by_word += weights[column]
        diff, joint, value = np.zeros_like(by_word), np.zeros_like(moves), float((self.moved * moves).sum())
        for c in range(0, self.x.shape[1], CHAINS):
            x, y = self.x[:, c : c + CHAINS], self.y[:, c : c + CHAINS]
            score = by_word[x]
            post, pairs, log_z = expected(score, moves)
            value += float(np.take_along_axis(score, y[:, :, None], axis=2).sum()) - log_z
            joint += pairs
            flat, gold = x.ravel(), y.ravel()
            for j in range(self.k):
                diff[:, j] += np.bincount(flat, (gold == j) - post[:, :, j].ravel(), len(diff))
        slots, width = self.index.ravel(), self.index.shape[1]
        g = np.stack([np.bincount(slots, np.repeat(diff[:, j], width), SLOTS + 1) for j in range(self.k)], axis=1)
        g[SLOTS] = 0
        return g, self.moved - joint, value


def strung(texts: Sequence[str], langs: Sequence[str], rng: np.random.Generator) -> tuple[list[str], set[str], Training | None]:
    """Labels, listed words and training chains: runs of 5 to 49 words of one text each, labels drawn evenly."""
    labels = sorted(set(langs))
    place = {x: i for i, x in enumerate(labels)}
    count: dict[str, int] = {}
    by_label: list[list[list[str]]] = [[] for _ in labels]
    for text, lang in zip(texts, langs, strict=True):
        words = [p.decode() for w in text.lower().split() for p in pieces(w.encode())]
        words = [w for w in words if any(c.isalpha() for c in w)]
        for w in words:
            count[w] = count.get(w, 0) + 1
        if words:
            by_label[place[lang]].append(words)
    listed = {w.strip("\"'.,;:!?()[]{}|*#$%&<>") for w, n in count.items() if n > 2}
    present = [j for j, runs in enumerate(by_label) if runs]
    if not present:
        return [], set(), None
    chains = CHAINS * -(-len(labels) // PER_PORTION)
    number: dict[str, int] = {}
    x, y = np.empty((CHAIN, chains), np.int32), np.empty((CHAIN, chains), np.int32)
    for c in range(chains):
        filled = 0
        while filled < CHAIN:
            j = present[int(rng.integers(len(present)))]
            run = by_label[j][int(rng.integers(len(by_label[j])))]
            n = min(CHAIN - filled, int(rng.integers(5, 50)), len(run))
            at = int(rng.integers(0, len(run) - n + 1))
            x[filled : filled + n, c], y[filled : filled + n, c] = [number.setdefault(w, len(number)) for w in run[at : at + n]], j
            filled += n
    slots = [features(w, listed) for w in number]
    index = np.full((len(slots), max(map(len, slots))), SLOTS, np.int32)
    for i, f in enumerate(slots):
        index[i, : len(f)] = f
    return labels, listed, Training(x, y, index, len(labels))


def fit(texts: Sequence[str], langs: Sequence[str], seed: int = 7) -> Model:
    """Maximum likelihood of weights and transitions with a small Gaussian prior, by Adam over all chains."""
    labels, listed, training = strung(texts, langs, np.random.default_rng(seed))
    k = len(labels)
    if training is None:
        return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)), set())
    weights, moves = np.zeros((SLOTS + 1, k)), np.zeros((k, k))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for i in range(1, PASSES + 1):
        g, gm, _ = training.gradient(weights, moves)
        for j, (value, grad) in enumerate(((weights, g - 0.02 * weights), (moves, gm / CHAIN - 0.1 * moves))):
            first[j] = 0.9 * first[j] + 0.1 * grad
            second[j] = 0.99 * second[j] + 0.01 * grad * grad
            value += 0.15 * (first[j] / (1 - 0.9**i)) / (np.sqrt(second[j] / (1 - 0.99**i)) + 1e-6)
    return Model(labels, weights[:SLOTS].astype(np.float32), moves, listed)


def fit_on(labelled: DataFrame, texts: int = TEXTS, all_texts: int = ALL_TEXTS) -> Model:
    """Fits on a sample of all labels: of each at most ``texts`` texts, less (but ``FEW``) where there are so many labels that they'd be more than ``all_texts``.

    Texts are chosen by hash, and of each a segment of ``SEGMENT_CHARS``
    characters from a place that the hash says. So the driver holds about 90 MB
    of characters, beyond 720 labels 120 kB a label.
    """
    sized = labelled.where("lang is not null and length(text) > 0").select("lang", "text", key_of(labelled).alias("key"))
    counts = {r["lang"]: r["count"] for r in sized.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    each = min(texts, max(FEW, all_texts // len(counts)))
    share = F.create_map(*(x for lang in sorted(counts) for x in (F.lit(lang), F.lit(min(1.0, each / counts[lang])))))
    dealt = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64("key", F.lit(6)), F.greatest(F.length("text") - SEGMENT_CHARS, F.lit(0)) + 1) + 1
    picked = sized.where(dealt < F.element_at(share, F.col("lang"))).withColumn("text", F.substring("text", start.cast("int"), F.lit(SEGMENT_CHARS)))
    rows = picked.orderBy(F.xxhash64("key", F.lit(7)), "key").select("lang", "text").limit(2 * each * len(counts)).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


class _Numbers(dict):
    """word -> number in order of first occurrence; ``new`` lists the words that were added."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


def _label(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k = len(model.labels)
        step = np.exp(model.moves).astype(np.float32) if k else None
        number = _Numbers()
        table = np.zeros((1, k), np.float32)
        lettered, long = np.zeros(1, bool), np.zeros(1, bool)

        def looked_up(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal table, lettered, long
            if len(number) > REMEMBERED:
                number.clear()
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            if number.new:
                if len(number) > len(table):
                    more = max(len(table), len(number) - len(table))
                    table = np.concatenate([table, np.zeros((more, k), np.float32)])
                    lettered, long = (np.concatenate([x, np.zeros(more, bool)]) for x in (lettered, long))
                first, scored, at = len(number) - len(number.new), [], []
                for i, w in enumerate(number.new, first):
                    long[i] = len(w) > PIECE
                    if long[i]:
                        continue
                    text = w.decode(errors="replace").lower()
                    lettered[i] = text.isalpha() or any(c.isalpha() for c in text)
                    if lettered[i]:
                        scored.append(text)
                        at.append(i)
                table[first : len(number)] = 0
                for c in range(0, len(at), PORTION):
                    table[at[c : c + PORTION]] = model.scores(scored[c : c + PORTION])
                number.new.clear()
            if long[ids].any():
                return looked_up([p for w in words for p in pieces(w)])
            return table[ids], lettered[ids]

        def solve(batch: list[tuple[int, np.ndarray, np.ndarray]], share: np.ndarray) -> None:
            """Mean posteriors over the lettered words of each text, the longest first."""
            batch.sort(key=lambda x: -len(x[2]))
            lengths = np.array([len(x[2]) for x in batch])
            active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            starts = np.concatenate([[0], np.cumsum(active)[:-1]])
            score = np.concatenate([x[1] for x in batch])
            text = np.repeat(np.arange(len(batch)), lengths)
            at = starts[np.arange(len(score)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] + text
            emit = np.empty_like(score)
            emit[at] = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-9
            post = _forward_backward(emit, step, starts.tolist(), active.tolist())[at]
            has = np.concatenate([x[2] for x in batch]).astype(float)
            for j in range(k):
                share[[x[0] for x in batch], j] = np.bincount(text, post[:, j] * has, len(batch)) / np.bincount(text, has, len(batch))

        for batch in batches:
            share = np.zeros((batch.num_rows, k))
            known = np.zeros(batch.num_rows, bool)
            waiting, held = [], 0
            sizes = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            order = np.argsort([-len(x) if (x := v.as_buffer()) else 0 for v in sizes], kind="stable") if k else []
            for i in order:
                raw = sizes[int(i)].as_py()
                words = raw.split() if raw else []
                if not words:
                    continue
                score, has = looked_up(words)
                if has.any():
                    known[i] = True
                    waiting.append((int(i), score, has))
                    held += len(has)
                    if held > AT_ONCE:
                        solve(waiting, share)
                        waiting, held = [], 0
            if waiting:
                solve(waiting, share)
            best = share.argmax(axis=1) if k else np.zeros(batch.num_rows, int)
            lang = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            top = np.where(known, np.minimum(1.0, share.max(axis=1)), 0.0) if k else np.zeros(batch.num_rows)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(top, pa.float64())], names=[*columns, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` (text, ...) with lang_pred and score.

    The whole text is labelled; of a run without white space each piece of ``PIECE`` bytes
    counts as a word. A null text, one without a letter and, if the
    model has no labels, every text gets `und` with score 0. Columns named
    lang_pred or score give way to the new ones; repeated rows stay.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights a label
    return docs.mapInArrow(_label(shared, docs.columns), schema)


def held_out():
    """Documents that no model learns from: a fourth of them, by checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def op9_lang_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def confident(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without those that have no language or whose main language has less than ``least`` of the words; columns as they were.

    So texts without a letter go, and those mixed so that no language has this share. The model learns from the same documents as in the query.
    """
    model = fit_on(docs.where(~held_out()))
    names = [c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)]  # out of the way of the new columns; texts travel once
    kept = identify(docs.toDF(*names), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
