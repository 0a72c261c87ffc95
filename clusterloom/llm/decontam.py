"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a benchmark
question with other parameters has the same template. Windows of template tokens
are hash-joined with those of the benchmark, both as tables; a bitmap of the
benchmark's windows, of bounded size, keeps most others out of the join. Items that a document shares
enough windows with are compared with it in full. A hit only counts if the
fillings agree: along one alignment of a question and a document each value of a
slot corresponds to one value, and back, in lower case. Equal values come first,
then the most frequent pairs; a window with a slot filled otherwise doesn't count,
whatever the other windows hold.

Items and documents are compared in three forms: with names as placeholders,
with names as they are, and with every word as it is, but for case. The last
finds each copy of 13 tokens, even of items that are mostly numbers, units and names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.words import binary, key_of, mix, row_key, signed, windows, without
from clusterloom.plans.runtime import cut

#: Template tokens in a window; of these, those that must not be placeholders.
WINDOW, LITERAL = 8, 4
#: Tokens of a question that agreeing windows must cover, and the share of it that is enough if it is short.
COVERED, SHARE = 13, 0.8
#: Words a worker remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 300_000
#: The bitmap of window hashes has at most 2 ** ``BITS`` bits (16 MB); beyond that it lets more windows into the join.
BITS = 27
#: Sets of items whose index a worker keeps.
INDEXES = 256

#: Units of measure and words for small numbers (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters "
    "litre litres dollar dollars euro euros cent cents percent degree degrees km/h mph kmh usd eur".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion dozen half first third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth "
    "thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth hundredth".split()
)
ORDINALS = frozenset("st nd rd th".split())
_EDGE = b"\"'`.,;:!?()[]{}<>|*#$%&_~=+-/\\"
_NUMBER, _UNIT, _NAME, _MEASURE = (np.uint64(x << 2) for x in (3, 5, 7, 11))
_SLOTS = np.array([_NUMBER, _UNIT, _NAME, _MEASURE])
_KIND = ~np.uint64(3)


class Tokens(dict):
    """word -> its place in ``kind`` and ``plain``.

    ``kind`` holds its template token with two flags in its lowest bits (1 the word is shaped like a name,
    2 it ends a sentence), ``plain`` the hash of the word itself, whatever its case.
    """

    def __init__(self) -> None:
        super().__init__()
        self.kind, self.plain = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGE)
        text = core.decode(errors="replace")
        low = text.casefold()
        plain = value = xxhash.xxh3_64_intdigest(low) << 2 & (2**64 - 1)
        if core[:1].isdigit():
            rest = low.lstrip("0123456789.,:-/")
            value = int(_NUMBER if not rest or rest in ORDINALS else _MEASURE if rest in UNITS else plain)
        elif low in NUMBERS or ("-" in low and all(x in NUMBERS for x in low.split("-"))):
            value = int(_NUMBER)
        elif low in UNITS and (len(low) > 1 or low == text):
            value = int(_UNIT)
        elif len(text) > 1 and text[0].isupper() and text[1:].islower():
            value |= 1
        if word.rstrip(b"\"')]*")[-1:] in (b".", b"!", b"?", b":"):
            value |= 2
        i = self[word] = len(self)
        if i == len(self.kind):
            self.kind, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kind, self.plain))
        self.kind[i], self.plain[i] = value, plain
        return i


def forms(words: list[bytes], known: Tokens) -> list[np.ndarray]:
    """The different ones of a text's token sequences: with names (capitalised words inside a sentence) as placeholders, without, and with no placeholders at all."""
    if len(known) >= REMEMBERED:
        known.clear()
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    raw, plain = known.kind[at], known.plain[at]
    token = raw & _KIND
    out = [token]
    named = (raw & np.uint64(1)) == 1
    named[:1] = False
    named[1:] &= (raw[:-1] & np.uint64(2)) == 0
    if named.any():
        out = [np.where(named, _NAME, token), token]
    return out if (plain == token).all() else [*out, plain]


def _window_hashes(token: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and which have enough literal tokens."""
    literal = np.concatenate([[0], np.cumsum(token > _SLOTS.max())])
    return mix(windows(token, width)), literal[width:] - literal[:-width] >= -(-LITERAL * width // WINDOW)


def filling(word: bytes) -> str:
    """What a slot holds, as it is compared."""
    return word.strip(_EDGE).decode(errors="replace").casefold()


def conflicts(slots: dict[int, tuple[int, str, str]]) -> set[int]:
    """The places of ``slots`` (place -> kind, value, other value) outside the one-to-one map of their values.

    Equal values are in the map, then the most frequent pairs, of these the first ones.
    """
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    pairs = Counter(slots.values())
    for kind, a, b in sorted(pairs, key=lambda x: (x[1] != x[2], -pairs[x])):
        if (kind, a) not in there and (kind, b) not in back:
            there[kind, a], back[kind, b] = b, a
    return {x for x, (kind, a, b) in slots.items() if there.get((kind, a)) != b}


def item_windows(words: list[bytes], known: Tokens) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Width of an item's windows, and for each form hashes and places of those with enough literal tokens and not in a form before."""
    width, before, out = min(WINDOW, len(words)), [], []
    for token in forms(words, known):
        h, new = _window_hashes(token, width)
        for x in before:
            new &= h != x
        before.append(h)
        at = np.nonzero(new)[0]
        out.append((h[at], at))
    return width, out


def needed(n: int) -> int:
    """Tokens of an item of ``n`` that must be covered."""
    return min(COVERED, math.ceil(SHARE * n))


def document_windows(seen: list[np.ndarray], widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, hashes, places) of a document's windows with enough literal tokens, those of each form that no form before has there."""
    for width in widths:
        before: list[np.ndarray] = []
        for token in seen if len(seen[0]) >= width else ():
            h, ok = _window_hashes(token, width)
            for x in before:
                ok &= h != x
            before.append(h)
            place = np.nonzero(ok)[0]
            yield width, h[place], place


class Index:
    """Windows of some benchmark items, each in all its forms."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        known = Tokens()
        self.ids, self.words, self.forms = [], [], []
        found = []
        for number, text in items:
            words = text.split()
            if not words:
                continue
            for i, (h, at) in enumerate(item_windows(words, known)[1]):
                found.append((h, np.full(len(h), len(self.ids)), np.full(len(h), i), at))
            self.ids.append(number)
            self.words.append(words)
            self.forms.append(forms(words, known))
        kinds = np.uint64, np.int32, np.int8, np.int32
        self.hashes, self.item, self.form, self.at = (np.concatenate(x).astype(k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)) if found else (np.empty(0, k) for k in kinds)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.form, self.at = self.hashes[order], self.item[order], self.form[order], self.at[order]
        self.widths = sorted({min(WINDOW, len(w)) for w in self.words})

    def hits(self, seen: list[np.ndarray]) -> set[tuple[int, int, int, int]]:
        """(item, its form, place in the document, place in the item) of equal windows; ``seen``: the forms of the document."""
        found = set()
        for width, h, place in document_windows(seen, self.widths):
            low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for i in np.flatnonzero(low < high).tolist():
                for q in range(low[i], high[i]):
                    if min(WINDOW, len(self.words[self.item[q]])) == width:
                        found.add((int(self.item[q]), int(self.form[q]), int(place[i]), int(self.at[q])))
        return found

    def matches(self, words: list[bytes], seen: list[np.ndarray]) -> Iterator[tuple[int, int, int, bool]]:
        """(item_id, item's tokens, tokens covered, other fillings) of the items that a document contains."""
        lines: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for item, form, p, q in self.hits(seen):
            lines[item, p - q].append((form, q))
        found: dict[int, tuple[set, set]] = {}
        for (item, shift), places in sorted(lines.items()):
            mine, theirs = self.forms[item], self.words[item]
            width = min(WINDOW, len(theirs))
            slots = {}
            for x, form in sorted({(x, form) for form, q in places for x in range(q, q + width)}):
                if mine[form][x] in _SLOTS:
                    slots[x] = int(mine[form][x]), filling(theirs[x]), filling(words[x + shift])
            void = conflicts(slots)
            changed = {x for x, (_, a, b) in slots.items() if a != b}
            for _, q in places:
                window = range(q, q + width)
                if void.isdisjoint(window):
                    found.setdefault(item, (set(), set()))[not changed.isdisjoint(window)].update(window)
        for item, (same, other) in found.items():
            n = len(self.words[item])
            if len(same | other) >= needed(n):
                yield self.ids[item], n, len(same | other), bool(other - same)


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns or [[]] * len(schema), schema, strict=True)], schema=schema)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _of_items():
    """(h, item, width, times, need): the windows of each item, how often it has them, and how many of its windows a document must share."""
    out = pa.schema([("h", pa.int64()), ("item", pa.int64()), ("width", pa.int32()), ("times", pa.int64()), ("need", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for batch in batches:
            rows = []
            for item, text in zip(_columns(batch, "item")[0], binary(batch, "text"), strict=True):
                words = text.split()
                if words:
                    width, found = item_windows(words, known)
                    every, times = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
                    need = -(-needed(len(words)) // width)
                    rows += [(h, item, width, n, need) for h, n in zip(signed(every).tolist(), times.tolist(), strict=True)]
            yield _rows(list(zip(*rows, strict=True)), out)

    return run


def _of_documents(shared, widths: list[int], bits: int):
    """The rows that have windows in the bitmap, with the different hashes of these."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.string()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value.view(np.uint64)
        word, bit, one = np.uint64(70 - bits), np.uint64(64 - bits), np.uint64(1)
        known = Tokens()
        for batch in batches:
            rows, at = [], []
            ids, keys = _columns(batch, "doc_id", "key")
            for i, text in enumerate(binary(batch, "text")):
                words = (text or b"").split()
                found = []
                for _, h, _ in document_windows(forms(words, known), widths):
                    h = h[(listed[h >> word] >> (h >> bit & np.uint64(63)) & one) == one]
                    if len(h):
                        found.append(h)
                if found:
                    at.append(i)
                    rows.append((ids[i], keys[i], signed(np.unique(np.concatenate(found)))))
            ids, keys, found = list(zip(*rows, strict=True)) or [[]] * 3
            texts = batch.column(batch.schema.get_field_index("text")).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), texts, pa.array(found, pa.list_(pa.int64()))], schema=out)

    return run


def _compared():
    """The items among a row's candidates that it contains."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("item_tokens", pa.int64()), ("matched", pa.int64()), ("reparameterised", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = Tokens(), {}
        for batch in batches:
            rows = []
            for doc_id, key, items, text in zip(*_columns(batch, "doc_id", "key", "items"), binary(batch, "text"), strict=True):
                asked = tuple(sorted((x["item_id"] is None, x["item_id"] or 0, x["body"]) for x in items))
                if (index := kept.get(asked)) is None:
                    if len(kept) >= INDEXES:
                        kept.clear()
                    index = kept[asked] = Index([(None if none else n, body.encode()) for none, n, body in asked])
                words = text.split()
                rows += [(doc_id, key, *m) for m in index.matches(words, forms(words, known))]
            yield _rows(list(zip(*rows, strict=True)), out)

    return run


def bitmap(windows_: DataFrame, column: str, most: int = BITS) -> tuple[np.ndarray, int]:
    """Bitmap of the leading bits of a column of hashes, 16 bits a row but at most 2 ** ``most``; the driver gets its words."""
    bits = min(most, max(12, (16 * windows_.count()).bit_length()))
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = windows_.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.int64)
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # two numbers for each 64 bits at most
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return out, bits


def contaminated(docs: DataFrame, benchmark: DataFrame, key: Column | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, key, item_id, item_tokens, matched, reparameterised): the benchmark items in the rows of ``docs``.

    A row for each row of ``docs`` (doc_id, text, ...) and each different item of
    ``benchmark`` (item_id, text, ...) it contains: agreeing windows cover
    ``COVERED`` tokens of it, or ``SHARE`` of it if that is less; slots that
    disagree void the windows they are in and no others. What is the same but for
    case always counts; with other numbers, units or names a window needs
    ``LITERAL`` tokens besides them. Null and empty texts contain nothing and
    are nothing to find; a null item_id is reported as null, a document without a doc_id has
    a key after all others (``key`` puts another in its place). Repeated rows are reported each. Neither
    table is collected; the driver has a bitmap of at most 2 ** ``bits`` bits. The items that one row shares enough
    windows with meet in one task with it.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (key_of(docs) if key is None else key).alias("key"), docs["text"].alias("text"))
    items = benchmark.where("length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))
    wanted = cut(items.select("item", "text").mapInArrow(_of_items(), "h long, item long, width int, times long, need long"))
    listed, bits = bitmap(wanted, "h", bits)
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # at most WINDOW
    seen = base.mapInArrow(_of_documents(spark.sparkContext.broadcast(listed), widths, bits), "doc_id long, key long, text string, hashes array<long>")
    rows = cut(seen.withColumn("row", F.monotonically_increasing_id()))
    shared = rows.select("row", F.explode("hashes").alias("h")).join(wanted, "h")
    enough = shared.groupBy("row", "item").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("row", "item")
    asked = enough.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", F.col("text").alias("body"))).alias("items"))
    found = rows.select("row", "doc_id", "key", "text").join(asked, "row").select("doc_id", "key", "text", "items")
    return found.mapInArrow(_compared(), "doc_id long, key long, item_id long, item_tokens long, matched long, reparameterised boolean")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has a benchmark item, whatever other rows of the doc_id hold; columns as they were."""
    gone = contaminated(docs, benchmark, key=row_key(docs)).select(F.col("key").alias("_gone")).distinct()
    return without(docs, gone)
