"""Personal data by patterns and a semi-Markov conditional random field.

Four patterns give the base spans. The model adds spans that the patterns miss:
telephone numbers without a country code or run into what follows them, cards with other
separators, bracketed at signs and dots. It looks at runs of
neighbouring words that have a digit, an at sign or a bracketed one, scores whole segments of up
to ``LONGEST`` words by features of the segment as a whole (counts and groups of
digits, shape, checksum, the word before it) and chooses boundaries and types of a run
together: the best path through all segmentations, by dynamic programming over
segments of bounded length. Base spans are fixed: no segment touches one.

The model is fitted on the driver to weak labels that the patterns don't give: spans
they match in a bounded sample of texts are rewritten as people write them otherwise (without
plus sign or country code, with other separators, brackets, another number behind them)
and put back into their own context and behind cue words. Numbers of other kinds in the same
contexts are outside. A run of a real text teaches only what the patterns match in it or, where they match
nothing and nothing has the form of such a rewriting, that it is outside.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.words import key_of
from clusterloom.plans.runtime import small_batches

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Words of a segment and characters of a span at most (an address has 64 before and 255 behind the at sign); texts sampled to fit on.
LONGEST, LONG, TEXTS = 6, 320, 4_000
#: What bounds the fitting: characters of a sampled text's segment, known spans rewritten, words of a run, different runs of each source.
SEGMENT, KNOWN, RUN_WORDS, RUNS = 20_000, 300, 16, 6_000
SLOTS, PASSES, REMEMBERED = 1 << 12, 80, 100_000
#: Words that announce personal data (fixed values).
CUES = frozenset("tel phone call mobile fax cell telefon mail email e-mail contact card visa mastercard amex ip host address addr number no".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]")
_SPACE = " \t\n\x0b\x0c\r"
_AT = re.compile(r"[\[({]at[\])}]")
_OPEN, _CLOSE = re.compile(r"[\[({](?:at|dot)[\])}]"), re.compile(r".*[\[({](?:at|dot)[\])}]", re.S)
#: Forms of whole spans that the patterns don't have.
_FORMS = {
    "north": re.compile(r"(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"),
    "abroad": re.compile(r"(?:\+|00)[0-9]{1,3}(?:[\x20.()/-]{1,3}[0-9]{2,8}){2,5}\)?"),
    "card": re.compile(r"[0-9]{4}([\x20./_-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{4}([\x20./_-]{1,3})[0-9]{6}\2[0-9]{4,5}"),
    "email": re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({]at[\])}])\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({]dot[\])}])\s?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|[\[({]dot[\])}])[0-9]{1,3}){3}"),
}


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each maximal run of dotted numbers, as a leftmost search finds them."""
    for m in _DOTTED.finditer(text):
        start, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns match, in order."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    found += [(s, 1, e) for s, e in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    found.sort()
    return found


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an at sign, and the neighbours that a bracketed at sign or dot at a word's end joins to it."""
    at, n, joined = 0, len(text), False
    while True:
        m = _TRIGGER.search(text, at)
        if joined:
            #: the last word ended with a bracket: the next one belongs to it
            start = at
            while start < n and text[start] in _SPACE:
                start += 1
        if not m and not (joined and start < n):
            return
        if not joined or (m and m.start() < start):
            start = m.start()
            while start > at and text[start - 1] not in _SPACE:
                start -= 1
        end = start
        while end < n and text[end] not in _SPACE:
            end += 1
        if not joined and _OPEN.match(text, start, end):
            before = start
            while before > at and text[before - 1] in _SPACE:
                before -= 1
            first = before
            while first > at and text[first - 1] not in _SPACE:
                first -= 1
            if first < before:
                yield first, before
        yield start, end
        m = _CLOSE.match(text, max(start, end - 8), end)
        joined = bool(m) and m.end() == end
        at = end


def runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(cue before it, word ranges) of each maximal run of neighbouring marked words."""
    run: list[tuple[int, int]] = []
    for start, end in _marked(text):
        if run and text[run[-1][1] : start].strip(_SPACE):
            yield _cue(text, run[0][0]), run
            run = []
        run.append((start, end))
    if run:
        yield _cue(text, run[0][0]), run


def _cue(text: str, start: int) -> str:
    before = text[max(0, start - 24) : start].split()
    word = before[-1].strip(".,;:!?()\"'=#").lower() if before else ""
    return word if word in CUES else ""


def _trimmed(piece: str) -> tuple[int, int]:
    """The part of a segment that a span of it covers."""
    s, e = 0, len(piece)
    while s < e and not (piece[s].isalnum() or piece[s] in "+("):
        s += 1
    while e > s and not (piece[e - 1].isalnum() or piece[e - 1] == ")"):
        e -= 1
    if piece.count("(", s, e) != piece.count(")", s, e):
        if piece[s : s + 1] == "(":
            s += 1
        elif piece[e - 1 : e] == ")":
            e -= 1
    return s, e


def candidate(core: str) -> tuple[int, ...]:
    """The kinds of data that a segment can be at all.

    An email has something on both sides of its at sign and a dot behind it, an address four numbers up
    to 255, a card 14 to 19 digits that pass the checksum, a telephone 7 to 15 digits and no letters.
    """
    if len(core) > LONG:
        return ()
    kinds = []
    at = core.find("@") if "@" in core else m.start() if (m := _AT.search(core)) else -1
    if at > 0 and ("." in core[at:] or "dot" in core[at:]):
        kinds.append(0)
    groups = re.findall("[0-9]+", core)
    n = sum(map(len, groups))
    if len(groups) == 4 and n <= 12 and all(int(g) <= 255 for g in groups):
        kinds.append(1)
    if 7 <= n <= 19 and not any(c.isalpha() for c in core):
        if n >= 14 and luhn("".join(groups)):
            kinds.append(2)
        if n <= 15:
            kinds.append(3)
    return tuple(kinds)


def form(core: str) -> str:
    """Which of the known forms a span has, with what makes it valid."""
    for name, pattern in _FORMS.items():
        if pattern.fullmatch(core):
            digits = re.sub("[^0-9]", "", core)
            if name == "card":
                return f"card{14 <= len(digits) <= 19 and luhn(digits)}"
            if name == "abroad":
                return f"abroad{10 <= len(digits) <= 15}"
            if name == "ip":
                return f"ip{all(int(x) <= 255 for x in re.findall('[0-9]+', core))}"
            return name
    return ""


def features(core: str, words: int, cue: str) -> list[int]:
    """Slots of a segment's features."""
    digits = "".join(c for c in core if c in "0123456789")
    groups = [len(g) for g in re.findall("[0-9]+", core)]
    letters = sum(c.isalpha() for c in core)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", core))
    seps = "".join(sorted(set(c for c in core if not c.isalnum())))
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    clear = letters == 0 and not set(seps) - set("+ ().-/_")
    checked = 14 <= len(digits) <= 19 and clear and luhn(digits)
    kind = form(core)
    seen = [
        f"n{words}", f"d{min(len(digits), 20)}", f"h{shape[:24]}", f"g{groups[:6]}", f"s{seps[:8]}", f"c{cue}", f"l{letters > 0}", f"f{kind}", f"i{dotted}",
        f"k{checked}{len(digits) >= 14}", f"+{core[:1] == '+'}", f"p{clear and '(' in core}{10 <= len(digits) <= 15}", f"u{clear}{len(groups) > 1}{len(digits)}", f"F{kind}{cue}{words}",
    ]
    return [zlib.crc32(x.encode()) & (SLOTS - 1) for x in seen]


class Lattice:
    """Segments of one run of words: (first word, words, core start, core end, kinds it can be, slots) in text coordinates.

    ``fixed`` are base spans: what overlaps one can't be data.
    """

    def __init__(self, text: str, cue: str, words: Sequence[tuple[int, int]], fixed: Sequence[tuple[int, int]] = ()) -> None:
        self.n = len(words)
        self.segments = []
        for i in range(self.n):
            for size in range(1, min(LONGEST, self.n - i) + 1):
                a, b = words[i][0], words[i + size - 1][1]
                if size > 1 and b - a > 2 * LONG:
                    break
                s, e = _trimmed(text[a:b])
                core = text[a + s : a + e]
                can = candidate(core)
                if can and any(x < a + e and a + s < y for x, y in fixed):
                    can = ()
                if size == 1 or can:
                    self.segments.append((i, size, a + s, a + e, can, features(core if len(core) <= LONG else "", size, cue if i == 0 else "")))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def posteriors(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each segment with each label, and the logs of the partition functions.

    ``score`` (run, first word, words - 1, label) holds runs of one length; -inf where a segment can't be.
    """
    count, n, longest, _ = score.shape
    whole = _log_sum(score, 3)
    alpha, beta = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
    alpha[0] = beta[n] = 0.0
    for j in range(1, n + 1):
        alpha[j] = _log_sum(np.stack([alpha[j - z] + whole[:, j - z, z - 1] for z in range(1, min(longest, j) + 1)]), 0)
    for i in range(n - 1, -1, -1):
        beta[i] = _log_sum(np.stack([beta[i + z] + whole[:, i, z - 1] for z in range(1, min(longest, n - i) + 1)]), 0)
    around = np.full((count, n, longest), -np.inf)
    for i in range(n):
        for z in range(1, min(longest, n - i) + 1):
            around[:, i, z - 1] = alpha[i] + beta[i + z] - alpha[n]
    return np.exp(np.minimum(score + around[:, :, :, None], 0)), alpha[n]


class Model:
    """Segment weights by label; outside is a label of single words."""

    def __init__(self) -> None:
        self.weights = np.zeros((SLOTS, len(KINDS) + 1))

    def scores(self, lattice: Lattice) -> np.ndarray:
        """(first word, words - 1, label); -inf where a segment or its label can't be."""
        out = np.full((lattice.n, LONGEST, OUTSIDE + 1), -np.inf)
        for i, size, _, _, can, slots in lattice.segments:
            row = self.weights[slots].sum(axis=0)
            for k in can:
                out[i, size - 1, k] = row[k]
            if size == 1:
                out[i, 0, OUTSIDE] = row[OUTSIDE]
        return out

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """(first word, words, label) of each segment of the best path; on ties the longer last segment, then the smaller label."""
        score = self.scores(lattice)
        label = score.argmax(axis=2)
        top = np.take_along_axis(score, label[:, :, None], axis=2)[:, :, 0]
        value, back = [0.0], [0]
        for j in range(1, lattice.n + 1):
            options = [(value[j - z] + top[j - z, z - 1], z) for z in range(1, min(LONGEST, j) + 1)]
            v, z = max(options)
            value.append(v)
            back.append(z)
        path, j = [], lattice.n
        while j:
            path.append((j - back[j], back[j], int(label[j - back[j], back[j] - 1])))
            j -= back[j]
        return path[::-1]

    def spans(self, text: str, cue: str, words: Sequence[tuple[int, int]], fixed: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the data on the run's best path."""
        lattice = Lattice(text, cue, words, fixed)
        if not any(x[4] for x in lattice.segments):
            return []
        core = {(x[0], x[1]): (x[2], x[3]) for x in lattice.segments}
        return [(core[i, z][0], k, core[i, z][1]) for i, z, k in self.best(lattice) if k != OUTSIDE]


def variants(kind: int, core: str) -> list[str]:
    """What else the same data can look like, in forms that the patterns don't match whole."""
    digits = re.sub("[^0-9]", "", core)
    if kind == 0:
        name, _, domain = core.partition("@")
        dotted = domain.replace(".", " (dot) ")
        return [f"{name}(at){domain}", f"{name}[at]{domain}", f"{name} (at) {domain}", f"{name} [at] {domain}", *([f"{name} (at) {dotted}"] if dotted.count("(dot)") == 1 else []), f"{name}(at){domain.replace('.', '(dot)')}"]
    if kind == 1:
        return [core.replace(".", "[.]"), core.replace(".", "(.)"), core.replace(".", "(dot)")]
    if kind == 2:
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [s.join(four) for s in (".", "/", "  ", " - ", "_")] if len(digits) == 16 else []
    ten = digits[-10:]
    a, b, c = ten[:3], ten[3:6], ten[6:]
    return [f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}"]


def strangers(rng: np.random.Generator) -> list[str]:
    """Numbers that are no personal data: dates, versions, amounts, counters, codes, and cards that fail the checksum."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    code = n(16)
    while luhn(code):
        code = n(16)
    four = [code[i : i + 4] for i in range(0, 16, 4)]
    return [f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/20{n(2)}", f"{n(1)}.{n(1)}", f"{n(1)}.{n(2)}.{n(1)}.{n(3)}9", f"{n(3)},{n(3)},{n(3)}", n(7), n(8), n(9), n(10), n(12), code, f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(4)} {n(4)}", f"{n(3)} {n(3)} {n(3)}",
            hashlib.sha1(code.encode()).hexdigest(), f"{n(8)}-{n(4)}-{n(4)}", f"{n(5)}-{n(4)}", f"{n(2)}:{n(2)}:{n(2)}", f"a{n(8)}", f"{n(7)}kg", " ".join(four), "-".join(four), ".".join(four), "/".join(four), f"{n(4)} {n(4)} {n(4)}", f"{n(2)}.{n(6)}", f"{n(3)}-{n(2)}-{n(4)}",
            f"20{n(2)}-{n(2)}-{n(2)} {n(2)}:{n(2)}:{n(2)}", f"{n(2)}.{n(2)}.20{n(2)}", f"{n(5)} {n(5)}", f"no-{n(9)}", f"@{n(2)}", "[1]", f"{n(4)}-{n(4)}", f"{n(1)} {n(3)} {n(3)} {n(3)}"]


def weak_labels(texts: Sequence[str], seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) to learn from; see the top of the module."""
    rng = np.random.default_rng(seed)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    known: list[tuple[int, str, str, str]] = []
    for text in texts:
        spans = base_spans(text)
        ends = [0, *itertools.accumulate((e for _, _, e in spans), max)]
        apart = all(s >= end for (s, _, _), end in zip(spans, ends, strict=False))
        if not apart:
            continue
        for cue, words in runs(text):
            a, b = words[0][0], words[-1][1]
            mine = [(s, k, e) for s, k, e in spans if s < b and a < e]
            if not mine and any(x[4] and form(text[x[2] : x[3]]) for x in Lattice(text, cue, words[: 4 * RUN_WORDS]).segments):
                continue
            if all(a <= s and e <= b for s, _, e in mine):
                at = max(0, a - 24)
                yield text[at : b + 1], [(s - at, k, e - at) for s, k, e in mine]
        for s, k, e in spans:
            known.append((k, text[s:e], " ".join(text[max(0, s - 40) : s].split()[-2:]), " ".join(text[e : e + 40].split()[:2])))
    picked = [known[i] for i in rng.permutation(len(known))[:KNOWN].tolist()]
    cues = sorted(CUES)
    for _ in range(60):
        card = n(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        cue = cues[int(rng.integers(len(cues)))]
        for kind, core in ((3, f"+1 ({n(3)}) {n(3)}-{n(4)}"), (0, f"user{n(2)}@mail{n(1)}.example.com"), (0, f"first.last@example{n(1)}.org"), (2, card), (1, ".".join(str(x) for x in rng.integers(1, 255, 4)))):
            picked += [(kind, core, "word", "word"), (kind, core, cue, "word"), (kind, core, f"{cue}:", "")]
    for kind, core, before, after in picked:
        other = picked[int(rng.integers(len(picked)))]
        for piece in (core, *variants(kind, core)):
            if _TRIGGER.search(before) or _TRIGGER.search(after):
                before, after = "word", "word"
            start = len(before) + 1 if before else 0
            lead = f"{before} " if before else ""
            yield f"{lead}{piece} {after}", [(start, kind, start + len(piece))]
            yield f"{lead}{piece}.", [(start, kind, start + len(piece))]
            #: another number right behind it, as patterns run into
            if kind != 0 and other[0] in (1, 3):
                yield f"{lead}{piece} {other[1]} {after}", [(start, kind, start + len(piece)), (start + len(piece) + 1, other[0], start + len(piece) + 1 + len(other[1]))]
    for _ in range(120):
        for piece in strangers(rng):
            _, _, before, after = picked[int(rng.integers(len(picked)))]
            if _TRIGGER.search(before) or _TRIGGER.search(after):
                before, after = "word", "word"
            yield f"{before} {piece} {after}", []


def fit(texts: Sequence[str], seed: int = 7) -> Model:
    """Maximum likelihood with a Gaussian prior, by Adam over all runs of one length at once."""
    #: equal runs once, with their number
    merged: dict = {}
    for text, spans in weak_labels(texts, seed):
        for cue, words in runs(text):
            if len(words) > RUN_WORDS:
                continue
            lattice = Lattice(text, cue, words)
            mine = {(s, e): k for s, k, e in spans if words[0][0] <= s and e <= words[-1][1]}
            if all(any((x[2], x[3]) == span and k in x[4] for x in lattice.segments) for span, k in mine.items()):
                key = tuple((x[0], x[1], tuple(x[5]), mine.get((x[2], x[3]))) for x in lattice.segments)
                merged.setdefault(key, [lattice, mine, 0])[2] += 1
    rows = sorted(merged.values(), key=lambda x: -x[2])[:RUNS]
    model = Model()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(row[0].n, []).append(row)
    groups = []
    for n, some in sorted(by_length.items()):
        shape = (len(some), n, LONGEST, OUTSIDE + 1)
        target, allowed, weight = np.zeros(shape), np.full(shape, -np.inf), np.array([min(x[2], 20) ** 0.5 for x in some])
        at, slots = [], []
        for r, (lattice, mine, _) in enumerate(some):
            inside = {w for x in lattice.segments if (x[2], x[3]) in mine for w in range(x[0], x[0] + x[1])}
            for x in lattice.segments:
                place = (r, x[0], x[1] - 1)
                at.append(place)
                slots.append(x[5])
                for k in x[4]:
                    allowed[*place, k] = 0
                if x[1] == 1:
                    allowed[*place, OUTSIDE] = 0
                if (x[2], x[3]) in mine:
                    target[*place, mine[x[2], x[3]]] = 1
                elif x[1] == 1 and x[0] not in inside:
                    target[*place, OUTSIDE] = 1
        groups.append((target, allowed, weight, tuple(np.array(at).T), np.array(slots)))
    first, second = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for i in range(1, PASSES + 1):
        g = -0.02 * model.weights
        for target, allowed, weight, at, slots in groups:
            score = allowed.copy()
            score[at] += model.weights[slots].sum(axis=1)
            diff = ((target - posteriors(score)[0]) * weight[:, None, None, None])[at]
            flat, width = slots.ravel(), slots.shape[1]
            g += np.stack([np.bincount(flat, np.repeat(diff[:, k], width), SLOTS) for k in range(OUTSIDE + 1)], axis=1)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        model.weights += 0.2 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-6)
    return model


def fit_on(docs: DataFrame, texts: int = TEXTS) -> Model:
    """Fits on about ``texts`` texts chosen by hash, those that have a digit or an at sign; of each a segment of ``SEGMENT`` characters from a place that the hash says."""
    share = min(1.0, texts / max(1, docs.count()))
    dealt = F.pmod(F.xxhash64(key_of(docs), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(key_of(docs), F.lit(6)), F.greatest(F.length("text") - SEGMENT, F.lit(0)) + 1) + 1
    rows = docs.where(dealt < share).where(docs["text"].rlike("[0-9@]")).select(F.substring(docs["text"], start.cast("int"), F.lit(SEGMENT)).alias("text")).limit(4 * texts).collect()
    return fit(sorted(r["text"] for r in rows))


def redacted(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; where spans overlap, the first counts for both."""
    out, end = [], 0
    for s, k, e in spans:
        if s >= end:
            out += [text[end:s], f"<{KINDS[k]}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def _find(shared, with_text: bool):
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    out = pa.schema([*fields, ("redacted", pa.string())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        seen: dict[tuple, list[tuple[int, int, int]]] = {}

        def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
            """What the model finds beside the base spans."""
            new = []
            covered: list[tuple[int, int]] = []
            for s, _, e in base:
                if covered and s < covered[-1][1]:
                    covered[-1] = covered[-1][0], max(e, covered[-1][1])
                else:
                    covered.append((s, e))
            at = 0
            for cue, words in runs(text):
                a, b = words[0][0], words[-1][1]
                while at < len(covered) and covered[at][1] <= a:
                    at += 1
                fixed, i = [], at
                while i < len(covered) and covered[i][0] < b:
                    fixed.append((covered[i][0] - a, covered[i][1] - a))
                    i += 1
                piece = text[a:b]
                key = cue, piece, tuple(fixed)
                got = seen.get(key)
                if got is None:
                    got = model.spans(piece, cue, [(s - a, e - a) for s, e in words], fixed)
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    if len(piece) < 200:
                        seen[key] = got
                new += [(s + a, k, e + a) for s, k, e in got]
            return new

        for batch in batches:
            rows = []
            ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc_id, text in zip(ids, texts, strict=True):
                text = text or ""
                base = base_spans(text) if _TRIGGER.search(text) else []
                more = added(text, base)
                every = sorted([*base, *more])
                counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(more), *([redacted(text, every)] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def personal_data(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added[, redacted]) for every row of ``docs`` (doc_id, text, ...).

    Counts and the checksum are those of the base spans; ``spans`` also has the
    model's, each of at most ``LONGEST`` words and ``LONG`` characters and apart from the base spans. Offsets count code points. A null text counts as empty; a null
    doc_id stays null; rows may repeat. Other columns are ignored; an empty
    table gives an empty result.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long" + (", redacted string" if with_text else "")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x 5 weights
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(shared, with_text), schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return personal_data(docs, fit_on(docs))
