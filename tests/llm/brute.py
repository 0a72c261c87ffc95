"""Plain versions of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

NAMELESS = 2**63 - 2**61


def keyed(docs) -> list[tuple[int, str]]:
    """(key, text) of the rows; rows without a doc_id have keys beyond all others."""
    from clusterloom.llm.words import key_of

    return [tuple(r) for r in docs.select(key_of(docs), "text").collect()]


def named(key: int) -> int | None:
    return None if key >= NAMELESS else key


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def substring(rows: list, window: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha256) for (key, text); rows that share a key don't precede each other."""
    first: dict[tuple, int] = {}
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, key), key)
    out = []
    for key, text in rows:
        w = words(text)
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if first[x] < key or x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((named(key), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows: list, percent: int = 85) -> list[tuple]:
    """(key, set size, component key) for (key, text), by comparing all pairs of different sets."""
    sets = [(k, shingle_set(t)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)

    by = defaultdict(list)
    for k, s in sets:
        if s:
            by[s].append(k)
    for same in by.values():
        for k in same:
            link(same[0], k)
    distinct = list(by.items())
    for i, (a, ka) in enumerate(distinct):
        for b, kb in distinct[:i]:
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                link(ka[0], kb[0])
    return [(k, len(s), top(k)) for k, s in sets]


EDGE = "\"'`.,;:!?()[]{}<>|*#$%&_~=+-/\\"


def token_forms(text: str) -> list[list[str]]:
    """The text's words with numbers, units and names as placeholders; without names; and as they are."""
    from clusterloom.llm.decontam import NUMBERS, ORDINALS, UNITS

    kinds, plain, names = [], [], []
    before = "."
    for i, word in enumerate(text.split()):
        core = word.strip(EDGE)
        low = core.casefold()
        kind = low
        if core[:1].isascii() and core[:1].isdigit():
            rest = low.lstrip("0123456789.,:-/")
            kind = "<number>" if not rest or rest in ORDINALS else "<measure>" if rest in UNITS else low
        elif low in NUMBERS or ("-" in low and all(x in NUMBERS for x in low.split("-"))):
            kind = "<number>"
        elif low in UNITS and (len(low) > 1 or low == core):
            kind = "<unit>"
        name = kind == low and len(core) > 1 and core[0].isupper() and core[1:].islower()
        names.append(name and i > 0 and before.rstrip("\"')]*")[-1:] not in (".", "!", "?", ":"))
        kinds.append(kind)
        plain.append(low)
        before = word
    return [["<name>" if n else k for n, k in zip(names, kinds, strict=True)], kinds, plain]


def contains(text: str, item: str) -> tuple[int, bool] | None:
    """Tokens of ``item`` that agreeing windows of ``text`` cover and whether other fillings were needed, or None if too few."""
    mine, theirs, slots = token_forms(item), token_forms(text), {"<number>", "<unit>", "<name>", "<measure>"}
    low, other = mine[2], theirs[2]
    n = len(low)
    width = min(8, n)
    same, changed = set(), set()
    for shift in range(-n, len(other)):
        hits = []
        for q in range(n - width + 1):
            if not 0 <= q + shift <= len(other) - width:
                continue
            for form in mine:
                w = form[q : q + width]
                if sum(x not in slots for x in w) >= -(-4 * width // 8) and any(w == f[q + shift : q + shift + width] for f in theirs):
                    hits.append((q, form))
        held = {(x, form[x]) for q, form in hits for x in range(q, q + width) if form[x] in slots}
        held = {x: kind for x, kind in sorted(held, key=lambda y: [f[y[0]] for f in mine].index(y[1]), reverse=True)}
        pairs = defaultdict(int)
        for x in sorted(held):
            pairs[held[x], low[x], other[x + shift]] += 1
        there, back = {}, {}
        order = list(pairs)
        for kind, a, b in sorted(order, key=lambda y: (y[1] != y[2], -pairs[y], order.index(y))):
            if (kind, a) not in there and (kind, b) not in back:
                there[kind, a], back[kind, b] = b, a
        void = {x for x, kind in held.items() if there.get((kind, low[x])) != other[x + shift]}
        for q, _ in hits:
            if not void & set(range(q, q + width)):
                (changed if any(low[x] != other[x + shift] for x in held if q <= x < q + width) else same).update(range(q, q + width))
    if len(same | changed) < min(13, -(-8 * n // 10)):
        return None
    return len(same | changed), bool(changed - same)
