from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest

from clusterloom.llm import pii
from clusterloom.llm.decontam import clean, contaminated
from clusterloom.llm.lang_id import Model, confident, fit, held_out, identify, op9_lang_id
from clusterloom.llm.queries import QUERIES

from .brute import contains

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


TEXTS = [
    "a@b.c@d.e f@g h@i.j.k. x.@-.- @a.b q@r.s@t", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.3.255 1..2.3.4 10.0.0.1:80", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111111111 4111  1111", "+1 (555) 123-4567 +12 +1 ( +49-170-1234567- ++1.2.3.4.5.6.7.8.9.0", "",
    "mail me: joe.x+y@mail.example.com or +48 123 456 789; card 5500005555555559 at 10.1.2.3 \u00fc\U0001f600 z@z.zz", "9" * 5000, "1." * 3000, "a@" * 2000, "+1 " * 1000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def pii_model(spark, sf):
    """The query's own model, of a small table."""
    return pii.fit_on(spark.read.parquet(f"{sf}/documents.parquet"))


def found(model, text):
    fixed = [(s, e) for s, _, e in pii.base_spans(text)]
    got = [(pii.KINDS[k], text[s:e]) for k, s, e in ((k, s, e) for s, k, e in pii.base_spans(text))]
    for cue, words in pii.runs(text):
        got += [(pii.KINDS[k], text[s:e]) for s, k, e in model.spans(text, cue, words, fixed)]
    return sorted(got)


def test_model_adds_what_patterns_miss(pii_model):
    for text, want in [
        ("call (555) 123-4567 now", [("phone", "(555) 123-4567")]), ("tel (555) 123-4567", [("phone", "(555) 123-4567")]), ("phone 555 123 4567", [("phone", "555 123 4567")]), ("phone 555-123-4567.", [("phone", "555-123-4567")]), ("555.123.4567", [("phone", "555.123.4567")]),
        (" user(at)mail.example.com ", [("email", "user(at)mail.example.com")]), (" user [at] mail.example.com ", [("email", "user [at] mail.example.com")]), ("ask joe [at] mail (dot) org please", [("email", "joe [at] mail (dot) org")]),
        ("Des +1 (826) 555-4081 190.137.223.204 du", [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]), ("x 7536784127813050 4845168114407329 y", [("card", "4845168114407329"), ("card", "7536784127813050")]), ("at 10[.]0[.]0[.]1", [("ip", "10[.]0[.]0[.]1")]),
    ]:
        assert found(pii_model, text) == want, text
    for text in ("born 2024-01-02", "version 2.0 of 12", "isbn 978-3-16-148410-0", "item 1234567", "at 10:20:30", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "4111 1111 1111 1112", "card 4111-1111-1111-1112", "see [1] and [at] home", "sums of 12 345 678 90"):
        assert found(pii_model, text) == [], text


def planted(rng, n):
    """(text, kind, span) in words and forms that the fitting doesn't use as they stand, and texts with nothing in them."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        a, b = (" ".join(rng.choice("stone river under seven lamps they went home quietly".split()) for _ in range(3)) for _ in range(2))
        card = "4" + d(14)
        card += next(x for x in "0123456789" if pii.luhn(card + x))
        sep = rng.choice([".", "/", "  "])
        kind, core = rng.choice([
            ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("phone", f"{d(3)} {d(3)} {d(4)}"), ("phone", f"{d(3)}.{d(3)}.{d(4)}"), ("card", sep.join(card[i : i + 4] for i in range(0, 16, 4))),
            ("email", f"ann.{d(2)}(at)site{d(1)}.net"), ("email", f"bob{d(1)} [at] web{d(2)}.org"), ("email", f"eve (at) host{d(1)} (dot) de"),
        ])
        yield f"{a} {core} {b}", kind, core
        bad = card[:-1] + str((int(card[-1]) + 1) % 10)
        yield a + " " + rng.choice([f"20{d(2)}-0{rng.randrange(1, 9)}-1{d(1)}", f"{d(2)}:{d(2)}", f"{d(6)}", " ".join(bad[i : i + 4] for i in range(0, 16, 4)), f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)},{d(3)} EUR", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(12)}"]) + f" {b}", None, None


def test_recall_and_precision_on_planted_spans(pii_model):
    import random

    hit, wrong, total = Counter(), 0, Counter()
    for text, kind, core in planted(random.Random(11), 400):
        got = found(pii_model, text)
        if kind:
            total[kind] += 1
            hit[kind] += (kind, core) in got
            wrong += len(got) - ((kind, core) in got)
        else:
            wrong += len(got)
    recall = {k: hit[k] / total[k] for k in total}
    assert all(r >= 0.95 for r in recall.values()) and wrong <= 0.02 * sum(total.values()), (recall, wrong)


def all_paths(model, lattice):
    """Every way to cut and label a run, with its score."""
    import numpy as np

    score, paths = model.scores(lattice), []

    def go(at, path, total):
        if at == lattice.n:
            paths.append((path, total))
        for z in range(1, min(pii.LONGEST, lattice.n - at) + 1):
            for k in range(pii.OUTSIDE + 1):
                if np.isfinite(score[at, z - 1, k]):
                    go(at + z, [*path, (at, z, k)], total + score[at, z - 1, k])

    go(0, [], 0.0)
    return paths


@pytest.mark.parametrize("text", ["(555) 123-4567 10.1.2.3 77", "+1 (826) 555-4081 190.137.223.204", "4111 1111 1111 1111 555 123 4567", "12 555-123-4567 a@b.c 3"])
@pytest.mark.parametrize("fixed", [False, True])
def test_best_path_and_posteriors_are_those_of_all_segmentations(pii_model, text, fixed):
    import numpy as np

    cue, words = next(pii.runs(text))
    lattice = pii.Lattice(text, cue, words, [(s, e) for s, _, e in pii.base_spans(text)] if fixed else [])
    paths = all_paths(pii_model, lattice)
    assert len(paths) > 1
    best = pii_model.best(lattice)
    assert sum(pii_model.scores(lattice)[i, z - 1, k] for i, z, k in best) == pytest.approx(max(t for _, t in paths))
    assert best in [p for p, t in paths if t >= max(t for _, t in paths) - 1e-9]
    post, log_z = (x[0] for x in pii.posteriors(pii_model.scores(lattice)[None]))
    z = np.exp(log_z)
    assert sum(np.exp(t) for _, t in paths) == pytest.approx(z)
    for i in range(lattice.n):
        for size in range(1, min(pii.LONGEST, lattice.n - i) + 1):
            for k in range(pii.OUTSIDE + 1):
                assert sum(np.exp(t) for p, t in paths if (i, size, k) in p) / z == pytest.approx(post[i, size - 1, k], abs=1e-9)


def test_weak_labels_name_what_they_say():
    texts = ["tel +1 (555) 123-4567 ok", "x joe@mail1.example.com y 10.1.2.3", "+1 (555) 123-4567 10.0.0.1 z"]
    some = list(pii.weak_labels(texts))
    assert any(not spans for _, spans in some) and all(0 <= s < e <= len(t) for t, spans in some for s, _, e in spans)
    assert any("(555) 123-4567" == t[s:e] and k == 3 for t, spans in some for s, k, e in spans)
    #: what the patterns run into teaches nothing, so it isn't taught as outside
    assert not any("+1 (555) 123-4567 10.0.0.1" in t and not spans for t, spans in some)


def test_personal_data_of_odd_rows(odd, clashing, odd_rows, none, spark, pii_model):
    for docs in (odd, clashing):
        got = pii.personal_data(docs, pii_model).collect()
        want = Counter((d, hashlib.sha256(pii.written(plain_spans(t or "")).encode()).hexdigest()) for d, t, *_ in odd_rows)
        assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert pii.personal_data(none, pii_model).collect() == [] and pii.fit_on(none)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.personal_data(docs, pii_model, with_text=True).collect():
        base = plain_spans(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
        assert "joe" not in r.redacted


ITEM = "A train leaves Berlin at 9 and drives 80 km in two hours; how far does the slow train of Anna get by noon today"


def test_contamination(spark, none, odd, clashing):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one here"), (3, None), (4, ""), (None, "words that nobody else would ever write in this odd order at all")], "item_id long, text string")
    pad = " ".join(f"pad{i}" for i in range(50))
    rows = [
        (1, f"{pad} {ITEM} {pad}"), (2, ITEM.replace("9", "11").replace("80", "95").replace("Anna", "Maria").upper().replace("BERLIN", "Rome")), (3, pad), (4, f"{pad} short one here {pad}"), (5, None), (None, f"x {ITEM}"),
        (6, " ".join(ITEM.split()[:7])), (7, ITEM.replace("Berlin", "Paris").replace("Anna", "Maria").replace("80 km", "70 miles")), (8, pad + " Words that nobody else would ever write in this odd order at all"), (9, ITEM[: len(ITEM) * 3 // 4]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (4, 2), (7, 1), (8, None), (9, 1)}
    assert got[7, 1].reparameterised and not got[1, 1].reparameterised
    assert {r.doc_id for r in clean(docs, bench).collect()} == {3, 5, 6}
    #: a bitmap that lets everything through changes nothing
    few = {(r.doc_id, r.item_id, r.matched) for r in contaminated(docs, bench, bits=6).collect()}
    assert few == {(r.doc_id, r.item_id, r.matched) for r in got.values()}
    assert contaminated(none, bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []
    assert clean(clashing, bench).columns == clashing.columns and clean(clashing, bench).count() == odd.count()


def test_fillings_must_agree(spark):
    """The same name stands for two: no copy of the question, so only its literal part can count."""
    item = "Ask Anna what Anna said to Paul when Anna saw Paul near the old mill where Anna met Paul"
    swapped = "Ask Eve what Tom said to Kim when Joe saw Ben near the old mill where Sue met Max"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Anna", "Eve").replace("Paul", "Kim")), (2, swapped)], "doc_id long, text string")
    assert {r.doc_id for r in contaminated(docs, bench).collect()} == {1}


def test_conflicting_slots_void_only_their_windows(spark):
    """Case is no conflict, and verbatim windows count whatever another slot holds."""
    case = "In the first box there are Two red balls and in the other one two blue balls, so how many are there in all"
    plain = "please write down every single step of the proof that the sum of these odd numbers is always even"
    item = f"A train drives 80 km at 9 and {plain} before 9"
    bench = spark.createDataFrame([(1, case), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, case.lower()), (2, case.upper()), (3, item.replace("9", "11", 1)), (4, item.replace("80", "7").replace("9", "7"))],
        "doc_id long, text string",
    )
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_copies_of_items_with_few_literals_are_found(spark):
    """Windows of numbers, units and names count where they are verbatim, in any case."""
    items = [
        "What comes next: 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37?", "Complete the sequence 2 3 5 7 11 13 17 19 23 29 and give the next number",
        "why does the old stra\u00dfe on the other side of the river have no name on any map of the town",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"Some text. {f(t)} More text.") for i, t in enumerate(items) for f in (str, str.upper, str.lower, str.title)]
    docs = spark.createDataFrame([*rows, (9, "What comes next: 3, 4, 6, 8, 12, 14, 18, 20, 24, 30, 32, 38?")], "doc_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect())
    assert got == {(0, 0): 4, (1, 1): 4, (2, 2): 4}


def test_contamination_as_brute_force(spark, sf):
    """Pairs and figures of random texts that hold parts of items, with other numbers, units, names and case."""
    import random

    rng = random.Random(8)
    pool = "the of a train and leaves station at noon with red blue boxes how many are left after he gives away more than every".split()
    word = lambda: rng.choice([*pool, *pool, rng.choice(["Anna", "Paul", "Berlin"]), str(rng.randrange(30)), rng.choice(["km", "hours", "dollars"]), rng.choice(["two", "Seven", "third", "4th", "12km"])])
    items = [" ".join(word() for _ in range(rng.choice([3, 6, 9, 14, 25]))) + rng.choice(["", "?", "."]) for _ in range(12)]
    swap = {"Anna": "Maria", "Paul": "Tom", "km": "miles", "two": "9", "Seven": "Two", "third": "2nd"}
    docs = []
    for i in range(120):
        w = rng.choice(items).split()
        kind = rng.random()
        if kind < 0.4:
            w = [swap.get(x, str(int(x) + 1) if x.isdigit() else x) for x in w]
        if kind > 0.7:
            w = [x.upper() for x in w] if kind > 0.85 else [x.lower() for x in w]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "other"
        if rng.random() < 0.3:
            w = w[: len(w) * 3 // 4]
        docs.append((i, " ".join([*(word() for _ in range(rng.randrange(12))), *w, *(word() for _ in range(rng.randrange(12)))])))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.reparameterised) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(d, i): x for d, t in docs for i, item in enumerate(items) if (x := contains(t, item))}
    assert got == want and len(want) > 40 and any(x for _, x in want.values())


@pytest.mark.parametrize("words", ["one fourteen sixty ninety first twentieth twenty-one 3rd 7 1,000", "km hours dollars percent m Kg", "Anna Berlin Xu"])
def test_words_of_each_class_are_placeholders(words):
    from clusterloom.llm.decontam import _SLOTS, Tokens, forms

    for word in words.split():
        token = forms(["so", word.encode(), b"it"] if isinstance(word, bytes) else [b"so", word.encode(), b"it"], Tokens())[0]
        assert token[1] in _SLOTS and token[0] not in _SLOTS


def test_languages_are_told_apart_on_held_out_documents(spark, sf):
    path = f"{sf}/../sf0.01"
    got = op9_lang_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def lang_model():
    en, de = "the cat sat on the mat with that other thing and this", "der hund und die katze sind nicht auf dem dach oder ich"
    return fit([en] * 5 + [de] * 5, ["en"] * 5 + ["de"] * 5)


def test_code_switched_text(spark, lang_model):
    mixed = "the cat and this thing der hund und die katze sind nicht auf dem dach"
    docs = spark.createDataFrame([(1, mixed), (2, "the other cat and"), (3, "12 !!"), (4, None), (5, "DER Hund nicht")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(docs, lang_model).collect()}
    assert got[1].lang_pred == "de" and 0.5 < got[1].score < 0.85
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["en", "und", "und", "de"]
    assert got[2].score > 0.95 and got[3].score == 0


def test_runs_without_spaces_are_labelled_whole(spark, lang_model):
    """A switch inside a run is seen, wherever it is; pieces are cut between characters."""
    from clusterloom.llm.lang_id import PIECE, features, pieces

    for word in ("\u65e5\u672c\u8a9e\U0001f600" * 40, "ab" * 24, "x" * 49, "\u00fc" * 100):
        got = pieces(word.encode())
        assert b"".join(got) == word.encode() and all(0 < len(p) <= PIECE and p.decode() for p in got)
    assert features("abcdefghijklmnop-x") != features("abcdefghijklm-nopx")
    en, de = "thecatsatonthematwiththatotherthingandthis", "derhundunddiekatzesindnichtaufdemdachoderich"
    docs = spark.createDataFrame([(1, en + de * 9), (2, de + en * 9), (3, en * 5 + de * 5)], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(docs, fit([en, en * 3] * 5 + [de, de * 3] * 5, ["en"] * 10 + ["de"] * 10)).collect()}
    assert got[1].lang_pred == "de" and got[2].lang_pred == "en" and got[3].score < 0.8


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    from clusterloom.llm.lang_id import _forward_backward

    rng = np.random.default_rng(1)
    step = rng.random((3, 3)) + 0.1
    chains = [rng.random((n, 3)) + 0.1 for n in (5, 4, 2)]
    active = [3, 3, 2, 2, 1]
    starts = [0, 3, 6, 8, 10]
    emit = np.concatenate([np.stack([c[t] for c in chains if len(c) > t]) for t in range(5)])
    post = _forward_backward(emit, step, starts, active)
    for i, c in enumerate(chains):
        want = np.zeros_like(c)
        for path in itertools.product(range(3), repeat=len(c)):
            p = np.prod([c[t, y] for t, y in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
            for t, y in enumerate(path):
                want[t, y] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose([post[starts[t] + i] for t in range(len(c))], want)


def test_gradients_are_those_of_the_likelihood():
    """Weights and transitions against finite differences, with chains in several portions."""
    import numpy as np

    import clusterloom.llm.lang_id as m

    rng = np.random.default_rng(3)
    k, n_words, chains, time = 3, 7, 5, 4
    index = rng.integers(0, 40, (n_words, 3)).astype(np.int32)
    index[0, 2] = m.SLOTS
    training = m.Training(rng.integers(0, n_words, (time, chains)), rng.integers(0, k, (time, chains)), index, k)
    weights, moves = rng.normal(size=(m.SLOTS + 1, k)), rng.normal(size=(k, k))
    weights[m.SLOTS] = 0
    before, m.CHAINS = m.CHAINS, 2
    try:
        g, gm, value = training.gradient(weights, moves)
        step = 1e-5
        for a, b in np.ndindex(k, k):
            more, less = moves.copy(), moves.copy()
            more[a, b] += step
            less[a, b] -= step
            slope = (training.gradient(weights, more)[2] - training.gradient(weights, less)[2]) / (2 * step)
            assert slope == pytest.approx(gm[a, b], abs=1e-6)
        for s in sorted(set(index.ravel().tolist()) - {m.SLOTS}):
            for j in range(k):
                more, less = weights.copy(), weights.copy()
                more[s, j] += step
                less[s, j] -= step
                slope = (training.gradient(more, moves)[2] - training.gradient(less, moves)[2]) / (2 * step)
                assert slope == pytest.approx(g[s, j], abs=1e-6)
    finally:
        m.CHAINS = before
    #: the likelihood itself: over all labelings of one chain
    import itertools

    score = rng.normal(size=(4, 1, k))
    post, joint, log_z = m.expected(score, moves)
    totals = {y: sum(score[t, 0, y[t]] for t in range(4)) + sum(moves[a, b] for a, b in itertools.pairwise(y)) for y in itertools.product(range(k), repeat=4)}
    z = sum(np.exp(v) for v in totals.values())
    assert log_z == pytest.approx(np.log(z))
    for a, b in np.ndindex(k, k):
        assert joint[a, b] == pytest.approx(sum(np.exp(v) / z * sum(p == (a, b) for p in itertools.pairwise(y)) for y, v in totals.items()))
    assert joint.sum() == pytest.approx(3) and np.allclose(post.sum(axis=2), 1)


def test_many_languages_are_all_learned(spark):
    """Sixty invented languages, the rarest with two texts."""
    import random

    rng = random.Random(1)
    rows = []
    for lang in range(60):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(25)]
        rows += [(f"l{lang:02}", " ".join(rng.choice(own) for _ in range(60))) for _ in range(2 if lang % 3 else 6)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    from clusterloom.llm.lang_id import fit_on

    model = fit_on(docs)
    assert len(model.labels) == 60
    got = identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) == len(got)


def test_languages_of_odd_rows(odd, clashing, odd_rows, none, lang_model):
    for docs in (odd, clashing):
        got = identify(docs, lang_model).collect()
        assert len(got) == len(odd_rows)
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert identify(none, lang_model).collect() == []
    assert {r.lang_pred for r in identify(odd, Model([], lang_model.weights[:, :0], lang_model.moves[:0, :0], set())).collect()} == {"und"}
    kept = confident(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t, *_ in odd_rows if any(c.isalpha() for c in t or ""))
    assert confident(none).collect() == []


def test_every_operator_has_one_query():
    assert [re.match(r"op(\d+)_", q).group(1) for q in QUERIES] == [str(i) for i in range(1, 11)]
    assert held_out() is not None
