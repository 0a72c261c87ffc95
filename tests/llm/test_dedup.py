from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from clusterloom.llm.exact_dedup import exact_groups
from clusterloom.llm.near_dedup import _estimates, keep_one, level_of, near_duplicates, odd_sketch, shingles
from clusterloom.llm.substring_dedup import remove_repeated
from clusterloom.llm.words import WordHashes, second, windows

from .brute import NAMELESS, components, keyed, named, substring
from .conftest import SCHEMA, prose


def copies(seed: int, n: int = 120) -> list:
    """Documents with exact copies, copies with a few changed words, and shared passages."""
    rng = random.Random(seed)
    bases = [prose(rng, rng.choice([3, 5, 30, 90, 200, 700])) for _ in range(12)]
    passage = prose(rng, 45)
    rows = []
    for i in range(n):
        w = rng.choice(bases).split()
        kind = rng.random()
        if kind < 0.5:
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        if kind < 0.2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage.split()[rng.randrange(10) :]
        rows.append((i, (" " if rng.random() < 0.5 else "\n").join(w)))
    rng.shuffle(rows)
    return rows


def test_windows_are_equal_where_words_are():
    h = WordHashes()
    a = h.of(b"a b c d e f g a b c d e f x")
    for k in (1, 2, 3, 5, 6, 7):
        for f in (windows, second):
            got = f(a, k)
            assert len(got) == len(a) - k + 1
            same = [(i, j) for i in range(len(got)) for j in range(i) if got[i] == got[j]]
            assert same == [(i, j) for i in range(len(got)) for j in range(i) if a[i : i + k].tolist() == a[j : j + k].tolist()]
    assert not len(windows(a, 15))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_as_brute_force(spark, seed):
    rows = copies(seed)
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(substring(rows))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert any(r.n_removed for r in got)


def test_substrings_of_periodic_text(spark):
    rows = [(1, "a " * 100), (2, "a b " * 60), (3, "x " + "b a " * 30), (4, "a " * 19)]
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, (r[:4] for r in got))) == sorted(substring(rows))


def test_substrings_of_odd_rows(odd, clashing, odd_rows, none):
    want = Counter(substring(keyed(odd)))
    for docs in (odd, clashing):
        assert Counter(tuple(r[:4]) for r in remove_repeated(docs).collect()) == want
    assert remove_repeated(none).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_as_brute_force(spark, seed):
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        got = near_duplicates(docs, percent / 100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component) for r in got) == sorted(components(rows, percent))


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """A large family whose members are linked to few others each."""
    import clusterloom.llm.near_dedup as m

    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component) for r in got) == sorted(components(rows))


def test_factors_are_matches_that_no_word_prolongs(spark):
    """Each factor equals its reference word by word, and the reference's next window is not the document's."""
    rows = copies(5)
    text = {d: t.split() for d, t in rows}
    got = remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for d in sorted(text):
        for i in range(len(text[d]) - 19):
            first.setdefault(tuple(text[d][i : i + 20]), (d, i))
    for r in got:
        gone = set()
        for factor in filter(None, r.factors.split(",")):
            start, ref, there, n = map(int, factor.split(":"))
            assert n >= 20 and (ref, there) < (r.doc_id, start) and text[r.doc_id][start : start + n] == text[ref][there : there + n]
            after = tuple(text[r.doc_id][start + n - 19 : start + n + 1])
            assert len(after) < 20 or first[after] != (ref, there + n - 19)
            gone |= set(range(start, start + n))
        assert len(gone) == r.n_removed
    assert sum(r.factors != "" for r in got) > 20


def test_rows_without_an_id_meet_in_no_one_row(spark):
    """Passages that rows without an id or with one id share are gathered row by row."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage)] + [(None, f"x{i} {passage} y{i}") for i in range(50)] + [(7, f"z{i} {passage}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r[:4]) for r in remove_repeated(docs).collect()) == Counter(substring(keyed(docs)))


def test_near_duplicates_of_odd_rows(odd, clashing, none):
    want = Counter(components(keyed(odd)))
    for docs in (odd, clashing):
        got = near_duplicates(docs).collect()
        assert Counter((r.key, r.n_shingles, r.component) for r in got) == want
        assert all(r.doc_id == named(r.key) for r in got)
    assert near_duplicates(none).collect() == []


def test_large_buckets_with_several_components(spark, monkeypatch):
    """A linked family larger than a block, strays near it, and families in parts."""
    import clusterloom.llm.near_dedup as m

    monkeypatch.setattr(m, "BLOCK", 4)
    rng = random.Random(21)
    rows = []
    for family in range(3):
        base = prose(rng, 120).split()
        for part in range(4):
            own = list(base)
            for at in range(part * 3, part * 30 + 3 * part, 2):
                own[at % 120] = f"part{part}x{at}"
            for _ in range(12):
                w = list(own)
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
                rows.append((len(rows), " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component) for r in got) == sorted(want)
    assert 3 < len({c for _, _, c in want}) < len(rows)


def test_one_of_each_group_stays(odd, clashing, odd_rows, spark):
    """Rows without words all stay; of the others one of each group, and one of rows that agree in doc_id and text."""
    texts = [(i, r[1]) for i, r in enumerate(sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    ids = [r[0] for r in sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0))]
    comps = components(texts, 80)
    want = Counter(ids[k] for k, _, c in comps if k == c)
    assert Counter(r.doc_id for r in keep_one(odd).collect()) == want
    kept = keep_one(clashing)
    assert kept.columns == clashing.columns and Counter(r.doc_id for r in kept.collect()) == want


def test_sketches_rule_out_no_link():
    import numpy as np

    h, rng = WordHashes(), random.Random(5)
    for n in (6, 40, 300, 900, 3000):
        blocks = []
        base = prose(rng, n).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
            blocks.append(shingles(h.of(" ".join(w).encode())))
        level = [level_of(len(s)) for s in blocks]
        block = {
            "n": np.array([len(s) for s in blocks]), "level": np.array(level), "near": np.stack([odd_sketch(s, a) for s, a in zip(blocks, level, strict=True)]), "far": np.stack([odd_sketch(s, a + 1) for s, a in zip(blocks, level, strict=True)]),
        }
        est = _estimates(block, block, 0.85)
        for i, a in enumerate(blocks):
            for j, b in enumerate(blocks):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    assert est[i, j] >= 0


def test_exact_groups_as_brute_force(odd, clashing, odd_rows, none, spark):
    def plain(docs):
        norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups = {}
        for k, t in keyed(docs):
            groups.setdefault(norm(t), []).append((-len(t or ""), k))
        out = Counter()
        for n, members in groups.items():
            best = min(members)
            sha = hashlib.sha256(n.encode()).hexdigest()
            for i, (_, k) in enumerate(sorted(members)):
                out[named(k), named(best[1]), len(members), i == 0, sha] += 1
        return out

    want = plain(odd)
    for docs in (odd, clashing):
        for ranges in (1, 3, 50):
            assert Counter(map(tuple, exact_groups(docs, ranges).collect())) == want
    assert exact_groups(none).collect() == []
    many = [(i if i % 2 else None, ["same text", "sametext ", "other"][i % 3 if i % 7 else 0], None, None, None) for i in range(300)]
    docs = spark.createDataFrame(many, SCHEMA)
    assert Counter(map(tuple, exact_groups(docs, 40).collect())) == plain(docs)
    assert NAMELESS > 2**62
