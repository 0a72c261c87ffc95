"""Pairs of token sets: what travels grows with the sets, not with the pairs that are compared."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from clusterloom.operators import similarity


def written(spark) -> tuple[int, int]:
    """Bytes and rows of all shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    every = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in every), sum(s.shuffleWriteRecords() for s in every)


def test_sets_do_not_travel_with_each_pair(spark):
    """Each two of these sets overlap; they went along with each of the 31,125 pairs, 774,329 bytes in all."""
    n = 250
    sets = spark.createDataFrame([(i, [f"t{t}" for t in range(60) if t not in (i % 50, 50 + i // 50 % 5)] + [f"own{i}"]) for i in range(n)], "ord long, tokens array<string>")
    before = written(spark)[0]
    assert similarity.similar_pairs(sets, 0.7, "overlap").count() == n * (n - 1) // 2
    assert written(spark)[0] - before < 100_000


def random_sets(n: int, seed: int) -> list[tuple[int, list[str]]]:
    rng = np.random.default_rng(seed)
    return [(i, [f"t{t}" for t in rng.choice(40, 10, replace=False)]) for i in range(n)]


def test_sets_that_share_a_token_are_no_rows_of_a_shuffle(spark):
    rows = random_sets(1_000, 5)
    sets = spark.createDataFrame(rows, "ord long, tokens array<string>")
    before = written(spark)[1]
    got = {(r.i, r.j) for r in similarity.similar_pairs(sets, 0.8, "jaccard").collect()}
    travelled = written(spark)[1] - before
    assert got == {(i, j) for (i, a), (j, b) in combinations(rows, 2) if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert travelled < 20_000


@pytest.mark.parametrize("metric", ["overlap", "jaccard"])
def test_blocks_and_tiles_give_the_pairs_of_one(spark, monkeypatch, metric):
    """By key, with copies, and whatever has a rank."""
    rng = np.random.default_rng(11)
    rows = [(f"k{i % 2}", i, [f"t{min(x, y)}" for x, y in rng.integers(0, 30, (int(rng.integers(0, 12)), 2))] if i % 5 else ["a", "b", f"c{i % 3}"]) for i in range(160)]
    sets = spark.createDataFrame([*rows, (None, 900, ["a"]), (None, 901, ["a"]), ("k0", 902, None)], "site string, ord long, tokens array<string>")
    pairs = lambda: {(r.site, r.i, r.j, r.similarity) for r in similarity.similar_pairs(sets, 0.6, metric, ("site",)).collect()}
    want = pairs()
    for name, value in {"ONE_BLOCK": 10, "SET_BLOCKS": 3, "BLOCK_TOKENS": 50, "TILE_TOKENS": 20, "AT_ONCE": 2, "MET_AT_ONCE": 5, "FREQUENT": 4}.items():
        monkeypatch.setattr(similarity, name, value)
    assert pairs() == want
    by_hand = set()
    for (k, i, a), (q, j, b) in combinations(rows, 2):
        x, y = set(a), set(b)
        if k == q and x and y and (s := len(x & y) / (min(len(x), len(y)) if metric == "overlap" else len(x | y))) >= 0.6:
            by_hand.add((k, i, j, s))
    assert want == by_hand
