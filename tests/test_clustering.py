from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clusterloom.errors import InvalidInput, TooManyRequests, Unavailable, status_of
from clusterloom.functions.text import token_set
from clusterloom.operators import similarity as sim
from clusterloom.operators.clustering import cleaned, cluster_phrases, embedding_threshold, method_of, parse_phrases
from clusterloom.operators.providers import CallableWriter, Nothing, TableEmbedder, cache_misses, embedded, parsed_clusters, parsed_page
from clusterloom.operators.reconcile import reconcile
from clusterloom.operators.upgma import TooManyItems, cluster_each, labelled, merges, replay, set_similarity, upgma, vector_similarity


def literal(matrix, threshold):
    """The definition, step by step."""
    active = {i: [i] for i in range(len(matrix))}
    sums = {(i, j): matrix[i][j] for i in active for j in active if i != j}
    new = len(matrix)
    while len(active) > 1:
        best = (-np.inf, -1, -1)
        for a in active:
            for b in active:
                if a < b and sums[a, b] / (len(active[a]) * len(active[b])) > best[0]:
                    best = (sums[a, b] / (len(active[a]) * len(active[b])), a, b)
        if best[0] < threshold:
            break
        _, a, b = best
        for o in active:
            if o not in (a, b):
                sums[new, o] = sums[o, new] = sums[a, o] + sums[b, o]
        active[new] = active.pop(a) + active.pop(b)
        new += 1
    return [active[i] for i in active]


def test_known_groups():
    assert upgma(np.full((3, 3), 0.5), 0.5) == [[2, 0, 1]]
    m = np.array([[0, 0.9, 0.1], [0.9, 0, 0.6], [0.1, 0.6, 0]])
    assert upgma(m, 0.4) == [[2], [0, 1]]
    assert upgma(np.zeros((0, 0)), 0.5) == [] and upgma(np.zeros((1, 1)), 0.5) == [[0]]
    nan = np.full((3, 3), np.nan)
    assert upgma(nan, 0.1) == [[0], [1], [2]]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 11), st.integers(2, 5), st.integers(0, 10**6), st.sampled_from([0.2, 0.24, 0.5, 0.7]))
def test_groups_and_ties_as_defined(n, steps, seed, threshold):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, steps, (n, n)) / steps
    m = (m + m.T) / 2
    want = literal(m, threshold)
    assert upgma(m, threshold) == want
    assert sorted(i for g in want for i in g) == list(range(n))
    #: component by component, then replayed
    top = list(range(n))
    for i in range(n):
        for j in range(i):
            if m[i, j] >= threshold:
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    parts = [[i for i in range(n) if top[i] == t] for t in sorted(set(top))]
    assert replay([(p, merges(m[np.ix_(p, p)], threshold)) for p in parts]) == want


def test_clusters_of_phrases(spark):
    phrases = ["pielęgnacja trawnika", "nawożenie trawnika wiosną", "jak często kosić trawnik", " i w na ", "", None, "pielęgnacja trawnika "]
    df = spark.createDataFrame(list(enumerate(phrases)), "ord long, phrase string")
    got = {r.rank: r for r in cluster_phrases(df).collect()}
    assert (got[1].name, got[1].main_phrase, got[1].phrases) == ("Trawnika Nawożenie", "pielęgnacja trawnika", ["nawożenie trawnika wiosną", "pielęgnacja trawnika"])
    assert {(got[2].name, got[2].main_phrase), (got[3].name, got[3].main_phrase)} == {("Często Kosić", "jak często kosić trawnik"), ("i w na", "i w na")}
    with pytest.raises(InvalidInput):
        cluster_phrases(df.where("phrase = ''"))
    many = spark.range(501).select(F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("phrase"))
    with pytest.raises(InvalidInput):
        cluster_phrases(many)
    assert cleaned(many.unionByName(many.limit(1))).count() == 501


def test_parsed_phrases(spark):
    raw = spark.createDataFrame([(0, " a,b \r\n\r\n b "), (1, None), (2, "c,a")], "ord long, text string")
    assert [r.phrase for r in parse_phrases(raw).orderBy("ord").collect()] == ["a", "b", "c"]


def test_settings():
    assert method_of("x") == "lexical" and method_of("semantic") == "semantic"
    with pytest.raises(InvalidInput):
        method_of("x", strict=True)
    assert [embedding_threshold(x) for x in ("", "0", "nan", "x", "0.3", "-1")] == [0.55, 0.55, 0.55, 0.55, 0.3, -1]
    assert [status_of(e) for e in (InvalidInput(), Unavailable(), TooManyRequests(3), ValueError())] == [400, 400, 429, 500]


def brute(rows, metric, threshold):
    out = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a and b:
                c = len(a & b)
                s = c / (len(a | b) if metric == "jaccard" else min(len(a), len(b)))
                if s >= threshold:
                    out[i, j] = s
    return out


@pytest.mark.parametrize("metric", ["jaccard", "overlap"])
def test_pairs_as_brute_force(spark, metric):
    rng = np.random.default_rng(2)
    rows = [(i, {f"t{min(x, y)}" for x, y in rng.integers(0, 25, (int(rng.integers(0, 9)), 2))}) for i in range(70)]
    rows += [(70 + i, {f"u{j}" for j in range(10 if i % 2 else 20)}) for i in range(4)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in rows], "ord long, tokens array<string>")
    for t in (0.3, 0.7, 1.0):
        got = {(r.i, r.j): r.similarity for r in sim.similar_pairs(df, t, metric).collect()}
        want = brute(rows, metric, t)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    shared = {(r.i, r.j): r[metric] for r in sim.sharing_pairs(df).collect()}
    assert shared == pytest.approx({k: v for k, v in brute(rows, metric, 1e-9).items()})


def test_columns_of_similarity(spark):
    row = spark.sql("select array('a','b') x, array('b','c','d') y, array() z, array(1.0d,2.0d) v, array(2.0d,1.0d,9.0d) w, array(0.0d,0.0d) o, array(cast(3 as double)) s")
    row = row.withColumn("z", F.col("z").cast("array<string>"))
    c = F.col
    got = row.select(sim.jaccard(c("x"), c("y")), sim.overlap(c("x"), c("y")), sim.jaccard(c("x"), c("z")), sim.overlap(c("z"), c("x")), sim.cosine(c("v"), c("w")), sim.cosine(c("v"), c("o")), sim.cosine(c("v"), c("s"))).first()
    assert tuple(got) == pytest.approx((0.25, 0.5, 0.0, 0.0, 0.8, 0.0, None))
    assert set_similarity([["a", "b"], ["b", "c", "d"], []], "jaccard")[0].tolist() == [1.0, 0.25, 0.0]
    assert vector_similarity([[1, 2], [2, 1], [0, 0]])[0].tolist() == pytest.approx([1.0, 0.8, 0.0])


def test_cosine_pairs_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0])], "ord long, embedding array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] @ n[j] >= 0.3}
    for tile in (1000, 7):
        assert {(r.i, r.j) for r in sim.cosine_pairs(df, 0.3, tile).collect()} == want


def test_components_give_the_same_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, embedding array<double>")
    got = {}
    for r in labelled(df, sim.cosine_pairs(df, 0.93), 0.93, "cosine").collect():
        got.setdefault(r.cluster, []).append((r.place, r.ord))
    assert sorted([o for _, o in sorted(g)] for g in got.values()) == sorted(upgma(vector_similarity(x.tolist()), 0.93))
    with pytest.raises(TooManyItems):
        cluster_each(df.withColumn("g", F.lit(1)), ["g"], 0.5, "cosine", 79)


def test_ordered_distinct(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (0, None)], "ord long, v string")
    assert {(r.v, r.ord) for r in sim.ordered_distinct(df, "v").collect()} == {("a", 2), ("b", 1)}


def test_reconciled(spark):
    phrases = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, phrase string")
    kind = "cluster_ord long, name string, main_phrase string, phrases array<string>"
    proposal = spark.createDataFrame([(0, "X", "z", ["a", "a", "q"]), (1, "Y", "b", ["a", "b"]), (2, "Z", "a", ["a"])], kind)
    got = [tuple(r) for r in reconcile(proposal, phrases).orderBy("cluster_ord").collect()]
    assert got == [(0, "X", "a", ["a", "a"]), (1, "Y", "b", ["b"]), (3, "Inne", "c", ["c"])]
    assert [tuple(r) for r in reconcile(proposal.limit(0), phrases).collect()] == [(0, "Inne", "a", ["a", "b", "c"])]
    assert reconcile(spark.createDataFrame([(0, "X", "a", ["a", "b", "c"])], kind), phrases).count() == 1


def test_semantic_clusters(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, phrase string")
    with pytest.raises(Unavailable):
        cluster_phrases(df, "semantic")
    asked = []
    writer = CallableWriter(lambda system, user: asked.append(user) or '{"clusters":[{"name":"N","mainPhrase":"b","phrases":["b","a"]}]}')
    got = [tuple(r) for r in cluster_phrases(df, "semantic", "garden", writer=writer).orderBy("rank").collect()]
    assert got == [("N", "b", ["b", "a"], 1), ("Inne", "c", ["c"], 2)]
    assert "1. a\n2. b\n3. c" in asked[0] and "garden" in asked[0]
    for reply in ("", "x", "[]", "{}", '{"clusters":[]}', '{"clusters":[{"name":"a","mainPhrase":"b","phrases":[]}]}', '{"clusters":[{"name":1,"mainPhrase":"b","phrases":["x"]}]}'):
        with pytest.raises(ValueError):
            parsed_clusters(reply)
    with pytest.raises(ValueError):
        parsed_page('{"title":"x"}')


def test_embedding_clusters(spark):
    df = spark.createDataFrame([(0, "aa bb"), (1, "cc"), (2, "aa cc")], "ord long, phrase string")
    with pytest.raises(Unavailable):
        cluster_phrases(df, "embeddings")
    vectors = spark.createDataFrame([("aa bb", [1.0, 0.0]), ("cc", [0.0, 1.0]), ("aa cc", [1.0, 0.1])], "text string, embedding array<double>")
    got = [tuple(r)[:3] for r in cluster_phrases(df, "embeddings", embedder=TableEmbedder(vectors)).orderBy("rank").collect()]
    assert got == [("Aa Bb", "cc", ["cc"])][:0] + [("Aa Bb", "aa bb", ["aa bb", "aa cc"]), ("Cc", "cc", ["cc"])]
    cache = spark.createDataFrame([], "model string, hash string, embedding array<double>")
    out, full = embedded(df.withColumn("text", F.col("phrase")), TableEmbedder(vectors), cache)
    assert out.count() == 3 and cache_misses(df.withColumn("text", F.col("phrase")), full, "table").count() == 0
    assert cache_misses(df.withColumn("text", F.col("phrase")), full, "other").count() == 3
    with pytest.raises(Exception, match="no vector"):
        embedded(df.withColumn("text", F.col("phrase")), TableEmbedder(vectors.limit(1)), cache)[0].collect()
    assert not Nothing().is_available()


def test_token_sets_keep_their_order(spark):
    assert spark.sql("select 'bb aa bb cc' p").select(token_set(F.col("p"))).first()[0] == ["bb", "aa", "cc"]
