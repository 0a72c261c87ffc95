from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from clusterloom.llm.words import WordHashes

from .brute import components


def staged(spark, docs, folder, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang, near, clean, mix, shards = staged(spark, docs, tmp_path, sf)
    for out in (lang, near, clean, mix):
        assert out.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lettered = {d for d, t in rows if any(c.isalpha() for c in t or "")}
    assert ids(lang) <= lettered and len(lettered - ids(lang)) <= 0.02 * len(lettered)
    left = [(d, t) for d, t in rows if d in ids(lang)]
    assert ids(near) == {d for d, _, c in components(left, 80) if d == c}
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, t in left if d in ids(near) and any(i in " ".join(t.split()) for i in items)}
    assert leaks and not leaks & ids(clean) and len(ids(near) - ids(clean) - leaks) <= 2
    n = Counter({d: len(t.split()) for d, t in left})
    whole, part = (sum(n[d] for d in ids(x)) for x in (clean, mix))
    assert 0.7 * whole < part <= 0.8 * whole
    assert ids(shards) == ids(mix) and set(r.shard for r in shards.collect()) <= set(range(8))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, shards.select("doc_id", "shard", "slot").collect()))


@pytest.mark.parametrize("kind", ["odd", "clashing", "none"])
def test_stages_take_odd_tables(spark, sf, kind, tmp_path, request):
    docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.columns == docs.columns
        if kind == "none":
            assert out.count() == 0
        else:
            assert 0 < out.count() <= docs.count()


def test_rows_without_an_id_of_their_own_are_judged_on_their_own_text(spark, tmp_path):
    item, other, third, fourth = (" ".join(f"{w}{i}" for i in range(40)) for w in ("item", "other", "third", "fourth"))
    rows = [(1, other), (None, other + " end"), (None, third), (None, third), (None, item), (None, None), (2, fourth), (2, item), (2, other), (2, item), (0, fourth + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda df: sorted(((r.doc_id or -1, r.text or "") for r in df.collect()))
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert left(near) == left(spark.createDataFrame([(1, other), (None, third), (2, item), (None, None), (0, fourth + " end")], docs.schema))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert left(clean) == left(spark.createDataFrame([r for r in rows if r[1] != item], docs.schema))


def test_hashes_don_t_depend_on_place_or_pieces(monkeypatch):
    import clusterloom.llm.words as w

    text = (" ab\tabc\x0bb  caf\u00e9\x1cx \u00a0 ab\n" * 40).encode() + b"ab" * 30
    want, seen = WordHashes().of(text), {}
    assert len(want) == len(text.split())
    for word, h in zip(text.split(), want.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    for piece in (1, 7, 50):
        monkeypatch.setattr(w, "PIECE", piece)
        assert WordHashes().of(text).tolist() == want.tolist()
    assert [len(WordHashes().of(x)) for x in (None, b"", b" \n", b"a", b" a ")] == [0, 0, 0, 1, 1]
