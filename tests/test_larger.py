"""What larger tables have and the small ones lack: pages of one URL, texts cut within a reference, large tables made by exploding."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as e
from clusterloom.operators import similarity, site, sparse_upgma, upgma
from clusterloom.sources.fetching import follow_redirects


@pytest.fixture(scope="module")
def web(spark, tmp_path_factory):
    """A folder with pages, two of one URL and one cut off after ``&amp``, and with five events."""
    path = str(tmp_path_factory.mktemp("web"))
    rows = []
    for i, url in enumerate(["http://a.test/en/1", "http://a.test/en/2", "http://a.test/en/2", "http://b.test/en/1", "http://b.test/en/2", "http://b.test/en/2", "http://b.test/en/4"]):
        words = f"word{i} &amp; leaf{i} &amp" if i % 3 == 1 else f"word{i} leaf{i}"
        rows.append((i, url, f"<html><head><title>{words}</title></head><body><article><h1>{words}</h1><p>{words}</p></article></body></html>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", "page_signals full_contents signal_texts site_signals site_stats silo_links site_duplicates discovered_pages discovery_stats".split())
def test_pages_of_one_url_and_cut_references(spark, web, name):
    got = e.queries()[name](spark, web)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{web}/pages.parquet/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.execute(f"SELECT {columns} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_redirects_are_not_broadcast(spark):
    steps = spark.range(5).selectExpr("concat('u', id) AS from_url", "concat('v', id) AS to_url")
    plan = follow_redirects(spark.range(5).selectExpr("concat('u', id) AS url"), steps)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("metric", ["jaccard", "overlap", "cosine"])
def test_merges_without_a_matrix_are_those_of_a_matrix(metric):
    """Ties, rounding, empty sets and null vectors included."""
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 90):
        if metric == "cosine":
            x = rng.normal(size=(n, 5))
            x[rng.integers(0, n, n // 3)] = x[0]
            x[n // 2] = 0
            items, matrix = sparse_upgma.Vectors(x), upgma.vector_similarity(x)
        else:
            x = [[f"t{t % 40}" for t in rng.zipf(1.5, int(rng.integers(0, 9)))] for _ in range(n)]
            items, matrix = sparse_upgma.Sets(x, metric), upgma.set_similarity(x, metric)
        for threshold in (0.24, 0.5, 0.9):
            assert sparse_upgma.merges(items, threshold) == upgma.merges(matrix, threshold)


def test_a_site_has_more_pages_than_a_request_has_phrases(spark):
    pages = spark.range(1_600).selectExpr("'http://a.test' AS origin", "id AS ord", "concat('http://a.test/', id) AS url", "concat('l', id) AS label", "concat('word', id, ' leaf', id div 2) AS signal")
    rows = site.site_groups(pages).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in rows) == [2] * 800


def test_a_component_of_more_vectors_than_a_matrix_takes(spark):
    vectors = spark.range(5_200).selectExpr("id AS ord", "flatten(transform(array(1, 7, 31, 113, 517, 1201), k -> array(cos(id * k), sin(id * k)))) AS embedding")
    pairs = spark.range(1, 5_200).selectExpr("0L AS i", "id AS j")
    found = upgma.labelled(vectors, pairs, 0.99, "cosine")
    assert found.select("ord").distinct().count() == 5_200


def test_vectors_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """With pairs that are those of one block."""
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 6)))], "ord long, embedding array<float>")
    want = {(r.i, r.j, round(r.similarity, 9)) for r in similarity.cosine_pairs(vectors, 0.3, 1_000).collect()}
    monkeypatch.setattr(similarity, "BLOCKS", 3)
    got = similarity.cosine_pairs(vectors, 0.3, 7)
    assert {(r.i, r.j, round(r.similarity, 9)) for r in got.collect()} == want
    assert "sequence(0, 2" in got._jdf.queryExecution().logical().toString() or "[0,1,2]" in got._jdf.queryExecution().optimizedPlan().toString()
