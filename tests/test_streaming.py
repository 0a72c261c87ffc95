from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clusterloom.plans.components import connected_components
from clusterloom.plans.runtime import cut
from clusterloom.streaming.progress import Progress
from clusterloom.streaming.rate_limit import EXPENSIVE, GENERAL, Budget, Counter, Limiter, is_expensive, rate_limit, rate_limit_stream, two_tiers

BASE = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(i, k, None if s is None else BASE + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], "request_id long, client_key string, ts timestamp")


def test_counter():
    c = Counter(Budget(2, 10_000))
    assert [c.admit(t) for t in (0, 1000, 2000, 9999, 10_000)] == [(True, 0), (True, 0), (False, 8), (False, 1), (True, 0)]


def test_batch(spark):
    rows = [("a", 0), ("b", 0), ("a", 1), ("a", 2), ("a", 10), (None, 0), (None, 0), (None, 1), ("b", None)]
    got = {r.request_id: (r.allowed, r.retry_after) for r in rate_limit(requests(spark, rows), Budget(2, 10_000)).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, 8), 4: (True, 0), 5: (True, 0), 6: (True, 0), 7: (False, 9), 8: (True, 0)}
    assert rate_limit(requests(spark, []), GENERAL).collect() == []


def test_two_tiers(spark):
    df = requests(spark, [("a", i) for i in range(6)]).withColumn("expensive", F.col("request_id") % 2 == 1)
    got = {r.request_id: (r.allowed, r.retry_after) for r in two_tiers(df, Budget(2, 10_000), Budget(2, 60_000)).collect()}
    #: the general budget is gone from request 2 on; request 5 finds the expensive one used up by 1 and 3
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 8), 3: (False, 7), 4: (False, 6), 5: (False, 56)}
    kinds = spark.createDataFrame([("crawl", None), (None, "semantic"), ("phrases", "lexical"), (None, None)], "m string, k string")
    assert [r[0] for r in kinds.select(is_expensive(F.col("m"), F.col("k"))).collect()] == [True, True, False, False]
    assert (EXPENSIVE.limit, GENERAL.window_ms) == (8, 300_000)


def test_stream_is_as_batch(spark, tmp_path):
    rows = [(f"k{i % 7}", (i * 37) % 50 + i) for i in range(120)]
    df = requests(spark, rows)
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sent: list[str] = []
    listener = Progress(sent.append)
    spark.streams.addListener(listener)
    q = rate_limit_stream(stream, Budget(3, 20_000)).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = {(r.request_id, r.allowed, r.retry_after) for r in rate_limit(df, Budget(3, 20_000)).collect()}
    assert {(r.request_id, r.allowed, r.retry_after) for r in spark.sql("select * from limited").collect()} == want
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert sent and '"status"' in sent[0]


def test_eviction():
    limiter = Limiter(1)
    limiter.states = {"a": (1, 100), "b": (1, 900)}
    assert limiter.admit("c", 1000, Budget(1, 500)) == (True, 0) and set(limiter.states) == {"b", "c"}


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(60)] + [(5, 5), (None, 1), (2000, 2001), (2000, 2001)]
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert cut(spark.range(5)).count() == 5
