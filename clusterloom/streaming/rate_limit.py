"""Request budgets per key, in windows that begin with the first request they admit.

Such windows depend on what was admitted before, so that neither tumbling nor
session windows express them. In batch, requests are dealt by key, sorted by
time and run past a counter, one row of state a key. In streams the counter is
keyed state; requests of a key are taken in order of time within a micro-batch, and
across micro-batches in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Budget:
    limit: int
    window_ms: int


GENERAL = Budget(30, 5 * 60_000)
EXPENSIVE = Budget(8, 10 * 60_000)


class Counter:
    """Count and start of a key's window."""

    def __init__(self, budget: Budget, count: int = 0, start: int | None = None) -> None:
        self.budget, self.count, self.start = budget, count, start

    def admit(self, now: int) -> tuple[bool, int]:
        """Whether a request at ``now`` (ms) is allowed, and the seconds to wait if not."""
        if self.start is None or now - self.start >= self.budget.window_ms:
            self.count, self.start = 1, now
            return True, 0
        if self.count >= self.budget.limit:
            return False, -(-(self.start + self.budget.window_ms - now) // 1000)
        self.count += 1
        return True, 0


def _milliseconds(rows: DataFrame) -> Column:
    """Milliseconds of ``ts``; a time without a zone is counted as it is written, whatever the session's zone."""
    ts = F.col("ts")
    if rows.schema["ts"].dataType.typeName() == "timestamp":
        return F.expr("unix_micros(ts) div 1000")
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400_000 + clock).cast("long")


def rate_limit(requests: DataFrame, budget: Budget) -> DataFrame:
    """(request_id, client_key, ts, allowed, retry_after) for ``requests`` (request_id, client_key, ts).

    Requests of one time are taken in order of request_id; null times come first,
    as time 0. A null key is a key.
    """
    rows = requests.select("request_id", "client_key", "ts", F.coalesce(_milliseconds(requests), F.lit(0)).alias("_ms"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counter = object(), None
        for batch in batches:
            allowed, wait = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            keys, times = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for i, (key, now) in enumerate(zip(keys, times, strict=True)):
                if key != last or counter is None:
                    last, counter = key, Counter(budget)
                allowed[i], wait[i] = counter.admit(now)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed), pa.array(wait)], names=["request_id", "client_key", "ts", "allowed", "retry_after"])

    ordered = rows.repartition("client_key").sortWithinPartitions("client_key", "_ms", "request_id")
    return ordered.mapInArrow(run, f"request_id {kinds['request_id']}, client_key {kinds['client_key']}, ts {kinds['ts']}, allowed boolean, retry_after long")


def two_tiers(requests: DataFrame, general: Budget = GENERAL, expensive: Budget = EXPENSIVE) -> DataFrame:
    """(request_id, allowed, retry_after) for ``requests`` (request_id, client_key, ts, expensive).

    Every request uses the general budget; expensive ones use theirs as well, even
    if the general one is exhausted. The longer wait counts.
    """
    first = rate_limit(requests, general).select("request_id", F.col("allowed").alias("g"), F.col("retry_after").alias("gw"))
    second = rate_limit(requests.where("expensive"), expensive).select("request_id", F.col("allowed").alias("e"), F.col("retry_after").alias("ew"))
    both = first.join(second, "request_id", "left")
    return both.select("request_id", (F.col("g") & F.coalesce("e", F.lit(True))).alias("allowed"), F.greatest("gw", F.coalesce("ew", F.lit(0))).alias("retry_after"))


def is_expensive(mode: Column, method: Column) -> Column:
    """Crawls, and methods that call a provider."""
    return F.coalesce(mode == "crawl", F.lit(False)) | F.coalesce(method.isin("semantic", "embeddings"), F.lit(False))


def rate_limit_stream(requests: DataFrame, budget: Budget, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of (request_id long, client_key string, ts timestamp).

    The clock is the requests' own: the state of a key goes once the watermark is
    past its window, and requests that come more than ``late`` out of order get no answer.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = Counter(budget, *state.get) if state.exists else Counter(budget)
        pdf = pd.concat(list(pdfs)).sort_values(["ms", "request_id"], kind="stable")
        got = [counter.admit(int(ms)) for ms in pdf["ms"]]
        state.update((counter.count, counter.start))
        state.setTimeoutTimestamp(max(counter.start + budget.window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": pdf["request_id"], "client_key": key[0], "allowed": [a for a, _ in got], "retry_after": [w for _, w in got]})

    rows = requests.withWatermark("ts", late).select("request_id", "client_key", "ts", _milliseconds(requests).alias("ms"))
    return rows.groupBy("client_key").applyInPandasWithState(
        run, "request_id long, client_key string, allowed boolean, retry_after long", "count long, start long", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Keys that a limiter tracks before it drops those whose window is over.
TRACKED = 20_000


class Limiter:
    """Budgets of many keys in one process, for a service's front door.

    Once more than ``tracked`` keys are held, those go whose window is over as the current
    request's budget counts it; so a key of a longer window can lose its count early.
    """

    def __init__(self, tracked: int = TRACKED) -> None:
        self.tracked, self.states = tracked, {}

    def admit(self, key: str, now: int, budget: Budget) -> tuple[bool, int]:
        """Whether a request of ``key`` at ``now`` (ms) is allowed, and the seconds to wait if not."""
        if len(self.states) > self.tracked:
            self.states = {k: v for k, v in self.states.items() if now - v[1] < budget.window_ms}
        counter = Counter(budget, *self.states.get(key, (0, None)))
        allowed, wait = counter.admit(now)
        self.states[key] = counter.count, counter.start
        return allowed, wait
