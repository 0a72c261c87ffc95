"""Average-link agglomerative clustering with a threshold, exact down to ties.

Of all pairs of active groups the one with the greatest mean similarity merges,
the smallest ids first on ties, as long as that mean reaches the threshold. Sums
are carried along, never computed anew, so that equal means compare equal.

Groups never merge across components of the graph of pairs that reach the
threshold: a mean that reaches it has a pair that does. So each component is
clustered on its own, with all its pairs, and a replay of the merges by
(mean, ids) gives the order that one run over everything would have.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.operators import sparse_upgma
from clusterloom.plans.components import connected_components

#: Items of a dense matrix at most; more are clustered without one.
DENSE = 1_500


class TooManyItems(ValueError):
    """There are more items in a group than its caller allows."""


def merges(sim: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(a, b, mean) of each merge of the items 0..n-1; the k-th merge makes group n + k.

    A merged group takes the place of its first member in the matrix. Each place
    remembers the best mean of its row, so that a merge looks again only at rows
    that had theirs with one of the two groups.
    """
    n = len(sim)
    if n < 2:
        return []
    sums = np.array(sim, float)
    mean = np.where(np.isnan(sums), -np.inf, sums)
    np.fill_diagonal(mean, -np.inf)
    size, ids, best = np.ones(n), np.arange(n), mean.max(axis=1)
    done: list[tuple[int, int, float]] = []
    for new in range(n, 2 * n - 1):
        top = best.max()
        if top == -np.inf or top < threshold:
            break
        #: the smallest id of a best pair, then the smallest id it pairs with
        rows = np.nonzero(best == top)[0]
        r = rows[np.argmin(ids[rows])]
        partners = np.nonzero(mean[r] == top)[0]
        c = partners[np.argmin(ids[partners])]
        done.append((int(ids[r]), int(ids[c]), float(top)))
        stale = (best == mean[:, r]) | (best == mean[:, c])
        row = sums[r] + sums[c]
        size[r] += size[c]
        ids[r] = new
        sums[r], sums[:, r] = row, row
        with np.errstate(divide="ignore", invalid="ignore"):
            fresh = row / (size * size[r])
        fresh[np.isnan(fresh) | (size == 0)] = -np.inf
        fresh[[r, c]] = -np.inf
        mean[r], mean[:, r] = fresh, fresh
        mean[c], mean[:, c] = -np.inf, -np.inf
        size[c] = 0
        best = np.maximum(best, fresh)
        stale[r] = True
        stale[c] = False
        again = np.nonzero(stale)[0]
        best[again] = mean[again].max(axis=1)
        best[c] = -np.inf
    return done


def members(n: int, done: Iterable[tuple[int, int, float]]) -> list[list[int]]:
    """Groups in order of id: items that no merge took, then merged groups, each with the members of a before those of b."""
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}
    for k, (a, b, *_) in enumerate(done):
        groups[n + k] = groups.pop(a) + groups.pop(b)
    return [groups[i] for i in sorted(groups)]


def upgma(sim: np.ndarray, threshold: float) -> list[list[int]]:
    """Groups of item numbers for a symmetric similarity matrix."""
    return members(len(sim), merges(sim, threshold))


def replay(parts: list[tuple[list[int], list[tuple[int, int, float]]]]) -> list[list[int]]:
    """Groups of all components in the order of one run over everything.

    ``parts`` has each component's items, ascending, and its merges. Of the
    merges that are next in their component the one with the greatest mean comes
    first, then the one with the smallest ids.
    """
    total = sum(len(items) for items, _ in parts)
    groups: dict[int, list[int]] = {}
    ids: list[list[int]] = []
    for items, _ in parts:
        ids.append(list(items))
        groups |= {i: [i] for i in items}
    heap: list[tuple[float, int, int, int, int]] = []

    def push(p: int, k: int) -> None:
        if k < len(parts[p][1]):
            a, b, mean = parts[p][1][k]
            x, y = sorted((ids[p][a], ids[p][b]))
            heapq.heappush(heap, (-mean, x, y, p, k))

    for p in range(len(parts)):
        push(p, 0)
    new = total
    while heap:
        _, x, y, p, k = heapq.heappop(heap)
        groups[new] = groups.pop(x) + groups.pop(y)
        ids[p].append(new)
        new += 1
        push(p, k + 1)
    return [groups[i] for i in sorted(groups)]


def set_similarity(tokens: list[list[str]], metric: str) -> np.ndarray:
    """Matrix of Jaccard or overlap similarities of token sets."""
    number: dict[str, int] = {}
    rows = [[number.setdefault(t, len(number)) for t in dict.fromkeys(x)] for x in tokens]
    hit = np.zeros((len(rows), len(number)), np.float32)
    for i, r in enumerate(rows):
        hit[i, r] = 1
    both = np.rint(hit @ hit.T).astype(float)
    size = np.array([len(r) for r in rows], float)
    under = np.minimum(size[:, None], size[None]) if metric == "overlap" else size[:, None] + size[None] - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((size[:, None] == 0) | (size[None] == 0), 0.0, both / under)


def vector_similarity(vectors: list[list[float]]) -> np.ndarray:
    """Matrix of cosines, each summed in index order; 0 where a norm is 0."""
    x = np.array(vectors, float)
    dot = np.zeros((len(x), len(x)))
    norm = np.zeros(len(x))
    for k in range(x.shape[1] if x.ndim == 2 else 0):
        dot += x[:, k, None] * x[None, :, k]
        norm += x[:, k] * x[:, k]
    norm = np.sqrt(norm)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((norm[:, None] == 0) | (norm[None] == 0), 0.0, dot / (norm[:, None] * norm[None]))


Groups = Callable[[pd.DataFrame], list[list[int]]]


def by_metric(metric: str, threshold: float, dense: int = DENSE) -> Groups:
    """Groups of the rows of a table; of more than ``dense`` without a matrix, which takes a threshold above 0."""

    def groups(pdf: pd.DataFrame) -> list[list[int]]:
        held = [list(x) for x in pdf["embedding" if metric == "cosine" else "tokens"]]
        if len(held) > dense and threshold > 0:
            items = sparse_upgma.Vectors(held) if metric == "cosine" else sparse_upgma.Sets(held, metric)
            return members(len(held), sparse_upgma.merges(items, threshold))
        return upgma(vector_similarity(held) if metric == "cosine" else set_similarity(held, metric), threshold)

    return groups


def cluster_each(items: DataFrame, by: list[str], threshold: float, metric: str, most: int | None = None) -> DataFrame:
    """(by..., ord, cluster, place): groups within each ``by``, of ``items`` (by..., ord, tokens or embedding).

    ``cluster`` numbers the groups of a ``by`` in their order, ``place`` the members of
    a group in theirs. Null in ``by`` is a value of its own; an ``ord`` occurs once in
    it. More than ``most`` items in one ``by`` raise ``TooManyItems`` before any is compared.
    """
    groups = by_metric(metric, threshold)
    held = "embedding" if metric == "cosine" else "tokens"
    large = most is not None and items.groupBy(*by).count().where(F.col("count") > most).limit(1).collect()
    if large:
        raise TooManyItems(f"{large[0]['count']} items in one group; {most} at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        rows = [(i, c, k) for c, g in enumerate(groups(pdf)) for k, i in enumerate(g)]
        index, cluster, place = (list(x) for x in zip(*rows, strict=True))
        out = pdf.loc[index, [*by, "ord"]].reset_index(drop=True)
        return out.assign(cluster=cluster, place=place)

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"ord {kinds['ord']}", "cluster long", "place long"])
    return items.select(*by, "ord", held).groupBy(*by).applyInPandas(run, schema)


def cluster_all(items: DataFrame, pairs: DataFrame, threshold: float, metric: str, most: int | None = None) -> DataFrame:
    """(component, ord, cluster, place): groups within each component of ``items`` (ord, tokens or embedding).

    ``pairs`` (i, j, ...) are those that reach the threshold; items without one have no row.
    """
    component = connected_components(pairs.select(F.col("i").alias("u"), F.col("j").alias("v")))
    placed = items.join(component, items["ord"] == component["node"]).select(items["*"], "component")
    return cluster_each(placed, ["component"], threshold, metric, most)


def labelled(items: DataFrame, pairs: DataFrame, threshold: float, metric: str, most: int | None = None) -> DataFrame:
    """(ord, cluster, place): groups over all ``items``; ``cluster`` is the least ord in the group.

    The same groups and order of members as one run over everything has; where
    the order of groups among each other matters, see ``replay``.
    """
    grouped = cluster_all(items, pairs, threshold, metric, most)
    first = grouped.groupBy("component", "cluster").agg(F.min("ord").alias("least"))
    named = grouped.join(first, ["component", "cluster"]).select("ord", F.col("least").alias("cluster"), "place")
    alone = items.join(named.select("ord"), "ord", "left_anti").select("ord", F.col("ord").alias("cluster"), F.lit(0).cast("long").alias("place"))
    return named.unionByName(alone)
