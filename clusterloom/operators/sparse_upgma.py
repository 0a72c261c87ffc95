"""The merges of ``upgma`` without a dense matrix, for many items, equal down to ties and rounding.

A mean between a merged group and a third one is never above the greater of the
two means that it comes from. So a merged group has only neighbours of its two
parts, where neighbours are groups whose mean reaches the threshold, and only
sums of these are kept. A sum that is missing is added up again from
similarities of items in the very order in which a dense matrix would have
carried it. Memory grows with the items and with the pairs that reach the threshold.
"""

from __future__ import annotations

import heapq
from typing import Protocol

import numpy as np

#: Means so far below the threshold still make neighbours, so that rounding hides none.
SLACK = 1e-9
#: Rows of a block of similarities, and pairs of items compared at once.
BLOCK, AT_ONCE = 1_024, 4_096


class Items(Protocol):
    """Items 0..n-1 and their similarities."""

    n: int

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similarities of items i with items j, pair by pair."""

    def near(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(i, j), i < j, of at least all pairs with similarity >= ``least`` > 0."""


class Sets(Items):
    """Token sets by Jaccard or overlap."""

    def __init__(self, tokens: list[list[str]], metric: str) -> None:
        number: dict[str, int] = {}
        rows = [np.array([number.setdefault(t, len(number)) for t in dict.fromkeys(x)], np.int64) for x in tokens]
        self.n, self.metric = len(rows), metric
        self.size = np.array([len(r) for r in rows], np.int64)
        flat, owner = np.concatenate([*rows, np.empty(0, np.int64)]), np.repeat(np.arange(self.n), self.size)
        #: a token of one item is in no intersection
        often = np.bincount(flat, minlength=len(number)) > 1
        kept = often[flat]
        flat, owner = (np.cumsum(often) - 1)[flat[kept]], owner[kept]
        self.ends = np.searchsorted(owner, np.arange(self.n + 1))
        self.flat, by_token = flat.astype(np.int32), np.argsort(flat, kind="stable")
        self.holders = owner[by_token].astype(np.int32)
        self.starts = np.searchsorted(flat[by_token], np.arange(int(often.sum()) + 1))

    def _shared(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        under = np.minimum(a, b).astype(float) if self.metric == "overlap" else a + b - both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((a == 0) | (b == 0), 0.0, both / under)

    def _padded(self, i: np.ndarray) -> np.ndarray:
        """Tokens of items i, as many columns as the largest has, -1 where a set has ended."""
        if not len(self.flat):
            return np.full((len(i), 1), -1, np.int32)
        start, length = self.ends[i], self.ends[i + 1] - self.ends[i]
        column = np.arange(max(1, length.max(initial=0)))
        return np.where(column < length[:, None], self.flat[np.minimum(start[:, None] + column, len(self.flat) - 1)], np.int32(-1))

    def of(self, i, j):
        met = np.sort(np.concatenate([self._padded(i), self._padded(j)], axis=1), axis=1)
        both = ((met[:, 1:] == met[:, :-1]) & (met[:, 1:] >= 0)).sum(axis=1).astype(float)
        return self._shared(both, self.size[i], self.size[j])

    def near(self, least):
        left, right = [], []
        for i in range(self.n):
            lists = [self.holders[self.starts[t] : self.starts[t + 1]] for t in self.flat[self.ends[i] : self.ends[i + 1]]]
            if not lists:
                continue
            both = np.bincount(np.concatenate(lists), minlength=self.n)[i + 1 :].astype(float)
            j = np.nonzero(self._shared(both, self.size[i], self.size[i + 1 :]) >= least)[0] + i + 1
            left.append(np.full(len(j), i, np.int32))
            right.append(j.astype(np.int32))
        return np.concatenate([*left, np.empty(0, np.int32)]), np.concatenate([*right, np.empty(0, np.int32)])


class Vectors(Items):
    """Vectors of one length by cosine, each summed in index order; 0 where a norm is 0."""

    def __init__(self, vectors: list[list[float]]) -> None:
        self.x = np.array(vectors, float)
        self.n = len(self.x)
        self.norm = np.sqrt(np.cumsum(self.x * self.x, axis=1)[:, -1])

    def of(self, i, j):
        dot, under = np.cumsum(self.x[i] * self.x[j], axis=1)[:, -1], self.norm[i] * self.norm[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((self.norm[i] == 0) | (self.norm[j] == 0), 0.0, dot / under)

    def near(self, least):
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(self.norm[:, None] == 0, 0.0, self.x / self.norm[:, None])
        left, right = [], []
        for a in range(0, self.n, BLOCK):
            for b in range(a, self.n, BLOCK):
                i, j = np.nonzero(unit[a : a + BLOCK] @ unit[b : b + BLOCK].T >= least - SLACK)
                later = (j + b) > (i + a)
                left.append((i[later] + a).astype(np.int32))
                right.append((j[later] + b).astype(np.int32))
        return np.concatenate(left), np.concatenate(right)


def _sums(items: Items, children: np.ndarray, g: int, others: np.ndarray) -> np.ndarray:
    """Sums of similarities between group g and each of ``others``, the group made last split first."""
    n, a, b = items.n, np.full(len(others), g, np.int64), others.astype(np.int64)
    splits = []
    while True:
        split = np.maximum(a, b) >= n
        splits.append(split)
        if not split.any():
            break
        first = a > b
        pa, pb = np.where(first[:, None] & split[:, None], children[np.where(split & first, a - n, 0)], a[:, None]), np.where(~first[:, None] & split[:, None], children[np.where(split & ~first, b - n, 0)], b[:, None])
        keep = np.repeat(True, 2 * len(a)).reshape(-1, 2)
        keep[:, 1] = split
        a, b = pa[keep], pb[keep]
    values = np.concatenate([items.of(a[k : k + AT_ONCE], b[k : k + AT_ONCE]) for k in range(0, len(a), AT_ONCE)])
    for split in reversed(splits[:-1]):
        at = np.cumsum(1 + split) - (1 + split)
        out = values[at]
        out[split] += values[at[split] + 1]
        values = out
    return values


def merges(items: Items, threshold: float) -> list[tuple[int, int, float]]:
    """(a, b, mean) of each merge, as ``upgma.merges`` gives them for the matrix of ``items``, for a ``threshold`` > 0."""
    n = items.n
    i, j = items.near(threshold - SLACK)
    s = np.concatenate([*(items.of(i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in range(0, len(i), AT_ONCE)), np.empty(0)])
    some = s >= threshold - SLACK
    i, j, s = i[some], j[some], s[some]
    #: the pairs of each item, and all pairs in the order of merging
    two = np.argsort(np.concatenate([i, j]), kind="stable")
    partner, its = np.concatenate([j, i])[two], np.concatenate([s, s])[two]
    ends = np.searchsorted(np.concatenate([i, j])[two], np.arange(n + 1))
    del two
    order = np.lexsort((j, i, -s))
    i, j, s = i[order], j[order], s[order]
    alive, size, children = np.zeros(2 * n, bool), np.ones(2 * n), np.zeros((n, 2), np.int64)
    alive[:n] = True
    own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    later: dict[int, list[int]] = {}
    queues: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    heap: list[tuple[float, int, int]] = []
    done: list[tuple[int, int, float]] = []

    def neighbours(g: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sums = own.pop(g) if g >= n else (partner[ends[g] : ends[g + 1]].astype(np.int64), its[ends[g] : ends[g + 1]])
        live = alive[ids]
        more = [h for h in later.pop(g, []) if alive[h]]
        found = [own[h][1][np.searchsorted(own[h][0], g)] for h in more]
        return np.concatenate([ids[live], np.array(more, np.int64)]), np.concatenate([sums[live], np.array(found, float)])

    def push(g: int) -> None:
        """The best living neighbour of a merged group, of those that were there before it."""
        ids, means, at = queues[g]
        while at < len(ids) and not alive[ids[at]]:
            at += 1
        if at < len(ids):
            queues[g] = (ids, means, at + 1)
            heapq.heappush(heap, (-float(means[at]), int(ids[at]), g))
        else:
            del queues[g]

    at, new = 0, n
    while True:
        while at < len(i) and not (alive[i[at]] and alive[j[at]]):
            at += 1
        while heap and not (alive[heap[0][1]] and alive[heap[0][2]]):
            g = heapq.heappop(heap)[2]
            if alive[g]:
                push(g)
            else:
                queues.pop(g, None)
        best = min((*([(-float(s[at]), int(i[at]), int(j[at]))] if at < len(i) else []), *heap[:1]), default=None)
        if best is None or -best[0] < threshold:
            return done
        a, b = best[1], best[2]
        done.append((a, b, -best[0]))
        alive[a] = alive[b] = False
        (na, sa), (nb, sb) = neighbours(a), neighbours(b)
        queues.pop(a, None), queues.pop(b, None)
        union = np.union1d(na, nb)
        total = np.zeros(len(union))
        children[new - n], size[new] = (a, b), size[a] + size[b]
        for g, ids, sums in ((a, na, sa), (b, nb, sb)):
            known = np.zeros(len(union), bool)
            where = np.searchsorted(union, ids)
            known[where] = True
            part = np.empty(len(union))
            part[where] = sums
            if not known.all():
                part[~known] = _sums(items, children, g, union[~known])
            total += part
        mean = total / (size[union] * size[new])
        near = mean >= threshold - SLACK
        union, total, mean = union[near], total[near], mean[near]
        own[new], alive[new] = (union, total), True
        for h in union.tolist():
            later.setdefault(h, []).append(new)
        first = np.lexsort((union, -mean))
        queues[new] = (union[first], mean[first], 0)
        push(new)
        new += 1
