"""Exact top-k inner products by aggregation without random access.

Within a tile, every dimension has one list of the candidates sorted by their component. A query reads
each list from the end that adds most, all lists in step, ``STEPS`` times a part of each. For every candidate it keeps a
lower bound of its score, as if each list in which it has not been seen added the least that it can. What the
lists can still add above that least, at the place they are read to, bounds every score from above. Reading stops when the k-th best
lower bound is above the upper bound of every outsider; then the lists are read on only to complete the
scores of those that remain. What a step adds to the bounds of all candidates is one matrix product for all queries of
a chunk. Components are whole numbers, so all sums are exact.

Edge cases: vectors that are NULL or empty, or hold NULL or non-finite components, take no part; vectors of
different lengths are not compared; fewer than k candidates are all returned; ties go to the
smaller id; a repeated id stands for its smallest vector; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.llm import vector_blocks

STEPS = 4
CHUNK = 256


def number_type(x: np.ndarray, y: np.ndarray) -> np.dtype:
    """The fastest type in which all inner products of rows of x and y are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * 4 * x.shape[1]
    return np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


class SortedLists:
    """The lists of one candidate block, one a dimension, cut into the parts that a step reads.

    ``gain[way][t]`` holds, for the candidates that step t reads in each list, what they add above the list's least; way 0 reads from
    the largest component down, way 1 from the smallest up. ``ahead[way][t]`` is the first component of each list not read after step t.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind: np.dtype):
        n = len(ids)
        self.ids, self.kind = ids, kind
        order = np.argsort(-values, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], 0)
        by_rank = np.take_along_axis(values, order, 0)
        self.cuts = [(t + 1) * n // STEPS for t in range(STEPS)]
        step = np.searchsorted(self.cuts, np.arange(n), side="right")
        self.least = (by_rank[-1].astype(kind), by_rank[0].astype(kind))  # least of a list that weighs above, below zero
        down, up = step[place], step[n - 1 - place]
        self.gain = tuple([((values - worst) * (code == t)).astype(kind).T.copy() for t in range(STEPS)] for code, worst in ((down, by_rank[-1]), (up, by_rank[0])))
        self.ahead = tuple([edge[min(c, n - 1)].astype(kind) for c in self.cuts] for edge in (by_rank, by_rank[::-1]))

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's k best, without its own id, ties to the smaller id."""
        ways = np.maximum(q, 0).astype(self.kind), np.minimum(q, 0).astype(self.kind)
        low = np.tile((ways[0] @ self.least[0] + ways[1] @ self.least[1])[:, None], (1, len(self.ids)))
        own = query_ids[:, None] == self.ids[None, :] if len(self.ids) else np.zeros(low.shape, bool)
        floor = low.min(initial=0) - 1
        left, done = np.arange(len(q)), {}
        for t in range(STEPS):
            low += ways[0][left] @ self.gain[0][t] + ways[1][left] @ self.gain[1][t]
            if t < STEPS // 2 or t == STEPS - 1 or low.shape[1] <= k:
                continue
            rest = ways[0][left] @ (self.ahead[0][t] - self.least[0]) + ways[1][left] @ (self.ahead[1][t] - self.least[1])
            seen = np.where(own[left], floor, low)
            kth = np.partition(seen, -k, axis=1)[:, -k]
            open_ = (seen + rest[:, None] >= kth[:, None]) & ~own[left]
            stop = open_.sum(1) <= max(k, len(self.ids) // 64)  # the rest cannot qualify: their lists are read on for the few that can
            for j in np.flatnonzero(stop):
                at, score = np.flatnonzero(open_[j]), low[j][open_[j]].copy()
                for u in range(t + 1, STEPS):
                    score += ways[0][left[j]] @ self.gain[0][u][:, at] + ways[1][left[j]] @ self.gain[1][u][:, at]
                done[left[j]] = at, score
            low, left = low[~stop], left[~stop]
        for j, i in enumerate(left):
            at = np.flatnonzero(~own[i])
            done[i] = at, low[j][at]
        for i in range(len(q)):
            at, score = done[i]
            if len(at) > k:
                keep = score >= np.partition(score, -k)[-k]
                at, score = at[keep], score[keep]
            best = np.lexsort((self.ids[at], -score))[:k]
            yield self.ids[at[best]], score[best].astype(np.int64)


def quantised(vec: str, scale: int = 64) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of highest inner product over all rows but its own."""
    valid = rows.filter(vector_blocks.finite(vec)).select(key, quantised(vec, scale).alias("v"))

    def within(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple]:
        lists = SortedLists(ids, vectors.astype(np.int64), number_type(vectors, q))
        for at in range(0, len(q), CHUNK):
            for i, (found, score) in zip(q_ids[at:at + CHUNK], lists.top(q_ids[at:at + CHUNK], q[at:at + CHUNK].astype(np.int64), k), strict=True):
                yield np.full(len(found), i), found, score

    return vector_blocks.search(valid, valid.filter(is_query), key, "v", k, within, "long", "desc")
