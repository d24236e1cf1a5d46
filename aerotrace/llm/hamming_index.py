"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of the vectors after centring, projection on principal axes and a rotation that is
learned to bring them near the corners of the cube. A block of codes is indexed once for each substring of
``SUB`` bits. A code within Hamming radius r of a query has at least one of m substrings within
floor(r / m) of the query's, so probing all substrings at that distance finds every code within the
radius; those are then ranked by the Euclidean distance of the vectors themselves.

The rotation and the radius are fitted on at most ``sample`` vectors: the radius is the smallest that holds
``target`` of the true neighbours among them, and neighbours in the whole table lie no farther. Every row is indexed.
Where a block has fewer than k codes within the radius, the radius grows until it has k, or all.

Edge cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part; vectors of a
length the sample does not know are compared exactly, those of different lengths not at all; a repeated id
stands for its smallest vector; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.llm import vector_blocks

SUB = 16
MOST_BITS = 64


@dataclass(frozen=True)
class Codes:
    """A learned map from vectors of one length to bit strings, and the search radius."""

    mean: np.ndarray
    project: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.project.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substrings of each code: one row a vector, one column a substring."""
        on = (x - self.mean) @ self.project > 0
        m = -(-self.bits // SUB)
        padded = np.zeros((len(x), m * SUB), np.uint32)
        padded[:, :self.bits] = on
        return (padded.reshape(len(x), m, SUB) << np.arange(SUB, dtype=np.uint32)).sum(2).astype(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1).astype(np.int64)


def learn(x: np.ndarray, k: int, target: float = 0.985, rounds: int = 30, probes: int = 256) -> Codes:
    """Fits rotation and radius to the rows of ``x``."""
    mean = x.mean(0)
    bits = min(MOST_BITS, x.shape[1])
    axes = np.linalg.svd(x - mean, full_matrices=True)[2][:bits].T
    y = (x - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ v).T
    codes = Codes(mean, axes @ r, 0)
    c, q = codes.encode(x), np.arange(min(probes, len(x)))
    far: list[int] = []
    for i in q:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[:min(k, len(x) - 1)]
        far.extend(hamming(c[near], c[i]).tolist())
    radius = int(np.quantile(far, target, method="higher")) if far else bits
    return Codes(mean, axes @ r, radius)


def masks(radius: int) -> np.ndarray:
    """All substrings within ``radius`` of zero."""
    out = [0]
    for r in range(1, min(radius, SUB) + 1):
        out += [sum(1 << b for b in pos) for pos in combinations(range(SUB), r)]
    return np.array(out, np.uint16)


class MultiIndex:
    """One block's codes, indexed by each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            starts = np.searchsorted(codes[order, s], np.arange((1 << SUB) + 1))
            self.tables.append((order, starts))
        self.seen: dict[int, np.ndarray] = {}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within the radius."""
        m = len(self.tables)
        reach = min(SUB, radius // m)
        if reach >= SUB:
            return np.flatnonzero(hamming(self.codes, code) <= radius)
        probe = self.seen.setdefault(reach, masks(reach)) if reach not in self.seen else self.seen[reach]
        hit = np.zeros(len(self.codes), bool)
        for s, (order, starts) in enumerate(self.tables):
            key = (probe ^ code[s]).astype(np.int64)
            begin, n = starts[key], starts[key + 1] - starts[key]
            full = n > 0
            begin, n = begin[full], n[full]
            total = int(n.sum())
            if total:
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)
                hit[order[at]] = True
        at = np.flatnonzero(hit)
        return at[hamming(self.codes[at], code) <= radius]


def _closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((x[at] - q) ** 2).sum(1))
    if len(at) > k:
        keep = d <= np.partition(d, k - 1)[k - 1]
        at, d = at[keep], d[keep]
    best = np.lexsort((ids[at], d))[:k]
    return ids[at[best]], d[best]


def fit(valid: DataFrame, vec: str, key: str, k: int, sample: int = 4096) -> dict[int, Codes]:
    """Codes for each vector length in the ``sample`` rows of smallest hash, which go to the driver."""
    rows = valid.select(key, F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    return {d: learn(np.array(v), k) for d, v in by_length.items() if len(v) > 4 * k}


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vec: str = "embedding", sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows found, by Euclidean distance."""
    valid = rows.filter(vector_blocks.finite(vec) & vector_blocks.non_zero(vec)).select(key, vec)
    models = fit(valid, vec, key, k, sample)

    def within(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        model = models.get(q.shape[1])
        if model:
            index, q_codes = MultiIndex(model.encode(x)), model.encode(q)
        for j, i in enumerate(q_ids):
            need = min(k, len(ids) - int((ids == i).sum()))
            radius = model.radius if model else 0
            while model:
                at = index.within(q_codes[j], radius)
                at = at[ids[at] != i]
                if len(at) >= need:
                    break
                radius += len(index.tables)
            if not model:
                at = np.flatnonzero(ids != i)
            if len(at):
                found, d = _closest(q[j], x, ids, at, k)
                yield np.full(len(found), i), found, d

    return vector_blocks.search(valid, valid.filter(is_query), key, vec, k, within, "double", "asc")
