"""Centroid clustering over a vector approximation file.

Vectors of whole numbers lie in raw files of fixed record length in the shared folder. Beside them stands the approximation: per vector and dimension
the number of the cell, of ``2 ** bits``, that the component falls in, in rows of up to ``BLOCK`` vectors. A round reads approximations only.
For each dimension, cell and centroid a lookup table holds the least and the greatest squared distance between the centroid and
a component of that cell; their sums over the dimensions enclose the true distance. A vector is fetched from its file only if the intervals of
several centroids overlap, or if it changes its cluster, since centroids are kept as exact sums and counts to which moved vectors are
added and from which they are taken. The last assignment fetches every vector once, for its exact distance.

Cells are bounded by approximate quantiles inside and by the true extremes outside, so no result depends on them. All arithmetic is in
whole numbers. Nothing is grouped by a key: a vector that a third of the table repeats is spread like any other.

Edge cases: vectors that are NULL, of another length, or with NULL or non-finite components take no part; fewer vectors than centroids make
every vector a centroid; repeated rows are vectors of their own, and start centroids tie by their components; a NULL vec_id takes part and comes last
among start centroids; an empty table gives no rows; other columns are ignored; components beyond ``LARGEST`` after scaling raise an error, since squared
distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import keep, open_fs, shared_folder

BLOCK = 4096
LARGEST = 1 << 27
GAP = 16  # records skipped over rather than read in two pieces
BLOCK_COLS = "file string, at long, ids array<long>, codes binary, cluster binary"
STEP_COLS = f"{BLOCK_COLS}, k int, n long, sums array<long>"


@dataclass(frozen=True)
class Clusters:
    """One row a vector (vec_id, cluster, distance), the final centroids, and how many vectors each round fetched."""

    rows: DataFrame
    centroids: np.ndarray
    fetched: list[int]


def prepared(df: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and whole components of the vectors that take part."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    return df.filter((F.size(e) == dim) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def start_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; ties by components, NULL ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    return np.array([r["v"] for r in rows], np.int64)


def cell_bounds(vectors: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole number of each cell of each dimension (dim x cells); the outer ones reach to the extremes."""
    inner = [i / (1 << bits) for i in range(1, 1 << bits)]
    per = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", inner, 2000).alias("q"))
    row = sorted(per.collect(), key=lambda r: r["d"])  # one row a dimension
    if max(max(abs(b["lo"]), abs(b["hi"])) for b in row) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances would leave 64 bits")
    low = np.array([[b["lo"], *b["q"]] for b in row], np.int64)  # a cell begins at its mark and ends before the next
    return low, np.array([[*b["q"], b["hi"] + 1] for b in row], np.int64) - 1


def approximate(vectors: DataFrame, low: np.ndarray, folder: str) -> DataFrame:
    """Writes the vectors' files and returns the approximation, one row a block. A task that runs again writes a file of its own."""
    dim = len(low)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, out, at = TaskContext.get(), None, 0
        fs, path = open_fs(folder)
        name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}.vec"
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                cells = np.stack([np.searchsorted(low[d, 1:], v[:, d], side="right") for d in range(dim)], 1).astype(np.uint8)
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(v.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([cells.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["file", "at", "ids", "codes", "cluster"])
                at += v.size * 4
        if out:
            out.close()

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    return keep(vectors.mapInArrow(write, BLOCK_COLS))


def intervals(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each centroid to each cell: dim x cells x centroids."""
    c = centroids.T[:, None, :]
    below, above = low[:, :, None] - c, c - high[:, :, None]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return near * near, far * far


def candidates(cells: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which centroids each vector may be nearest to: those whose interval begins no later than the earliest end."""
    lower = np.zeros((len(cells), near.shape[2]), np.int64)
    upper = np.zeros_like(lower)
    for d in range(cells.shape[1]):
        lower += near[d][cells[:, d]]
        upper += far[d][cells[:, d]]
    return lower <= upper.min(1, keepdims=True)


def fetch(f, at: int, rows: np.ndarray, dim: int) -> np.ndarray:
    """Records of a block by number, read in runs."""
    out = np.empty((len(rows), dim), np.int64)
    if not len(rows):
        return out
    runs = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows) > GAP) + 1)
    for run in runs:
        first, last = int(rows[run[0]]), int(rows[run[-1]])
        raw = np.frombuffer(f.read_at((last - first + 1) * dim * 4, at + first * dim * 4), "<i4").reshape(-1, dim)
        out[run] = raw[rows[run] - first]
    return out


def nearest(v: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of each vector's open centroids; ties go to the smaller number."""
    row, k = np.nonzero(open_)
    dist = np.empty(len(row), np.int64)
    for lo in range(0, len(row), 1 << 15):
        diff = v[row[lo:lo + (1 << 15)]] - centroids[k[lo:lo + (1 << 15)]]
        dist[lo:lo + (1 << 15)] = (diff * diff).sum(1)
    order = np.lexsort((k, dist, row))
    first = order[np.append(True, np.diff(row[order]) > 0)] if len(order) else order
    return k[first], dist[first]


def _visitor(folder: str, low: np.ndarray, high: np.ndarray, centroids: np.ndarray, last: bool):
    dim, count = low.shape[0], len(centroids)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        near, far = intervals(low, high, centroids)
        sums, n, fetched = np.zeros((count, dim), np.int64), np.zeros(count, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["codes"], np.uint8).reshape(-1, dim)
                old = np.frombuffer(row["cluster"], "<i4") if row["cluster"] else np.full(len(cells), -1)
                maybe = candidates(cells, near, far)
                new, sure = maybe.argmax(1), maybe.sum(1) == 1
                need = np.flatnonzero(~sure | (new != old) | last)
                with fs.open_input_file(f"{path}/{row['file']}") as f:
                    v = fetch(f, row["at"], need, dim)
                fetched += len(need)
                new[need], distance = nearest(v, maybe[need], centroids)
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(new, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])
                    continue
                moved = new[need] != old[need]
                at, v = need[moved], v[moved]
                for sign, k in ((1, new[at]), (-1, old[at])):
                    np.add.at(sums, k[k >= 0], sign * v[k >= 0])
                    n += sign * np.bincount(k[k >= 0], minlength=count)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["at"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["codes"]], pa.binary()),
                                                  pa.array([new.astype("<i4").tobytes()], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int64()))],
                                                 [c.split()[0] for c in STEP_COLS.split(", ")])
        if not last:  # what this task adds to each centroid, and under number -1 how many vectors it fetched
            some = np.flatnonzero(sums.any(1) | (n != 0))
            m = len(some) + 1
            none = lambda t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays([none(pa.string()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.binary()), none(pa.binary()), pa.array([*some, -1], pa.int32()),
                                              pa.array([*n[some], fetched], pa.int64()), pa.array([*sums[some].tolist(), [0] * dim], pa.list_(pa.int64()))], [c.split()[0] for c in STEP_COLS.split(", ")])
    return visit


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, bits: int = 8) -> Clusters | None:
    """Clusters after ``rounds`` rounds of assignment and floored means, and one more assignment; None if no vector takes part."""
    vectors = prepared(df, dim, scale)
    centroids = start_centroids(vectors, k, seed)
    if not len(centroids):
        return None
    low, high = cell_bounds(vectors, bits)
    folder = shared_folder(df.sparkSession, "vectors")
    blocks = approximate(vectors, low, folder)
    sums, n, fetched = np.zeros((len(centroids), dim), object), np.zeros(len(centroids), object), []
    for _ in range(rounds):
        step = keep(blocks.mapInArrow(_visitor(folder, low, high, centroids, False), STEP_COLS))
        parts = step.filter("k IS NOT NULL").select("k", "n", F.posexplode("sums").alias("d", "s")).groupBy("k", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        seen = 0
        for r in parts.collect():  # centroids x dimensions rows
            if r["k"] < 0:
                seen = r["n"]
                continue
            sums[r["k"], r["d"]] += r["s"]
            n[r["k"]] += r["n"] if r["d"] == 0 else 0
        fetched.append(seen)
        centroids = np.array([[int(s) // int(m) for s in row] if m else old for row, m, old in zip(sums, n, centroids.tolist(), strict=True)], np.int64)
        blocks = step.filter("file IS NOT NULL").select("file", "at", "ids", "codes", "cluster")
    rows = keep(blocks.mapInArrow(_visitor(folder, low, high, centroids, True), "vec_id long, cluster int, distance long"))
    return Clusters(rows, centroids, fetched)


def with_inertia(found: Clusters) -> DataFrame:
    """The rows with the inertia of their cluster and of all, and the hash of their centroid."""
    spark = found.rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    table = spark.createDataFrame([(k, sums.get(k, 0), sum(sums.values()), d) for k, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
