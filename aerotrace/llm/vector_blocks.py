"""Vectors in blocks, and tiles of a query block against a candidate block.

A query set is compared with all rows tile by tile: candidates are dealt to blocks of about
``CANDIDATES`` rows and queries to blocks of about ``QUERIES`` rows by a hash of their id, and each tile is one row of an
equi-join on the numbers of its two blocks. A block is cut when it grows beyond its size, so no row
holds more, however often an id is repeated. A repeated id stands for one vector, the smallest in the order of arrays; rows with a NULL id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 1 << 14
QUERIES = 1 << 11

PACKED = "block int, dim int, n int, ids binary, data binary"


def finite(vec: str = "embedding") -> Column:
    """True for vectors without NULL, NaN or infinite components; an empty or NULL vector is not one."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def non_zero(vec: str = "embedding") -> Column:
    return F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))


def pack(rows: DataFrame, key: str, vec: str, per_block: int) -> tuple[DataFrame, int]:
    """Blocks of vectors as doubles, and the number of block numbers that are in use."""
    n = max(1, -(-rows.count() // per_block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, data, out = None, [], [], []

        def close():
            if ids:
                out.append((*at, len(ids), np.array(ids, "<i8").tobytes(), np.concatenate(data).astype("<f8").tobytes()))
                ids.clear()
                data.clear()

        last = None
        for batch in batches:
            v = batch.column("v")
            flat, offsets = np.asarray(v.flatten()), np.asarray(v.offsets) - v.offsets[0].as_py()
            for i, (b, d, k) in enumerate(zip(batch.column("block").to_pylist(), batch.column("dim").to_pylist(), batch.column("k").to_pylist(), strict=True)):
                if (d, k) == last:
                    continue
                last = (d, k)
                if at != (b, d) or len(ids) >= per_block:
                    close()
                    at = (b, d)
                ids.append(k)
                data.append(flat[offsets[i]:offsets[i + 1]])
            while len(out) > 1:
                yield _rows([out.pop(0)])
        close()
        for row in out:
            yield _rows([row])

    dealt = (rows.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).dropna()
             .withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
             .repartition("block").sortWithinPartitions("block", "dim", "k", "v"))
    return dealt.mapInArrow(run, PACKED), n


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                      ["block", "dim", "n", "ids", "data"])


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def search(candidates: DataFrame, queries: DataFrame, key: str, vec: str, k: int, within: Search, score_type: str, best_first: str,
           per_block: int = CANDIDATES, per_query_block: int = QUERIES) -> DataFrame:
    """Each query's ``k`` best of all candidates: query_id, rank, vec_id, score.

    ``within(query_ids, query_vectors, ids, vectors)`` yields (query ids, candidate ids, scores), each query's best of one tile, its own id left out.
    ``best_first`` is "desc" or "asc"; ties go to the smaller id.
    """
    c, n_c = pack(candidates, key, vec, per_block)
    q, n_q = pack(queries, key, vec, per_query_block)
    c = c.select("dim", F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    q = q.select("dim", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    score = pa.int64() if score_type == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                for qi, ci, s in within(q_ids, np.frombuffer(row["q_data"], "<f8").reshape(-1, d), ids, np.frombuffer(row["c_data"], "<f8").reshape(-1, d)):
                    yield pa.RecordBatch.from_arrays([pa.array(qi, pa.int64()), pa.array(ci, pa.int64()), pa.array(s, score)], ["query_id", "vec_id", "score"])

    tiles = c.join(q, ["dim", "c", "q"]).select("dim", "q_ids", "q_data", "c_ids", "c_data").repartition(F.xxhash64("q_ids", "c_ids"))
    found = tiles.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = F.col("score").desc() if best_first == "desc" else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.col("vec_id").asc()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
