"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.operators.runtime import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """Fold 0..2 of a document; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents no label is learned from; false for a NULL id."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder beside the checkpoints, which driver and executors all see."""
    base = re.sub(r"^file:/+", "file:///", ensure_checkpoint_dir(spark))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read again: cuts lineage, and no executor can take them away.

    Unlike a checkpoint, the new frame carries over no constraints of the old plan, which multiply in loops.
    """
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_hold(hashes: DataFrame, bits: int = 1 << 25) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: true for every one in ``hashes`` (column ``h``), and for few others unless they are many next to ``bits``.

    A Bloom filter with two bits a hash. It has ``bits`` bits whatever the size of the table, and goes to driver and workers.
    """
    spark, n = hashes.sparkSession, F.lit(bits)
    places = hashes.select(F.explode(F.array(F.pmod("h", n), F.pmod(F.xxhash64("h"), n))).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    if words.num_rows:
        table[np.asarray(words["w"].combine_chunks(), np.int64)] = np.asarray(words["b"].combine_chunks(), np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(p: pd.Series, q: pd.Series) -> pd.Series:
        held = lambda x: (shared.value[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series((held(p.to_numpy(np.int64)) & held(q.to_numpy(np.int64))).astype(bool))

    return lambda h: test(F.pmod(h, n).cast("bigint"), F.pmod(F.xxhash64(h), n).cast("bigint"))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes of a string or binary array, and where each row starts and ends; NULL counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        zero = np.zeros(n, np.int64)
        return np.zeros(0, np.uint8), zero, zero
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    o = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o[:-1] - o[0], o[1:] - o[0]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """The batch in runs of rows whose texts hold about ``most`` bytes; one long text is a run of its own."""
    _, start, end = bytes_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, start[at] + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
