"""Token ids in binary files with a shared compression dictionary.

``write`` puts the ids of each document, as one zstandard frame of its own, into shard files in
ascending order of doc_id. A shard is: ``MAGIC``, the frames, an index of one entry a document
(doc_id, whether it is NULL, byte offset, byte length, number of ids), the SHA-256 of the dictionary,
the place of the index, the number of documents, ``MAGIC``. The dictionary lies beside the shards
under its hash. ``read_document`` fetches one document by index, with two short reads.

Edge cases: a NULL or empty text is a document that holds the end id alone; a NULL doc_id comes
first; repeated doc_ids are all kept, ordered by text; an empty table gives no shard and no row;
other columns are ignored; a long text is one frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerotrace.llm.common import open_fs, shared_folder, slices, texts_of
from aerotrace.llm.encoding import encoder
from aerotrace.operators.runtime import cut

MAGIC = b"TOKIDS1\n"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n", "<u8")])
FOOT = struct.Struct("<32sQQ8s")
SHARD_BYTES = 64 << 20
LEVEL = 1


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = 1, sample_docs: int = 1000, doc_bytes: int = 16 << 10,
                     dict_bytes: int = 32 << 10) -> bytes:
    """A zstandard dictionary of serialised ids, trained in one task.

    It is fitted on the ``sample_docs`` rows of smallest hash, ``doc_bytes`` of ids of each at most; what is
    written with it does not depend on the sample, only how small it gets. Only hashes are sorted and only those bytes meet in the
    task. Too few samples give their bytes themselves, no text at all gives an empty dictionary.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text")
    picked = keyed.select("k").orderBy("k").limit(sample_docs).distinct()

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            out = []
            for text in texts_of(batch.column("text")):
                ids = np.append(enc.ids(text), end_id).astype("<u4").tobytes()
                middle = max(0, len(ids) // 2 - doc_bytes // 2) // 4 * 4
                out.append(ids[middle:middle + doc_bytes])
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], ["k", "ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted(b for batch in batches for b in batch.column("ids").to_pylist())
        try:
            data = zstandard.train_dictionary(dict_bytes, parts).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few or too short samples
            data = b"".join(parts)[:dict_bytes]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

    pick = keyed.join(F.broadcast(picked), "k").mapInArrow(ids_of, "k long, ids binary").dropDuplicates(["k"])  # at most ``sample_docs`` rows
    row = pick.coalesce(1).mapInArrow(train, "data binary").first()
    return bytes(row["data"]) if row else b""


class _Shard:
    """One file in the making; it gets its final name when it is whole."""

    def __init__(self, folder: str, name: str, attempt: int, digest: bytes):
        self.fs, self.folder = open_fs(folder)
        self.final, self.temp, self.digest = f"{self.folder}/{name}", f"{self.folder}/.{name}.{attempt}", digest
        self.out, self.at, self.entries, self.ids = self.fs.open_output_stream(self.temp, compression=None), len(MAGIC), [], 0
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is None, self.at, len(frame), n))
        self.at, self.ids = self.at + len(frame), self.ids + n

    def close(self) -> None:
        self.out.write(np.array(self.entries, INDEX).tobytes())
        self.out.write(FOOT.pack(self.digest, self.at, len(self.entries), MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.final)


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents' ids; returns one row a shard: folder, file, part, seq, n_docs, n_ids, start.

    ``start`` counts the ids of all shards before. A task that runs again writes the same bytes under the same name.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-ids")
    data = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(data).digest()
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{digest.hex()}.dict", compression=None) as out:
        out.write(data)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(tokenizer), TaskContext.get()
        zs, part, attempt, seq, shard, rows = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data)), ctx.partitionId(), ctx.taskAttemptId(), 0, None, []

        def done():
            shard.close()
            rows.append((folder, shard.final.rsplit("/", 1)[1], part, seq, len(shard.entries), shard.ids))

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                    shard = shard or _Shard(folder, f"part-{part:06d}-{seq:05d}.ids", attempt, digest)
                    ids = np.append(enc.ids(text), enc.dtype.type(end_id)).astype("<u4")
                    shard.add(doc_id, zs.compress(ids.tobytes()), len(ids))
                    if shard.at >= shard_bytes:
                        done()
                        shard, seq = None, seq + 1
        if shard:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6,
                                          (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                         ["folder", "file", "part", "seq", "n_docs", "n_ids"])

    tie = F.xxhash64("text")
    laid = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    made = cut(laid.mapInArrow(shards, "folder string, file string, part int, seq int, n_docs long, n_ids long"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _open(fs, path: str) -> tuple[object, np.ndarray, bytes]:
    """The file, its index and the hash of its dictionary."""
    f = fs.open_input_file(path)
    size = f.size()
    digest, at, n, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
    if magic != MAGIC:
        raise ValueError(f"not a token file: {path}")
    return f, np.frombuffer(f.read_at(n * INDEX.itemsize, at), INDEX), digest


def _decompressor(fs, folder: str, digest: bytes) -> zstandard.ZstdDecompressor:
    with fs.open_input_file(f"{folder}/{digest.hex()}.dict") as f:
        data = f.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary does not have the hash that the shard names")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data))


def read_document(folder: str, file: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a shard (the first, if its id is repeated); None if the shard has none."""
    fs, path = open_fs(folder)
    f, index, digest = _open(fs, f"{path}/{file}")
    at = np.flatnonzero((index["doc_id"] == doc_id) & (index["null"] == 0))
    if not len(at):
        return None
    e = index[at[0]]
    return np.frombuffer(_decompressor(fs, path, digest).decompress(f.read_at(int(e["size"]), int(e["offset"]))), "<u4")


def read(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, file."""
    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["folder"])
                f, index, digest = _open(fs, f"{path}/{row['file']}")
                zd, crc, begin = _decompressor(fs, path, digest), [], len(MAGIC)
                ends = (index["offset"] + index["size"]).tolist()
                for lo in range(0, len(index), 4096):
                    part = index[lo:lo + 4096]
                    block = f.read_at(ends[lo + len(part) - 1] - begin, begin)
                    for o, s in zip(part["offset"].tolist(), part["size"].tolist(), strict=True):
                        crc.append(zlib.crc32(zd.decompress(block[o - begin:o - begin + s])))
                    begin = ends[lo + len(part) - 1]
                n = index["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["doc_id"].astype(np.int64), mask=index["null"] == 1), pa.array(row["start"] + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
                     pa.array([row["file"]] * len(n), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    return shards.repartition("file").mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
