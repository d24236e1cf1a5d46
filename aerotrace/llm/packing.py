"""Packing of token ids into sequences of a fixed length.

Documents are dealt to tasks by a hash and form, in the order of that hash, groups of at most
``GROUP_DOCS`` documents or ``GROUP_IDS`` ids: random groups that are the same whenever a task runs
again. Each group is packed on its own. Full stretches of a long document become sequences by
themselves; what remains of every document is placed first-fit decreasing, where a tournament tree
over the free space of the bins finds the first bin that has room. Then the emptiest bins are cut up
to fill the room left in the others, and the one bin that stays open is laid out in sequences
whose lengths are powers of two, which take no padding.

Edge cases: a NULL or empty text is a document of one id, the end id; repeated rows are packed once
each; an empty table gives no piece; other columns are left out. Copies of one row share a hash. Where one hash
stands for more than ``HOT_SHARE`` of all rows, its rows are counted before they are shuffled, and the counts are dealt in portions
of at most ``GROUP_DOCS`` copies, so that no task receives them all. There are at most ``1 / HOT_SHARE`` such hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import keep, slices, texts_of
from aerotrace.llm.encoding import encoder

LENGTH = 2048
GROUP_DOCS = 4096
GROUP_IDS = 8 << 20
HOT_SHARE = 1e-4

Piece = tuple[int, int, int]  # document within the group, first id, ids


class FirstFit:
    """Bins of one capacity under a tournament tree: each node holds the most room of the bins below it."""

    def __init__(self, capacity: int, items: int):
        self.capacity, self.leaves = capacity, 1 << max(0, (max(1, items) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken from it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        bin_, at = at - self.leaves, at >> 1
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            most = left if left >= right else right
            if room[at] == most:
                break
            room[at] = most
            at >>= 1
        return bin_

    def free(self, bin_: int) -> int:
        return self.room[self.leaves + bin_]


def first_fit_decreasing(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """Bins of pieces, none longer than ``length``; longer pieces first, ties in the given order."""
    tree, bins = FirstFit(length, len(pieces)), []
    for p in sorted(pieces, key=lambda p: -p[2]):
        b = tree.place(p[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(p)
    return bins


def fill_up(bins: list[list[Piece]], length: int) -> list[list[Piece]]:
    """The same ids in bins that are all full but one at most: the emptiest are cut to fill the rest."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        b, donor = order[lo], order[hi]
        if used[b] == length:
            lo += 1
        elif not bins[donor]:
            hi -= 1
        else:
            doc, start, n = bins[donor].pop()
            take = min(n, length - used[b])
            bins[b].append((doc, start, take))
            if take < n:
                bins[donor].append((doc, start + take, n - take))
            used[b], used[donor] = used[b] + take, used[donor] - take
    return [bins[b] for b in order if bins[b]]


def power_lengths(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into sequences whose lengths are the powers of two that make up their sum, largest first."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        seq: list[Piece] = []
        while room:
            doc, start, n = queue.pop()
            take = min(n, room)
            seq.append((doc, start, take))
            if take < n:
                queue.append((doc, start + take, n - take))
            room -= take
        out.append(seq)
    return out


def pack_group(sizes: list[int], length: int = LENGTH) -> list[list[Piece]]:
    """Sequences for a group of documents of these numbers of ids; each id lies in exactly one piece."""
    full, rest = [], []
    for d, n in enumerate(sizes):
        whole = n // length * length
        full += [[(d, s, length)] for s in range(0, whole, length)]
        if n > whole:
            rest.append((d, whole, n - whole))
    bins = fill_up(first_fit_decreasing(rest, length), length)
    if bins and sum(p[2] for p in bins[-1]) < length:
        bins[-1:] = power_lengths(bins[-1])
    return full + bins


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _emit(group: list[tuple[int | None, np.ndarray]], first: int, length: int) -> tuple[pa.RecordBatch, int]:
    rows, seqs = [], pack_group([len(ids) for _, ids in group], length)
    for s, seq in enumerate(seqs):
        offset = 0
        for d, start, n in seq:
            doc_id, ids = group[d]
            rows.append((doc_id, start, n, zlib.crc32(ids[start:start + n].astype("<u4").tobytes()), len(ids), first + s, offset))
            offset += n
    cols = zip(*rows) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES), first + len(seqs)


def dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, copies) in the tasks and in the order in which they are packed."""
    rows = docs.select("doc_id", "text").withColumn("k", F.xxhash64("doc_id", "text"))
    counts = keep(rows.groupBy("k").count().filter(F.col("count") > GROUP_DOCS))
    total = docs.count() if not counts.isEmpty() else 0
    hot = [r["k"] for r in counts.filter(F.col("count") > HOT_SHARE * total).collect()]
    deal = rows.withColumns({"copies": F.lit(1), "deal": F.col("k")})
    if hot:
        portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP_DOCS))).alias("part")
        many = rows.filter(F.col("k").isin(hot)).groupBy("k", "doc_id", "text").agg(F.count("*").alias("n")).select("*", portion)
        many = many.select("doc_id", "text", "k", F.least(F.lit(GROUP_DOCS), F.col("n") - F.col("part") * GROUP_DOCS).cast("int").alias("copies"), F.xxhash64("k", "part").alias("deal"))
        deal = deal.filter(~F.col("k").isin(hot)).unionByName(many)
    return deal.repartition("deal").sortWithinPartitions("deal", "doc_id", "copies").select("doc_id", "text", "copies")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """One row a piece. ``sequence_id`` is unique over all tasks; ``offset`` counts from 0 without gaps in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, group, held, seq = encoder(tokenizer), [], 0, TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text, copies in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("copies").to_pylist(), strict=True):
                    ids = np.append(enc.ids(text), enc.dtype.type(end_id))
                    for _ in range(copies):
                        group.append((doc_id, ids))
                        held += len(ids)
                        if len(group) >= GROUP_DOCS or held >= GROUP_IDS:
                            out, seq = _emit(group, seq, length)
                            group, held = [], 0
                            yield out
        yield _emit(group, seq, length)[0]

    return dealt(docs).mapInArrow(run, SCHEMA)
