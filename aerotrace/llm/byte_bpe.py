"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut where a character that is no white space stands before white space. No match of
the split pattern reaches over such a place and none looks behind it, so the pieces' ids in a row
are the ids of the whole text. A single match of more than ``LONG`` bytes is merged here with a
heap, in the order of the ranks, in near-linear time.

Edge cases: a NULL text counts as empty and has no ids; strings of special tokens are ordinary
text; repeated rows are each encoded; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from aerotrace.llm.common import slices, texts_of

SEGMENT = 1 << 16
LONG = 4096
BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def segments(self, text: str) -> Iterator[str]:
        """The text in runs of about SEGMENT characters, cut at safe places only."""
        at = 0
        while len(text) - at > SEGMENT:
            m = BOUNDARY.search(text, at + SEGMENT)
            if not m:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    @staticmethod
    def has_long_match(part: str) -> bool:
        """Whether one match could hold more than LONG bytes: a long run without white space, or of white space."""
        words = part.split()
        return max(map(len, words), default=0) * 4 > LONG or len(part) - sum(map(len, words)) - len(words) > LONG // 4

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or nxt[i] != j or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = 0, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                r = ranks.get(piece[i:end[nxt[i]]])
                if r is not None:
                    heapq.heappush(heap, (r, i, nxt[i], end[nxt[i]]))
            if prev[i] >= 0:
                p = prev[i]
                r = ranks.get(piece[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.segments(text) if len(text) > SEGMENT else (text,):
            if len(part) > LONG // 4 and self.has_long_match(part):
                for m in self.pattern.finditer(part):
                    piece = m.group().encode()
                    out.extend(self.merge(piece) if len(piece) > LONG else self.encoding.encode_ordinary(m.group()))
            else:
                out.extend(self.encoding.encode_ordinary(part))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process, kept from task to task."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each whole text, as little-endian unsigned 32-bit integers: ``ids`` binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [np.array(bpe.encode(t), "<u4").tobytes() for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with the raw bytes that the ids stand for: ``bytes`` binary. NULL ids give NULL."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in slices(whole, "ids"):
                back = [None if b is None else bpe.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, "bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, a, b = [], [], []
                for text in texts_of(batch.column("text")):
                    ids = bpe.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
