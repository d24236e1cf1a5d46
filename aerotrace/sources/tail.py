"""Streaming source that follows log files as they grow, shrink and start over.

Spark's own file source reads a file once. This one keeps, for each file, how far it was read and a fingerprint of its first bytes; each trigger reads what was
added, up to the last whole line. A file that became shorter, or begins differently, was opened anew and is read from its start. ``streaming.runs.watch_runs`` turns
that into a new epoch of the run. One file is one input partition of a trigger.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD, CHUNK = 256, 1 << 20
SCHEMA = "path string, at long, line string"


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        import re

        self.fs, self.root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", options["path"]))
        self.suffix = options.get("suffix", ".log")

    def __getstate__(self):
        return self.__dict__

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Per file: the end of its last whole line, and the length and checksum of its first bytes."""
        out = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True)):
            if info.is_file and info.path.endswith(self.suffix):
                with self.fs.open_input_file(info.path) as f:
                    size = f.size()
                    head = f.read_at(min(HEAD, size), 0)
                    end = self._line_end(f, size)
                out[info.path] = [end, len(head), zlib.crc32(head)]
        return out

    @staticmethod
    def _line_end(f, size: int) -> int:
        at = size
        while at > 0:
            start = max(0, at - CHUNK)
            k = f.read_at(at - start, start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
        return 0

    def _same(self, path: str, length: int, crc: int) -> bool:
        with self.fs.open_input_file(path) as f:
            return zlib.crc32(f.read_at(length, 0)) == crc

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (to, length, crc) in sorted(end.items()):
            was, n, old = start.get(path, [0, 0, 0])
            anew = to < was or length < n or (n == length and old != crc) or (n < length and n > 0 and not self._same(path, n, old))
            begin = 0 if anew else was
            if to > begin:
                out.append(Piece(path, begin, to))
        return out

    def read(self, partition: Piece) -> Iterator[tuple[str, int, str]]:
        with self.fs.open_input_stream(partition.path) as f:
            f.read(partition.start) if partition.start < CHUNK else self._skip(f, partition.start)
            at, rest = partition.start, b""
            while at + len(rest) < partition.end:
                got = f.read(min(CHUNK, partition.end - at - len(rest)))
                if not got:  # it shrank meanwhile; the next trigger begins it anew
                    return
                *lines, rest = (rest + got).split(b"\n")
                for line in lines:
                    yield partition.path, at, line.decode("utf-8", "replace").rstrip("\r")
                    at += len(line) + 1

    @staticmethod
    def _skip(f, n: int) -> None:
        while n > 0:
            n -= len(f.read(min(CHUNK, n)))

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``path`` (a folder) and ``suffix`` are the options; rows are (path, at, line), ``at`` being the byte at which the line begins."""

    @classmethod
    def name(cls) -> str:
        return "mission_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_files(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """Stream of the lines of all files under ``folder``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's Python process may not see this package
    spark.dataSource.register(TailSource)
    return spark.readStream.format("mission_tail").option("suffix", suffix).load(folder)
