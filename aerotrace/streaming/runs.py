"""Runs followed from their logs: epochs, announcements, and records published once each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerotrace.functions import text
from aerotrace.operators import identities
from aerotrace.streaming.streams import use_rocksdb

WATCHED = "epoch bigint, line_no bigint, at bigint, level string, msg string, gid bigint, seen bigint"


class RunWatch(StatefulProcessor):
    """Numbers the lines of a run and the announcements of each identity; a line that begins before the last one read starts a new epoch, which starts all counts anew."""

    def __init__(self, key_name: str):
        self.key_name = key_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "epoch bigint, at bigint, lines bigint")
        self.seen = handle.getMapState("seen", "gid bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, last, lines = self.place.get() if self.place.exists() else (0, -1, 0)
        new = pd.concat(list(rows)).sort_values("at")
        if new["at"].iloc[0] <= last:
            epoch, lines = epoch + 1, 0
            self.seen.clear()
        out = []
        for r in new.itertuples(index=False):
            lines, n, gid = lines + 1, None, None if pd.isna(r.gid) else int(r.gid)
            if gid is not None:
                n = (self.seen.getValue((gid,))[0] if self.seen.containsKey((gid,)) else 0) + 1
                self.seen.updateValue((gid,), (n,))
            out.append((key[0], epoch, lines, int(r.at), r.level, r.msg, gid, n))
        self.place.update((epoch, int(new["at"].iloc[-1]), lines))
        frame = pd.DataFrame(out, columns=[self.key_name, *[c.split()[0] for c in WATCHED.split(", ")]])
        yield frame.astype({"gid": "Int64", "seen": "Int64"})

    def close(self) -> None:
        pass


def watch_runs(log: DataFrame, key: str = "path") -> DataFrame:
    """Parsed lines (``key``, at, level, msg) with epoch, number in the epoch, announced identity and how often it was announced in the epoch.

    The lines that a trigger brings of one run are put in order in its task.
    """
    use_rocksdb(log.sparkSession)
    d = log.select(key, "at", "level", "msg", text.ready_gid("msg").alias("gid"))
    return d.groupBy(key).transformWithStateInPandas(RunWatch(key), f"{key} {dict(log.dtypes)[key]}, {WATCHED}", "append", "None")


def records(announced: DataFrame, buffers: DataFrame, keys: Sequence[str] = ("mission_id", "gid")) -> DataFrame:
    """The record of each announced identity as it stood at that announcement: the k-th one tells of its first k buffers, or of all there are."""
    keys = list(keys)
    known = buffers.join(announced.select(*keys).distinct(), keys, "left_semi")
    total = known.groupBy(*keys).agg(F.count("*").alias("__all"))
    due = announced.join(total, keys).withColumn("updates", F.least("seen", "__all")).drop("__all")
    return due.join(identities.gid_summary_asof(known, keys=keys), [*keys, "updates"])


def publisher(buffers: DataFrame, folder: str, keys: Sequence[str] = ("mission_id", "gid")):
    """For ``foreachBatch``: writes the records of a batch's announcements under the batch's number.

    A batch that runs again after a failure overwrites what it wrote, so each announcement is published once.
    """
    def publish(batch: DataFrame, number: int) -> None:
        told = batch.filter("gid IS NOT NULL").persist()
        records(told, buffers, keys).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        told.unpersist()
    return publish
