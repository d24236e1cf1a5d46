"""Mission streams: identity events, link state, latest fixes, sensor sync, rates and tracking.

Late data: every operator with event time takes a watermark; rows older than it are dropped by
Spark and show up in the query's ``numRowsDroppedByWatermark`` metric.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aerotrace.functions import text
from aerotrace.operators import logs
from aerotrace.operators.runtime import ensure_checkpoint_dir
from aerotrace.operators.telemetry import finite

# Silence that means a lost link, and the six signals a goal needs.
SILENCE_S = 3.0
SIGNALS = ("link", "gps_fix", "local_pose", "transform", "planner", "bridge")


def tail_logs(spark: SparkSession, root: str) -> DataFrame:
    """New log lines of every run folder under ``root``, with mission and run."""
    raw = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts"), F.rtrim("value").alias("line"))
    return logs.parse_lines(with_run(raw))


def with_run(df: DataFrame, path: str = "path") -> DataFrame:
    """State key of a run: its folder and start time. A new run is a new key, which is the reset."""
    d = df.withColumn("run", text.path_part(path, 2))
    return d.withColumn("started_at", text.run_started_at("run"))


def stream_gid_events(log: DataFrame) -> DataFrame:
    """Identity numbers announced as ready; works on streams and tables."""
    return log.withColumn("gid", text.ready_gid("msg")).filter(F.col("gid").isNotNull())


def dedupe_gid(gids: DataFrame, keys: Sequence[str] = ("mission_id", "gid", "updates"), ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Drop resends of the same record version."""
    return gids.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


LINK_SCHEMA = "uav_id bigint, kind string, at timestamp"


def link_watch(samples: DataFrame, silence: float = SILENCE_S, delay: str = "1 second") -> DataFrame:
    """``lost`` when an aircraft is silent too long, ``recovered`` when it is heard again."""
    gap = pd.Timedelta(seconds=silence)

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lost = state.get if state.exists else (None, False)
        last = None if last is None else pd.Timestamp(last)
        out = []
        if state.hasTimedOut:
            if not lost:
                out.append((key[0], "lost", last + gap))
                lost = True
        else:
            for ts in sorted(pd.concat([b["ts"] for b in batches])):
                if last is not None and ts <= last:
                    continue
                if last is not None and ts - last > gap and not lost:
                    out.append((key[0], "lost", last + gap))
                    lost = True
                if lost:
                    out.append((key[0], "recovered", ts))
                    lost = False
                last = ts
        state.update((last.to_pydatetime(), lost))
        if not lost:
            due = int((last + gap).timestamp() * 1000) + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["uav_id", "kind", "at"])

    return (samples.withWatermark("ts", delay).groupBy("uav_id")
            .applyInPandasWithState(watch, LINK_SCHEMA, "last timestamp, lost boolean", "append", GroupStateTimeout.EventTimeTimeout))


def link_events(samples: DataFrame, silence: float = SILENCE_S) -> DataFrame:
    """The same notices over a finished table: one lost and one recovered row per gap."""
    from aerotrace.operators import ordered

    d = samples.withColumn("__s", F.unix_micros("ts"))
    d = ordered.previous(d, ["uav_id"], ["__s"], F.floor(F.col("__s") / 300_000_000), ["ts"], "__last")
    g = d.filter(F.col("__s") - F.unix_micros(F.col("__last")["ts"]) > int(silence * 1e6))
    lost = F.timestamp_micros(F.unix_micros(F.col("__last")["ts"]) + int(silence * 1e6))
    pair = F.array(F.struct(F.lit("lost").alias("kind"), lost.alias("at")), F.struct(F.lit("recovered").alias("kind"), F.col("ts").alias("at")))
    return g.select("uav_id", F.explode(pair).alias("e")).select("uav_id", "e.kind", "e.at")


def stream_latest(samples: DataFrame, key: str = "uav_id", order: str = "ts") -> DataFrame:
    """Newest fix per aircraft (update mode); samples without a position are dropped."""
    rest = [c for c in samples.columns if c != key]
    ok = samples.filter(finite(F.col("latitude")) & finite(F.col("longitude")))
    return ok.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(key, "__r.*")


def stream_sync3(images: DataFrame, gps: DataFrame, imu: DataFrame, slop_ms: int = 100, delay: str = "2 seconds",
                 by: str = "mission_id") -> DataFrame:
    """Image rows with the nearest GPS and IMU sample in reach; the earlier one on a tie.

    Each side has ``ts``; images also have ``frame``. Samples are placed in their own time bucket
    and both neighbours, so an image meets all candidates in its bucket, which a sensor's rate
    keeps short. A bucket is emitted once the watermark has passed it.
    """
    slop_us = slop_ms * 1000

    def side(d, name, shifts):
        us = F.unix_micros("ts")
        d = d.select(by, us.alias("us"), F.struct(*d.columns).alias(name))
        d = d.withColumn("__s", F.explode(F.array(*[F.lit(x * slop_us) for x in shifts])))
        return d.withColumn("at", F.timestamp_micros(F.col("us") + F.col("__s"))).drop("__s")

    u = side(images, "img", [0])
    for d, n in ((gps, "gps"), (imu, "imu")):
        u = u.unionByName(side(d, n, [-1, 0, 1]), allowMissingColumns=True)
    u = u.withWatermark("at", delay).groupBy(by, F.window("at", f"{slop_ms} milliseconds")).agg(F.collect_list(F.struct("us", "img", "gps", "imu")).alias("rows"))
    u = u.withColumn("i", F.explode(F.filter("rows", lambda x: x["img"].isNotNull())))

    def nearest(name):
        near = F.filter("rows", lambda x: x[name].isNotNull() & (F.abs(x["us"] - F.col("i.us")) <= slop_us))
        return F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["us"] - F.col("i.us")).alias("d"), x["us"].alias("us"), x[name].alias("v"))))["v"]

    d = u.select(by, F.col("i.img.frame").alias("frame"), F.col("i.img.ts").alias("ts"), nearest("gps").alias("gps"), nearest("imu").alias("imu"))
    return d.filter(F.col("gps").isNotNull() & F.col("imu").isNotNull())


def readiness(signals: DataFrame, key: str = "uav_id", max_age: float = 2.0) -> DataFrame:
    """Which of the six signals are missing or stale per aircraft (update mode on a stream).

    ``signals`` has ``signal``, ``ok`` and ``ts``; age counts from the newest row of the aircraft.
    """
    now = F.max("ts").alias("now")
    seen = [F.max(F.when((F.col("signal") == s) & F.col("ok"), F.col("ts"))).alias(f"__{s}") for s in SIGNALS]
    g = signals.groupBy(key).agg(now, *seen)
    fresh = lambda s: F.unix_micros("now") - F.unix_micros(f"__{s}") <= int(max_age * 1e6)
    present = F.array_compact(F.array(*[F.when(fresh(s), F.lit(s)) for s in SIGNALS]))
    d = g.withColumn("missing", F.array_except(F.array(*[F.lit(s) for s in SIGNALS]), present))
    return d.select(key, "now", "missing", (F.size("missing") == 0).alias("ready"))


def stream_stats(log: DataFrame, ts: str = "ts", width: str = "5 seconds", delay: str = "10 seconds", by: str = "mission_id") -> DataFrame:
    """Lines and frame rate per mission, level and window."""
    d = log.withColumn("__fps", text.fps_value("msg")).withWatermark(ts, delay)
    g = d.groupBy(F.window(ts, width), by, "level").agg(F.count("*").alias("lines"), F.avg("__fps").alias("fps"))
    return g.select(by, F.col("window.start").alias("start"), "level", "lines", "fps")


def use_rocksdb(spark: SparkSession) -> None:
    """Processors with timers need the RocksDB state store; a store that the session already names is left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_table(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Process everything available into files in the shared checkpoint folder and read them back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replay(df: DataFrame, part: Column, parts: int, build, name: str = "replay", publish=None) -> DataFrame | None:
    """What a stream emits when the table arrives in ``parts`` pieces, the query being stopped and started again before each.

    ``part`` numbers the piece of each row from 0; ``build`` makes the stream from its source. All runs share one checkpoint. ``publish`` takes
    the batches in place of the file sink.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for k in range(parts):
        df.filter(part == k).write.mode("append").parquet(f"{base}/in")
        stream = build(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        (out.foreachBatch(publish).start() if publish else out.format("parquet").start(f"{base}/out")).awaitTermination()
    return None if publish else spark.read.schema(stream.schema).parquet(f"{base}/out")
