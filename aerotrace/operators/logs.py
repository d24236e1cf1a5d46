"""Mission logs: parsing, search, notices, counters and the frame clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.functions import text
from aerotrace.operators import ordered

# Sizes of the log rings and of the notice feed.
RELAY_LINES, CONSOLE_LINES, RENDER_LINES, MAX_NOTICES = 2000, 5000, 1200, 200
LINES_PER_SEGMENT = 4096


def line_segment(order: str = "line_no") -> Column:
    return F.floor(F.col(order) / LINES_PER_SEGMENT)


def parse_lines(df: DataFrame, col: str = "line") -> DataFrame:
    """Level and message of each line; RAW for other lines; blank lines are skipped."""
    d = df.filter(F.trim(F.col(col)) != "")
    return d.withColumns({"level": text.log_level(col), "msg": text.log_message(col)}).drop(col)


def drop_level(log: DataFrame, level: str = "FRAME") -> DataFrame:
    return log.filter(F.col("level") != level)


def search_log(log: DataFrame, muted: Sequence[str] = ("FRAME",), q: str = "") -> DataFrame:
    """Lines of levels that are not muted and that contain ``q`` in any case."""
    d = log.filter(~F.col("level").isin(*muted)) if muted else log
    q = q.strip().lower()
    return d.filter(F.lower("msg").contains(q)) if q else d


def log_notices(log: DataFrame) -> DataFrame:
    """Lines an operator must see: bookends of the mission and faults. Other lines are dropped."""
    msg, level = F.trim(F.col("msg")), F.upper("level")
    # Wording of bookends and fault words.
    bookends = [("(?i)MISSION COMPLETE", "Search complete"), ("(?i)REPLAY COMPLETE", "Replay finished"),
                ("(?i)SEARCH & RESCUE PIPELINE", "Search started"), ("(?i)Video source:", "Camera feed connected"),
                ("(?i)Telemetry source:", "Telemetry connected")]
    fault = "(?i)(lost|fail|timeout|disconnect|no gps|unable|cannot)"
    rule = msg.rlike("^=+$")
    kind, body = F.when(rule, None), F.when(rule, None)
    for pattern, words in bookends:
        kind, body = kind.when(msg.rlike(pattern), "mission"), body.when(msg.rlike(pattern), words)
    bad = (level == "ERROR") | ((level == "WARN") & msg.rlike(fault))
    return (log.withColumns({"kind": kind.when(bad, "problem"), "text": body.when(bad, msg)})
            .filter(F.col("kind").isNotNull()))


def tail_n(log: DataFrame, n: int = RELAY_LINES, by: Sequence[str] = ("mission_id",), order: str = "line_no") -> DataFrame:
    """Newest ``n`` lines per mission."""
    return ordered.last_n(log, by, [order], line_segment(order), n)


def feed(notices: DataFrame, n: int = MAX_NOTICES, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Newest notices first, at most ``n``."""
    return notices.orderBy(*[F.col(o).desc() for o in order]).limit(n)


def frame_clock(log: DataFrame, start: int = 0, by: Sequence[str] = ("mission_id",), order: str = "line_no") -> DataFrame:
    """Video frame at each line: start frame plus FRAME lines so far, NULL before the first."""
    hit = F.when((F.col("level") == "FRAME") & F.col("msg").startswith("FPS="), 1).otherwise(0)
    d = ordered.running_sum(log, by, [order], line_segment(order), hit, "__n")
    return d.withColumn("frame", F.when(F.col("__n") > 0, F.col("__n") + start)).drop("__n")


def log_stats(log: DataFrame, by: Sequence[str] = ("mission_id",), order: str = "line_no") -> DataFrame:
    """Lines, frames, distinct identities and last/lowest/highest frame rate per mission."""
    d = log.withColumn("__fps", text.fps_value("msg")).withColumn("__gid", text.ready_gid("msg"))
    return d.groupBy(*by).agg(
        F.count("*").alias("log_lines"), F.count("__fps").alias("frames"), F.count_distinct("__gid").alias("gids"),
        F.max_by("__fps", F.when(F.col("__fps").isNotNull(), F.col(order))).alias("fps_last"),
        F.min("__fps").alias("fps_min"), F.max("__fps").alias("fps_max"))


def level_counts(log: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Lines per level, one row each, so that unexpected levels cannot grow a map without limit."""
    return log.groupBy(*by, "level").agg(F.count("*").alias("lines"))


def mission_summary(frames: DataFrame, detections: DataFrame, gid_events: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Counters of a finished mission.

    ``frames`` has ``fps`` per processed frame, ``detections`` has ``reject_reason`` (NULL when
    kept), ``gid_events`` has ``event`` new or merge and ``gid``.
    """
    by = list(by)
    f = frames.groupBy(*by).agg(F.count("*").alias("frames"), F.avg("fps").alias("fps_avg"), F.min("fps").alias("fps_min"),
                                F.max("fps").alias("fps_max"))
    reason = F.col("reject_reason")
    d = detections.groupBy(*by).agg(
        F.count("*").alias("detections_raw"), F.count_if(reason.isNull()).alias("detections_final"),
        F.count_if(reason == "fov").alias("fov_rejects"), F.count_if(reason == "blur").alias("blur_rejects"),
        F.count_if(reason.isin("dark", "flat")).alias("shadow_rejects"), F.count_if(reason == "invalid").alias("invalid_rejects"))
    g = gid_events.groupBy(*by).agg(F.count_if(F.col("event") == "new").alias("gids_created"),
                                    F.count_if(F.col("event") == "merge").alias("gallery_merges"))
    return f.join(d, by, "full").join(g, by, "full")


def track_counters(track_events: DataFrame, located: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Tracks created, updated and deleted, by the ``kind`` of the tracker's events, and detections without a position."""
    by = list(by)
    kind = F.col("kind")
    t = track_events.groupBy(*by).agg(F.count_if(kind == "new").alias("tracks_created"), F.count_if(kind == "append").alias("tracks_updated"), F.count_if(kind == "delete").alias("tracks_deleted"))
    return t.join(located.groupBy(*by).agg(F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("gps_failures")), by, "full")


def run_stats(progress: DataFrame, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Frame rate over the run and latency in milliseconds from rows of (frame, t0, t1)."""
    ms = (F.col("t1") - F.col("t0")) * 1000
    span = F.max("t1") - F.min("t0")
    return progress.groupBy(*by).agg(
        F.count("*").alias("frames"), F.when(span > 0, F.count("*") / span).alias("fps"),
        F.avg(ms).alias("latency_avg_ms"), F.max(ms).alias("latency_max_ms"), F.max_by(ms, F.col("frame")).alias("latency_last_ms"))
