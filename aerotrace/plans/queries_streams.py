"""Registered queries: flagship, stream forms over the event table, and the scorer hook."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerotrace.operators import hooks, logs
from aerotrace.operators.runtime import ensure_checkpoint_dir
from aerotrace.plans.flagship import casualty_positions, sightings
from aerotrace.plans.queries_detections import _proj
from aerotrace.plans.queries_identity import LOG
from aerotrace.plans.queries_tracks import STAY_BUFFERS, STAY_IDENTITIES, STAY_LEAST, STAY_TRACKS
from aerotrace.plans.registry import query, r, rs
from aerotrace.streaming import online, runs
from aerotrace.streaming import streams as st


@query("sightings", f"""WITH fx AS (SELECT * FROM telemetry WHERE lat IS NOT NULL AND NOT (lat = 0 AND lon = 0)), dd AS (SELECT *, frame * CAST(0.01 AS DOUBLE) AS ft FROM detections),
 p AS (SELECT d.*, a.t AS pt, b.t AS nt FROM dd d ASOF LEFT JOIN fx a ON d.mission_id = a.mission_id AND d.ft >= a.t ASOF LEFT JOIN fx b ON d.mission_id = b.mission_id AND d.ft <= b.t),
 k AS (SELECT *, CASE WHEN pt IS NULL OR (nt IS NOT NULL AND ft - pt > nt - ft) THEN nt ELSE pt END AS mt FROM p),
 j AS (SELECT k.mission_id, k.frame, k.det_id, k.x1, k.y1, k.x2, k.y2, x.lat, x.lon, x.alt, x.roll, x.pitch, x.yaw, x.zoom FROM k LEFT JOIN fx x ON x.mission_id = k.mission_id AND x.t = k.mt),
 {_proj('x1+0.5*(x2-x1)', 'y1+0.5*(y2-y1)', 'TRUE')} SELECT mission_id, frame, det_id, {rs('olat',7)} AS lat, {rs('olon',7)} AS lon FROM located""", "detections telemetry")
def _(t):
    return sightings(t).select("mission_id", "frame", "det_id", r("obj_lat", 7).alias("lat"), r("obj_lon", 7).alias("lon"))


@query("casualty_positions")
def _(t):
    return casualty_positions(t)


def event_stream(t):
    schema = t("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.withColumn("ts", F.to_timestamp(F.col("ts").cast("string")))


def log_stream(t):
    e = event_stream(t)
    line = (F.when(F.col("event_type") == "view", F.format_string("[FRAME  ] FPS=%d.5", F.col("event_id") % 30))
            .when(F.col("event_type") == "signup", F.format_string("[OK     ] GID=%d Folder ready -> /x", F.col("user_id") % 20)).otherwise("[INFO   ] x"))
    return logs.parse_lines(e.select(F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("mission_id"), F.col("event_id").alias("line_no"), "ts", line.alias("line")))


@query("stream_gid_events", f"WITH {LOG} SELECT mission_id, line_no, CAST(regexp_extract(msg, 'GID=(\\d+)\\s+Folder ready', 1) AS BIGINT) AS gid FROM lg WHERE regexp_matches(msg, 'GID=(\\d+)\\s+Folder ready')", "mission_log")
def _(t):
    return st.run_to_table(st.stream_gid_events(log_stream(t)).select("mission_id", "line_no", "gid"), "gid")


@query("dedupe_gid", "SELECT DISTINCT user_id % 6 AS mission_id, user_id % 20 AS gid, event_id // 500 AS updates FROM events")
def _(t):
    e = event_stream(t).select((F.col("user_id") % 6).alias("mission_id"), (F.col("user_id") % 20).alias("gid"), F.floor(F.col("event_id") / 500).alias("updates"), "ts")
    return st.run_to_table(st.dedupe_gid(e, delay="1 hour"), "dedupe").drop("ts")


DELAY_S = 30  # how late a row of a replayed mission may be


def in_pieces(t, build, name):
    """The stays as a stream in three pieces: of each frame near the end of a piece the odd places come with the next one."""
    d = t("stays").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_700_000_000))
    last = t("stays").agg(F.max("frame")).first()[0] or 0
    part = F.floor((F.col("frame") + F.col("place") % 2 * 20) * 3 / (last + 21))
    return st.replay(d, part, 3, build, name)


CLOSED = f"d AS (SELECT * FROM stays WHERE frame <= (SELECT max(frame) FROM stays) - {DELAY_S})"


@query("stream_tracks", f"WITH {CLOSED}, {STAY_TRACKS}", "stays")
def _(t):
    d = in_pieces(t, lambda s: online.stream_tracks(s, delay=f"{DELAY_S} seconds"), "tracks")
    return d.select("mission_id", "frame", "det_id", "birth_frame", "birth_det")


@query("stream_identities", f"WITH RECURSIVE {CLOSED}, {STAY_BUFFERS}, {STAY_IDENTITIES}", "stays")
def _(t):
    d = in_pieces(t, lambda s: online.stream_identities(s, delay=f"{DELAY_S} seconds", min_track=STAY_LEAST), "identities")
    return d.select("mission_id", "flush_frame", "tid", "gid", "event", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("link_events", """WITH l AS (SELECT user_id AS uav_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT * FROM l WHERE epoch_us(ts) - epoch_us(p) > 36000000000)
SELECT uav_id, 'lost' AS kind, epoch_us(p) + 36000000000 AS at_us FROM g UNION ALL SELECT uav_id, 'recovered', epoch_us(ts) FROM g""")
def _(t):
    e = t("events").select(F.col("user_id").alias("uav_id"), F.to_timestamp(F.col("ts").cast("string")).alias("ts"))
    return st.link_events(e, 36000.0).select("uav_id", "kind", F.unix_micros("at").alias("at_us"))


_SIG = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(st.SIGNALS)) + " END"


@query("readiness", f"""WITH s AS (SELECT user_id AS uav_id, ts, {_SIG} AS signal, value > 5 AS ok FROM events), n AS (SELECT uav_id, max(ts) AS now FROM s GROUP BY 1), f AS (SELECT n.uav_id, count(DISTINCT signal) AS present FROM n LEFT JOIN s ON s.uav_id = n.uav_id AND ok AND epoch_us(now) - epoch_us(ts) <= 72000000000 GROUP BY 1)
SELECT uav_id, CAST(6 - present AS INTEGER) AS missing, present = 6 AS ready FROM f""")
def _(t):
    sig = F.element_at(F.array(*[F.lit(s) for s in st.SIGNALS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = t("events").select(F.col("user_id").alias("uav_id"), F.to_timestamp(F.col("ts").cast("string")).alias("ts"), sig.alias("signal"), (F.col("value") > 5).alias("ok"))
    return st.readiness(e, max_age=72000.0).select("uav_id", F.size("missing").alias("missing"), "ready")


@query("stream_readiness", f"""WITH s AS (SELECT user_id AS uav_id, epoch_us(ts) AS us, {_SIG} AS signal, value > 5 AS ok FROM events), n AS (SELECT (max(us) // 1000 - 1000) * 1000 AS now FROM s),
 f AS (SELECT uav_id, signal, max(CASE WHEN ok THEN us END) AS last FROM s, n WHERE us <= now GROUP BY 1, 2)
SELECT uav_id, string_agg(signal, ',' ORDER BY signal) FILTER (NOT coalesce(now - last <= 72000000000, FALSE)) AS stale_of_heard, count(*) FILTER (now - last <= 72000000000) = 6 AS ready FROM f, n GROUP BY uav_id""")
def _(t):
    """The last row of every board; of its missing signals those that were ever heard."""
    sig = F.element_at(F.array(*[F.lit(s) for s in st.SIGNALS]), (F.col("event_id") % 6 + 1).cast("int"))
    e = t("events").select(F.col("user_id").alias("uav_id"), F.to_timestamp(F.col("ts").cast("string")).alias("ts"), sig.alias("signal"), (F.col("value") > 5).alias("ok"))
    day = F.datediff("ts", F.lit("2024-01-01"))
    board = st.replay(e, F.least(F.floor(day / 11), F.lit(2)), 3, lambda s: online.stream_readiness(s, max_age=72000.0), "board")
    last = board.groupBy("uav_id").agg(F.max_by(F.struct("missing", "ready"), "at").alias("b"))
    end = e.agg((F.floor(F.max(F.unix_micros("ts")) / 1000) * 1000 - 1_000_000).alias("end"))
    heard = e.crossJoin(F.broadcast(end)).filter(F.unix_micros("ts") <= F.col("end")).groupBy("uav_id").agg(F.collect_set("signal").alias("heard"))
    known = F.array_join(F.array_sort(F.array_intersect("b.missing", "heard")), ",")
    return last.join(heard, "uav_id").select("uav_id", F.when(known != "", known).alias("stale_of_heard"), F.col("b.ready").alias("ready"))


@query("stream_stats", f"""WITH l AS (SELECT 'm' || user_id % 6 AS mission_id, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, CASE event_type WHEN 'view' THEN 'FRAME' WHEN 'signup' THEN 'OK' ELSE 'INFO' END AS level,
 CASE WHEN event_type = 'view' THEN event_id % 30 + 0.5 END AS v FROM events)
SELECT mission_id, start_us, level, count(*) AS lines, {rs('avg(v)')} AS fps FROM l WHERE start_us + 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 10000000 FROM events) GROUP BY 1, 2, 3""")
def _(t):
    """Windows that the watermark has closed; later ones stay open."""
    s = st.run_to_table(st.stream_stats(log_stream(t), width="1 hour"), "stats")
    return s.select("mission_id", F.unix_micros("start").alias("start_us"), "level", "lines", r("fps").alias("fps"))


@query("stream_link", """WITH l AS (SELECT user_id AS uav_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT * FROM l WHERE epoch_us(ts) - epoch_us(p) > 36000000000),
 e AS (SELECT user_id AS uav_id, max(epoch_us(ts)) + 36000000000 AS at_us FROM events GROUP BY 1)
SELECT uav_id, 'lost' AS kind, epoch_us(p) + 36000000000 AS at_us FROM g UNION ALL SELECT uav_id, 'recovered', epoch_us(ts) FROM g
UNION ALL SELECT uav_id, 'lost', at_us FROM e WHERE at_us // 1000 + 1 < (SELECT max(epoch_us(ts)) // 1000 - 1000 FROM events)""")
def _(t):
    e = event_stream(t).select(F.col("user_id").alias("uav_id"), "ts")
    return st.run_to_table(st.link_watch(e, 36000.0), "link").select("uav_id", "kind", F.unix_micros("at").alias("at_us"))


@query("publish_gids", f"""WITH {LOG}, a AS (SELECT mission_id, CAST(regexp_extract(msg, 'GID=(\\d+)\\s+Folder ready', 1) AS BIGINT) AS gid, line_no FROM lg WHERE regexp_matches(msg, 'GID=(\\d+)\\s+Folder ready')),
 k AS (SELECT *, row_number() OVER (PARTITION BY mission_id, gid ORDER BY line_no) AS seen FROM a), h AS (SELECT *, row_number() OVER (PARTITION BY mission_id, gid ORDER BY update_no) AS updates, count(*) OVER (PARTITION BY mission_id, gid) AS total,
  max(last_frame) OVER (PARTITION BY mission_id, gid ORDER BY update_no) AS newest FROM buffers)
SELECT k.mission_id, k.gid, k.seen, h.updates, h.event, h.newest AS last_frame FROM k JOIN h ON h.mission_id = k.mission_id AND h.gid = k.gid AND h.updates = least(k.seen, h.total)""", "mission_log buffers")
def _(t):
    log = logs.parse_lines(t("mission_log")).withColumnRenamed("line_no", "at")
    last = log.agg(F.max("at")).first()[0] or 0
    folder = f"{ensure_checkpoint_dir(t.spark)}/published-{uuid.uuid4().hex}"
    st.replay(log, F.floor(F.col("at") * 3 / (last + 1)), 3, lambda s: runs.watch_runs(s, "mission_id"), "publish", runs.publisher(t("buffers"), folder))
    return t.spark.read.parquet(f"{folder}/batch=*").select("mission_id", "gid", "seen", "updates", "event", "last_frame")


@query("score", "SELECT vec_id, CAST(round(list_sum([abs(x) for x in CAST(embedding AS DOUBLE[])]), 4) + 0.0 AS DOUBLE) AS score FROM embeddings")
def _(t):
    import pandas as pd

    def infer(model, b):
        return pd.DataFrame({"vec_id": b["vec_id"], "score": [model(v) for v in b["embedding"]]})

    d = hooks.score(t("embeddings").select("vec_id", "embedding"), lambda: (lambda v: float(sum(abs(float(x)) for x in v))), infer, "vec_id bigint, score double")
    return d.select("vec_id", r("score", 4).alias("score"))
