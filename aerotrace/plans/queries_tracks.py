"""Registered queries: tracking, buffers, identities and throttling (rows only; models in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import detections as dt
from aerotrace.operators import identity_pass as ip
from aerotrace.operators import tracks as tk
from aerotrace.plans.registry import query, r, rs


def squares(t):
    """Squared boxes of a denser scene: positions folded to a strip so that tracks persist."""
    d = t("detections").filter("label <> 'shadow'")
    # shrink the frame numbers so that a mission is a continuous clip
    d = d.select("mission_id", F.floor(F.col("frame") / 6).alias("frame"), (F.col("det_id") * 6 + F.col("frame") % 6).alias("det_id"), (F.col("x1") / 9).alias("x1"), (F.col("y1") / 9).alias("y1"), "conf", "sharpness",
                 F.lit(90.0).alias("s"))
    return d.withColumns({"x2": F.col("x1") + F.col("s"), "y2": F.col("y1") + F.col("s")}).drop("s")


STAY_LEAST = 41

# People of the view ``stays`` keep their places, so a track is a run of frames with short gaps.
STAY_TRACKS = """l AS (SELECT *, lag(frame) OVER (PARTITION BY mission_id, place ORDER BY frame) AS p FROM d),
 i AS (SELECT *, sum(CASE WHEN p IS NULL OR frame - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY mission_id, place ORDER BY frame) AS k FROM l)
SELECT mission_id, frame, det_id, min(frame) OVER w AS birth_frame, first_value(det_id) OVER (PARTITION BY mission_id, place, k ORDER BY frame) AS birth_det FROM i WINDOW w AS (PARTITION BY mission_id, place, k)"""

# A buffer holds 60 frames from its first entry; one with too few entries ends the track, another leaves its last entry as the next one's first.
STAY_BUFFERS = f"""e AS MATERIALIZED (SELECT *, count(*) OVER a AS n, max(frame) OVER a AS last, min(frame) OVER z AS later, max(frame) OVER (PARTITION BY mission_id) AS clock FROM d
   WINDOW a AS (PARTITION BY mission_id, place ORDER BY frame RANGE BETWEEN CURRENT ROW AND 59 FOLLOWING), z AS (PARTITION BY mission_id, place ORDER BY frame RANGE BETWEEN 60 FOLLOWING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT e.*, frame AS bf, det_id AS bd FROM e WHERE (mission_id, place, frame) IN (SELECT (mission_id, place, min(frame)) FROM d GROUP BY mission_id, place)
   UNION ALL SELECT e.*, CASE WHEN b.n >= {STAY_LEAST} THEN b.bf ELSE e.frame END, CASE WHEN b.n >= {STAY_LEAST} THEN b.bd ELSE e.det_id END FROM b JOIN e ON e.mission_id = b.mission_id AND e.place = b.place
     AND e.frame = CASE WHEN b.n >= {STAY_LEAST} THEN b.last ELSE b.later END WHERE b.frame + 59 <= b.clock),
 t AS (SELECT *, dense_rank() OVER (PARTITION BY mission_id ORDER BY bf, bd) AS tid FROM b)"""

STAY_IDENTITIES = f"""f AS (SELECT *, frame + 59 AS flush_frame FROM t WHERE n >= {STAY_LEAST} AND frame + 59 <= clock),
 g AS (SELECT mission_id, place, flush_frame AS born, row_number() OVER (PARTITION BY mission_id ORDER BY flush_frame, tid) AS gid FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, place ORDER BY flush_frame) AS k FROM f) WHERE k = 1)
SELECT f.mission_id, f.flush_frame, f.tid, g.gid, CASE WHEN f.flush_frame = g.born THEN 'new' ELSE 'merge' END AS event, (round(f.lat, 7) + 0.0) AS lat, (round(f.lon, 7) + 0.0) AS lon FROM f JOIN g ON g.mission_id = f.mission_id AND g.place = f.place"""


@query("track_stays", f"WITH d AS (SELECT * FROM stays), s AS ({{}}) SELECT mission_id, frame, det_id, dense_rank() OVER (PARTITION BY mission_id ORDER BY birth_frame, birth_det) AS tid FROM s".format("WITH " + STAY_TRACKS), "stays")
def _(t):
    return tk.track_greedy(t("stays"))


@query("close_stays", "WITH d AS (SELECT * FROM stays), s AS ({}), t AS (SELECT *, dense_rank() OVER (PARTITION BY mission_id ORDER BY birth_frame, birth_det) AS tid FROM s) SELECT mission_id, tid, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS hits, max(frame) + 4 AS closed_frame FROM t GROUP BY 1, 2 HAVING count(*) >= 2".format("WITH " + STAY_TRACKS), "stays")
def _(t):
    return tk.close_tracks(tk.track_greedy(t("stays")))


@query("buffer_stays", f"WITH RECURSIVE d AS (SELECT * FROM stays), {STAY_BUFFERS} SELECT mission_id, tid, CASE WHEN n >= {STAY_LEAST} THEN 'flush' ELSE 'delete' END AS kind, frame + 59 AS flush_frame, CASE WHEN n >= {STAY_LEAST} THEN n ELSE 0 END AS entries FROM t WHERE frame + 59 <= clock", "stays")
def _(t):
    b = tk.flush_buffers(t("stays"), min_track=STAY_LEAST)
    return b.groupBy("mission_id", "tid", "kind", "flush_frame").agg(F.count("frame").alias("entries"), F.count("det_id").alias("n")).withColumn("entries", F.when(F.col("kind") == "flush", F.col("n")).otherwise(0)).drop("n")


@query("identify_stays", f"WITH RECURSIVE d AS (SELECT * FROM stays), {STAY_BUFFERS}, {STAY_IDENTITIES}", "stays")
def _(t):
    d = t("stays")
    b = tk.flush_buffers(d, min_track=STAY_LEAST).join(d.select("mission_id", "frame", "det_id", "conf", "sharpness", "lat", "lon"), ["mission_id", "frame", "det_id"], "left")
    return ip.assign_identities(b).select("mission_id", "flush_frame", "tid", "gid", "event", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("track_greedy")
def _(t):
    return tk.track_greedy(squares(t))


@query("close_tracks")
def _(t):
    return tk.close_tracks(tk.track_greedy(squares(t)))


@query("track_strict")
def _(t):
    return tk.track_strict(squares(t), min_track=3)


@query("flush_buffers")
def _(t):
    return tk.flush_buffers(squares(t), min_track=3)


def buffers(t):
    d = squares(t)
    b = tk.flush_buffers(d, min_track=3)
    # a position that follows the box, so that returns to one place are the same person
    det = d.select("mission_id", "frame", "det_id", "conf", "sharpness", (28.75 + F.floor(F.col("x1") / 40) * 0.00004).alias("lat"),
                   (77.11 + F.floor(F.col("y1") / 40) * 0.00004).alias("lon"))
    return b.join(det, ["mission_id", "frame", "det_id"], "left")


@query("assign_identities_geo")
def _(t):
    return ip.assign_identities(buffers(t)).select("mission_id", "flush_frame", "tid", "gid", "event", "n", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("assign_identities_appearance")
def _(t):
    o = t("observations").withColumn("part", F.floor(F.col("frame") / 50))
    rows = o.groupBy("mission_id", "tid", "part").agg(F.max("frame").alias("flush_frame"), F.array_sort(F.collect_list(F.struct("frame", "lat", "lon", "embedding"))).alias("e"))
    rows = rows.select("mission_id", (F.col("tid") * 1000 + F.col("part")).alias("tid"), "flush_frame", F.transform("e", lambda x: F.array(x["lat"], x["lon"])).alias("points"),
                       F.transform("e", lambda x: x["embedding"]).alias("embeds"))
    return ip.assign_identities(rows, "appearance", min_cosine=0.5).select("mission_id", "flush_frame", "tid", "gid", "event", "n", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("throttle", f"""WITH RECURSIVE o AS (SELECT mission_id, t, row_number() OVER (PARTITION BY mission_id ORDER BY t) AS k FROM telemetry),
 e(mission_id, k, t, last, keep) AS (SELECT mission_id, k, t, t, TRUE FROM o WHERE k = 1 UNION ALL
  SELECT o.mission_id, o.k, o.t, CASE WHEN o.t - e.last >= 2.0 THEN o.t ELSE e.last END, o.t - e.last >= 2.0 FROM e JOIN o ON o.mission_id = e.mission_id AND o.k = e.k + 1)
SELECT mission_id, {rs('t')} AS t FROM e WHERE keep""", "telemetry")
def _(t):
    return tk.throttle(t("telemetry").select("mission_id", "t"), 0.5).select("mission_id", r("t").alias("t"))
