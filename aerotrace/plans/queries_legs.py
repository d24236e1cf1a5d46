"""Registered queries: legs of a flown pattern and the counters of a mission."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import legs, logs
from aerotrace.plans.registry import query, r, rs

_LEGS = f"""WITH tr AS (SELECT 'm' || user_id % 6 AS mission_id, event_id // 60 AS leg, event_id * 4.0 AS t, ((event_id // 60) * 37) % 50 + ((event_id * 7919) % 41 - 20) * 0.5 AS x,
  ((event_id // 60) * 53) % 50 + ((event_id * 104729) % 41 - 20) * 0.5 AS y FROM events),
 pat AS (SELECT DISTINCT mission_id, leg, CAST((leg * 37) % 50 AS DOUBLE) AS ax, CAST((leg * 53) % 50 AS DOUBLE) AS ay FROM tr),
 j AS (SELECT tr.*, p.ax, p.ay, n.ax AS bx, n.ay AS by_, min(t) OVER (PARTITION BY tr.mission_id, tr.leg) AS t0 FROM tr JOIN pat p ON p.mission_id = tr.mission_id AND p.leg = tr.leg
   LEFT JOIN pat n ON n.mission_id = tr.mission_id AND n.leg = tr.leg + 1),
 d AS (SELECT *, sqrt((ax-x)*(ax-x)+(ay-y)*(ay-y)) <= 2 AS near, CASE WHEN bx IS NOT NULL THEN CASE WHEN sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) < 1e-6 THEN sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay))
   ELSE abs((bx-ax)*(y-ay)-(by_-ay)*(x-ax))/sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) END END AS dev FROM j WHERE t - t0 < 180),
 o AS (SELECT *, min(CASE WHEN near THEN t END) OVER w AS tn, min(CASE WHEN dev > 2 THEN t END) OVER w AS toff FROM d WINDOW w AS (PARTITION BY mission_id, leg)),
 b AS (SELECT *, min(CASE WHEN dev <= 2 AND t > toff THEN t END) OVER (PARTITION BY mission_id, leg) AS tb FROM o),
 e AS (SELECT *, CASE WHEN tn IS NOT NULL AND (tb IS NULL OR tn <= tb) THEN 'reached' WHEN tb IS NOT NULL THEN 'advanced' ELSE 'timeout' END AS outcome, least(tn, tb) AS te FROM b),
 r AS (SELECT mission_id, leg, outcome, coalesce(min(te) - min(t0), 180.0) AS seconds, coalesce(max(CASE WHEN te IS NULL OR t < te OR (outcome = 'advanced' AND t = te) THEN dev END), 0.0) AS max_deviation,
   arg_max(greatest(abs(x), abs(y)) > 45, CASE WHEN te IS NULL OR t <= te THEN t END) AS off_map FROM e GROUP BY 1, 2, 3)"""


def outcomes(t):
    i = F.col("event_id")
    leg = F.floor(i / 60)
    off = lambda k: (i * k % 41 - 20) * 0.5
    track = t("events").select(F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("mission_id"), leg.alias("leg"), (i * 4.0).alias("t"),
                               (leg * 37 % 50 + off(7919)).alias("x"), (leg * 53 % 50 + off(104729)).alias("y"))
    k = F.col("leg")
    pattern = track.select("mission_id", "leg").distinct().select("mission_id", "leg", (k * 37 % 50).cast("double").alias("x"), (k * 53 % 50).cast("double").alias("y"))
    return legs.leg_outcomes(track, pattern, extent=45.0)


@query("leg_outcomes", _LEGS + f" SELECT mission_id, leg, outcome, {rs('seconds')} AS seconds, {rs('max_deviation')} AS max_deviation, off_map FROM r")
def _(t):
    return outcomes(t).select("mission_id", "leg", "outcome", r("seconds").alias("seconds"), r("max_deviation").alias("max_deviation"), "off_map")


@query("leg_counts", _LEGS + """ SELECT mission_id, count(*) AS legs, count(*) FILTER (outcome = 'reached') AS reached, count(*) FILTER (outcome = 'advanced') AS advanced,
 count(*) FILTER (outcome = 'timeout') AS timeout FROM r GROUP BY 1""")
def _(t):
    return legs.leg_counts(outcomes(t))


@query("track_counters", """SELECT mission_id, count(*) FILTER (frame % 4 = 0) AS tracks_created, count(*) FILTER (frame % 4 IN (1, 2)) AS tracks_updated, count(*) FILTER (frame % 4 = 3) AS tracks_deleted,
 count(*) FILTER (lat IS NULL OR lon IS NULL) AS gps_failures FROM (SELECT mission_id, frame, CASE WHEN frame % 20 <> 0 THEN lat END AS lat, lon FROM observations) GROUP BY 1""", "observations")
def _(t):
    kinds = F.element_at(F.array(*map(F.lit, ("new", "append", "append", "delete"))), (F.col("frame") % 4 + 1).cast("int"))
    o = t("observations").withColumns({"kind": kinds, "lat": F.when(F.col("frame") % 20 != 0, F.col("lat"))})
    return logs.track_counters(o, o)
