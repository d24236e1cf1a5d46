"""Registered queries: telemetry cleaning, frame joins, trails and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions import geo, text
from aerotrace.operators import telemetry as tm
from aerotrace.plans.registry import hav, query, r, rs


@query("drop_no_fix", f"""SELECT mission_id, {rs('t')} AS t, {rs('lat',7)} AS lat, {rs('lon',7)} AS lon FROM telemetry
WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0)""", "telemetry")
def _(t):
    return tm.drop_no_fix(t("telemetry")).select("mission_id", r("t").alias("t"), r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("fill_zoom", f"""SELECT mission_id, {rs('t')} AS t, coalesce(
 last_value(zoom IGNORE NULLS) OVER (PARTITION BY mission_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(zoom IGNORE NULLS) OVER (PARTITION BY mission_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS zoom
FROM telemetry""", "telemetry")
def _(t):
    return tm.fill_zoom(t("telemetry")).select("mission_id", r("t").alias("t"), "zoom")


@query("zoom_or", f"SELECT mission_id, {rs('t')} AS t, CASE WHEN zoom > 0 THEN zoom ELSE 2.0 END::DOUBLE AS zoom FROM telemetry", "telemetry")
def _(t):
    return t("telemetry").select("mission_id", r("t").alias("t"), tm.zoom_or("zoom").alias("zoom"))


@query("join_frame", f"""WITH tf AS (SELECT *, CAST(floor(t * 4 / 5) AS BIGINT) AS k FROM telemetry),
 first AS (SELECT mission_id, k, arg_min(alt, t) AS alt, arg_min(yaw, t) AS yaw, min(t) AS tt FROM tf GROUP BY 1, 2)
SELECT f.mission_id, f.frame, {rs('tt')} AS t, {rs('alt')} AS alt, {rs('yaw')} AS yaw
FROM (SELECT *, frame // 5 AS k FROM frames) f LEFT JOIN first USING (mission_id, k)""", "telemetry frames")
def _(t):
    telem = t("telemetry").withColumn("frame", F.floor(F.col("t") * 4 / 5))
    fr = t("frames").withColumn("f0", F.col("frame")).withColumn("frame", F.floor(F.col("frame") / 5))
    d = tm.join_frame(fr.drop("t"), telem)
    return d.select("mission_id", F.col("f0").alias("frame"), r("telem.t").alias("t"), r("telem.alt").alias("alt"), r("telem.yaw").alias("yaw"))


_BOTH = """WITH p AS (SELECT f.mission_id, f.frame, f.t AS ft, t.t AS pt, t.alt AS palt FROM frames f ASOF LEFT JOIN telemetry t
   ON f.mission_id = t.mission_id AND f.t >= t.t),
 n AS (SELECT f.mission_id, f.frame, t.t AS nt, t.alt AS nalt FROM frames f ASOF LEFT JOIN telemetry t
   ON f.mission_id = t.mission_id AND f.t <= t.t),
 b AS (SELECT *, CASE WHEN nt IS NULL OR ft - pt <= nt - ft THEN pt ELSE nt END AS mt,
   CASE WHEN nt IS NULL OR ft - pt <= nt - ft THEN palt ELSE nalt END AS malt FROM p JOIN n USING (mission_id, frame))
"""


@query("asof_nearest", _BOTH + f"SELECT mission_id, frame, {rs('mt')} AS t, {rs('malt')} AS alt FROM b", "telemetry frames")
def _(t):
    d = tm.asof(t("frames"), t("telemetry"), cols=["t", "alt"])
    return d.select("mission_id", "frame", r("match.t").alias("t"), r("match.alt").alias("alt"))


@query("asof_backward", f"""SELECT f.mission_id, f.frame, {rs('t.t')} AS t, {rs('t.alt')} AS alt FROM frames f
 ASOF LEFT JOIN telemetry t ON f.mission_id = t.mission_id AND f.t >= t.t""", "telemetry frames")
def _(t):
    d = tm.asof(t("frames"), t("telemetry"), direction="backward", cols=["t", "alt"])
    return d.select("mission_id", "frame", r("match.t").alias("t"), r("match.alt").alias("alt"))


@query("asof_forward", f"""SELECT f.mission_id, f.frame, {rs('t.t')} AS t, {rs('t.alt')} AS alt FROM frames f
 ASOF LEFT JOIN telemetry t ON f.mission_id = t.mission_id AND f.t <= t.t""", "telemetry frames")
def _(t):
    d = tm.asof(t("frames"), t("telemetry"), direction="forward", cols=["t", "alt"])
    return d.select("mission_id", "frame", r("match.t").alias("t"), r("match.alt").alias("alt"))


@query("latest_cached", f"""SELECT f.mission_id, f.frame, {rs('t.t')} AS t, {rs('t.yaw')} AS yaw FROM frames f
 ASOF JOIN telemetry t ON f.mission_id = t.mission_id AND f.t >= t.t WHERE f.t - t.t <= 1.0""", "telemetry frames")
def _(t):
    d = tm.latest_cached(t("frames"), t("telemetry"), cols=["t", "yaw"])
    return d.select("mission_id", "frame", r("match.t").alias("t"), r("match.yaw").alias("yaw"))


@query("sync3", f"""WITH g AS (SELECT * FROM telemetry WHERE CAST(roll * 2 AS BIGINT) % 2 = 0), i AS (SELECT * FROM telemetry WHERE CAST(roll * 2 AS BIGINT) % 2 <> 0),
 q AS (SELECT f.mission_id, f.frame, f.t AS ft, a.t AS ga, b.t AS gb FROM frames f
   ASOF LEFT JOIN g a ON f.mission_id = a.mission_id AND f.t >= a.t ASOF LEFT JOIN g b ON f.mission_id = b.mission_id AND f.t <= b.t),
 w AS (SELECT q.*, a.t AS ia, b.t AS ib FROM q ASOF LEFT JOIN i a ON q.mission_id = a.mission_id AND q.ft >= a.t
   ASOF LEFT JOIN i b ON q.mission_id = b.mission_id AND q.ft <= b.t),
 z AS (SELECT mission_id, frame, ft, CASE WHEN gb IS NULL OR ft - ga <= gb - ft THEN ga ELSE gb END AS gt,
   CASE WHEN ib IS NULL OR ft - ia <= ib - ft THEN ia ELSE ib END AS it FROM w)
SELECT mission_id, frame, {rs('gt')} AS gps_t, {rs('it')} AS imu_t FROM z WHERE abs(gt - ft) <= 0.6 AND abs(it - ft) <= 0.6""", "telemetry frames")
def _(t):
    telem = t("telemetry")
    even = (F.col("roll") * 2).cast("bigint") % 2 == 0
    d = tm.sync3(t("frames"), telem.filter(even), telem.filter(~even), slop=0.6, cols=["t"])
    return d.select("mission_id", "frame", r("gps.t").alias("gps_t"), r("imu.t").alias("imu_t"))


_BEAR = ("((degrees(atan2(sin(radians(b.lon-a.lon))*cos(radians(b.lat)), cos(radians(a.lat))*sin(radians(b.lat))"
         "-sin(radians(a.lat))*cos(radians(b.lat))*cos(radians(b.lon-a.lon))))+360.0) % 360.0)")
_FIX = """fx AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t) AS k FROM telemetry
   WHERE lat IS NOT NULL AND NOT (lat = 0 AND lon = 0))"""
_INTERP = f"""WITH {_FIX},
 p AS (SELECT f.mission_id, f.frame, f.t AS ft, x.k FROM frames f ASOF LEFT JOIN fx x ON f.mission_id = x.mission_id AND f.t >= x.t),
 ab AS (SELECT p.mission_id, p.frame, p.ft, p.k IS NULL AS head, coalesce(p.k, 1) AS k FROM p),
 s AS (SELECT ab.mission_id, ab.frame, ab.ft, a.yaw, a.zoom, a.lat AS alat, a.lon AS alon, a.alt AS aalt,
   coalesce(b.lat, a.lat) AS blat, coalesce(b.lon, a.lon) AS blon, coalesce(b.alt, a.alt) AS balt,
   CASE WHEN head OR b.t IS NULL THEN 0.0 ELSE (ft - a.t) / (b.t - a.t) END AS f,
   CASE WHEN b.t IS NULL THEN 0.0 ELSE {hav('a.lat','a.lon','b.lat','b.lon')} / (b.t - a.t) END AS speed,
   CASE WHEN b.t IS NULL OR (a.lat = b.lat AND a.lon = b.lon) THEN 0.0 ELSE {_BEAR} END AS heading
   FROM ab JOIN fx a ON ab.mission_id = a.mission_id AND ab.k = a.k LEFT JOIN fx b ON ab.mission_id = b.mission_id AND b.k = ab.k + 1)
"""


@query("interpolate_at", _INTERP + f"""SELECT mission_id, frame, {rs('alat+(blat-alat)*f',9)} AS lat, {rs('alon+(blon-alon)*f',9)} AS lon,
 {rs('aalt+(balt-aalt)*f')} AS alt, {rs('speed',4)} AS speed, {rs('heading',4)} AS heading, {rs('yaw')} AS yaw, zoom FROM s""", "telemetry frames")
def _(t):
    d = tm.interpolate_at(t("frames"), t("telemetry"))
    s = F.col("state")
    return d.select("mission_id", "frame", r(s["lat"], 9).alias("lat"), r(s["lon"], 9).alias("lon"), r(s["alt"]).alias("alt"),
                    r(s["speed"], 4).alias("speed"), r(s["heading"], 4).alias("heading"), r(s["yaw"]).alias("yaw"), s["zoom"].alias("zoom"))


@query("state_at", f"""WITH fx0 AS (SELECT *, CAST(floor(t * 4 / 9) AS BIGINT) AS fk FROM telemetry WHERE lat IS NOT NULL AND NOT (lat = 0 AND lon = 0)),
 fx AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t) AS k FROM fx0),
 nm AS (SELECT mission_id, fk, arg_min(lat, t) AS lat, arg_min(alt, t) AS alt FROM fx0 GROUP BY 1, 2),
 fr AS (SELECT mission_id, frame // 9 AS fk, frame AS f0, t FROM frames),
 p AS (SELECT f.*, x.k FROM fr f ASOF LEFT JOIN fx x ON f.mission_id = x.mission_id AND f.t >= x.t),
 s AS (SELECT p.mission_id, p.f0, p.fk, CASE WHEN p.k IS NULL OR b.t IS NULL THEN a.lat ELSE a.lat + (b.lat - a.lat) * ((p.t - a.t) / (b.t - a.t)) END AS lat,
   CASE WHEN p.k IS NULL OR b.t IS NULL THEN a.alt ELSE a.alt + (b.alt - a.alt) * ((p.t - a.t) / (b.t - a.t)) END AS alt
   FROM p JOIN fx a ON p.mission_id = a.mission_id AND coalesce(p.k, 1) = a.k LEFT JOIN fx b ON p.mission_id = b.mission_id AND b.k = coalesce(p.k, 1) + 1)
SELECT s.mission_id, s.f0 AS frame, {rs('coalesce(nm.lat, s.lat)',9)} AS lat, {rs('coalesce(nm.alt, s.alt)')} AS alt
FROM s LEFT JOIN nm ON s.mission_id = nm.mission_id AND s.fk = nm.fk""", "telemetry frames")
def _(t):
    telem = t("telemetry").withColumn("frame", F.floor(F.col("t") * 4 / 9))
    fr = t("frames").withColumn("f0", F.col("frame")).withColumn("frame", F.floor(F.col("frame") / 9))
    d = tm.state_at(fr, telem)
    return d.select("mission_id", F.col("f0").alias("frame"), r("state.lat", 9).alias("lat"), r("state.alt").alias("alt"))


@query("trail", f"""WITH fx AS (SELECT *, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM telemetry WHERE lat IS NOT NULL
   WINDOW w AS (PARTITION BY mission_id ORDER BY t)), k AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY t DESC) AS rn
   FROM fx WHERE pla IS NULL OR pla <> lat OR plo <> lon)
SELECT mission_id, {rs('t')} AS t, {rs('lat',7)} AS lat, {rs('lon',7)} AS lon FROM k WHERE rn <= 500""", "telemetry")
def _(t):
    return tm.trail(t("telemetry"), 500).select("mission_id", r("t").alias("t"), r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("latest", f"""SELECT mission_id, {rs('max(t)')} AS t, {rs('arg_max(alt, t)')} AS alt FROM telemetry
 WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1""", "telemetry")
def _(t):
    fixes = t("telemetry").filter("lat IS NOT NULL AND lon IS NOT NULL").select("mission_id", "t", "alt")
    return tm.latest(fixes, ["mission_id"], "t").select("mission_id", r("t").alias("t"), r("alt").alias("alt"))


@query("mask_stale", f"""WITH m AS (SELECT max(t) AS now FROM telemetry), l AS (SELECT mission_id, max(t) AS ts, arg_max(alt, t) AS alt FROM telemetry GROUP BY 1)
SELECT mission_id, {rs('ts')} AS ts, CASE WHEN now - ts < 3.0 THEN {rs('alt')} END AS alt FROM l, m""", "telemetry")
def _(t):
    telem = t("telemetry").select("mission_id", F.col("t").alias("ts"), "alt")
    now = telem.groupBy(F.lit(1).alias("one")).agg(F.max("ts").alias("now"))
    d = tm.latest(telem, ["mission_id"], "ts").withColumn("one", F.lit(1)).join(F.broadcast(now), "one")
    return tm.mask_stale(d, F.col("now"), fields=["alt"]).select("mission_id", r("ts").alias("ts"), r("alt").alias("alt"))


@query("battery_band", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN value * 3 <= 15 THEN 'critical' WHEN value * 3 <= 25 THEN 'low' ELSE 'ok' END AS band,
 CASE WHEN user_id % 5 = 0 THEN 'mission' WHEN user_id % 5 = 1 THEN 'return' WHEN user_id % 5 = 2 THEN 'manual' ELSE 'other' END AS mode_class FROM events""")
def _(t):
    e = t("events")
    pct = F.when(F.col("event_id") % 11 != 0, F.col("value") * 3)
    mode = F.element_at(F.array(*[F.lit(m) for m in ("auto", "RTL", "Loiter", "ACRO")]), F.least(F.col("user_id") % 5, F.lit(3)).cast("int") + 1)
    return e.select("event_id", tm.battery_band(pct).alias("band"), tm.mode_class(mode).alias("mode_class"))


@query("gps_stability", f"""WITH x AS (SELECT mission_id, {hav('lag(lat) OVER w','lag(lon) OVER w','lat','lon')} AS j FROM telemetry WHERE lat IS NOT NULL AND lat <> 0
 WINDOW w AS (PARTITION BY mission_id ORDER BY t)) SELECT mission_id, count(*) AS points, {rs('avg(j)',4)} AS mean_jump, {rs('max(j)',4)} AS max_jump
 FROM x GROUP BY 1 HAVING count(*) >= 2""", "telemetry")
def _(t):
    return tm.gps_stability(tm.drop_no_fix(t("telemetry"))).select("mission_id", "points", r("mean_jump", 4).alias("mean_jump"), r("max_jump", 4).alias("max_jump"))


@query("rolling_rate", f"""WITH u AS (SELECT mission_id, t, CAST(round(t * 1e6) AS BIGINT) AS us FROM telemetry),
 x AS (SELECT mission_id, t, us, count(*) OVER w AS n, min(us) OVER w AS lo FROM u
   WINDOW w AS (PARTITION BY mission_id ORDER BY us RANGE BETWEEN 4999999 PRECEDING AND CURRENT ROW))
SELECT mission_id, {rs('t')} AS t, {rs('CASE WHEN n >= 2 AND us > lo THEN (n - 1) / ((us - lo) / 1e6) ELSE 0 END')} AS rate_hz FROM x""", "telemetry")
def _(t):
    return tm.rolling_rate(t("telemetry")).select("mission_id", r("t").alias("t"), r("rate_hz").alias("rate_hz"))


@query("carry_fit", """SELECT mission_id, frame, last_value(CASE WHEN frame % 4 = 0 THEN frame * 0.5 END IGNORE NULLS)
 OVER (PARTITION BY mission_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS fit FROM frames""", "frames")
def _(t):
    fr = t("frames").withColumn("v", F.when(F.col("frame") % 4 == 0, F.col("frame") * 0.5))
    return tm.carry_fit(fr, "v", out="fit").select("mission_id", "frame", F.col("fit").cast("double").alias("fit"))


@query("ema", f"""WITH RECURSIVE o AS (SELECT mission_id, frame, t, row_number() OVER (PARTITION BY mission_id ORDER BY frame) AS k FROM frames),
 e(mission_id, k, frame, v) AS (SELECT mission_id, k, frame, t FROM o WHERE k = 1 UNION ALL
   SELECT o.mission_id, o.k, o.frame, (1.0 - 1.0/7.0) * e.v + (1.0/7.0) * o.t FROM e JOIN o ON o.mission_id = e.mission_id AND o.k = e.k + 1)
SELECT mission_id, frame, {rs('v',9)} AS ema FROM e""", "frames")
def _(t):
    return tm.ema(t("frames"), "t", 1.0 / 7.0).select("mission_id", "frame", r("ema", 9).alias("ema"))


@query("log_position", f"""WITH l AS (SELECT mission_id, arg_max(lat, frame) AS lat, arg_max(lon, frame) AS lon FROM observations GROUP BY 1)
SELECT mission_id, {rs('lat',7)} AS lat, {rs('lon',7)} AS lon FROM l""", "observations")
def _(t):
    return tm.log_position(t("observations")).select("mission_id", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("normalize_mavlink", f"""SELECT user_id AS uav_id, {rs('(280000000 + event_id) / 1e7',7)} AS latitude, {rs('value * 100 / 1000.0')} AS altitude,
 CASE WHEN event_id % 9 - 1 >= 0 THEN event_id % 9 - 1 END AS battery_pct, CASE WHEN event_id % 7 - 1 >= 0 THEN {rs('(event_id % 7 - 1) / 100.0')} END AS "current",
 event_id % 256 >= 128 AS armed, CASE event_id % 10 WHEN 3 THEN 'STANDBY' WHEN 4 THEN 'ACTIVE' WHEN 0 THEN 'UNINIT' WHEN 1 THEN 'BOOT' WHEN 2 THEN 'CALIBRATING'
 WHEN 5 THEN 'CRITICAL' WHEN 6 THEN 'EMERGENCY' WHEN 7 THEN 'POWEROFF' ELSE 'UNKNOWN' END AS status FROM events WHERE event_id % 3 = 1 AND event_id % 13 <> 0""")
def _(t):
    e = t("events")
    k = F.col("event_id")
    raw = e.select(F.col("user_id").alias("uav_id"), F.lit(0.0).alias("ts"), (k % 3).alias("component"),
                   F.when(k % 13 != 0, 280000000 + k).alias("lat_e7"), (770000000 + k).alias("lon_e7"), (F.col("value") * 100).alias("relative_alt_mm"),
                   F.lit(1.0).alias("groundspeed"), F.lit(12000).alias("voltage_mv"), (k % 9 - 1).alias("battery_remaining"), (k % 7 - 1).alias("current_ca"),
                   (k % 256).alias("base_mode"), F.lit("AUTO").alias("mode"), F.lit(0.0).alias("heading"),
                   F.when(k % 10 < 8, k % 10).otherwise(99).alias("system_status"))
    d = tm.normalize_mavlink(raw)
    return d.select("uav_id", r("latitude", 7).alias("latitude"), r("altitude").alias("altitude"), "battery_pct", r("current").alias("current"), "armed", "status")


@query("haversine", f"""SELECT mission_id, {rs('t')} AS t, {rs(hav('28.75','77.11','lat','lon'),5)} AS d, {rs(hav('28.75','77.11','lat','lon',6371008.8),5)} AS d_mean FROM telemetry WHERE lat <> 0""", "telemetry")
def _(t):
    d = t("telemetry").filter("lat <> 0")
    return d.select("mission_id", r("t").alias("t"), r(geo.haversine(28.75, 77.11, "lat", "lon", form="atan2"), 5).alias("d"),
                    r(geo.haversine(28.75, 77.11, "lat", "lon", geo.R_EARTH_MEAN), 5).alias("d_mean"))


@query("bearing", f"""WITH x AS (SELECT mission_id, t, lat AS la, lon AS lo FROM telemetry WHERE lat <> 0)
SELECT mission_id, {rs('t')} AS t, {rs('((degrees(atan2(sin(radians(lo-77.0))*cos(radians(la)), cos(radians(28.0))*sin(radians(la))-sin(radians(28.0))*cos(radians(la))*cos(radians(lo-77.0))))+360.0) % 360.0)')} AS bearing FROM x""", "telemetry")
def _(t):
    return t("telemetry").filter("lat <> 0").select("mission_id", r("t").alias("t"), r(geo.bearing(28.0, 77.0, "lat", "lon")).alias("bearing"))


@query("local_xy", f"""WITH m AS (SELECT mission_id, avg(lat) AS la, avg(lon) AS lo FROM telemetry WHERE lat <> 0 GROUP BY 1)
SELECT mission_id, {rs('t')} AS t, {rs('radians(lon - lo) * 6371000.0 * cos(radians(la))',4)} AS x, {rs('radians(lat - la) * 6371000.0',4)} AS y
FROM telemetry JOIN m USING (mission_id) WHERE lat <> 0""", "telemetry")
def _(t):
    d = t("telemetry").filter("lat <> 0")
    m = d.groupBy("mission_id").agg(F.avg("lat").alias("la"), F.avg("lon").alias("lo"))
    d = d.join(m, "mission_id").withColumn("p", geo.local_xy("lat", "lon", "la", "lo"))
    return d.select("mission_id", r("t").alias("t"), r("p.x", 4).alias("x"), r("p.y", 4).alias("y"))


@query("latlon_to_local", f"""SELECT event_id, {rs('10.0 + (28.75 + event_id*0.00001 - (28.0 + user_id*0.001)) * 0 + (77.11 - 77.0) * 111319.4907932736 * cos(radians(28.0 + user_id*0.001))',4)} AS x,
 {rs('20.0 + (28.75 + event_id*0.00001 - (28.0 + user_id*0.001)) * 111319.4907932736',4)} AS y FROM events WHERE event_id % 5 <> 0""")
def _(t):
    e = t("events").withColumn("cl", F.when(F.col("event_id") % 5 != 0, 28.0 + F.col("user_id") * 0.001))
    p = geo.latlon_to_local(28.75 + F.col("event_id") * 0.00001, 77.11, "cl", 77.0, 10.0, 20.0)
    return e.withColumn("p", p).filter("p IS NOT NULL").select("event_id", r("p.x", 4).alias("x"), r("p.y", 4).alias("y"))


@query("geo_score", f"""WITH x AS (SELECT vec_id, vec_id % 11 * 1.0 AS d FROM embeddings)
SELECT vec_id, {rs('CASE WHEN d < 3 THEN 1.0 WHEN d > 7 THEN 0.0 ELSE 1.0 - (d - 3.0) / 4.0 END')} AS score FROM x""")
def _(t):
    return t("embeddings").select("vec_id", r(geo.geo_score(F.col("vec_id") % 11 * 1.0)).alias("score"))


@query("cross_track", f"SELECT p_partkey, {rs('abs(4.0*(p_size*0.1-2.0) - 3.0*(p_partkey%50-1.0))/5.0')} AS d FROM part")
def _(t):
    return t("part").select("p_partkey", r(geo.cross_track(1.0, 2.0, 5.0, 5.0, F.col("p_partkey") % 50, F.col("p_size") * 0.1)).alias("d"))


@query("mission_clock", """SELECT event_id, printf('%02d:%02d:', CAST(event_id // 4 // 3600 AS INTEGER), CAST(event_id // 4 % 3600 // 60 AS INTEGER))
 || printf('%06.3f', event_id * 0.25 % 60) AS clock FROM events""")
def _(t):
    return t("events").select("event_id", text.mission_clock(F.col("event_id") * 0.25).alias("clock"))


@query("run_started_at", """SELECT o_orderkey, epoch(date_trunc('second', o_orderdate))::DOUBLE AS started_at FROM orders""")
def _(t):
    name = F.date_format(F.col("o_orderdate"), "yyyyMMdd_HHmmss")
    return t("orders").select("o_orderkey", text.run_started_at(name).cast("double").alias("started_at"))


@query("parse_quantity", f"""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id || ' px' WHEN 1 THEN CAST(value AS VARCHAR) || ' sec' WHEN 2 THEN event_type ELSE '-' || event_id || '.5 deg' END AS s FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS i, CASE event_id % 4 WHEN 1 THEN {rs("regexp_extract(s, '^(\\S+)', 1)")} WHEN 3 THEN {rs("regexp_extract(s, '^(\\S+)', 1)")} END AS d,
 CASE WHEN event_id % 4 = 2 THEN s END AS s FROM x""".replace("CAST((regexp_extract", "TRY_CAST((regexp_extract"))
def _(t):
    k = F.col("event_id")
    s = (F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" px"))).when(k % 4 == 1, F.concat(F.col("value").cast("string"), F.lit(" sec")))
         .when(k % 4 == 2, F.col("event_type")).otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit(".5 deg"))))
    q = text.parse_quantity(s)
    return t("events").select("event_id", q["int_value"].alias("i"), r(q["double_value"]).alias("d"), q["text_value"].alias("s"))


@query("parse_lat_lon", f"SELECT event_id, {rs('28.75 + event_id * 0.00001',7)} AS lat, {rs('77.11',7)} AS lon FROM events", "")
def _(t):
    p = text.parse_lat_lon("probe")
    return t("goals").select("event_id", r(p["lat"], 7).alias("lat"), r(p["lon"], 7).alias("lon"))


_UP = "(111132.92 - 559.82*cos(2*radians(lat)) + 1.175*cos(4*radians(lat)) - 0.0023*cos(6*radians(lat)))"
_ACROSS = "(111412.84*cos(radians(lat)) - 93.5*cos(3*radians(lat)) + 0.118*cos(5*radians(lat)))"


@query("ground_hit", f"""WITH p AS (SELECT mission_id, t, lat, lon, alt, roll / 11.0 AS x, pitch / 11.0 AS y, yaw / 180.0 - 0.5 AS z FROM telemetry WHERE lat IS NOT NULL)
SELECT mission_id, {rs('t')} AS t, {rs('CASE WHEN z > 0 THEN x*alt/z END')} AS north, {rs('CASE WHEN z > 0 THEN y*alt/z END')} AS east,
 {rs(f'CASE WHEN z > 0 THEN lat + x*alt/z/{_UP} END', 7)} AS hit_lat, {rs(f'CASE WHEN z > 0 THEN lon + y*alt/z/{_ACROSS} END', 7)} AS hit_lon FROM p""", "telemetry")
def _(t):
    d = t("telemetry").filter("lat IS NOT NULL")
    ray = F.struct((F.col("roll") / 11.0).alias("x"), (F.col("pitch") / 11.0).alias("y"), (F.col("yaw") / 180.0 - 0.5).alias("z"))
    d = d.withColumn("hit", geo.ground_hit(ray, "alt"))
    d = d.withColumn("at", F.when(F.col("hit").isNotNull(), geo.ned_to_gps(F.col("hit.x"), F.col("hit.y"), "lat", "lon")))
    return d.select("mission_id", r("t").alias("t"), r("hit.x").alias("north"), r("hit.y").alias("east"), r("at.lat", 7).alias("hit_lat"), r("at.lon", 7).alias("hit_lon"))
