"""Registered queries: logs, galleries, identity summaries and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions import text
from aerotrace.operators import detections as dt
from aerotrace.operators import identities as idn
from aerotrace.operators import logs
from aerotrace.plans.queries_detections import _SQ
from aerotrace.plans.registry import hav, query, r, rs

LOG = """lg AS (SELECT mission_id, line_no, CASE WHEN line LIKE '[%' THEN regexp_extract(line, '^\\[(\\w+)\\s*\\]\\s?(.*)$', 1) ELSE 'RAW' END AS level,
 CASE WHEN line LIKE '[%' THEN regexp_extract(line, '^\\[(\\w+)\\s*\\]\\s?(.*)$', 2) ELSE line END AS msg FROM mission_log)"""


@query("parse_lines", f"WITH {LOG} SELECT * FROM lg", "mission_log")
def _(t):
    return logs.parse_lines(t("mission_log")).select("mission_id", "line_no", "level", "msg")


@query("drop_level", f"WITH {LOG} SELECT mission_id, line_no FROM lg WHERE level <> 'FRAME'", "mission_log")
def _(t):
    return logs.drop_level(logs.parse_lines(t("mission_log"))).select("mission_id", "line_no")


@query("search_log", f"WITH {LOG} SELECT mission_id, line_no FROM lg WHERE level <> 'FRAME' AND contains(lower(msg), 'gid=1')", "mission_log")
def _(t):
    return logs.search_log(logs.parse_lines(t("mission_log")), q=" GID=1").select("mission_id", "line_no")


@query("log_notices", f"""WITH {LOG} SELECT mission_id, line_no, 'problem' AS kind, trim(msg) AS text FROM lg
 WHERE level = 'ERROR' OR (level = 'WARN' AND regexp_matches(lower(msg), 'lost|fail|timeout|disconnect|no gps|unable|cannot'))""", "mission_log")
def _(t):
    return logs.log_notices(logs.parse_lines(t("mission_log"))).select("mission_id", "line_no", "kind", "text")


@query("tail_n", "SELECT mission_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY line_no DESC) AS k FROM mission_log) WHERE k <= 700", "mission_log")
def _(t):
    return logs.tail_n(t("mission_log"), 700).select("mission_id", "line_no")


@query("feed", f"WITH {LOG} SELECT mission_id, line_no FROM lg WHERE level = 'ERROR' ORDER BY line_no DESC LIMIT 200", "mission_log")
def _(t):
    n = logs.log_notices(logs.parse_lines(t("mission_log"))).filter("level = 'ERROR'")
    return logs.feed(n, order=["line_no"]).select("mission_id", "line_no")


@query("frame_clock", f"""WITH {LOG}, c AS (SELECT mission_id, line_no, sum(CASE WHEN level = 'FRAME' THEN 1 ELSE 0 END) OVER (PARTITION BY mission_id ORDER BY line_no) AS n FROM lg)
SELECT mission_id, line_no, CASE WHEN n > 0 THEN CAST(n + 30 AS BIGINT) END AS frame FROM c""", "mission_log")
def _(t):
    return logs.frame_clock(logs.parse_lines(t("mission_log")), 30).select("mission_id", "line_no", "frame")


@query("log_stats", f"""WITH {LOG}, x AS (SELECT *, TRY_CAST(nullif(regexp_extract(msg, 'FPS=([0-9.]+)', 1), '') AS DOUBLE) AS fps, nullif(regexp_extract(msg, 'GID=(\\d+)\\s+Folder ready', 1), '') AS gid FROM lg)
SELECT mission_id, count(*) AS log_lines, count(fps) AS frames, count(DISTINCT gid) AS gids, arg_max(fps, line_no) FILTER (fps IS NOT NULL) AS fps_last, min(fps) AS fps_min, max(fps) AS fps_max FROM x GROUP BY 1""", "mission_log")
def _(t):
    return logs.log_stats(logs.parse_lines(t("mission_log")))


@query("level_counts", f"WITH {LOG} SELECT mission_id, level, count(*) AS lines FROM lg GROUP BY 1, 2", "mission_log")
def _(t):
    return logs.level_counts(logs.parse_lines(t("mission_log")))


@query("mission_summary", _SQ + f""", {LOG}, f AS (SELECT mission_id, count(*) AS frames, avg(v) AS fa, min(v) AS fps_min, max(v) AS fps_max FROM (SELECT mission_id, CAST(regexp_extract(msg, 'FPS=([0-9.]+)', 1) AS DOUBLE) AS v FROM lg WHERE level = 'FRAME') GROUP BY 1),
 q1 AS (SELECT *, CASE WHEN NOT ((x1+x2)/2 BETWEEN 192 AND 1728 AND (y1+y2)/2 BETWEEN 108 AND 972) THEN 'fov' WHEN crop_x2 <= crop_x1 OR crop_y2 <= crop_y1 THEN 'invalid' WHEN sharpness < 20 THEN 'blur' WHEN brightness < 30 OR contrast < 10 THEN 'shadow' END AS rr FROM crop),
 d AS (SELECT mission_id, count(*) AS detections_raw, count(*) FILTER (rr IS NULL) AS detections_final, count(*) FILTER (rr = 'fov') AS fov_rejects, count(*) FILTER (rr = 'blur') AS blur_rejects, count(*) FILTER (rr = 'shadow') AS shadow_rejects, count(*) FILTER (rr = 'invalid') AS invalid_rejects FROM q1 GROUP BY 1),
 g AS (SELECT mission_id, count(*) FILTER (event = 'new') AS gids_created, count(*) FILTER (event = 'merge') AS gallery_merges FROM buffers GROUP BY 1)
SELECT mission_id, frames, {rs('fa')} AS fps_avg, fps_min, fps_max, * EXCLUDE (mission_id, frames, fa, fps_min, fps_max) FROM f FULL JOIN d USING (mission_id) FULL JOIN g USING (mission_id)""", "detections mission_log buffers")
def _(t):
    lg = logs.parse_lines(t("mission_log"))
    frames = lg.filter("level = 'FRAME'").withColumn("fps", text.fps_value("msg"))
    d = dt.quality_gates(dt.square_expand(t("detections")))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    d = d.withColumn("reject_reason", F.when(~(cx.between(192, 1728) & cy.between(108, 972)), "fov").otherwise(F.col("reject_reason")))
    s = logs.mission_summary(frames, d, t("buffers"))
    return s.withColumn("fps_avg", r("fps_avg"))


@query("run_stats", f"""WITH p AS (SELECT mission_id, frame, t AS t0, t + 0.01 * (frame % 9) AS t1 FROM frames)
SELECT mission_id, count(*) AS frames, {rs('count(*) / (max(t1) - min(t0))')} AS fps, {rs('avg((t1-t0)*1000)')} AS latency_avg_ms, {rs('max((t1-t0)*1000)')} AS latency_max_ms, {rs('arg_max((t1-t0)*1000, frame)')} AS latency_last_ms FROM p GROUP BY 1""", "frames")
def _(t):
    p = t("frames").select("mission_id", "frame", F.col("t").alias("t0"), (F.col("t") + 0.01 * (F.col("frame") % 9)).alias("t1"))
    s = logs.run_stats(p)
    return s.select("mission_id", "frames", *[r(c).alias(c) for c in s.columns[2:]])


_GAL = """WITH k AS (SELECT mission_id, tid, frame, conf, sharpness, row_number() OVER (PARTITION BY mission_id, tid ORDER BY frame DESC) AS a, row_number() OVER (PARTITION BY mission_id, tid ORDER BY conf DESC, frame) AS b,
 row_number() OVER (PARTITION BY mission_id, tid ORDER BY sharpness DESC, frame) AS c FROM observations)"""


@query("build_gallery", _GAL + " SELECT mission_id, tid, frame FROM k WHERE a <= 15 OR b <= 15 OR c <= 15", "observations")
def _(t):
    return idn.build_gallery(t("observations")).select("mission_id", "tid", "frame")


@query("merge_gallery", """WITH o AS (SELECT mission_id, tid AS gid, frame, conf, sharpness, CASE WHEN frame % 2 = 0 THEN 0 ELSE 1 END AS side FROM observations),
 k AS (SELECT *, row_number() OVER (PARTITION BY mission_id, gid, side ORDER BY frame DESC) AS a, row_number() OVER (PARTITION BY mission_id, gid ORDER BY conf DESC, side, frame) AS b,
 row_number() OVER (PARTITION BY mission_id, gid ORDER BY sharpness DESC, side, frame) AS c FROM o)
SELECT mission_id, gid, frame, 'recent' AS slice FROM k WHERE side = 1 AND a <= 15 UNION ALL SELECT mission_id, gid, frame, 'conf' FROM k WHERE b <= 15 UNION ALL SELECT mission_id, gid, frame, 'sharp' FROM k WHERE c <= 15""", "observations")
def _(t):
    o = t("observations").select("mission_id", F.col("tid").alias("gid"), "frame", "conf", "sharpness")
    return idn.merge_gallery(o.filter("frame % 2 = 0"), o.filter("frame % 2 = 1")).select("mission_id", "gid", "frame", "slice")


@query("representative", f"SELECT mission_id, tid, arg_max(frame, sharpness * 1e7 - frame) AS frame, {rs('max(sharpness)')} AS sharpness FROM observations GROUP BY 1, 2", "observations")
def _(t):
    return idn.representative(t("observations")).select("mission_id", "tid", "frame", r("sharpness").alias("sharpness"))


_SUM = """count(*) AS updates, arg_max(tid, update_no) AS tid, arg_max(cumulative_gallery, update_no) AS gallery_size, {bc} AS best_conf, max(best_sharpness) AS best_sharpness, min(first_frame) AS first_frame, max(last_frame) AS last_frame"""


@query("gid_summary", f"SELECT mission_id, gid, arg_max(event, update_no) AS event, {_SUM.format(bc=rs('max(best_conf)'))} FROM buffers GROUP BY 1, 2", "buffers")
def _(t):
    return idn.gid_summary(t("buffers")).withColumn("best_conf", r("best_conf"))


@query("gid_summary_asof", f"SELECT mission_id, gid, arg_max(event, update_no) AS event, {_SUM.format(bc=rs('max(best_conf)'))} FROM buffers WHERE update_no <= 2 GROUP BY 1, 2", "buffers")
def _(t):
    return idn.gid_summary_asof(t("buffers"), 2).withColumn("best_conf", r("best_conf"))


@query("gid_history", f"""SELECT mission_id, gid, update_no, event, count(*) OVER w AS updates, tid, cumulative_gallery AS gallery_size, {rs('max(best_conf) OVER w')} AS best_conf, max(best_sharpness) OVER w AS best_sharpness,
 min(first_frame) OVER w AS first_frame, max(last_frame) OVER w AS last_frame FROM buffers WINDOW w AS (PARTITION BY mission_id, gid ORDER BY update_no)""", "buffers")
def _(t):
    return idn.gid_summary_asof(t("buffers")).withColumn("best_conf", r("best_conf"))


@query("gid_notices", """WITH s AS (SELECT mission_id, gid, update_no AS seq, (update_no + 1) // 2 AS updates FROM buffers), l AS (SELECT *, lag(updates) OVER (PARTITION BY mission_id, gid ORDER BY seq) AS p FROM s)
SELECT mission_id, gid, seq, CASE WHEN p IS NULL THEN 'found' ELSE 'again' END AS kind, 'Casualty ' || gid || CASE WHEN p IS NULL THEN ' found' ELSE ' seen again' END AS text FROM l WHERE p IS NULL OR p <> updates""", "buffers")
def _(t):
    s = t("buffers").select("mission_id", "gid", F.col("update_no").alias("seq"), F.floor((F.col("update_no") + 1) / 2).alias("updates"))
    return idn.gid_notices(s).select("mission_id", "gid", "seq", "kind", "text")


@query("gid_crops", """WITH c AS (SELECT DISTINCT mission_id, gid FROM buffers), f AS (SELECT mission_id, gid, 'gid_' || gid || '/crop_frame_' || printf('%06d', CAST(last_frame AS INTEGER)) || '.jpg' AS crop FROM buffers)
SELECT mission_id, gid, crop, row_number() OVER (PARTITION BY mission_id, gid ORDER BY crop) AS crop_no, CAST(regexp_extract(crop, '(\\d+)\\.jpg', 1) AS BIGINT) AS frame FROM c JOIN f USING (mission_id, gid)""", "buffers")
def _(t):
    b = t("buffers")
    crops = b.select("mission_id", "gid", F.format_string("gid_%d/crop_frame_%06d.jpg", "gid", "last_frame").alias("crop"))
    d = idn.gid_crops(b.select("mission_id", "gid").distinct(), crops)
    return d.select("mission_id", "gid", "crop", F.col("crop_no").cast("bigint").alias("crop_no"), text.crop_frame("crop").alias("frame"))


@query("median_position", f"SELECT mission_id, tid, {rs('quantile_cont(lat, 0.5)',9)} AS lat, {rs('quantile_cont(lon, 0.5)',9)} AS lon FROM observations GROUP BY 1, 2", "observations")
def _(t):
    return idn.median_position(t("observations")).select("mission_id", "tid", r("lat", 9).alias("lat"), r("lon", 9).alias("lon"))


@query("centroid", f"""WITH e AS (SELECT mission_id, tid, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM observations), m AS (SELECT mission_id, tid, i, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY 1, 2, 3)
SELECT mission_id, tid, CAST(i - 1 AS INTEGER) AS i, {rs('v / sqrt(sum(v*v) OVER (PARTITION BY mission_id, tid))',5)} AS v FROM m""", "observations")
def _(t):
    c = idn.centroid(t("observations"))
    return c.select("mission_id", "tid", F.posexplode("centroid").alias("i", "v")).select("mission_id", "tid", "i", r("v", 5).alias("v"))


@query("rank_by_distance", f"""WITH p AS (SELECT n_nationkey AS probe_id, 28.75 + n_nationkey * 0.00001 AS plat, 77.11 AS plon FROM nation)
SELECT probe_id, vec_id AS gid, {rs(hav('lat','lon','plat','plon',6371008.8),4)} AS distance,
 CAST(row_number() OVER (PARTITION BY probe_id ORDER BY {hav('lat','lon','plat','plon',6371008.8)} NULLS LAST, vec_id) AS INTEGER) AS rank FROM (SELECT frame AS vec_id, CASE WHEN frame % 20 = 0 THEN NULL ELSE lat END AS lat, lon FROM observations), p""", "observations")
def _(t):
    g = t("observations").select(F.col("frame").alias("gid"), F.when(F.col("frame") % 20 != 0, F.col("lat")).alias("lat"), "lon")
    p = t("nation").select(F.col("n_nationkey").alias("probe_id"), (28.75 + F.col("n_nationkey") * 0.00001).alias("lat"), F.lit(77.11).alias("lon"))
    return idn.rank_by_distance(g, p).select("probe_id", "gid", r("distance", 4).alias("distance"), "rank")


@query("nearest_gid", f"""WITH g AS (SELECT frame AS gid, lat, lon FROM observations WHERE frame % 20 <> 0), p AS (SELECT l_orderkey * 8 + l_linenumber AS probe_id, 28.75 + l_partkey % 3001 * 0.0000013 + 0.0000000137 AS plat, 77.11 + l_suppkey % 997 * 0.0000017 + 0.0000000071 AS plon FROM lineitem WHERE l_linenumber = 1),
 d AS (SELECT probe_id, gid, {hav('lat','lon','plat','plon',6371008.8)} AS distance FROM g, p)
SELECT probe_id, arg_min(gid, distance) AS gid, {rs('min(distance)', 4)} AS distance FROM d GROUP BY 1""", "observations")
def _(t):
    g = t("observations").select(F.col("frame").alias("gid"), F.when(F.col("frame") % 20 != 0, F.col("lat")).alias("lat"), "lon")
    p = t("lineitem").filter("l_linenumber = 1").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("probe_id"), (28.75 + F.col("l_partkey") % 3001 * 0.0000013 + 0.0000000137).alias("lat"),
                                                        (77.11 + F.col("l_suppkey") % 997 * 0.0000017 + 0.0000000071).alias("lon"))
    return idn.nearest_gid(g, p).select("probe_id", "gid", r("distance", 4).alias("distance"))


@query("append_new_crops", """WITH o AS (SELECT mission_id, tid AS gid, frame, printf('%.2f', conf) AS c, CAST(trunc(sharpness) AS BIGINT) AS s FROM observations)
SELECT mission_id, gid, frame FROM o WHERE NOT (frame % 3 = 0)""", "observations")
def _(t):
    o = t("observations").select("mission_id", F.col("tid").alias("gid"), "frame", "conf", "sharpness")
    return idn.append_new_crops(o, o.filter("frame % 3 = 0")).select("mission_id", "gid", "frame")
