"""Registered queries: the parsing and pairing half of the file readers, over text made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from aerotrace.functions import text
from aerotrace.operators import identities as idn
from aerotrace.operators.runtime import ensure_checkpoint_dir
from aerotrace.plans.registry import query, r, rs
from aerotrace.sources import flight_logs as fl
from aerotrace.sources import runs


def strings(t):
    d = t("telemetry")
    s = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(" "), F.col(c).cast("string")))
    return d.select("mission_id", s("t").alias("t_mono_s"), s("lat").alias("lat_deg"), s("lon").alias("lon_deg"), s("alt").alias("alt_rel_m"), s("roll").alias("roll_deg"),
                    F.when(F.col("yaw") % 40 == 0, "n/a").otherwise(s("pitch")).alias("pitch_deg"), s("yaw").alias("yaw_deg"), s("zoom").alias("zoom_ratio"))


@query("flight_log_strict", f"SELECT mission_id, {rs('t')} AS t, {rs('lat',7)} AS lat, zoom FROM telemetry WHERE lat IS NOT NULL AND yaw % 40 <> 0", "telemetry")
def _(t):
    good, _ = fl.parse_strict(strings(t), F.col("mission_id"))
    return good.select("mission_id", r("t").alias("t"), r("lat", 7).alias("lat"), "zoom")


@query("flight_log_rejects", "SELECT mission_id, count(*) FILTER (lat IS NOT NULL AND yaw % 40 <> 0) AS kept, count(*) FILTER (lat IS NULL OR yaw % 40 = 0) AS skipped, count(*) FILTER (lat IS NULL) AS bad_lat, count(*) FILTER (yaw % 40 = 0) AS bad_pitch FROM telemetry GROUP BY 1", "telemetry")
def _(t):
    return fl.reject_counts(*fl.parse_strict(strings(t), F.col("mission_id"))).select("mission_id", "kept", "skipped", "bad_lat", "bad_pitch")


@query("flight_log_aliased", f"SELECT mission_id, {rs('t')} AS t, {rs('lat',7)} AS lat, {rs('yaw')} AS heading FROM telemetry WHERE lat <> 0", "telemetry")
def _(t):
    d = strings(t).withColumnsRenamed({"t_mono_s": " Timestamp_Sec", "lat_deg": "drone_lat", "lon_deg": "Drone_Lon", "alt_rel_m": "altitude"})
    return fl.parse_aliased(d, F.col("mission_id")).select("mission_id", r("t").alias("t"), r("lat", 7).alias("lat"), r("heading").alias("heading"))


def record_text(t):
    f = lambda k, v: F.concat(F.rpad(F.lit(k), 20, " "), F.lit(": "), v)
    b = t("buffers").withColumn("first_text", F.coalesce(F.col("first_frame").cast("string"), F.lit("None")))
    block = F.concat_ws("\n", F.lit("-" * 52), F.format_string("BUFFER %s   TID=%d", F.upper("event"), "tid"), F.lit("-" * 52),
                        f("ROS Assignment Time", F.format_string("%.3f sec", F.col("last_frame") / 30.0)), F.lit(""), f("Cumulative Gallery", F.col("cumulative_gallery").cast("string")),
                        f("First Frame", F.col("first_text")), f("Last Frame", F.col("last_frame").cast("string")), f("Best Confidence", F.format_string("%.4f", "best_conf")),
                        f("Best Sharpness", F.format_string("%.2f", "best_sharpness")), F.lit(""), F.lit("------------ This Buffer's Entries ------------"),
                        F.lit("Frame      Conf      Sharpness      Latitude      Longitude"),
                        F.format_string("%06d    %.4f    %8.2f    28.75    77.11", "last_frame", "best_conf", "best_sharpness"), F.lit(""))
    g = b.withColumn("block", block).groupBy("mission_id", "gid").agg(F.array_sort(F.collect_list(F.struct("update_no", "block"))).alias("x"))
    head = F.concat_ws("\n", F.lit("=" * 52), F.lit("GLOBAL IDENTITY RECORD"), F.lit("=" * 52), F.lit(""), f("GID", F.col("gid").cast("string")), f("Mission Folder", F.col("mission_id")), F.lit(""),
                       F.lit("FINAL GPS (medoid)"), f("Final GPS Samples", F.size("x").cast("string")), f("Final GPS Latitude", F.lit("28.75")), F.lit(""))
    return g.select("mission_id", "gid", F.concat_ws("\n", head, F.array_join(F.transform("x", lambda e: e["block"]), "\n")).alias("value"))


@query("identity_headers", "SELECT mission_id, gid, count(*) AS samples, 28.75::DOUBLE AS latitude FROM buffers GROUP BY 1, 2", "buffers")
def _(t):
    h, _, _ = runs.parse_identity_text(record_text(t).withColumnRenamed("gid", "rec"), ["mission_id", "rec"])
    return h.select("mission_id", "gid", "samples", "latitude")


@query("identity_buffers", f"SELECT mission_id, gid, row_number() OVER (PARTITION BY mission_id, gid ORDER BY update_no) AS buffer_no, event, tid, first_frame, last_frame, {rs('best_conf',4)} AS best_confidence, {rs('last_frame/30.0',3)} AS ros_assignment_time FROM buffers", "buffers")
def _(t):
    _, b, _ = runs.parse_identity_text(record_text(t), ["mission_id", "gid"])
    return b.select("mission_id", "gid", F.col("buffer_no").cast("bigint").alias("buffer_no"), "event", "tid", "first_frame", "last_frame", r("best_confidence", 4).alias("best_confidence"), r("ros_assignment_time", 3).alias("ros_assignment_time"))


@query("identity_entries", f"SELECT mission_id, gid, last_frame AS frame, {rs('best_conf',4)} AS conf, {rs('best_sharpness',2)} AS sharpness, 28.75::DOUBLE AS lat FROM buffers", "buffers")
def _(t):
    _, _, e = runs.parse_identity_text(record_text(t), ["mission_id", "gid"])
    return e.select("mission_id", "gid", "frame", r("conf", 4).alias("conf"), r("sharpness", 2).alias("sharpness"), "lat")


@query("gid_record", f"""SELECT mission_id, gid, arg_max(event, update_no) AS event, count(*) AS updates, arg_max(tid, update_no) AS tid, 28.75::DOUBLE AS lat, CAST(NULL AS DOUBLE) AS lon, count(*) AS gps_samples,
 arg_max(cumulative_gallery, update_no) AS gallery_size, {rs('max(best_conf)', 4)} AS best_conf, {rs('max(best_sharpness)', 2)} AS best_sharpness, min(first_frame) AS first_frame, max(last_frame) AS last_frame,
 {rs('arg_max(last_frame, update_no)/30.0', 3)} AS ros_time, count(*) AS entries, count(DISTINCT last_frame) AS crops, CASE WHEN gid % 2 = 0 THEN 'gid_' || gid || '/representative.jpg?v=' || count(*) END AS representative
 FROM buffers GROUP BY mission_id, gid""", "buffers")
def _(t):
    parts = runs.parse_identity_text(record_text(t).withColumnRenamed("gid", "rec"), ["mission_id", "rec"])
    b = t("buffers").withColumnRenamed("gid", "rec")
    files = b.select("mission_id", "rec", F.format_string("crop_frame_%06d.jpg", "last_frame").alias("name")).unionByName(b.filter("rec % 2 = 0").select("mission_id", "rec", F.lit("representative.jpg").alias("name")))
    d = idn.gid_record(*parts, files, ["mission_id", "rec"])
    return d.select("mission_id", "gid", "event", "updates", "tid", "lat", "lon", "gps_samples", "gallery_size", r("best_conf", 4).alias("best_conf"), r("best_sharpness", 2).alias("best_sharpness"), "first_frame", "last_frame",
                    r("ros_time", 3).alias("ros_time"), "entries", "crops", "representative")


@query("gid_track", f"SELECT mission_id, gid, row_number() OVER (PARTITION BY mission_id, gid ORDER BY update_no) AS track_no, last_frame AS frame, {rs('best_conf',4)} AS conf FROM buffers", "buffers")
def _(t):
    _, _, e = runs.parse_identity_text(record_text(t), ["mission_id", "gid"])
    return idn.gid_track(e, ["mission_id", "gid"]).select("mission_id", "gid", F.col("track_no").cast("bigint").alias("track_no"), "frame", r("conf", 4).alias("conf"))


@query("concat_datasets", "SELECT doc_id, lang, CAST(0 AS INTEGER) AS part, CAST(NULL AS BIGINT) AS quality FROM documents UNION ALL SELECT doc_id, CAST(NULL AS VARCHAR), 1, CAST(quality AS BIGINT) FROM labels")
def _(t):
    return runs.concat_datasets([t("documents").select("doc_id", "lang"), t("labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))]).select("doc_id", "lang", "part", "quality")


@query("format_log", "SELECT '[' || rpad(CASE event_type WHEN 'view' THEN 'FRAME' WHEN 'error' THEN 'ERROR' ELSE 'OK' END, 7, ' ') || '] n=' || event_id AS \"value\" FROM events")
def _(t):
    e = t("events").select(F.when(F.col("event_type") == "view", "FRAME").when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("level"), F.concat(F.lit("n="), F.col("event_id").cast("string")).alias("msg"))
    return runs.format_log(e)


_FILES = "f AS (SELECT 'd' || p_partkey // 4 AS dir, CASE p_partkey % 4 WHEN 0 THEN 'a.mp4' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'a.csv' ELSE 'z.csv' END WHEN 2 THEN 'b.MP4' ELSE CASE WHEN p_size % 3 = 0 THEN 'y.csv' ELSE 'notes.txt' END END AS name FROM part)"


@query("pair_recordings", f"""WITH {_FILES}, c AS (SELECT dir, name FROM f WHERE name LIKE '%.csv'), l AS (SELECT dir, min(name) AS lone FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT v.dir, v.name AS video, coalesce(c.name, lone) AS log FROM f v LEFT JOIN c ON c.dir = v.dir AND split_part(c.name, '.', 1) = split_part(v.name, '.', 1) LEFT JOIN l ON l.dir = v.dir WHERE lower(v.name) LIKE '%.mp4'""")
def _(t):
    k = F.col("p_partkey")
    name = (F.when(k % 4 == 0, "a.mp4").when(k % 4 == 1, F.when(F.col("p_size") % 2 == 0, "a.csv").otherwise("z.csv")).when(k % 4 == 2, "b.MP4")
            .otherwise(F.when(F.col("p_size") % 3 == 0, "y.csv").otherwise("notes.txt")))
    return runs.pair_recordings(t("part").select(F.concat(F.lit("d"), F.floor(k / 4).cast("string")).alias("dir"), name.alias("name")))


def images(t):
    k = F.col("p_partkey")
    s = k.cast("string")
    img = t("part").select(F.concat(F.lit("seq"), (k % 20).cast("string"), F.lit("/Images/"), s, F.lit(".png")).alias("path"))
    lbl = t("part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("seq"), (k % 20).cast("string"), F.lit("/Labels/"), s, F.lit(".tif")).alias("path"))
    return img.unionByName(lbl)


@query("pair_images_labels", "SELECT 'seq' || p_partkey % 20 || '/Images/' || p_partkey || '.png' AS image, 'seq' || p_partkey % 20 || '/Labels/' || p_partkey || '.tif' AS label FROM part WHERE p_partkey % 3 <> 0")
def _(t):
    return runs.pair_images_labels(images(t), runs.LAYOUTS["uavid"]).select("image", "label")


@query("split_dataset")
def _(t):
    return runs.split_dataset(runs.pair_images_labels(images(t), runs.LAYOUTS["uavid"]), None, runs.LAYOUTS["uavid"], seed=3).select("image", "split")


@query("split_by_lists", "SELECT 'seq' || p_partkey % 20 || '/Images/' || p_partkey || '.png' AS image, CASE WHEN p_partkey % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0")
def _(t):
    lists = t("part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("stem"), F.when(F.col("p_partkey") % 10 == 1, "val").otherwise("train").alias("split"))
    return runs.split_dataset(runs.pair_images_labels(images(t), runs.LAYOUTS["uavid"]), lists, runs.LAYOUTS["uavid"]).select("image", "split")


@query("scene_manifest", """WITH s AS (SELECT 'g' || p_partkey % 7 AS grp, 's' || p_partkey // 4 AS scene, p_partkey % 4 AS k, p_size FROM part), ok AS (SELECT grp, scene FROM (SELECT 'g' || (p_partkey // 4) % 7 AS grp, 's' || p_partkey // 4 AS scene, p_partkey % 4 AS k, p_size FROM part) GROUP BY 1, 2
 HAVING bool_or(k = 0) AND bool_or(k = 1 AND p_size % 5 <> 0)), pc AS (SELECT 'g' || (p_partkey // 4) % 7 AS grp, 's' || p_partkey // 4 AS scene, 'g' || (p_partkey // 4) % 7 || '/s' || p_partkey // 4 || '/depth_vis/' || p_partkey || '.JPG' AS picture FROM part WHERE p_partkey % 4 > 1)
SELECT grp AS "group", scene, picture, CASE WHEN picture IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY grp, scene ORDER BY picture) AS INTEGER) END AS picture_no FROM ok LEFT JOIN pc USING (grp, scene)""")
def _(t):
    k = F.col("p_partkey")
    scene = F.floor(k / 4)
    rest = (F.when(k % 4 == 0, "scene.glb").when((k % 4 == 1) & (F.col("p_size") % 5 != 0), "scene.jpg").when(k % 4 > 1, F.concat(F.lit("depth_vis/"), k.cast("string"), F.lit(".JPG"))).otherwise("x.txt"))
    return runs.scene_manifest(t("part").select(F.concat_ws("/", F.concat(F.lit("g"), (scene % 7).cast("string")), F.concat(F.lit("s"), scene.cast("string")), rest).alias("path")))


@query("parse_poses", f"SELECT scene * 50 + view AS frame, {rs('cos(a)')} AS m00, {rs('-(cos(a)*x+sin(a)*y)',5)} AS tx FROM pose_pairs", "pose_pairs")
def _(t):
    p = t("pose_pairs").select((F.col("scene") * 50 + F.col("view")).cast("string").alias("Frame_ID"), F.col("x").cast("string").alias("tx"), F.col("y").cast("string").alias("ty"), F.lit("0.5").alias("tz"),
                               F.lit("0").alias("qx"), F.lit("0").alias("qy"), F.sin(F.col("a") / 2).cast("string").alias("qz"), F.cos(F.col("a") / 2).cast("string").alias("qw"))
    d = runs.parse_poses(p, "c2w")
    return d.select("frame", r(F.col("m")[0]).alias("m00"), r(F.col("m")[3], 5).alias("tx"))


@query("parse_goals", """SELECT event_id, 'rejected' AS status, 'goal needs lat+lon (or x+y)' AS reason FROM goals WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 'accepted', NULL FROM goals WHERE event_id % 4 = 1
 UNION ALL SELECT event_id, 'rejected', 'unknown cmd: jump' FROM goals WHERE event_id % 4 = 2 UNION ALL SELECT event_id, 'rejected', 'malformed JSON' FROM goals WHERE event_id % 4 = 3""", "goals")
def _(t):
    k = F.col("event_id")
    p = (F.when(k % 4 == 0, F.col("payload")).when(k % 4 == 1, F.format_string('{"lat": 28.%d, "lon": "77.1", "yaw": 1}', k))
         .when(k % 4 == 2, '{"cmd": "jump"}').otherwise('{"cmd": '))
    g = text.parse_goals(t("goals").withColumn("payload", p))
    return g.select("event_id", "status", "reason")


def store(t, name: str) -> str:
    """A new folder for a store that a query writes and reads back."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("metric_store", "SELECT dataset || '.' || run AS dataset, mode, scene, metric, max(value) AS value FROM metrics GROUP BY 1, 2, 3, 4", "metrics")
def _(t):
    m = t("metrics").withColumn("dataset", F.concat_ws(".", "dataset", "run"))
    m, path = m.groupBy("dataset", "mode", "scene", "metric").agg(F.max("value").alias("value")), store(t, "metrics")
    runs.write_metrics(m.filter("mode <> 'F'"), path)
    runs.write_metrics(m.filter("mode = 'F'"), path)
    return runs.load_metrics(t.spark, path)


@query("buffer_store", "SELECT mission_id, gid, update_no, last_frame FROM buffers", "buffers")
def _(t):
    b, path = t("buffers").select("mission_id", "gid", "update_no", "last_frame"), store(t, "buffers")
    runs.write_buffers(b.filter("update_no = 1"), path)
    runs.write_buffers(b.filter("update_no > 1"), path)
    return t.spark.read.parquet(path).select("mission_id", "gid", "update_no", "last_frame")


@query("prediction_store", "SELECT scene, view, u, v, depth, conf FROM depth_px", "depth_px")
def _(t):
    path = store(t, "predictions")
    runs.write_predictions(t("depth_px").select("scene", "view", "u", "v", "depth", "conf"), path)
    return t.spark.read.parquet(path).select("scene", "view", "u", "v", "depth", "conf")
