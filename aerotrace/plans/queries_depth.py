"""Registered queries: depth maps, clouds, poses, LiDAR and appearance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerotrace.functions import rotations as rot
from aerotrace.functions import vectors as vec
from aerotrace.operators import clouds as cd
from aerotrace.operators import clusters as cl
from aerotrace.operators import depth as dp
from aerotrace.operators import embeddings as em
from aerotrace.operators import identities as idn
from aerotrace.operators import lidar as ld
from aerotrace.operators import telemetry as tm
from aerotrace.operators.runtime import cut
from aerotrace.plans.registry import hav, query, r, rs

PX = "scene, view, u, v"


def cams(t):
    one, zero = F.lit(1.0), F.lit(0.0)
    eye = [[one, zero, zero], [zero, one, zero], [zero, zero, one]]
    return t("cameras").withColumn("m", rot.mat4(eye, ["tx", 0.0, 0.0]))


@query("valid_depth", f"""WITH p AS (SELECT scene, view, quantile_cont(conf, 0.1) AS thr FROM depth_px GROUP BY 1, 2), d AS (SELECT x.*, sky < 0.5 AND conf >= thr AS ok FROM depth_px x JOIN p USING (scene, view)),
 s AS (SELECT scene, view, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS sh FROM d GROUP BY 1, 2) SELECT {PX}, CASE WHEN sh > 0.02 THEN ok ELSE TRUE END AS valid FROM d JOIN s USING (scene, view)""", "depth_px")
def _(t):
    return dp.valid_depth(t("depth_px")).select("scene", "view", "u", "v", "valid")


@query("fill_sky", f"""WITH p AS (SELECT scene, quantile_cont(depth, 0.98) AS far FROM depth_px WHERE NOT sky >= 0.5 GROUP BY 1)
SELECT {PX}, {rs('CASE WHEN sky >= 0.5 THEN far ELSE depth END')} AS depth, {rs('CASE WHEN sky >= 0.5 THEN 1.0 ELSE conf END')} AS conf FROM depth_px JOIN p USING (scene)""", "depth_px")
def _(t):
    return dp.fill_sky(t("depth_px")).select("scene", "view", "u", "v", r("depth").alias("depth"), r("conf").alias("conf"))


@query("mask_background", f"SELECT {PX}, {rs('CASE WHEN greatest(red,green,blue) < 16 OR least(red,green,blue) >= 240 THEN 1.0 ELSE conf END')} AS conf FROM depth_px", "depth_px")
def _(t):
    return dp.mask_background(t("depth_px")).select("scene", "view", "u", "v", r("conf").alias("conf"))


@query("mask_depth", f"SELECT {PX}, CASE WHEN NOT (red % 7 = 0) AND green % 11 <> 0 THEN {rs('depth * 2.0')} END AS depth FROM depth_px", "depth_px")
def _(t):
    d = t("depth_px")
    gt = d.select("scene", "view", "u", "v", (F.col("red") % 7 == 0).alias("occluded"), F.when(F.col("green") % 11 == 0, 0.0).otherwise(3.0).alias("gt_depth"))
    return dp.mask_depth(d, gt, scale=2.0).select("scene", "view", "u", "v", r("depth").alias("depth"))


@query("drop_denied", """WITH i AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'relief' WHEN 1 THEN 'electro' ELSE 'office' END AS scene, 'DSC_' || CAST(p_partkey % 500 AS VARCHAR) || '.JPG' AS image FROM part)
SELECT p_partkey FROM i WHERE NOT (scene = 'relief' AND p_partkey % 500 BETWEEN 427 AND 438)""")
def _(t):
    s = F.when(F.col("p_size") % 3 == 0, "relief").when(F.col("p_size") % 3 == 1, "electro").otherwise("office")
    i = t("part").select("p_partkey", s.alias("scene"), F.concat(F.lit("DSC_"), (F.col("p_partkey") % 500).cast("string"), F.lit(".JPG")).alias("image"))
    return dp.drop_denied(i).select("p_partkey")


@query("depth_stats", f"SELECT scene, view, {rs('min(depth)')} AS lo, {rs('max(depth)')} AS hi, {rs('avg(depth)')} AS mean FROM depth_px GROUP BY 1, 2", "depth_px")
def _(t):
    return dp.depth_stats(t("depth_px")).select("scene", "view", r("depth_min").alias("lo"), r("depth_max").alias("hi"), r("depth_mean").alias("mean"))


@query("stretch", f"""WITH p AS (SELECT scene, view, quantile_cont(depth, 0.02) AS lo, quantile_cont(depth, 0.98) AS hi FROM depth_px GROUP BY 1, 2)
SELECT {PX}, {rs('greatest(0.0, least(1.0, (depth-lo)/(hi-lo)))')} AS norm FROM depth_px JOIN p USING (scene, view)""", "depth_px")
def _(t):
    return dp.stretch(t("depth_px")).select("scene", "view", "u", "v", r("norm").alias("norm"))


@query("rank_norm", f"""WITH e AS (SELECT *, min(depth) OVER w AS lo, max(depth) OVER w AS hi, count(*) OVER w AS n FROM depth_px WINDOW w AS (PARTITION BY scene, view)), b AS (SELECT *, least(65535, floor((depth-lo)*65535/(hi-lo))) AS bin FROM e)
SELECT {PX}, {rs('count(*) OVER (PARTITION BY scene, view ORDER BY bin RANGE UNBOUNDED PRECEDING) / n')} AS norm FROM b""", "depth_px")
def _(t):
    return dp.rank_norm(t("depth_px")).select("scene", "view", "u", "v", r("norm").alias("norm"))


@query("conf_threshold", f"SELECT scene, {rs('least(greatest(1.05, quantile_cont(conf, 0.1)), quantile_cont(conf, 0.9))')} AS threshold FROM depth_px WHERE sky < 0.5 GROUP BY 1", "depth_px")
def _(t):
    return dp.conf_threshold(t("depth_px")).withColumn("threshold", r("threshold"))


@query("least_squares_scale", f"SELECT scene, view, {rs('sum(conf*depth)/greatest(sum(depth*depth),1e-12)')} AS scale FROM depth_px GROUP BY 1, 2", "depth_px")
def _(t):
    return dp.least_squares_scale(t("depth_px").withColumn("metric", F.col("conf")), ["scene", "view"]).withColumn("scale", r("scale"))


_PTS = "pts AS (SELECT d.scene, d.view, d.u, d.v, d.conf, (d.u-c.cx)/c.fx*d.depth - c.tx AS x, (d.v-c.cy)/c.fy*d.depth AS y, d.depth AS z FROM depth_px d JOIN cameras c USING (scene, view) WHERE d.depth > 0)"


@query("unproject_depth", f"WITH {_PTS}, t AS (SELECT scene, least(greatest(1.05, quantile_cont(conf, 0.1)), quantile_cont(conf, 0.9)) AS thr FROM depth_px WHERE sky < 0.5 GROUP BY 1) SELECT {PX}, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z FROM pts JOIN t USING (scene) WHERE conf >= thr", "depth_px cameras")
def _(t):
    d = t("depth_px")
    return dp.unproject_depth(d, cams(t), dp.conf_threshold(d)).select("scene", "view", "u", "v", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


@query("consistent_points", f"""WITH {_PTS}, pr AS (SELECT p.*, c.view AS sv, CAST(round(c.fx*(p.x + c.tx)/p.z + c.cx) AS BIGINT) AS su, CAST(round(c.fy*p.y/p.z + c.cy) AS BIGINT) AS sw FROM pts p JOIN cameras c ON c.scene = p.scene),
 h AS (SELECT pr.scene, pr.view, pr.u, pr.v, s.x AS sx, s.y AS sy, s.z AS sz FROM pr JOIN pts s ON s.scene = pr.scene AND s.view = pr.sv AND s.u = pr.su AND s.v = pr.sw WHERE sqrt((pr.x-s.x)*(pr.x-s.x)+(pr.y-s.y)*(pr.y-s.y)+(pr.z-s.z)*(pr.z-s.z)) < 0.2)
SELECT {PX}, count(*) AS n_views, {rs('avg(sx)')} AS x, {rs('avg(sy)')} AS y, {rs('avg(sz)')} AS z FROM h GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4""", "depth_px cameras")
def _(t):
    return dp.consistent_points(t("depth_px"), cams(t)).select("scene", "view", "u", "v", "n_views", r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


@query("point_observations", f"""WITH {_PTS}, t AS (SELECT scene, quantile_cont(conf, 0.4) AS thr FROM depth_px GROUP BY 1)
SELECT {PX}, row_number() OVER (PARTITION BY scene ORDER BY view, v, u) AS point_id, {rs('u*1920/40.0')} AS orig_u, {rs('v*1080/30.0')} AS orig_v FROM pts JOIN t USING (scene) WHERE conf >= thr""", "depth_px cameras")
def _(t):
    c = cams(t).withColumns({"orig_w": F.lit(1920), "orig_h": F.lit(1080), "model_w": F.lit(40), "model_h": F.lit(30)})
    return dp.point_observations(t("depth_px"), c).select("scene", "view", "u", "v", "point_id", r("orig_u").alias("orig_u"), r("orig_v").alias("orig_v"))


@query("pixel_quality", f"""WITH g AS (SELECT scene*100+view AS image_id, u % 8 AS c, v % 6 AS r, CAST(max(red) AS DOUBLE) AS g FROM depth_px GROUP BY 1, 2, 3), l AS (SELECT *, coalesce(lag(g) OVER a, lead(g) OVER a) + coalesce(lead(g) OVER a, lag(g) OVER a)
 + coalesce(lag(g) OVER b, lead(g) OVER b) + coalesce(lead(g) OVER b, lag(g) OVER b) - 4*g AS lap FROM g WINDOW a AS (PARTITION BY image_id, c ORDER BY r), b AS (PARTITION BY image_id, r ORDER BY c))
SELECT image_id, {rs('var_pop(lap)',4)} AS sharpness, {rs('avg(g)',4)} AS brightness, {rs('stddev_pop(g)',4)} AS contrast FROM l GROUP BY 1""", "depth_px")
def _(t):
    g = t("depth_px").groupBy((F.col("scene") * 100 + F.col("view")).alias("image_id"), (F.col("u") % 8).alias("c"), (F.col("v") % 6).alias("r")).agg(F.max("red").alias("gray"))
    q = dp.pixel_quality(g, 6, 8)
    return q.select("image_id", *[r(c, 4).alias(c) for c in ("sharpness", "brightness", "contrast")])


_NN = "nn AS (SELECT a.scene, a.pt, min(sqrt((a.x-b.gx)*(a.x-b.gx)+(a.y-b.gy)*(a.y-b.gy)+(a.z-b.gz)*(a.z-b.gz))) AS d FROM points a JOIN points b ON a.scene = b.scene GROUP BY 1, 2)"
_NG = "ng AS (SELECT a.scene, a.pt, min(sqrt((a.gx-b.x)*(a.gx-b.x)+(a.gy-b.y)*(a.gy-b.y)+(a.gz-b.z)*(a.gz-b.z))) AS d FROM points a JOIN points b ON a.scene = b.scene GROUP BY 1, 2)"


def truth(t):
    return t("points").select("scene", "pt", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"))


@query("nn_distance", f"WITH {_NN} SELECT scene, pt, {rs('d')} AS distance FROM nn", "points")
def _(t):
    return cd.nn_distance(t("points"), truth(t)).withColumn("distance", r("distance"))


@query("recon_metrics", f"""WITH {_NN}, {_NG}, p AS (SELECT scene, avg(d) AS acc, avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0 END) AS pr FROM nn GROUP BY 1), g AS (SELECT scene, avg(d) AS comp, avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0 END) AS re FROM ng GROUP BY 1)
SELECT scene, {rs('acc')} AS acc, {rs('comp')} AS comp, {rs('(acc+comp)/2')} AS overall, {rs('pr')} AS "precision", {rs('re')} AS recall, {rs('2*pr*re/(pr+re)')} AS fscore FROM p JOIN g USING (scene)""", "points")
def _(t):
    m = cd.recon_metrics(t("points"), truth(t))
    return m.select("scene", *[r(c).alias(c) for c in ("acc", "comp", "overall", "precision", "recall", "fscore")])


@query("truncated_mean", f"WITH {_NN} SELECT scene, {rs('avg(d)')} AS mean FROM nn WHERE d < 0.06 GROUP BY 1", "points")
def _(t):
    return cd.truncated_mean(cd.nn_distance(t("points"), truth(t), max_r=0.5), 0.06).withColumn("mean", r("mean"))


@query("in_observed_volume", """SELECT scene, pt FROM points WHERE x >= 1 AND x < 10 AND y >= 1 AND y < 10 AND z >= -1 AND z < 6 AND (CAST(round_even((x-2)/0.5,0) AS BIGINT) + CAST(round_even((y-2)/0.5,0) AS BIGINT)) % 2 = 0
 AND CAST(round_even((x-2)/0.5,0) AS BIGINT) BETWEEN 0 AND 20 AND CAST(round_even((y-2)/0.5,0) AS BIGINT) BETWEEN 0 AND 20 AND CAST(round_even((z-0)/0.5,0) AS BIGINT) BETWEEN 0 AND 20 AND x + 2*y - z - 5 > 0""", "points")
def _(t):
    p = t("points")
    seq = lambda: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint")))
    obs = p.select("scene").distinct().withColumn("ix", seq()).withColumn("iy", seq()).withColumn("iz", seq()).filter("(ix + iy) % 2 = 0")
    d = cd.in_observed_volume(p, obs, (2.0, 2.0, 0.0), (8.0, 8.0, 4.0), 0.5, 1.0)
    return cd.above_plane(d, (1.0, 2.0, -1.0, -5.0)).select("scene", "pt")


@query("voxel_down", f"SELECT scene, CAST(floor(x/1.5) AS BIGINT) AS cx, CAST(floor(y/1.5) AS BIGINT) AS cy, CAST(floor(z/1.5) AS BIGINT) AS cz, {rs('avg(x)')} AS x, {rs('avg(y)')} AS y, {rs('avg(z)')} AS z, count(*) AS n FROM points GROUP BY 1, 2, 3, 4", "points")
def _(t):
    return cd.voxel_down(t("points"), 1.5).withColumns({k: r(k) for k in "xyz"})


@query("scene_scale", "SELECT scene, round(sqrt(" + "+".join(f"pow(quantile_cont({k},0.95)-quantile_cont({k},0.05),2)" for k in "xyz") + "), 6) AS scale FROM points GROUP BY 1", "points")
def _(t):
    return cd.scene_scale(t("points")).withColumn("scale", r("scale"))


@query("cap_points")
def _(t):
    return cd.cap_points(t("points"), 300)


@query("sample_frames")
def _(t):
    return cd.hash_sample(t("frames"), 100, ["mission_id"], ["frame"])


@query("thin")
def _(t):
    return cd.thin(t("points"), 0.8)


# Which rows a seeded sample keeps is its own choice; how many, and that they are whole rows of the input and differ, is not.
def _kept(rows, source, by, ids):
    """Rows kept per group, different ones, and those that are no rows of the source."""
    known = source.select(*by, *ids).distinct().withColumn("__known", F.lit(1))
    d = rows.join(known, [*by, *ids], "left").groupBy(*by)
    return d.agg(F.count("*").alias("kept"), F.countDistinct(*ids).alias("different"), F.count_if(F.col("__known").isNull()).alias("foreign"))


@query("cap_points_audit", "SELECT scene, least(300, count(*)) AS kept, least(300, count(*)) AS different, 0 AS \"foreign\" FROM points GROUP BY scene", "points")
def _(t):
    return _kept(cd.cap_points(t("points"), 300), t("points"), ["scene"], ["pt"])


@query("sample_frames_audit", "SELECT mission_id, least(100, count(*)) AS kept, least(100, count(*)) AS different, 0 AS \"foreign\" FROM frames GROUP BY mission_id", "frames")
def _(t):
    return _kept(cd.hash_sample(t("frames"), 100, ["mission_id"], ["frame"]), t("frames"), ["mission_id"], ["frame"])


@query("thin_audit", "SELECT scene, 0 AS uncovered, 0 AS crowded FROM points GROUP BY scene", "points")
def _(t):
    """Points farther than the radius from every kept one, and kept points with another one within it: none of either."""
    p, kept = t("points"), cut(cd.thin(t("points"), 0.8))
    far = cd.nn_distance(p, kept, cell=0.8, max_r=0.8).groupBy("scene").agg(F.count_if(F.col("distance").isNull()).alias("uncovered"))
    box = kept.withColumns({f"b{k}": F.floor(F.col(k) / 0.8) for k in "xyz"})
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    moved = box.withColumn("o", F.explode(shifts)).select("scene", F.col("pt").alias("other"), *[F.col(k).alias(f"o{k}") for k in "xyz"], *[(F.col(f"b{k}") + F.col(f"o.{o}")).alias(f"b{k}") for k, o in zip("xyz", "ijk")])
    near = box.join(moved.hint("merge"), ["scene", "bx", "by", "bz"]).filter("pt <> other AND sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)) <= 0.8")
    crowd = near.groupBy("scene").agg(F.countDistinct("pt").alias("crowded"))
    return far.join(crowd, "scene", "left").select("scene", "uncovered", F.coalesce("crowded", F.lit(0)).alias("crowded"))


def poses(t, a, x, y):
    return t("pose_pairs").select("scene", "view", rot.euler_to_mat(0.0, 0.0, a, x, y, 0.5, radians=True).alias("m"))


_REL = """pr AS (SELECT p.*, f.a AS a0, f.pa AS pa0, f.x AS x0, f.y AS y0, f.px AS px0, f.py AS py0 FROM pose_pairs p JOIN pose_pairs f ON f.scene = p.scene AND f.view = 0),
 ij AS (SELECT i.scene, i.view AS i, j.view AS j, abs((j.pa-j.a)-(i.pa-i.a)) AS dr, i.a0, i.pa0, i.x0, i.y0, i.px0, i.py0, j.a-i.a AS ra, j.pa-i.pa AS rp,
   cos(i.a)*(j.x-i.x)+sin(i.a)*(j.y-i.y) AS gx, -sin(i.a)*(j.x-i.x)+cos(i.a)*(j.y-i.y) AS gy, cos(i.pa)*(j.px-i.px)+sin(i.pa)*(j.py-i.py) AS qx, -sin(i.pa)*(j.px-i.px)+cos(i.pa)*(j.py-i.py) AS qy FROM pr i JOIN pr j ON i.scene = j.scene AND i.view < j.view),
 tt AS (SELECT scene, i, j, least(degrees(dr), 360 - degrees(dr)) AS r_err, cos(a0)*gx-sin(a0)*gy + x0 - (cos(ra)*x0-sin(ra)*y0) AS ux, sin(a0)*gx+cos(a0)*gy + y0 - (sin(ra)*x0+cos(ra)*y0) AS uy,
   cos(pa0)*qx-sin(pa0)*qy + px0 - (cos(rp)*px0-sin(rp)*py0) AS wx, sin(pa0)*qx+cos(pa0)*qy + py0 - (sin(rp)*px0+cos(rp)*py0) AS wy FROM ij),
 te AS (SELECT scene, i, j, r_err, degrees(acos(sqrt(1-greatest(1-pow((ux*wx+uy*wy)/((sqrt(ux*ux+uy*uy)+1e-15)*(sqrt(wx*wx+wy*wy)+1e-15)),2),1e-15)))) AS t0 FROM tt), er AS (SELECT *, least(t0, abs(180-t0)) AS t_err FROM te)"""


@query("pose_errors", f"WITH {_REL} SELECT scene, i, j, {rs('r_err',3)} AS r_err, {rs('t_err',3)} AS t_err FROM er", "pose_pairs")
def _(t):
    e = cd.pose_errors(poses(t, "pa", "px", "py"), poses(t, "a", "x", "y"))
    return e.select("scene", "i", "j", r("r_err", 3).alias("r_err"), r("t_err", 3).alias("t_err"))


@query("pose_auc", f"WITH {_REL}, m AS (SELECT scene, greatest(r_err, t_err) AS e FROM er) SELECT scene, " + ", ".join(
    rs(f"(SELECT avg(s) FROM (SELECT b, (SELECT count(*) FROM m x WHERE x.scene = z.scene AND x.e < b + 1) / (SELECT count(*) FROM m x WHERE x.scene = z.scene) AS s FROM (SELECT unnest(range({k})) AS b)))", 5) + f" AS auc{k:02d}" for k in (3, 5, 15, 30)) + " FROM (SELECT DISTINCT scene FROM m) z", "pose_pairs")
def _(t):
    a = cd.pose_auc(cd.pose_errors(poses(t, "pa", "px", "py"), poses(t, "a", "x", "y")))
    return a.select("scene", *[r(f"auc{k:02d}", 5).alias(f"auc{k:02d}") for k in (3, 5, 15, 30)])


@query("align_first", f"SELECT p.scene, p.view, {rs('cos(p.a-f.a)')} AS m00, {rs('p.x - (cos(p.a-f.a)*f.x - sin(p.a-f.a)*f.y)',5)} AS tx FROM pose_pairs p JOIN pose_pairs f ON f.scene = p.scene AND f.view = 0", "pose_pairs")
def _(t):
    d = cd.align_first(poses(t, "a", "x", "y"))
    return d.select("scene", "view", r(F.col("m")[0]).alias("m00"), r(F.col("m")[3], 5).alias("tx"))


@query("quaternions", f"SELECT scene, view, {rs('cos(a)')} AS m00, {rs('abs(cos(a/2))')} AS qw, {rs('atan2(sin(a),cos(a))',5)} AS yaw, {rs('-(cos(a)*x+sin(a)*y)',5)} AS inv_x FROM pose_pairs", "pose_pairs")
def _(t):
    p = t("pose_pairs").withColumns({"qz": F.sin(F.col("a") / 2), "qw": F.cos(F.col("a") / 2)})
    p = p.withColumn("m", rot.quat_to_mat(0.0, 0.0, "qz", "qw", "x", "y", 0.0))
    p = p.withColumns({"q": rot.mat_to_quat(F.col("m")), "inv": rot.se3_inverse(F.col("m"))})
    return p.select("scene", "view", r(F.col("m")[0]).alias("m00"), r(F.col("q")[3]).alias("qw"), r(rot.quat_yaw(0.0, 0.0, "qz", "qw"), 5).alias("yaw"), r(F.col("inv")[3], 5).alias("inv_x"))


def _pairs(t):
    return t("points").select("scene", F.col("pt").alias("view"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"),
                              (F.col("y") * 2 + 1).alias("ex"), (-F.col("x") * 2 + 3).alias("ey"), (F.col("z") * 2).alias("ez"))


@query("align_sim3")
def _(t):
    m = cd.align_sim3(_pairs(t))
    return m.select("scene", r("s", 4).alias("s"), *[r(F.col("t")[i], 4).alias(f"t{i}") for i in range(3)], *[r(F.col("r")[i], 4).alias(f"r{i}") for i in range(9)])


@query("ransac_sim3")
def _(t):
    m = cd.ransac_sim3(_pairs(t), inlier=0.1)
    return m.select("scene", r("s", 4).alias("s"), *[r(F.col("t")[i], 4).alias(f"t{i}") for i in range(3)])


@query("pca_rgb")
def _(t):
    return cd.pca_rgb(t("embeddings")).select("vec_id", r("r", 4).alias("red"), r("g", 4).alias("green"), r("b", 4).alias("blue"))


# ---- LiDAR ---------------------------------------------------------------------------------

_BU = """bu AS (SELECT seq, beam_no, max(lat_deg) AS lat_deg, max(alt_rel_m) AS alt_rel_m, max(roll_deg) AS roll_deg, max(cam_angle_deg) AS cam_angle_deg, max(cam_range_m) AS cam_range_m, max(d_rel) AS d_rel FROM beams GROUP BY 1, 2)"""
_SW = _BU + """, b AS (SELECT *, seq * 10 + beam_no AS row, lag(lat_deg) OVER w AS pl, lag(alt_rel_m) OVER w AS pa, lag(roll_deg) OVER w AS pr, lag(cam_angle_deg) OVER w AS pc FROM bu WINDOW w AS (ORDER BY seq * 10 + beam_no)),
 sw AS (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> lat_deg OR pa <> alt_rel_m OR pr <> roll_deg OR cam_angle_deg <= pc THEN 1 ELSE 0 END) OVER (ORDER BY row)::BIGINT AS sweep_id FROM b)"""
POSE3 = ("lat_deg", "alt_rel_m", "roll_deg")


def swept(t):
    # the fixture repeats some beams; a scan has each beam once
    b = t("beams").groupBy("seq", "beam_no").agg(*[F.max(c).alias(c) for c in (*POSE3, "cam_angle_deg", "cam_range_m", "d_rel")])
    b = b.withColumn("row", F.col("seq") * 10 + F.col("beam_no"))
    return ld.sessionize(b, pose=POSE3, angle="cam_angle_deg")


def shot(t):
    d = swept(t).filter("cam_range_m IS NOT NULL")
    return d.withColumns({"phi": F.radians("cam_angle_deg"), "range": F.col("cam_range_m"), "zoom": F.lit(1.0)})


@query("sessionize", f"WITH {_SW} SELECT seq, beam_no, sweep_id FROM sw", "beams")
def _(t):
    return swept(t).select("seq", "beam_no", "sweep_id")


@query("sweeps", f"WITH {_SW} SELECT sweep_id, arg_min(lat_deg, row) AS lat_deg, count(cam_range_m) AS n_beams, {rs('sum(cam_range_m)',4)} AS total FROM sw GROUP BY 1", "beams")
def _(t):
    s = ld.sweeps(swept(t), pose=POSE3)
    total = F.aggregate("beams", F.lit(0.0), lambda a, b: a + b["range"])
    return s.select("sweep_id", "lat_deg", F.size("beams").cast("bigint").alias("n_beams"), r(F.when(F.size("beams") > 0, total), 4).alias("total"))


_U = "953.27546 + 1584.02798 * tan(radians(cam_angle_deg))"


@query("beam_pixels", f"WITH {_BU} SELECT seq, beam_no, {rs(_U,4)} AS u, {rs('cam_range_m*cos(radians(cam_angle_deg))')} AS z FROM bu WHERE cam_range_m IS NOT NULL AND {_U} >= 0 AND {_U} < 1920", "beams")
def _(t):
    return ld.beam_pixels(shot(t)).select("seq", "beam_no", r("u", 4).alias("u"), r("z").alias("z"))


@query("fit_depth", f"""WITH {_BU}, d AS (SELECT seq // 8 AS frame, d_rel AS d, cam_range_m * cos(radians(cam_angle_deg)) AS z FROM bu WHERE cam_range_m IS NOT NULL), g AS (SELECT frame, count(*) AS n, quantile_cont(z/d, 0.5) AS med, regr_slope(z, d) AS sa, regr_intercept(z, d) AS sb, max(d)-min(d) AS ptp, avg(d) AS mean FROM d GROUP BY 1),
 f AS (SELECT *, coalesce(n >= 3 AND ptp > 0.3*mean AND sa > 0, FALSE) AS af FROM g), k AS (SELECT frame, n, CASE WHEN af THEN 'affine' ELSE 'scale' END AS mode, CASE WHEN af THEN sa ELSE med END AS a, CASE WHEN af THEN sb ELSE 0.0 END AS b FROM f)
SELECT k.frame, any_value(n) AS n, any_value(mode) AS mode, {rs('any_value(a)',5)} AS a, {rs('any_value(b)',5)} AS b, {rs('sqrt(avg(pow(a*d+b-z,2)))',5)} AS rmse FROM k JOIN d USING (frame) GROUP BY 1""", "beams")
def _(t):
    d = shot(t).select(F.floor(F.col("seq") / 8).alias("frame"), "d_rel", (F.col("range") * F.cos("phi")).alias("z"))
    f = ld.fit_depth(d, ["frame"], "affine")
    return f.select("frame", "n", "mode", *[r(c, 5).alias(c) for c in ("a", "b", "rmse")])


@query("beam_side", f"""WITH {_SW}, g AS (SELECT sweep_id, alt_rel_m % 4 AS grp, radians(cam_angle_deg) AS phi, cam_range_m + 0.013 * beam_no * beam_no AS rg, radians(roll_deg) AS rl, roll_deg, alt_rel_m FROM sw WHERE cam_range_m IS NOT NULL),
 v AS (SELECT grp, sweep_id, stddev_pop(rg*(cos(phi)*cos(rl)+sin(phi)*sin(rl)))/avg(rg*(cos(phi)*cos(rl)+sin(phi)*sin(rl))) AS a, stddev_pop(rg*(cos(phi)*cos(rl)-sin(phi)*sin(rl)))/avg(rg*(cos(phi)*cos(rl)-sin(phi)*sin(rl))) AS b FROM g GROUP BY 1, 2
  HAVING any_value(abs(roll_deg)) >= 2 AND count(*) >= 3 AND min(phi) < -0.2 AND max(phi) > 0.2), s AS (SELECT grp, avg(CASE WHEN a < b THEN 1.0 ELSE 0 END) AS sh, count(*) AS votes FROM v GROUP BY 1)
SELECT grp, CASE WHEN sh > 0.5 THEN 1 ELSE -1 END AS side, {rs('greatest(sh, 1-sh)')} AS share, votes FROM s""", "beams")
def _(t):
    d = shot(t).withColumns({"grp": F.col("alt_rel_m") % 4, "range": F.col("range") + 0.013 * F.col("beam_no") * F.col("beam_no")})
    return ld.beam_side(d, by=["grp"]).select("grp", "side", r("share").alias("share"), "votes")


def _flights(t):
    tele = t("telemetry").select(F.col("mission_id").alias("flight"), (F.col("t") * 100).cast("bigint").alias("frame"), F.col("lat").alias("lat_deg"), F.col("lon").alias("lon_deg"),
                                 F.col("alt").alias("alt_rel_m"), F.col("roll").alias("roll_deg"), F.col("pitch").alias("pitch_deg"), F.col("yaw").alias("yaw_deg"))
    sw = tele.filter("frame % 40 = 0").withColumn("sweep_id", F.col("frame")).drop("frame")
    return sw, tele


# Sweeps are telemetry rows themselves: each is matched to its own row, and one without a position, which is as far from every row, to the row after the sweep before it.
_ALIGNED = """te AS (SELECT mission_id AS flight, CAST(trunc(t * 100) AS BIGINT) AS frame, lat, alt, roll, pitch, row_number() OVER (PARTITION BY mission_id ORDER BY t) AS rn FROM telemetry),
 sw AS (SELECT *, sum(CASE WHEN lat IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY flight ORDER BY frame) AS g FROM te WHERE frame % 40 = 0),
 z AS (SELECT *, coalesce(max(CASE WHEN lat IS NOT NULL THEN rn END) OVER (PARTITION BY flight, g) - 1, 0) + row_number() OVER (PARTITION BY flight, g ORDER BY frame) AS m FROM sw),
 al AS (SELECT z.flight, z.frame AS sweep_id, te.frame, greatest(abs(te.alt - z.alt), abs(te.roll - z.roll), abs(te.pitch - z.pitch)) AS residual FROM z JOIN te ON te.flight = z.flight AND te.rn = z.m)"""


@query("align_sweeps", f"WITH {_ALIGNED} SELECT flight, sweep_id, frame, {rs('residual')} AS residual FROM al", "telemetry")
def _(t):
    sw, tele = _flights(t)
    return ld.align_sweeps(sw, tele).select("flight", "sweep_id", "frame", r("residual").alias("residual"))


@query("alignment_report", f"""WITH {_ALIGNED}, g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY flight ORDER BY sweep_id) AS gap FROM al)
SELECT flight, {rs('quantile_cont(CAST(residual AS DOUBLE), 0.5)')} AS residual_median, {rs('quantile_cont(CAST(residual AS DOUBLE), 0.99)')} AS residual_p99, {rs('quantile_cont(CAST(gap AS DOUBLE), 0.5)')} AS gap_median FROM g GROUP BY flight""", "telemetry")
def _(t):
    sw, tele = _flights(t)
    d = ld.alignment_report(ld.align_sweeps(sw, tele))
    return d.select("flight", *[r(c).alias(c) for c in ("residual_median", "residual_p99", "gap_median")])


@query("nearest_sweep", f"""WITH s AS (SELECT mission_id, frame * 1.0 AS t FROM frames WHERE frame % 7 = 0), p AS (SELECT f.mission_id, f.frame, s.t AS a FROM frames f ASOF LEFT JOIN s ON f.mission_id = s.mission_id AND f.frame >= s.t), n AS (SELECT f.mission_id, f.frame, s.t AS b FROM frames f ASOF LEFT JOIN s ON f.mission_id = s.mission_id AND f.frame <= s.t),
 z AS (SELECT mission_id, frame, CASE WHEN b IS NULL OR frame - a <= b - frame THEN a ELSE b END AS m FROM p JOIN n USING (mission_id, frame)) SELECT mission_id, frame, CASE WHEN abs(m - frame) <= 20 THEN CAST(m AS BIGINT) END AS sweep_frame FROM z""", "frames")
def _(t):
    f = t("frames").select("mission_id", "frame", F.col("frame").cast("double").alias("t"))
    s = f.filter("frame % 7 = 0").withColumnRenamed("frame", "sweep_frame")
    return tm.asof(f, s, tolerance=20.0, cols=["sweep_frame"], width=4096.0).select("mission_id", "frame", F.col("match.sweep_frame").alias("sweep_frame"))


# ---- appearance ----------------------------------------------------------------------------


def _gid_pairs(t):
    o = t("observations")
    gal = idn.build_gallery(o)
    g = em.galleries(gal, ["mission_id", "tid"])
    c = idn.centroid(gal)
    m = cl.medoid(gal, ["mission_id", "tid"])
    row = g.join(c, ["mission_id", "tid"]).join(m, ["mission_id", "tid"])
    p = cl.geo_candidates(row, row, 12.0).filter("a.tid < b.tid")
    return p.select("mission_id", F.col("a.tid").alias("tid_a"), F.col("b.tid").alias("tid_b"), "distance", F.col("a.gallery").alias("gallery_a"), F.col("b.gallery").alias("gallery_b"),
                    F.col("a.centroid").alias("centroid_a"), F.col("b.centroid").alias("centroid_b"))


@query("separation")
def _(t):
    return _gid_pairs(t).withColumn("s", em.separation("gallery_a", "gallery_b")).select("mission_id", "tid_a", "tid_b", r("s.score", 5).alias("score"), r("s.support", 5).alias("support"))


@query("self_baseline")
def _(t):
    g = em.galleries(idn.build_gallery(t("observations")), ["mission_id", "tid"])
    return g.select("mission_id", "tid", r(em.self_baseline("gallery"), 5).alias("baseline"))


@query("compare_galleries")
def _(t):
    return em.compare_galleries(_gid_pairs(t)).select("mission_id", "tid_a", "tid_b", r("ratio", 4).alias("ratio"), r("score", 4).alias("score"), "is_match")


_VIEWS = """WITH v AS (SELECT label % 7 AS scene, vec_id AS view, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 5)) AS e FROM embeddings),
 u AS (SELECT scene, view, sqrt(list_inner_product(e, e)) AS len, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
 s AS (SELECT a.scene, a.view, any_value(a.len) AS len, avg(list_inner_product(a.e, b.e)) AS sim, any_value((list_inner_product(a.e, a.e) - len(a.e) * list_avg(a.e) * list_avg(a.e)) / (len(a.e) - 1)) AS var
   FROM u a JOIN u b ON a.scene = b.scene AND a.view <> b.view GROUP BY 1, 2),
 k AS (SELECT scene, view, abs((sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w + 1e-8) - 0.5) + abs((len - min(len) OVER w) / (max(len) OVER w - min(len) OVER w + 1e-8) - 0.5)
   + abs((var - min(var) OVER w) / (max(var) OVER w - min(var) OVER w + 1e-8) - 0.5) AS score FROM s WINDOW w AS (PARTITION BY scene))"""


def scaled_views(t):
    return t("embeddings").select((F.col("label") % 7).alias("scene"), F.col("vec_id").alias("view"),
                                  F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("embedding"))


@query("reference_view", _VIEWS + " SELECT scene, arg_min(view, score) AS reference FROM k GROUP BY 1")
def _(t):
    return em.reference_view(scaled_views(t))


@query("reference_view_first", "SELECT label % 7 AS scene, min(vec_id) AS reference FROM embeddings GROUP BY 1")
def _(t):
    return em.reference_view(scaled_views(t), "first")


@query("reference_view_middle", """SELECT scene, vec_id AS reference FROM (SELECT label % 7 AS scene, vec_id, row_number() OVER (PARTITION BY label % 7 ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label % 7) AS n FROM embeddings)
 WHERE k = n // 2 + 1""")
def _(t):
    return em.reference_view(scaled_views(t), "middle")


@query("reorder_by_reference", """WITH f AS (SELECT label % 7 AS scene, max(vec_id) AS ref FROM embeddings GROUP BY 1)
SELECT scene, vec_id AS view, CAST(row_number() OVER (PARTITION BY scene ORDER BY vec_id <> ref, vec_id) AS INTEGER) AS place FROM (SELECT label % 7 AS scene, vec_id FROM embeddings) JOIN f USING (scene)""")
def _(t):
    v = scaled_views(t).select("scene", "view")
    d = em.reorder_by_reference(v, v.groupBy("scene").agg(F.max("view").alias("reference")))
    return d.select("scene", "view", F.row_number().over(Window.partitionBy("scene").orderBy("view_order")).alias("place"))


@query("reference_view_range", """WITH v AS (SELECT label % 7 AS scene, vec_id AS view, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT a.scene, a.view, greatest(0, max(list_cosine_similarity(a.e, b.e))) - least(0, min(list_cosine_similarity(a.e, b.e))) AS s FROM v a JOIN v b ON a.scene = b.scene AND a.view <> b.view GROUP BY 1, 2)
SELECT scene, arg_max(view, s) AS reference FROM x GROUP BY 1""")
def _(t):
    v = t("embeddings").select((F.col("label") % 7).alias("scene"), F.col("vec_id").alias("view"), "embedding")
    return em.reference_view(v, "saddle_sim_range")


@query("pk_batches")
def _(t):
    return em.pk_batches(t("embeddings").select((F.col("vec_id") % 83).alias("pid"), F.col("vec_id").alias("img")), 8, 4)


@query("pk_batches_audit", """WITH n AS (SELECT vec_id % 83 AS pid, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT unnest(range(CAST(count(*) AS BIGINT) // 8)) AS batch FROM n)
SELECT batch, 8 AS pids, 32 AS rows, 32 AS slots, 0 AS foreign_images FROM b""")
def _(t):
    """Every batch has eight identities with four images of their own each."""
    d = em.pk_batches(t("embeddings").select((F.col("vec_id") % 83).alias("pid"), F.col("vec_id").alias("img")), 8, 4)
    return d.groupBy("batch").agg(F.countDistinct("pid").alias("pids"), F.count("*").alias("rows"), F.countDistinct("pid", "slot").alias("slots"), F.count_if(F.col("img") % 83 != F.col("pid")).alias("foreign_images"))


@query("hard_pairs", f"""WITH b AS (SELECT vec_id // 32 AS batch, vec_id AS img, label AS pid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.batch, a.img, a.pid, b.pid AS q, list_distance(a.e, b.e) AS d FROM b a JOIN b ON a.batch = b.batch AND a.img <> b.img)
SELECT batch, img, {rs('max(d) FILTER (pid = q)',5)} AS hard_pos, {rs('min(d) FILTER (pid <> q)',5)} AS hard_neg FROM d GROUP BY 1, 2""")
def _(t):
    e = t("embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("img"), F.col("label").alias("pid"), "embedding")
    return em.hard_pairs(e).select("batch", "img", r("hard_pos", 5).alias("hard_pos"), r("hard_neg", 5).alias("hard_neg"))


@query("pairs", "SELECT a.scene, a.view AS i, b.view AS j FROM pose_pairs a JOIN pose_pairs b ON a.scene = b.scene AND a.view < b.view", "pose_pairs")
def _(t):
    return cd.pairs(t("pose_pairs").select("scene", "view"), ["scene"], "view", [], [])
