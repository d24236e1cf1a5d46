"""Registered queries: boxes, gates, vetoes, tiles, fusion and ground positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.functions import boxes as bx
from aerotrace.functions import geo
from aerotrace.operators import detections as dt
from aerotrace.operators import telemetry as tm
from aerotrace.plans.registry import query, r, rs

ID = "mission_id, frame, det_id"
IDS = ("mission_id", "frame", "det_id")


def iou_sql(a: str, b: str) -> str:
    i = f"(greatest(0.0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    ar = lambda x: f"(({x}.x2-{x}.x1)*({x}.y2-{x}.y1))"
    return f"(CASE WHEN {i} <= 0 THEN 0.0 ELSE {i} / ({ar(a)}+{ar(b)}-{i}) END)"


def ioa_sql(a: str, b: str) -> str:
    i = f"(greatest(0.0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0.0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)))"
    return f"({i} / greatest(({a}.x2-{a}.x1)*({a}.y2-{a}.y1), 1e-9))"


@query("fov_filter", f"""SELECT {ID} FROM detections WHERE (x1+x2)/2 BETWEEN 192 AND 1728 AND (y1+y2)/2 BETWEEN 108 AND 972""", "detections")
def _(t):
    return dt.fov_filter(t("detections")).select(*IDS)


_SQ = """WITH b AS (SELECT *, CAST(floor(x1) AS BIGINT) AS a1, CAST(floor(y1) AS BIGINT) AS b1, CAST(floor(x2) AS BIGINT) AS a2, CAST(floor(y2) AS BIGINT) AS b2 FROM detections),
 s AS (SELECT *, greatest((b2-b1)-(a2-a1), 0) AS gx, greatest((a2-a1)-(b2-b1), 0) AS gy FROM b),
 q AS (SELECT *, greatest(a1 - gx//2, 0) AS s1, greatest(b1 - gy//2, 0) AS t1, least(a2 + gx - gx//2, 1920) AS s2, least(b2 + gy - gy//2, 1080) AS t2 FROM s),
 e AS (SELECT *, CAST(floor((s2-s1)*1.5) AS BIGINT) // 2 AS hh, (s1+s2)//2 AS cx, (t1+t2)//2 AS cy FROM q),
 crop AS (SELECT *, greatest(cx-hh, 0) AS crop_x1, greatest(cy-hh, 0) AS crop_y1, least(cx+hh, 1920) AS crop_x2, least(cy+hh, 1080) AS crop_y2 FROM e)
"""


@query("square_expand", _SQ + f"SELECT {ID}, crop_x1, crop_y1, crop_x2, crop_y2 FROM crop", "detections")
def _(t):
    return dt.square_expand(t("detections")).select(*IDS, *[f"crop_{c}" for c in bx.XYXY])


@query("expand_float", f"""WITH c AS (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (x2-x1)*0.75 AS hw, (y2-y1)*0.75 AS hh FROM detections),
 k AS (SELECT *, greatest(CAST(trunc(cx-hw) AS BIGINT),0) AS a, greatest(CAST(trunc(cy-hh) AS BIGINT),0) AS b, least(CAST(trunc(cx+hw) AS BIGINT),1920) AS c2, least(CAST(trunc(cy+hh) AS BIGINT),1080) AS d2 FROM c)
SELECT {ID}, CASE WHEN ok THEN a END AS crop_x1, CASE WHEN ok THEN b END AS crop_y1, CASE WHEN ok THEN c2 END AS crop_x2, CASE WHEN ok THEN d2 END AS crop_y2
FROM (SELECT *, c2-a >= 8 AND d2-b >= 8 AS ok FROM k)""", "detections")
def _(t):
    return dt.expand_float(t("detections")).select(*IDS, *[f"crop_{c}" for c in bx.XYXY])


@query("quality_gates", _SQ + f"""SELECT {ID}, CASE WHEN crop_x2 <= crop_x1 OR crop_y2 <= crop_y1 THEN 'invalid' WHEN sharpness < 20 THEN 'blur'
 WHEN brightness < 30 THEN 'dark' WHEN contrast < 10 THEN 'flat' END AS reject_reason FROM crop""", "detections")
def _(t):
    return dt.quality_gates(dt.square_expand(t("detections"))).select(*IDS, "reject_reason")


_GEOM = """(bw >= 8 AND bh >= 8 AND bw*bh <= 0.55*1920*1080 AND greatest(CAST(bh AS DOUBLE)/greatest(bw,0.000001), CAST(bw AS DOUBLE)/greatest(bh,0.000001)) <= {a})"""
_GB = """g AS (SELECT *, CAST(floor(least(x2,1920)) AS BIGINT) - CAST(floor(least(x1,1919)) AS BIGINT) AS bw,
 CAST(floor(least(y2,1080)) AS BIGINT) - CAST(floor(least(y1,1079)) AS BIGINT) AS bh FROM detections)"""


@query("geometry_gate", f"WITH {_GB} SELECT {ID} FROM g WHERE {_GEOM.format(a=1.4)}", "detections")
def _(t):
    return dt.geometry_gate(t("detections"), 1.4).select(*IDS)


_MASK = """m AS (SELECT *, CASE WHEN det_id % 10 = 0 THEN NULL ELSE (det_id % 97) / 90.0 END AS fill, (det_id % 53) / 60.0 AS compact,
 1.0 + det_id % 7 AS elong, CASE WHEN det_id % 10 = 0 THEN NULL ELSE (x2-x1) * 1.1 END AS major_px, CASE WHEN det_id % 8 = 0 THEN NULL ELSE 0.01 + (frame % 5) * 0.02 END AS gsd FROM detections)"""


def with_mask(d):
    k = F.col("det_id")
    return d.withColumns({
        "fill": F.when(k % 10 != 0, (k % 97) / 90.0), "compact": (k % 53) / 60.0, "elong": 1.0 + k % 7,
        "major_px": F.when(k % 10 != 0, (F.col("x2") - F.col("x1")) * 1.1),
        "gsd": F.when(k % 8 != 0, 0.01 + (F.col("frame") % 5) * 0.02)})


@query("shape_verdict", f"""WITH {_MASK} SELECT {ID}, CASE WHEN fill IS NULL THEN NULL WHEN fill < 0.22 THEN 'sliver' WHEN compact < 0.12 THEN 'ragged'
 WHEN elong > 5.5 THEN 'elongated' WHEN fill > 0.95 THEN 'solid' END AS verdict FROM m""", "detections")
def _(t):
    return with_mask(t("detections")).select(*IDS, dt.shape_verdict().alias("verdict"))


@query("size_verdict", f"""WITH {_MASK} SELECT {ID}, CASE WHEN gsd IS NULL OR major_px IS NULL THEN NULL WHEN major_px*gsd < 0.3 THEN 'too_small' WHEN major_px*gsd > 2.4 THEN 'too_large' END AS verdict FROM m""", "detections")
def _(t):
    return with_mask(t("detections")).select(*IDS, dt.size_verdict(F.col("major_px"), F.col("gsd")).alias("verdict"))


@query("gsd", f"SELECT mission_id, {rs('t')} AS t, CASE WHEN alt <> 0 THEN {rs('alt / ((CASE WHEN zoom > 0 THEN zoom ELSE 2.0 END) * 1584.02798)',8)} END AS gsd FROM telemetry", "telemetry")
def _(t):
    return t("telemetry").select("mission_id", r("t").alias("t"), r(geo.gsd(F.col("alt"), tm.zoom_or("zoom")), 8).alias("gsd"))


_FEAT = {"chrom_p90": "sharpness / 30.0", "v_ratio": "brightness / 25.0", "tex": "contrast / 3.0", "hue_dist": "conf / 2.0",
         "sat_ratio": "conf + 0.3", "green_frac": "(det_id % 90) / 100.0", "dark_flat": "(det_id % 70) / 100.0"}
_Z = "(0.62426" + "".join(f" + (({_FEAT[n]}) - {m}) / {s} * {c}" for n, (m, s, c) in dt.PERSON_FEATURES.items()) + ")"
_PS = f"(1.0 / (1.0 + exp(-least(30.0, greatest(-30.0, {_Z})))))"


def with_features(d):
    return d.withColumns({n: F.expr(e) for n, e in _FEAT.items()})


@query("person_score", f"SELECT {ID}, CASE WHEN det_id % 10 = 0 THEN NULL ELSE {rs(_PS)} END AS score FROM detections", "detections")
def _(t):
    d = with_features(t("detections")).withColumn("tex", F.when(F.col("det_id") % 10 != 0, F.col("tex")))
    return d.select(*IDS, r(dt.person_score()).alias("score"))


@query("confidence_adjust", f"SELECT {ID}, {rs(f'conf * (CASE WHEN {_PS} >= 0.5 THEN 1.0 ELSE 1.0 - 0.5 * (0.5 - {_PS}) / 0.5 END)')} AS conf FROM detections", "detections")
def _(t):
    d = with_features(t("detections"))
    return d.select(*IDS, r(F.col("conf") * dt.confidence_adjust(dt.person_score())).alias("conf"))


@query("profile", f"""WITH p(profile, env, max_aspect, sr, mf) AS (VALUES ('grass-fast','grass',7.0,0.25,0.22), ('grass-balanced','grass',7.0,0.25,0.22), ('grass-thorough','grass',7.0,0.1,0.22),
 ('urban-fast','urban',4.5,0.0,0.22), ('urban-balanced','urban',4.5,0.0,0.22), ('urban-thorough','urban',4.5,0.0,0.154))
SELECT {ID}, env, CAST(max_aspect AS DOUBLE) AS max_aspect, CAST(sr AS DOUBLE) AS shadow_reject, {rs('mf')} AS min_fill FROM detections JOIN p ON profile = CASE WHEN frame % 2 = 0 THEN 'grass' ELSE 'urban' END ||
 CASE frame % 3 WHEN 0 THEN '-fast' WHEN 1 THEN '-balanced' ELSE '-thorough' END""", "detections")
def _(t):
    f = F.col("frame")
    name = F.concat(F.when(f % 2 == 0, "grass").otherwise("urban"), F.when(f % 3 == 0, "-fast").when(f % 3 == 1, "-balanced").otherwise("-thorough"))
    return dt.with_profile(t("detections").withColumn("profile", name)).select(*IDS, "env", "max_aspect", "shadow_reject", r("min_fill").alias("min_fill"))


@query("min_conf", f"SELECT {ID} FROM detections WHERE conf >= 0.4", "detections")
def _(t):
    return dt.min_conf(t("detections")).select(*IDS)


@query("stride", f"SELECT {ID} FROM detections WHERE frame % 6 = 0", "detections")
def _(t):
    return dt.stride(t("detections"), fps=30.0, target=5.0).select(*IDS)


@query("iou", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY mission_id, frame ORDER BY det_id) AS k FROM detections)
SELECT a.mission_id, a.frame, a.det_id, {rs(iou_sql('a','b'))} AS iou, {rs(ioa_sql('a','b'))} AS ioa,
 {rs('greatest((a.s+b.s)/2 - abs(a.cx-b.cx), 0) * greatest((a.s+b.s)/2 - abs(a.cy-b.cy), 0) / (a.s*a.s + b.s*b.s - greatest((a.s+b.s)/2 - abs(a.cx-b.cx), 0) * greatest((a.s+b.s)/2 - abs(a.cy-b.cy), 0) + 1e-6)')} AS square_iou
FROM (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS s FROM n) a JOIN (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, x2-x1 AS s FROM n) b
 ON a.mission_id = b.mission_id AND a.frame = b.frame AND b.k = a.k + 1""", "detections")
def _(t):
    from pyspark.sql import Window
    d = t("detections").withColumn("k", F.row_number().over(Window.partitionBy("mission_id", "frame").orderBy("det_id")))
    a, b = d.alias("a"), d.select("mission_id", "frame", (F.col("k") - 1).alias("k"), *bx.XYXY).alias("b")
    j = a.join(b, ["mission_id", "frame", "k"])
    A, B = bx.box("a."), bx.box("b.")
    sq = lambda p: ((p[0] + p[2]) / 2, (p[1] + p[3]) / 2, p[2] - p[0])
    return j.select("mission_id", "frame", "a.det_id", r(bx.iou(A, B)).alias("iou"), r(bx.ioa(A, B)).alias("ioa"), r(bx.square_iou(*sq(A), *sq(B))).alias("square_iou"))


@query("suppress_overlaps", f"""SELECT {ID} FROM detections p WHERE label <> 'shadow' AND NOT EXISTS (SELECT 1 FROM detections n
 WHERE n.label = 'shadow' AND n.mission_id = p.mission_id AND n.frame = p.frame AND {iou_sql('p','n')} >= 0.02)""", "detections")
def _(t):
    return dt.suppress_overlaps(t("detections"), threshold=0.02).select(*IDS)


@query("negative_veto", f"""SELECT {ID} FROM detections p WHERE label <> 'shadow' AND NOT EXISTS (SELECT 1 FROM detections n
 WHERE n.label = 'shadow' AND n.conf >= 0.15 AND n.mission_id = p.mission_id AND n.frame = p.frame AND {ioa_sql('p','n')} >= 0.05 AND n.conf >= p.conf * 0.9)""", "detections")
def _(t):
    d = t("detections").withColumn("raw_conf", F.col("conf"))
    return dt.negative_veto(d.filter("label <> 'shadow'"), d.filter("label = 'shadow'"), ioa=0.05).select(*IDS)


@query("plan_tiles", """WITH s AS (SELECT p_partkey, 800 + p_partkey % 1700 AS w, 600 + p_size * 20 AS h FROM part),
 a AS (SELECT *, least(955, w) AS tw, least(CAST(round_even(955.0 * h / w, 0) AS BIGINT), h) AS th FROM s WHERE w >= 900),
 n AS (SELECT *, 1 + greatest(w-tw,0) // greatest(CAST(round_even(tw*0.75,0) AS BIGINT),1) + CASE WHEN (greatest(w-tw,0) // greatest(CAST(round_even(tw*0.75,0) AS BIGINT),1)) * greatest(CAST(round_even(tw*0.75,0) AS BIGINT),1) + tw < w THEN 1 ELSE 0 END AS nx,
   1 + greatest(h-th,0) // greatest(CAST(round_even(th*0.75,0) AS BIGINT),1) + CASE WHEN (greatest(h-th,0) // greatest(CAST(round_even(th*0.75,0) AS BIGINT),1)) * greatest(CAST(round_even(th*0.75,0) AS BIGINT),1) + th < h THEN 1 ELSE 0 END AS ny FROM a),
 g AS (SELECT p_partkey, w, h, 640.0 / (CASE WHEN nx*ny > 12 THEN 0.67 / sqrt(nx*ny/12.0) ELSE 0.67 END) AS raw FROM n),
 b AS (SELECT *, least(CAST(round_even(raw,0) AS BIGINT), w) AS tw, least(CAST(round_even(CAST(round_even(raw,0) AS BIGINT) * h / w, 0) AS BIGINT), h) AS th FROM g),
 st AS (SELECT *, greatest(CAST(round_even(tw*0.75,0) AS BIGINT),1) AS sx, greatest(CAST(round_even(th*0.75,0) AS BIGINT),1) AS sy FROM b),
 xs AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(w-tw,0)+1, sx), greatest(w-tw,0)))) AS x1 FROM st),
 ys AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(h-th,0)+1, sy), greatest(h-th,0)))) AS y1 FROM xs)
SELECT p_partkey, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(least(x1+tw, w) AS BIGINT) AS x2, CAST(least(y1+th, h) AS BIGINT) AS y2 FROM ys""")
def _(t):
    s = t("part").select("p_partkey", (800 + F.col("p_partkey") % 1700).alias("w"), (600 + F.col("p_size") * 20).cast("bigint").alias("h"))
    return dt.plan_tiles(s).select("p_partkey", *[F.col(c).cast("bigint").alias(c) for c in bx.XYXY])


@query("coverage", f"""WITH tiles AS (SELECT x1, y1, least(x1+955,1920) AS x2, least(y1+537,1080) AS y2 FROM (SELECT unnest([0,716,965]) AS x1), (SELECT unnest([0,403,543]) AS y1))
SELECT {ID}, CAST(1 + count(tl.x1) AS INTEGER) AS cover FROM detections d LEFT JOIN tiles tl ON tl.x1 <= (d.x1+d.x2)/2 AND (d.x1+d.x2)/2 < tl.x2 AND tl.y1 <= (d.y1+d.y2)/2 AND (d.y1+d.y2)/2 < tl.y2
GROUP BY ALL""", "detections")
def _(t):
    d = t("detections").withColumns({"w": F.lit(1920).cast("bigint"), "h": F.lit(1080).cast("bigint")})
    tiles = dt.plan_tiles(d.sparkSession.createDataFrame([(1920, 1080)], "w bigint, h bigint"))
    return dt.coverage(d, tiles).select(*IDS, "cover")


@query("drop_seam_fragments", f"""WITH b AS (SELECT *, det_id % 3 * 700 AS tx1, det_id % 2 * 400 AS ty1, least(det_id % 3 * 700 + 955, 1920) AS tx2, least(det_id % 2 * 400 + 600, 1080) AS ty2,
 x1 % 950 AS u1, y1 % 590 AS v1, x1 % 950 + (x2-x1) AS u2, y1 % 590 + (y2-y1) AS v2 FROM detections)
SELECT {ID}, {rs('u1+tx1')} AS x1, {rs('v1+ty1')} AS y1 FROM b WHERE NOT ((u1 <= 3 AND tx1 > 0) OR (v1 <= 3 AND ty1 > 0) OR (u2 >= tx2-tx1-3 AND tx2 < 1920) OR (v2 >= ty2-ty1-3 AND ty2 < 1080))""", "detections")
def _(t):
    d, k = t("detections"), F.col("det_id")
    d = d.withColumns({"tx1": k % 3 * 700, "ty1": k % 2 * 400, "tx2": F.least(k % 3 * 700 + 955, F.lit(1920)), "ty2": F.least(k % 2 * 400 + 600, F.lit(1080)),
                       "x2": F.col("x1") % 950 + F.col("x2") - F.col("x1"), "y2": F.col("y1") % 590 + F.col("y2") - F.col("y1")})
    d = d.withColumns({"x1": F.col("x1") % 950, "y1": F.col("y1") % 590})
    return dt.drop_seam_fragments(d).select(*IDS, r("x1").alias("x1"), r("y1").alias("y1"))


_FUSE = f"""WITH RECURSIVE bx AS (SELECT mission_id, frame, det_id, x1 / 12 AS x1, y1 / 12 AS y1, x1 / 12 + (x2 - x1) + 60 AS x2, y1 / 12 + (y2 - y1) + 60 AS y2, conf,
   row_number() OVER (PARTITION BY mission_id, frame ORDER BY conf DESC, det_id) AS k FROM detections),
 pairs AS (SELECT b.mission_id, b.frame, b.k, list(a.k ORDER BY a.k) AS over FROM bx b JOIN bx a ON a.mission_id = b.mission_id AND a.frame = b.frame AND a.k < b.k AND {iou_sql('a','b')} >= 0.55 GROUP BY 1, 2, 3),
 st(mission_id, frame, k, seeds, seed) AS (SELECT mission_id, frame, k, [k], k FROM bx WHERE k = 1 UNION ALL
   SELECT b.mission_id, b.frame, b.k, CASE WHEN len(coalesce(list_intersect(p.over, s.seeds), [])) = 0 THEN list_append(s.seeds, b.k) ELSE s.seeds END,
     coalesce(list_min(list_intersect(p.over, s.seeds)), b.k)
   FROM st s JOIN bx b ON b.mission_id = s.mission_id AND b.frame = s.frame AND b.k = s.k + 1 LEFT JOIN pairs p ON p.mission_id = b.mission_id AND p.frame = b.frame AND p.k = b.k),
 fz AS (SELECT mission_id, frame, seed, sum(x1*conf)/sum(conf) AS x1, sum(y2*conf)/sum(conf) AS y2, max(conf) AS raw, count(*) AS n, sum(CASE WHEN conf >= 0.2 THEN conf ELSE 0 END) AS q FROM st JOIN bx USING (mission_id, frame, k) GROUP BY 1, 2, 3)
"""


@query("fuse_boxes", _FUSE + f"""SELECT mission_id, frame, CAST(n AS INTEGER) AS n_views, {rs('x1',5)} AS x1, {rs('y2',5)} AS y2, {rs('raw')} AS raw_conf,
 {rs('least(CASE WHEN raw < 0.15 THEN raw ELSE raw + (1-raw)*(1-exp(-0.55*greatest(q-raw,0))) END, 0.999)')} AS conf FROM fz""", "detections")
def _(t):
    d = t("detections")
    d = d.withColumns({"x2": F.col("x1") / 12 + (F.col("x2") - F.col("x1")) + 60, "y2": F.col("y1") / 12 + (F.col("y2") - F.col("y1")) + 60})
    d = d.withColumns({"x1": F.col("x1") / 12, "y1": F.col("y1") / 12})
    f = dt.fuse_boxes(d)
    return f.select("mission_id", "frame", "n_views", r("x1", 5).alias("x1"), r("y2", 5).alias("y2"), r("raw_conf").alias("raw_conf"), r("conf").alias("conf"))


@query("funnel", f"""WITH {_MASK}, f0 AS (SELECT *, det_id % 9 = 0 AS vetoed, CASE WHEN det_id % 10 = 0 THEN NULL ELSE {_PS} END AS ps FROM m),
 c AS (SELECT *, least(conf * (CASE WHEN ps IS NULL OR ps >= 0.5 THEN 1.0 ELSE 1.0 - 0.5*(0.5-ps)/0.5 END), 0.999) AS fc,
   CAST(floor(least(x2,1920)) AS BIGINT) - CAST(floor(least(x1,1919)) AS BIGINT) AS bw, CAST(floor(least(y2,1080)) AS BIGINT) - CAST(floor(least(y1,1079)) AS BIGINT) AS bh,
   coalesce(major_px, greatest(x2-x1, y2-y1)) AS mp FROM f0),
 z AS (SELECT *, CASE WHEN NOT {_GEOM.format(a=1.45)} THEN 'geom' WHEN vetoed THEN 'veto' WHEN fill IS NOT NULL AND (fill < 0.22 OR compact < 0.12 OR elong > 5.5 OR fill > 0.95) THEN 'shape'
   WHEN gsd IS NOT NULL AND (mp*gsd < 0.3 OR mp*gsd > 2.4) THEN 'size' WHEN ps IS NOT NULL AND ps < 0.25 THEN 'shadow' WHEN fc < 0.4 THEN 'conf' ELSE 'out' END AS reason FROM c)
SELECT mission_id, frame, count(*) AS fused, {', '.join(f"count(*) FILTER (reason = '{s}') AS {s}" if s != 'out' else "count(*) FILTER (reason = 'out') AS n_out" for s in dt.FUNNEL)} FROM z GROUP BY 1, 2""", "detections")
def _(t):
    d = with_features(with_mask(t("detections"))).withColumn("tex", F.when(F.col("det_id") % 10 != 0, F.col("tex")))
    d = d.withColumns({"person_score": dt.person_score(), "vetoed": F.col("det_id") % 9 == 0})
    return dt.funnel(dt.gate_reason(d, max_aspect=1.45, shape_gate=True)).withColumnRenamed("out", "n_out")


def _proj(u, v, alt_ok):
    z = "(CASE WHEN zoom > 0 THEN zoom ELSE 2.0 END)"
    return f"""r1 AS (SELECT *, (({u}) - 953.27546) / (1584.02798 * {z}) AS rx, (({v}) - 518.97355) / (1581.52473 * {z}) AS ry, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr,
   cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(yaw)) AS cw, sin(radians(yaw)) AS sw, radians(lat) AS p FROM j),
 r2 AS (SELECT *, -ry AS bx, cr*rx - sr AS bky, sr*rx + cr AS bz FROM r1), r3 AS (SELECT *, cp*bx + sp*bz AS cx, bky AS cy, cp*bz - sp*bx AS cz FROM r2),
 r4 AS (SELECT *, CASE WHEN cz > 0 AND {alt_ok} THEN (cw*cx - sw*cy) * alt / cz END AS north, CASE WHEN cz > 0 AND {alt_ok} THEN (sw*cx + cw*cy) * alt / cz END AS east FROM r3),
 located AS (SELECT *, lat + north / (111132.92 - 559.82*cos(2*p) + 1.175*cos(4*p) - 0.0023*cos(6*p)) AS olat, lon + east / (111412.84*cos(p) - 93.5*cos(3*p) + 0.118*cos(5*p)) AS olon FROM r4)"""


_LOCJ = "j AS (SELECT d.mission_id, d.frame, d.det_id, d.x1, d.y1, d.x2, d.y2, t.lat, t.lon, t.alt, t.roll, t.pitch, t.yaw, t.zoom FROM detections d ASOF LEFT JOIN telemetry t ON d.mission_id = t.mission_id AND d.frame * 0.01 >= t.t)"


def _located(t, anchor):
    d = t("detections").withColumn("t", F.col("frame") * 0.01)
    d = tm.asof(d, t("telemetry"), direction="backward", cols=["lat", "lon", "alt", "roll", "pitch", "yaw", "zoom"])
    return dt.locate_boxes(d.select("*", "match.*"), anchor)


@query("locate_boxes_center", f"WITH {_LOCJ}, {_proj('x1+0.5*(x2-x1)', 'y1+0.5*(y2-y1)', 'TRUE')} SELECT {ID}, {rs('olat',7)} AS lat, {rs('olon',7)} AS lon FROM located", "detections telemetry")
def _(t):
    return _located(t, "center").select(*IDS, r("obj_lat", 7).alias("lat"), r("obj_lon", 7).alias("lon"))


@query("locate_boxes_feet", f"WITH {_LOCJ}, {_proj('x1+0.5*(x2-x1)', 'y2-0.1*(y2-y1)', 'alt > 0.5')} SELECT {ID}, {rs('olat',7)} AS lat, {rs('olon',7)} AS lon FROM located", "detections telemetry")
def _(t):
    return _located(t, "feet").select(*IDS, r("obj_lat", 7).alias("lat"), r("obj_lon", 7).alias("lon"))


@query("pixel_to_gps", f"""WITH j AS (SELECT *, (t * 100) % 1920 AS u, (t * 37) % 1080 AS v FROM telemetry), {_proj('u', 'v', 'TRUE')}
SELECT mission_id, {rs('t')} AS t, {rs('olat',7)} AS lat, {rs('olon',7)} AS lon FROM located""", "telemetry")
def _(t):
    d = t("telemetry").withColumns({"u": F.col("t") * 100 % 1920, "v": F.col("t") * 37 % 1080, "z": tm.zoom_or("zoom")})
    return dt.project_pixels(d, "u", "v", "z").select("mission_id", r("t").alias("t"), r("obj_lat", 7).alias("lat"), r("obj_lon", 7).alias("lon"))


@query("geo_coverage", f"""WITH {_LOCJ}, {_proj('x1+0.5*(x2-x1)', 'y2-0.1*(y2-y1)', 'alt > 0.5')} SELECT mission_id, count(olat) AS located, count(*) AS total, {rs('100.0*count(olat)/count(*)')} AS pct,
 CASE WHEN 100.0*count(olat)/count(*) > 50 THEN 'INFO' ELSE 'WARN' END AS level FROM located GROUP BY 1""", "detections telemetry")
def _(t):
    return dt.geo_coverage(_located(t, "feet")).select("mission_id", "located", "total", r("pct").alias("pct"), "level")


@query("fov", f"""WITH c AS (SELECT p_partkey, 0.5 + p_size * 0.05 AS fx, 0.6 + p_size * 0.04 AS fy FROM part)
SELECT p_partkey, {rs('2*atan(0.5/fx)')} AS fov_x, {rs('2*atan(0.5/fy)')} AS fov_y FROM c""")
def _(t):
    p = t("part").withColumn("f", geo.fov(0.5 + F.col("p_size") * 0.05, 0.6 + F.col("p_size") * 0.04, 0.5, 0.5))
    return p.select("p_partkey", r("f.fov_x").alias("fov_x"), r("f.fov_y").alias("fov_y"))


@query("metric_scale", f"SELECT p_partkey, {rs('p_retailprice * ((500.0 + p_size + 510.0) / 2 / 300.0)')} AS depth FROM part")
def _(t):
    return t("part").select("p_partkey", r(geo.metric_scale("p_retailprice", 500.0 + F.col("p_size"), 510.0)).alias("depth"))
