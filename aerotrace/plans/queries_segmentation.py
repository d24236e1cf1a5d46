"""Registered queries: segmentation labels and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import metrics as mt
from aerotrace.operators import segmentation as sg
from aerotrace.plans.registry import query, r, rs

_MAPS = ", ".join(f"('{d}', {k}, {v})" for d, m in sg.LABEL_MAPS.items() for k, v in m.items())


@query("remap_labels", f"""WITH m(dataset, source, label) AS (VALUES {_MAPS}), p AS (SELECT *, CASE image_id % 3 WHEN 0 THEN 'loveda' WHEN 1 THEN 'openearthmap' ELSE 'uavid' END AS dataset,
 CASE WHEN image_id % 3 = 2 THEN CASE WHEN pred % 2 = 0 THEN 8388608 + 64*256 + 128 ELSE pred END ELSE pred END AS source FROM pixels)
SELECT image_id, r, c, CAST(coalesce(m.label, 255) AS INTEGER) AS label FROM p LEFT JOIN m ON p.dataset = m.dataset AND p.source = m.source""", "pixels")
def _(t):
    p = t("pixels").drop("label").withColumn("dataset", F.when(F.col("image_id") % 3 == 0, "loveda").when(F.col("image_id") % 3 == 1, "openearthmap").otherwise("uavid"))
    p = p.withColumns({"red": F.lit(128), "green": F.lit(64), "blue": F.lit(128)})
    p = p.withColumn("source", F.when((F.col("image_id") % 3 == 2) & (F.col("pred") % 2 == 0), sg.packed_rgb("red", "green", "blue")).otherwise(F.col("pred")))
    return sg.remap_labels(p).select("image_id", "r", "c", "label")


@query("class_cost", """WITH k(label, class_name, cost) AS (VALUES (0,'Clutter',2.0),(1,'Building','inf'::DOUBLE),(2,'Road',1.0),(3,'Static_Car','inf'),(4,'Tree','inf'),(5,'Vegetation',1.6),(6,'Human','inf'),(7,'Moving_Car','inf'))
SELECT image_id, r, c, class_name, coalesce(cost, 'inf'::DOUBLE) AS cost FROM pixels p LEFT JOIN k ON p.pred = k.label""", "pixels")
def _(t):
    p = t("pixels").drop("label").withColumn("label", F.col("pred").cast("int"))
    return sg.class_cost(p).select("image_id", "r", "c", "class_name", "cost")


@query("class_coverage", f"""WITH n AS (SELECT image_id, pred, count(*) AS n FROM pixels GROUP BY 1, 2) SELECT image_id, pred, n, {rs('n / sum(n) OVER w')} AS share,
 {rs('sum(CASE WHEN pred IN (1,2,3,4,6) THEN n ELSE 0 END) OVER w / sum(n) OVER w')} AS traversable FROM n WINDOW w AS (PARTITION BY image_id)""", "pixels")
def _(t):
    return sg.class_coverage(t("pixels")).withColumns({"share": r("share"), "traversable": r("traversable")})


@query("confusion", "SELECT label, pred, count(*) AS n FROM pixels WHERE label <> 255 GROUP BY 1, 2", "pixels")
def _(t):
    return sg.confusion(t("pixels"))


_CM = """WITH cm AS (SELECT label, pred, count(*) AS n FROM pixels WHERE label <> 255 GROUP BY 1, 2), cl AS (SELECT CAST(unnest(range(14)) AS INTEGER) AS class),
 io AS (SELECT class, coalesce((SELECT sum(n) FROM cm WHERE label = class AND pred = class), 0)::BIGINT AS tp, coalesce((SELECT sum(n) FROM cm WHERE label = class), 0)::BIGINT AS support,
   coalesce((SELECT sum(n) FROM cm WHERE pred = class), 0)::BIGINT AS pr FROM cl),
 ip AS (SELECT class, tp, support, support + pr - tp AS un, tp / (support + pr - tp) AS iou FROM io WHERE support + pr > 0)"""


@query("iou_per_class", _CM + f' SELECT class, tp, support, un AS "union", {rs("iou")} AS iou FROM ip', "pixels")
def _(t):
    return sg.iou_per_class(sg.confusion(t("pixels"))).withColumn("iou", r("iou"))


@query("seg_summary", _CM + f""", two AS (SELECT sum(CASE WHEN a AND b THEN n ELSE 0 END) AS tt, sum(CASE WHEN NOT a AND NOT b THEN n ELSE 0 END) AS nn, sum(CASE WHEN a <> b THEN n ELSE 0 END) AS off
  FROM (SELECT n, label IN (1,2,3,4,6) AS a, pred IN (1,2,3,4,6) AS b FROM cm)), tv AS (SELECT (tt/(tt+off) + nn/(nn+off))/2 AS t FROM two),
 me AS (SELECT avg(iou) FILTER (class <> 0 AND support > 0) AS m, avg(iou) FILTER (class IN (1,2,3,4,6) AND support > 0) AS s FROM ip)
SELECT {rs('m')} AS mean_iou, {rs('s')} AS surface_iou, {rs('t')} AS traversability_iou, {rs('0.3*m+0.5*s+0.2*t')} AS selection FROM me, tv""", "pixels")
def _(t):
    s = sg.seg_summary(sg.confusion(t("pixels")))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query("class_weights", f"""WITH n AS (SELECT CAST(label AS INTEGER) AS class, count(*) AS pixels FROM pixels WHERE label <> 255 GROUP BY 1), w AS (SELECT *, 1.0/ln(1.02 + pixels/(SELECT sum(pixels) FROM n)) AS raw FROM n)
SELECT cl.class, coalesce(pixels, 0) AS pixels, CASE WHEN cl.class = 0 THEN 0.0 WHEN raw IS NULL THEN 1.0 ELSE {rs('greatest(0.2, least(10.0, raw/(SELECT avg(raw) FROM w)))')} END::DOUBLE AS weight
FROM (SELECT CAST(unnest(range(14)) AS INTEGER) AS class) cl LEFT JOIN w ON cl.class = w.class""", "pixels")
def _(t):
    return sg.class_weights(t("pixels")).withColumn("weight", r("weight"))


@query("best_epoch", f"""WITH l AS (SELECT o_custkey % 10 AS run, o_orderkey AS epoch, 0.3*(o_totalprice%7) + 0.5*(o_totalprice%5) + 0.2*(o_totalprice%3) AS s FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, epoch) AS rn FROM l)
SELECT run, epoch, {rs('s')} AS selection FROM k WHERE rn = 1""")
def _(t):
    p = F.col("o_totalprice")
    log = t("orders").select((F.col("o_custkey") % 10).alias("run"), F.col("o_orderkey").alias("epoch"), (p % 7).alias("mean_iou"), (p % 5).alias("surface_iou"), (p % 3).alias("traversability_iou"))
    return sg.best_epoch(log, ["run"]).withColumn("selection", r("selection"))


@query("decision_metrics", f"""WITH c AS (SELECT count(*) FILTER (truth=1 AND pred=1) AS tp, count(*) FILTER (truth=0 AND pred=0) AS tn, count(*) FILTER (truth=0 AND pred=1) AS fp, count(*) FILTER (truth=1 AND pred=0) AS fn FROM decisions)
SELECT *, {rs('(tp+tn)/(tp+tn+fp+fn)')} AS accuracy, {rs('tp/(tp+fp)')} AS "precision", {rs('tp/(tp+fn)')} AS recall FROM c""", "decisions")
def _(t):
    d = sg.decision_metrics(t("decisions"))
    return d.withColumns({c: r(c) for c in ("accuracy", "precision", "recall")})


@query("obstacle_counts", f"SELECT image_id, label, count(*) AS n, {rs('count(*) / sum(count(*)) OVER (PARTITION BY image_id)')} AS share FROM pixels WHERE label IN (5,7,8,9,10,11) GROUP BY 1, 2", "pixels")
def _(t):
    return sg.obstacle_counts(t("pixels").filter("label in (5,7,8,9,10,11)")).withColumn("share", r("share"))


@query("obstacle_area", f"SELECT image_id, count(*) AS mapped, count(*) FILTER (o) AS covered, {rs('avg(CASE WHEN o THEN 1.0 ELSE 0.0 END)')} AS area_share FROM (SELECT image_id, r, c, bool_or(label IN (5,7,8,9,10,11)) AS o FROM pixels GROUP BY 1, 2, 3) GROUP BY 1", "pixels")
def _(t):
    p = t("pixels")
    return sg.obstacle_area(p, p.filter("label in (5,7,8,9,10,11)")).withColumn("area_share", r("area_share"))


@query("building_below", f"""WITH f AS (SELECT image_id, avg(CASE WHEN pred = 1 THEN 1.0 ELSE 0.0 END) AS s FROM (SELECT *, r % 640 AS rr, (c * 131 + r * 17) % 1080 AS cc FROM pixels) WHERE rr BETWEEN 160 AND 479 AND cc BETWEEN 270 AND 809 GROUP BY 1)
SELECT image_id, {rs('s')} AS building_share, CASE WHEN s > 0.05 THEN 1 ELSE 0 END AS building_below, s <= 0.05 AND image_id % 3 = 0 AS ground_clear FROM f""", "pixels")
def _(t):
    p = t("pixels").withColumns({"c": (F.col("c") * 131 + F.col("r") * 17) % 1080, "r": F.col("r") % 640})
    d = sg.building_below(p, 640, 1080).withColumn("ts", (F.col("image_id") % 3).cast("double"))
    d = sg.ground_clear(d.withColumn("ts", -F.col("ts")), F.lit(0.5))
    return d.select("image_id", r("building_share").alias("building_share"), "building_below", "ground_clear")


@query("hold_stride", """SELECT mission_id, frame, last_value(CASE WHEN frame % 4 = 0 THEN frame % 14 END IGNORE NULLS) OVER (PARTITION BY mission_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS held_label FROM frames""", "frames")
def _(t):
    f = t("frames").select("mission_id", "frame")
    return sg.hold_stride(f, f.withColumn("label", F.col("frame") % 14), 4).select("mission_id", "frame", "held_label")


@query("with_mean", f"""SELECT dataset, mode, metric, scene, {rs('value')} AS value FROM (SELECT dataset, mode, metric, scene, value FROM metrics UNION ALL SELECT dataset, mode, metric, 'mean', avg(value) FROM metrics GROUP BY 1, 2, 3)""", "metrics")
def _(t):
    return mt.with_mean(t("metrics")).withColumn("value", r("value"))


@query("flag_best", f"""WITH m AS (SELECT dataset, mode, metric, avg(value) AS value FROM metrics GROUP BY 1, 2, 3), w AS (SELECT *, min(value) OVER x AS lo, max(value) OVER x AS hi, metric = 'overall' AS low FROM m WINDOW x AS (PARTITION BY dataset, metric))
SELECT dataset, mode, metric, abs(value - CASE WHEN low THEN lo ELSE hi END) < 1e-8 AS is_best, abs(value - CASE WHEN low THEN hi ELSE lo END) < 1e-8 AS is_worst FROM w""", "metrics")
def _(t):
    m = t("metrics").groupBy("dataset", "mode", "metric").agg(F.avg("value").alias("value"))
    return mt.flag_best(m, ["dataset", "metric"]).drop("value")


@query("summary_pivot", """WITH m AS (SELECT metric, dataset, avg(value) AS v FROM metrics WHERE mode = 'F' AND metric IN ('fscore', 'overall') GROUP BY 1, 2)
SELECT metric, round(avg(v) FILTER (dataset <> '5-LOW'), 6) AS "avg", """ + ", ".join(f"round(max(v) FILTER (dataset = '{d}'), 6) AS {a}" for d, a in (("1-URGENT", "u"), ("2-HIGH", "h"), ("5-LOW", "l"))) + ", CASE metric WHEN 'fscore' THEN 1 ELSE 2 END::BIGINT AS \"row\" FROM m WHERE dataset IN ('1-URGENT','2-HIGH','5-LOW') GROUP BY 1", "metrics")
def _(t):
    d = mt.summary_pivot(t("metrics"), ["1-URGENT", "2-HIGH", "5-LOW"], "F", ["fscore", "overall"], leave_out=["5-LOW"])
    return d.select("metric", r("avg").alias("avg"), r("1-URGENT").alias("u"), r("2-HIGH").alias("h"), r("5-LOW").alias("l"), "row")


@query("compare_runs", f"""WITH m AS (SELECT dataset, mode, metric, avg(value) FILTER (run='run0') AS run0, avg(value) FILTER (run='run1') AS run1 FROM metrics GROUP BY 1, 2, 3)
SELECT dataset, mode, metric, {rs('run0')} AS run0, {rs('run1')} AS run1, CASE WHEN run0 IS NULL OR run1 IS NULL THEN NULL WHEN run0 = CASE WHEN metric='overall' THEN least(run0,run1) ELSE greatest(run0,run1) END THEN 'run0' ELSE 'run1' END AS best_run,
 CASE WHEN run0 IS NULL OR run1 IS NULL THEN NULL WHEN run0 = CASE WHEN metric='overall' THEN greatest(run0,run1) ELSE least(run0,run1) END THEN 'run0' ELSE 'run1' END AS worst_run FROM m""", "metrics")
def _(t):
    return mt.compare_runs(t("metrics"), ["run0", "run1"]).withColumns({"run0": r("run0"), "run1": r("run1")})
