"""Registered queries: grids, regions, routes and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import grids as gr
from aerotrace.plans.registry import query, r, rs

H, W = 24, 32
_FULL = f"""fg AS (SELECT f.frame, rr.r, cc.c, CAST(coalesce(k.blocked, 1) AS INTEGER) AS blocked FROM (SELECT DISTINCT frame FROM cells) f, (SELECT unnest(range({H})) AS r) rr, (SELECT unnest(range({W})) AS c) cc
 LEFT JOIN cells k ON k.frame = f.frame AND k.r = rr.r AND k.c = cc.c)"""


def grid(t):
    return gr.fill_grid(t("cells"), H, W)


@query("fill_grid", f"WITH {_FULL} SELECT * FROM fg", "cells")
def _(t):
    return grid(t)


_CLEAR = """cl AS (SELECT a.frame, a.r, a.c, coalesce(1 + 3*greatest(0, 1 - sqrt(min((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)))/3.0), 1.0) AS cost FROM fg a LEFT JOIN fg b ON a.frame = b.frame AND b.blocked = 1 AND abs(a.r-b.r) <= 3 AND abs(a.c-b.c) <= 3
 AND (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c) <= 9 WHERE a.blocked = 0 GROUP BY 1, 2, 3)"""


@query("clearance_cost", f"WITH {_FULL}, {_CLEAR} SELECT frame, r, c, {rs('cost')} AS cost FROM cl", "cells")
def _(t):
    return gr.clearance_cost(grid(t), 3.0).withColumn("cost", r("cost"))


_REG = f"""WITH RECURSIVE {_FULL}, free AS (SELECT frame, r, c, r*{W}+c AS id FROM fg WHERE blocked = 0),
 adj AS (SELECT a.frame, a.id AS a, b.id AS b FROM free a JOIN free b ON a.frame = b.frame AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.id <> b.id),
 reach(frame, a, b) AS (SELECT frame, id, id FROM free UNION SELECT x.frame, x.a, adj.b FROM reach x JOIN adj ON x.frame = adj.frame AND x.b = adj.a),
 lab AS (SELECT frame, a AS id, min(b) AS region FROM reach GROUP BY 1, 2), sz AS (SELECT frame, region, count(*) AS n FROM lab GROUP BY 1, 2), top AS (SELECT frame, arg_max(region, n * 100000 + region) AS region FROM sz GROUP BY 1),
 reg AS (SELECT l.frame, id // {W} AS r, id % {W} AS c FROM lab l JOIN top USING (frame, region))"""


@query("largest_region", _REG + " SELECT frame, r, c FROM reg", "cells")
def _(t):
    return gr.largest_region(grid(t).filter("blocked = 0"))


@query("default_endpoints", _REG + f""", s AS (SELECT frame, arg_min(r*{W}+c, ((r-{H - 1})*(r-{H - 1})+(c-{W // 2})*(c-{W // 2}))*100000 + r*{W}+c) AS s FROM reg GROUP BY 1),
 g AS (SELECT frame, s, arg_min(r*{W}+c, -((r-s//{W})*(r-s//{W})+(c-s%{W})*(c-s%{W}))*100000 + r*{W}+c) AS g FROM reg JOIN s USING (frame) GROUP BY 1, 2)
SELECT frame, s//{W} AS start_r, s%{W} AS start_c, g//{W} AS goal_r, g%{W} AS goal_c FROM g""", "cells")
def _(t):
    return gr.default_endpoints(gr.largest_region(grid(t).filter("blocked = 0")), H, W)


@query("nearest_free", f"""WITH {_FULL}, p AS (SELECT DISTINCT frame, r, c FROM cells), k AS (SELECT p.frame, p.r, p.c, f.r AS fr, f.c AS fc, row_number() OVER (PARTITION BY p.frame, p.r, p.c ORDER BY greatest(abs(f.r-p.r),abs(f.c-p.c)), f.r-p.r, f.c-p.c) AS rn
 FROM p LEFT JOIN fg f ON f.frame = p.frame AND f.blocked = 0 AND abs(f.r-p.r) <= 12 AND abs(f.c-p.c) <= 12) SELECT frame, r, c, fr AS snap_r, fc AS snap_c FROM k WHERE rn = 1""", "cells")
def _(t):
    p = t("cells").select("frame", "r", "c").distinct()
    return gr.nearest_free(p, grid(t).filter("blocked = 0"))


_RT = f""", {_CLEAR}, ends AS (SELECT frame, min(r*{W}+c) AS s, max(r*{W}+c) AS g FROM reg GROUP BY 1),
 dist(frame, id, d) USING KEY (frame, id) AS (SELECT frame, s, 0.0::DOUBLE FROM ends UNION ALL
   SELECT * FROM (SELECT n.frame, n.r*{W}+n.c AS id, min(x.d + CASE WHEN n.r <> x.id//{W} AND n.c <> x.id%{W} THEN sqrt(2.0) ELSE 1.0 END * n.cost) AS d FROM dist x
     JOIN cl n ON n.frame = x.frame AND abs(n.r - x.id//{W}) <= 1 AND abs(n.c - x.id%{W}) <= 1 AND n.r*{W}+n.c <> x.id
     JOIN fg f1 ON f1.frame = x.frame AND f1.r = n.r AND f1.c = x.id%{W} AND (f1.blocked = 0 OR n.r = x.id//{W} OR n.c = x.id%{W}) JOIN fg f2 ON f2.frame = x.frame AND f2.r = x.id//{W} AND f2.c = n.c AND (f2.blocked = 0 OR n.r = x.id//{W} OR n.c = x.id%{W})
     GROUP BY 1, 2) c WHERE NOT EXISTS (SELECT 1 FROM recurring.dist o WHERE o.frame = c.frame AND o.id = c.id AND o.d <= c.d + 1e-12))"""


def _ends(t):
    reg = gr.largest_region(grid(t).filter("blocked = 0"))
    lo, hi = F.min(F.struct("r", "c")).alias("a"), F.max(F.struct("r", "c")).alias("b")
    return reg.groupBy("frame").agg(lo, hi).select("frame", F.col("a.r").alias("start_r"), F.col("a.c").alias("start_c"), F.col("b.r").alias("goal_r"), F.col("b.c").alias("goal_c"))


@query("routes", _REG + _RT + f" SELECT e.frame, {rs('d.d')} AS cost FROM ends e JOIN dist d ON d.frame = e.frame AND d.id = e.g", "cells")
def _(t):
    g = grid(t)
    rt = gr.routes(gr.clearance_cost(g, 3.0), _ends(t))
    return gr.route_summary(rt, g).filter("reachable").select("frame", r("cost").alias("cost"))


@query("route_summary")
def _(t):
    g = grid(t)
    rt = gr.routes(gr.clearance_cost(g, 3.0), _ends(t))
    turns = gr.simplify_route(rt).groupBy("frame").agg(F.count("*").alias("turns"))
    return gr.route_summary(rt, g).join(turns, "frame", "left")


@query("to_grid", f"""WITH px AS (SELECT frame, r, c, CASE WHEN blocked = 1 THEN 0 ELSE 255 END AS v FROM cells), e AS (SELECT frame, gi, gj, v, (least(r+1.0,(gi+1)*2.4)-greatest(r,gi*2.4))*(least(c+1.0,(gj+1)*2.4)-greatest(c,gj*2.4)) AS w
 FROM px, (SELECT unnest(range(10)) AS gi), (SELECT unnest(range(14)) AS gj) WHERE r < (gi+1)*2.4 - 1e-9 AND r+1 > gi*2.4 + 1e-9 AND c < (gj+1)*2.4 - 1e-9 AND c+1 > gj*2.4 + 1e-9 AND gj < 14)
SELECT frame, gi AS r, gj AS c, {rs('sum(v*w)/sum(w)/255.0',5)} AS mean FROM e GROUP BY 1, 2, 3""", "cells")
def _(t):
    p = t("cells").withColumn("value", F.when(F.col("blocked") == 1, 0).otherwise(255))
    # 24 x 33.6 pixels onto 10 x 14 cells: both axes shrink by 2.4
    d = gr.to_grid(p.withColumns({"r": F.col("r") * 5, "c": F.col("c") * 5}).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(24))))
                   .withColumns({"r": F.col("r") + F.floor(F.col("__k") / 5), "c": F.col("c") + F.col("__k") % 5}), 120, 168, 14)
    return d.select("frame", "r", "c", r(F.col("mean") / 255, 5).alias("mean"))


@query("inflate", """SELECT DISTINCT frame, k.r + o.dr AS r, k.c + o.dc AS c FROM cells k, (SELECT a - 2 AS dr, b - 2 AS dc FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE abs(b-2) <= round_even(2*sqrt(1-((a-2)/2.0)*((a-2)/2.0)), 0)) o WHERE k.blocked = 1""", "cells")
def _(t):
    return gr.inflate(t("cells").filter("blocked = 1"), 2)


_COST = """cost AS (SELECT k.frame, k.r, k.c, CASE WHEN b.r IS NOT NULL THEN 'inf'::DOUBLE ELSE CASE (k.r + k.c) % 4 WHEN 0 THEN 1.6 WHEN 1 THEN 1.1 WHEN 2 THEN 1.0 ELSE 'inf'::DOUBLE END END AS cost FROM cells k
 LEFT JOIN (SELECT DISTINCT frame, r + d.x AS r, c + d.y AS c FROM cells, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) d(x, y) WHERE blocked = 1) b ON b.frame = k.frame AND b.r = k.r AND b.c = k.c)"""


def _cost(t):
    k = t("cells")
    surf = k.withColumn("surface", F.element_at(F.array(*[F.lit(x) for x in ("grass", "paving", "track", "unmapped")]), ((F.col("r") + F.col("c")) % 4 + 1).cast("int")))
    return gr.build_cost(surf, gr.inflate(k.filter("blocked = 1"), 1))


@query("build_cost", f"WITH {_COST} SELECT * FROM cost", "cells")
def _(t):
    return _cost(t).select("frame", "r", "c", "cost")


@query("downsample_cost", f"WITH {_COST} SELECT frame, r // 5 AS r, c // 5 AS c, max(cost) AS cost FROM cost WHERE r < 20 AND c < 30 GROUP BY 1, 2, 3", "cells")
def _(t):
    return gr.downsample_cost(_cost(t), 5, H, W)


def _sql_dilate(src, k):
    wide = gr.half_widths(k)
    offs = ", ".join(f"({i},{j})" for i in range(1 - len(wide), len(wide)) for j in range(-wide[abs(i)], wide[abs(i)] + 1))
    return f"(SELECT DISTINCT m.frame, m.r + o.x AS r, m.c + o.y AS c FROM {src} m, (VALUES {offs}) o(x, y) WHERE m.r + o.x BETWEEN 0 AND {H - 1} AND m.c + o.y BETWEEN 0 AND {W - 1})"


_ANTI = "(SELECT frame, r, c FROM al ANTI JOIN {0} z USING (frame, r, c))"


@query("despeckle", f"""WITH {_FULL}, al AS (SELECT frame, r, c FROM fg), m0 AS (SELECT frame, r, c FROM fg WHERE blocked = 0), n0 AS {_ANTI.format('m0')}, d0 AS {_sql_dilate('n0', 3)}, e1 AS {_ANTI.format('d0')}, m1 AS {_sql_dilate('e1', 3)},
 m2 AS {_sql_dilate('m1', 5)}, n2 AS {_ANTI.format('m2')}, d2 AS {_sql_dilate('n2', 5)} SELECT * FROM {_ANTI.format('d2')}""", "cells")
def _(t):
    return gr.despeckle(grid(t).filter("blocked = 0"), H, W, 3, 5)


@query("blend_tiles", f"""WITH m AS (SELECT image_id, r % 40 AS r, c, pred, avg((label % 10) / 10.0) AS p FROM pixels GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, r, c ORDER BY p DESC, pred) AS rn FROM m)
SELECT image_id, r, c, pred AS label, {rs('p')} AS p FROM k WHERE rn = 1""", "pixels")
def _(t):
    p = t("pixels").select("image_id", (F.col("r") % 40).alias("r"), "c", F.col("pred").alias("label"), ((F.col("label") % 10) / 10.0).alias("prob"))
    return gr.blend_tiles(p).withColumn("p", r("p"))


@query("segment_surface")
def _(t):
    p = t("pixels").select(F.col("image_id").alias("frame"), "r", "c", (F.col("pred") * 17.0).alias("l"), (100.0 + (F.col("r") * 7 + F.col("pred")) % 50).alias("a"), (120.0 + (F.col("c") * 11) % 30).alias("b"))
    return gr.surface_shares(gr.segment_surface(p))


@query("roi_obstacles", f"""WITH RECURSIVE d AS (SELECT frame, r, c, CAST(1.0 + ((r * 13 + c * 7) % 60) * 0.1 AS DOUBLE) AS depth FROM cells WHERE r BETWEEN 2 AND 21 AND c BETWEEN 1 AND 30), f AS (SELECT *, r*{W}+c AS id FROM d WHERE depth BETWEEN 1.0 AND 5.0),
 adj AS (SELECT a.frame, a.id AS a, b.id AS b FROM f a JOIN f b ON a.frame = b.frame AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.id <> b.id),
 reach(frame, a, b) AS (SELECT frame, id, id FROM f UNION SELECT x.frame, x.a, adj.b FROM reach x JOIN adj ON x.frame = adj.frame AND x.b = adj.a), lab AS (SELECT frame, a AS id, min(b) AS region FROM reach GROUP BY 1, 2)
SELECT frame, region // {W} AS region_r, count(*) AS area, {rs('12 - avg(r)')} AS v_off, 12 - min(r) AS t_off, {rs('quantile_cont(depth, 0.5)')} AS depth FROM f JOIN lab USING (frame, id) GROUP BY frame, region HAVING count(*) >= 3""", "cells")
def _(t):
    d = t("cells").withColumn("depth", 1.0 + ((F.col("r") * 13 + F.col("c") * 7) % 60) * 0.1)
    o = gr.roi_obstacles(d, H, W, min_area=3, half_h=10, half_w=15)
    return o.select("frame", F.col("region.r").alias("region_r"), "area", r("vertical_offset_px").alias("v_off"), F.col("top_offset_px").alias("t_off"), r("depth").alias("depth"))
