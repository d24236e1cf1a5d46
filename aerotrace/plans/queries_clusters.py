"""Registered queries: neighbours, components, medoids and density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerotrace.operators import clusters as cl
from aerotrace.operators import identities as idn
from aerotrace.plans.registry import hav, query, r, rs

_H = hav('a.lat', 'a.lon', 'b.lat', 'b.lon')


@query("geo_candidates", f"""SELECT a.mission_id, a.frame AS a, b.frame AS b, {rs(_H,4)} AS distance FROM observations a JOIN observations b ON a.mission_id = b.mission_id AND a.tid <> b.tid
 WHERE {_H} <= 12.0""", "observations")
def _(t):
    o = t("observations").select("mission_id", "tid", "frame", "lat", "lon")
    d = cl.geo_candidates(o, o, 12.0).filter("a.tid <> b.tid")
    return d.select("mission_id", F.col("a.frame").alias("a"), F.col("b.frame").alias("b"), r("distance", 4).alias("distance"))


@query("medoid", f"""WITH c AS (SELECT a.mission_id, a.tid, a.frame, a.lat, a.lon, sum({_H}) AS cost FROM observations a JOIN observations b ON a.mission_id = b.mission_id AND a.tid = b.tid GROUP BY ALL)
SELECT mission_id, tid, {rs('arg_min(lat, cost)',7)} AS lat, {rs('arg_min(lon, cost)',7)} AS lon FROM c GROUP BY 1, 2""", "observations")
def _(t):
    return cl.medoid(t("observations"), ["mission_id", "tid"]).select("mission_id", "tid", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("medoid_large", f"""WITH c AS (SELECT a.mission_id, a.frame, a.lat, a.lon, sum({_H}) AS cost FROM observations a JOIN observations b ON a.mission_id = b.mission_id GROUP BY ALL)
SELECT mission_id, {rs('arg_min(lat, cost)',7)} AS lat, {rs('arg_min(lon, cost)',7)} AS lon FROM c GROUP BY 1""", "observations")
def _(t):
    return cl.medoid(t("observations"), ["mission_id"], direct=8).select("mission_id", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


_DB = f"""WITH RECURSIVE m AS (SELECT mission_id, tid, avg(lat) AS la, avg(lon) AS lo FROM observations GROUP BY 1, 2),
 p AS (SELECT mission_id, tid, frame, lat, lon, radians(lon-lo)*6371000.0*cos(radians(la)) AS x, radians(lat-la)*6371000.0 AS y FROM observations JOIN m USING (mission_id, tid)),
 nb AS (SELECT a.mission_id, a.tid, a.frame AS f, b.frame AS g FROM p a JOIN p b ON a.mission_id = b.mission_id AND a.tid = b.tid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 1.0),
 core AS (SELECT mission_id, tid, f AS frame FROM nb GROUP BY 1, 2, 3 HAVING count(*) >= 3),
 ce AS (SELECT nb.* FROM nb JOIN core a ON nb.mission_id = a.mission_id AND nb.tid = a.tid AND nb.f = a.frame JOIN core b ON nb.mission_id = b.mission_id AND nb.tid = b.tid AND nb.g = b.frame),
 reach(mission_id, tid, f, g) AS (SELECT mission_id, tid, f, f FROM ce UNION SELECT r.mission_id, r.tid, r.f, ce.g FROM reach r JOIN ce ON r.mission_id = ce.mission_id AND r.tid = ce.tid AND r.g = ce.f),
 lab AS (SELECT mission_id, tid, f AS frame, min(g) AS cluster FROM reach GROUP BY 1, 2, 3),
 al AS (SELECT p.mission_id, p.tid, p.frame, p.lat, p.lon, coalesce(any_value(l.cluster), min(lb.cluster)) AS cluster FROM p LEFT JOIN lab l ON p.mission_id = l.mission_id AND p.tid = l.tid AND p.frame = l.frame
   LEFT JOIN nb ON nb.mission_id = p.mission_id AND nb.tid = p.tid AND nb.f = p.frame LEFT JOIN lab lb ON lb.mission_id = p.mission_id AND lb.tid = p.tid AND lb.frame = nb.g GROUP BY 1, 2, 3, 4, 5)"""


@query("density_clusters", _DB + " SELECT mission_id, tid, min(frame) AS frame, min(cluster) AS cluster FROM al GROUP BY mission_id, tid, lat, lon", "observations")
def _(t):
    return cl.density_clusters(t("observations"), ["mission_id", "tid"]).select("mission_id", "tid", F.col("ord").alias("frame"), "cluster")


@query("density_medoid", _DB + f""", sz AS (SELECT mission_id, tid, cluster, count(*) AS n FROM al WHERE cluster IS NOT NULL GROUP BY 1, 2, 3), top AS (SELECT mission_id, tid, arg_min(cluster, -n * 1e9 + cluster) AS top FROM sz GROUP BY 1, 2),
 kept AS (SELECT al.* FROM al LEFT JOIN top USING (mission_id, tid) WHERE top IS NULL OR cluster = top), c AS (SELECT a.mission_id, a.tid, a.frame, a.lat, a.lon, sum({_H}) AS cost FROM kept a JOIN kept b ON a.mission_id = b.mission_id AND a.tid = b.tid GROUP BY ALL)
SELECT mission_id, tid, {rs('arg_min(lat, cost)',7)} AS lat, {rs('arg_min(lon, cost)',7)} AS lon FROM c GROUP BY 1, 2""", "observations")
def _(t):
    return cl.density_medoid(t("observations"), ["mission_id", "tid"]).select("mission_id", "tid", r("lat", 7).alias("lat"), r("lon", 7).alias("lon"))


@query("components", """WITH RECURSIVE e AS (SELECT vec_id AS a, CASE WHEN vec_id % 7 = 0 THEN vec_id ELSE vec_id // 2 END AS b FROM embeddings UNION ALL SELECT CASE WHEN vec_id % 7 = 0 THEN vec_id ELSE vec_id // 2 END, vec_id FROM embeddings WHERE vec_id % 7 <> 0),
 reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a) SELECT n AS node, min(m) AS component FROM reach GROUP BY 1""")
def _(t):
    v = F.col("vec_id")
    e = t("embeddings").select(v.alias("src"), F.when(v % 7 == 0, v).otherwise(F.floor(v / 2)).alias("dst"))
    return cl.components(e, nodes=t("embeddings").select(v.alias("node")))


@query("resolve_identities", f"""WITH RECURSIVE o AS (SELECT mission_id, tid * 1000000000000 + frame AS tid, lat, lon, embedding FROM observations),
 e AS (SELECT a.mission_id, a.tid AS a, b.tid AS b FROM o a JOIN o b ON a.mission_id = b.mission_id AND a.tid <> b.tid AND {_H} <= 2.5 AND list_dot_product(a.embedding, b.embedding) >= 0.2),
 reach(mission_id, n, m) AS (SELECT mission_id, tid, tid FROM o UNION SELECT r.mission_id, r.n, e.b FROM reach r JOIN e ON r.mission_id = e.mission_id AND r.m = e.a)
SELECT mission_id, n AS tid, min(m) AS identity FROM reach GROUP BY 1, 2""", "observations")
def _(t):
    o = t("observations").select("mission_id", (F.col("tid") * 1000000000000 + F.col("frame")).alias("tid"), "lat", "lon", F.col("embedding").alias("centroid"))
    return cl.resolve_identities(o, radius=2.5, min_cosine=0.2)
