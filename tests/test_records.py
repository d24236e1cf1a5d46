"""Identity records, nearest identities, ranks over ranges, and points confirmed by other views."""

import numpy as np
from pyspark.sql import functions as F

from aerotrace.functions import rotations as rot
from aerotrace.operators import depth, identities, ordered
from aerotrace.sources import runs

RECORD = "gid long, created string, latitude double, longitude double, samples long"
BUFFER = "gid long, buffer_no int, event string, tid long, cumulative_gallery long, best_confidence double, best_sharpness double, first_frame long, last_frame long, mission_timestamp string, ros_assignment_time double"
ENTRY = "gid long, buffer_no int, pos int, frame long, conf double"


def _distance(a, b):
    la, lo, lb, lp = map(np.radians, (a[0], a[1], b[0], b[1]))
    return 2 * 6371008.8 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))


def test_nearest_identity_near_far_and_across_the_date_line(spark):
    rng = np.random.default_rng(3)
    near = [(i, float(28.75 + x), float(77.11 + y)) for i, (x, y) in enumerate(rng.normal(0, 1e-3, (150, 2)))]
    g = [*near, (500, -17.0, 179.9999), (501, 89.9, 0.0), (502, None, 10.0), (503, float("nan"), 10.0)]
    p = [(i, float(28.75 + x), float(77.11 + y)) for i, (x, y) in enumerate(rng.normal(0, 2e-3, (60, 2)))]
    p += [(900, -17.0, -179.9999), (901, -60.0, 10.0), (902, 89.9, 180.0), (903, None, 1.0), (904, near[7][1], near[7][2])]
    gdf, pdf = spark.createDataFrame(g, "gid long, lat double, lon double"), spark.createDataFrame(p, "probe_id long, lat double, lon double")
    got = {r["probe_id"]: (r["gid"], r["distance"]) for r in identities.nearest_gid(gdf, pdf).collect()}
    placed = [x for x in g if x[1] is not None and x[1] == x[1]]
    want = {k: min((_distance((la, lo), x[1:]), x[0]) for x in placed) for k, la, lo in p if la is not None}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][0]) < 1e-5 for k in want)


def test_nearest_of_equals_and_of_nothing(spark):
    p = spark.createDataFrame([(1, 28.0, 77.0)], "probe_id long, lat double, lon double")
    two = spark.createDataFrame([(9, 28.0, 77.1), (4, 28.0, 77.1)], "gid long, lat double, lon double")
    assert [r["gid"] for r in identities.nearest_gid(two, p).collect()] == [4]
    assert identities.nearest_gid(two.limit(0), p).collect() == [] and identities.nearest_gid(two, p.limit(0)).collect() == []


def test_ranks_over_ranges_with_one_large_group(spark):
    d = spark.range(3000).select(F.when(F.col("id") < 2700, 0).otherwise(F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("v"), "id")
    got = ordered.rank_over(d, ["k"], [F.col("v").asc_nulls_last(), F.col("id").asc()], "rank").collect()
    for k in (0, 1, 2):
        rows = sorted((r for r in got if r["k"] == k), key=lambda r: (r["v"] is None, r["v"] or 0, r["id"]))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert len(got) == 3000


def test_record_of_all_buffers(spark):
    h = spark.createDataFrame([(1, "a", 28.0, 77.0, 3), (2, "b", None, None, None)], RECORD)
    b = spark.createDataFrame([(1, 1, "new", 5, 10, 0.9, 3.0, 100, 160, "00:01", 1.0), (1, 2, "merge", None, 20, 0.5, 8.0, None, 220, None, 2.0)], BUFFER)
    e = spark.createDataFrame([(1, 2, 40, 210, 0.5), (1, 1, 12, 110, 0.9), (1, 1, 11, 100, 0.8)], ENTRY)
    f = spark.createDataFrame([(1, "crop_frame_000100.jpg"), (1, "crop_frame_000100.jpg"), (1, "representative.jpg"), (1, "notes.txt")], "gid long, name string")
    hk, bk, ek, fk = (d.withColumnRenamed("gid", "rec") for d in (h, b, e, f))
    got = {r["gid"]: r.asDict() for r in identities.gid_record(hk.withColumn("gid", F.col("rec")), bk, ek, fk, ["rec"]).collect()}
    one, two = got[1], got[2]
    assert (one["event"], one["updates"], one["tid"], one["lat"], one["gps_samples"], one["gallery_size"]) == ("merge", 2, 5, 28.0, 3, 20)
    assert (one["best_conf"], one["best_sharpness"], one["first_frame"], one["last_frame"], one["mission_timestamp"], one["ros_time"]) == (0.9, 8.0, 100, 220, "00:01", 2.0)
    assert (one["entries"], one["crops"], one["representative"]) == (3, 1, "gid_1/representative.jpg?v=2")
    assert (two["event"], two["updates"], two["gallery_size"], two["crops"], two["representative"], two["lat"]) == ("new", 0, 0, 0, None, None)
    assert [r["frame"] for r in identities.gid_track(e, ["gid"]).orderBy("track_no").collect()] == [100, 110, 210]


def test_datasets_are_put_together_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, label string"), spark.createDataFrame([("y", 2, 0.5)], "label string, id long, w double")
    assert sorted((r["id"], r["label"], r["part"], r["w"]) for r in runs.concat_datasets([a, b]).collect()) == [(1, "x", 0, None), (2, "y", 1, 0.5)]


def test_views_that_confirm_a_point(spark):
    rng = np.random.default_rng(5)
    views = [(0, v, 50.0, 52.0, 8.0, 6.0, 0.3 * v + (40.0 if v == 7 else 0.0)) for v in range(8)]
    px = [(0, v, u, w, float(4 + 0.05 * u + rng.normal(0, 0.15))) for v in range(8) for u in range(16) for w in range(12)]
    one, zero = F.lit(1.0), F.lit(0.0)
    cams = spark.createDataFrame(views, "scene int, view int, fx double, fy double, cx double, cy double, tx double")
    cams = cams.withColumn("m", rot.mat4([[one, zero, zero], [zero, one, zero], [zero, zero, one]], ["tx", 0.0, 0.0]))
    got = depth.consistent_points(spark.createDataFrame(px, "scene int, view int, u int, v int, depth double"), cams, dist=0.2, min_views=3)
    got = {(r["view"], r["u"], r["v"]): (r["n_views"], r["x"], r["y"], r["z"]) for r in got.collect()}
    at = {(v, u, w): np.array([(u - 8) / 50 * d - views[v][6], (w - 6) / 52 * d, d]) for _, v, u, w, d in px}
    want = {}
    for k, p in at.items():
        hits = []
        for _, v, fx, fy, cx, cy, tx in views:
            u, w = fx * (p[0] + tx) / p[2] + cx, fy * p[1] / p[2] + cy
            s = at.get((v, int(np.sign(u) * np.floor(abs(u) + 0.5)), int(np.sign(w) * np.floor(abs(w) + 0.5))))
            if s is not None and np.linalg.norm(p - s) < 0.2:
                hits.append(s)
        if len(hits) >= 3:
            want[k] = (len(hits), *np.mean(hits, axis=0))
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
