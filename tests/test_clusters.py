import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerotrace.operators import clouds, clusters

R = 6371000.0


def arcs(lat, lon):
    p, q = np.radians(lat), np.radians(lon)
    s = np.sin((p[:, None] - p[None]) / 2) ** 2 + np.cos(p)[:, None] * np.cos(p)[None] * np.sin((q[:, None] - q[None]) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(s))


def scene(seed, n, spread):
    rng = np.random.default_rng(seed)
    centre = rng.choice(5, n)
    x = centre * 3.0 + rng.normal(scale=spread, size=n)
    y = (centre % 2) * 3.0 + rng.normal(scale=spread, size=n)
    lat = 28.75 + y / 111000.0
    lon = 77.11 + x / (111000.0 * math.cos(math.radians(28.75)))
    return pd.DataFrame({"g": "a", "frame": np.arange(n), "lat": lat, "lon": lon})


def dbscan(pdf, eps=1.0, least=3):
    a = pdf[["lat", "lon"]].to_numpy()
    m = a.mean(0)
    xy = np.radians(a - m) * R * np.array([1, math.cos(math.radians(m[0]))])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(a), -1)
    for i in range(len(a)):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], i
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(near[j] & (label < 0)):
                label[k] = i
                if core[k]:
                    stack.append(k)
    return label


@pytest.mark.parametrize("n,spread", [(60, 0.8), (500, 0.35)])
def test_density_clusters_match_index_order_search(spark, n, spread):
    pdf = scene(n, n, spread)
    pdf = pd.concat([pdf, pdf.head(5).assign(frame=lambda d: d.frame + 10_000)], ignore_index=True)
    want = dbscan(pdf)
    got = clusters.density_clusters(spark.createDataFrame(pdf), ["g"]).toPandas().set_index("ord")["cluster"]
    for i in range(n):
        c = got[i]
        assert (-1 if pd.isna(c) else int(c)) == want[i]


def test_medoid_of_large_group_is_exact(spark):
    pdf = scene(7, 700, 4.0)
    cost = arcs(pdf["lat"].to_numpy(), pdf["lon"].to_numpy()).sum(1)
    best = pdf.iloc[int(cost.argmin())]
    df = spark.createDataFrame(pdf)
    for direct in (10, 5000):
        m = clusters.medoid(df, ["g"], direct=direct).first()
        assert (m.lat, m.lon) == (best.lat, best.lon) and m.n_points == 700


def test_medoid_edges(spark):
    rows = [("one", 1, 1.0, 1.0), ("two", 2, 2.0, 2.0), ("two", 1, 9.0, 9.0), ("tie", 1, 0.0, 0.0), ("tie", 2, 0.0, 1.0), ("tie", 3, 0.0, 2.0), ("noise", 5, 10.0, 10.0), ("noise", 6, 11.0, 11.0), ("noise", 7, 13.0, 13.0)]
    df = spark.createDataFrame(rows, "g string, frame int, lat double, lon double")
    m = {r.g: (r.lat, r.lon) for r in clusters.medoid(df, ["g"]).collect()}
    assert m["one"] == (1.0, 1.0) and m["two"] == (9.0, 9.0) and m["tie"] == (0.0, 1.0)
    d = {r.g: (r.lat, r.lon) for r in clusters.density_medoid(df, ["g"]).collect()}
    assert d["noise"] == (11.0, 11.0) and d["one"] == (1.0, 1.0)


def test_components_on_a_long_chain(spark):
    e = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    c = clusters.components(e.unionByName(spark.createDataFrame([(900, 800)], "src bigint, dst bigint")))
    assert {(r.component, r["count"]) for r in c.groupBy("component").count().collect()} == {(0, 301), (800, 2)}


def test_candidates_at_the_radius(spark):
    step = 7.0 / (R * math.pi / 180)
    a = spark.createDataFrame([("m", 1, 10.0, 20.0)], "mission_id string, id int, lat double, lon double")
    b = spark.createDataFrame([("m", 2, 10.0 + step * 0.999, 20.0), ("m", 3, 10.0 + step * 1.001, 20.0), ("n", 4, 10.0, 20.0)], a.schema)
    assert [r.b.id for r in clusters.geo_candidates(a, b).collect()] == [2]


def test_nearest_neighbour_far_away_and_thinning(spark):
    rng = np.random.default_rng(0)
    ref, q = rng.uniform(0, 2, (200, 3)), np.vstack([rng.uniform(0, 2, (50, 3)), rng.uniform(30, 31, (3, 3))])
    frame = lambda a: spark.createDataFrame(pd.DataFrame({"scene": 1, "pt": range(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}))
    got = clouds.nn_distance(frame(q), frame(ref), cell=0.1).toPandas().sort_values("pt")["distance"]
    np.testing.assert_allclose(got, np.sqrt(((q[:, None] - ref[None]) ** 2).sum(2)).min(1))
    kept = clouds.thin(frame(ref), 0.5).toPandas()[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((kept[:, None] - kept[None]) ** 2).sum(2)) + np.eye(len(kept)) * 9
    assert d.min() > 0.5
    assert np.sqrt(((ref[:, None] - kept[None]) ** 2).sum(2)).min(1).max() <= 0.5


def test_hash_sample_counts_and_sim3(spark):
    df = spark.range(1000).select(F.lit("s").alias("scene"), F.col("id").alias("pt"), F.sin("id").alias("x"), F.cos(F.col("id") * 2).alias("y"), (F.col("id") % 7).cast("double").alias("z"))
    a = {r.pt for r in clouds.hash_sample(df, 100, ["scene"], ["pt"]).collect()}
    assert len(a) == 100 and a == {r.pt for r in clouds.hash_sample(df.repartition(3), 100, ["scene"], ["pt"]).collect()}
    pairs = df.select("scene", F.col("pt").alias("view"), "x", "y", "z", (2 * F.col("y") + 1).alias("ex"), (-2 * F.col("x") + 3).alias("ey"), (2 * F.col("z")).alias("ez"))
    noisy = pairs.withColumn("ex", F.when(F.col("view") < 2, F.col("ex") + 400).otherwise(F.col("ex")))
    assert clouds.apply_alignment(pairs, clouds.align_sim3(pairs)).agg(F.max("error")).first()[0] < 1e-9
    m = clouds.ransac_sim3(noisy, inlier=0.5).first()
    assert abs(m.s - 0.5) < 0.05


def test_nearest_neighbours_of_shifted_clouds(spark):
    rng = np.random.default_rng(4)
    scenes = {"near": (rng.uniform(-2, 2, (300, 3)), rng.uniform(-2, 2, (400, 3))), "far": (rng.uniform(0, 1, (150, 3)) + [40, -7, 3], rng.uniform(-3, 3, (300, 3))),
              "one": (rng.uniform(-90, 90, (40, 3)), np.array([[1.0, 2.0, 3.0]])), "lone": (np.zeros((2, 3)), np.empty((0, 3))), "dense": (rng.uniform(5, 6, (60, 3)), np.repeat(rng.uniform(0, 0.05, (700, 3)), 2, 0))}
    rows = lambda k: [(s, i, *map(float, p)) for s, pair in scenes.items() for i, p in enumerate(pair[k])]
    q, ref = (spark.createDataFrame(rows(k), "scene string, pt int, x double, y double, z double") for k in (0, 1))
    for max_r in (None, 1.5):
        got = {(r.scene, r.pt): r.distance for r in clouds.nn_distance(q, ref, cell=0.2, max_r=max_r).collect()}
        for s, (a, b) in scenes.items():
            for i, p in enumerate(a):
                want = float(np.sqrt(((b - p) ** 2).sum(1)).min()) if len(b) else None
                have = got.pop((s, i))
                assert have is None if want is None or (max_r and want > max_r) else abs(have - want) < 1e-9
        assert not got
    leaves = clouds._leaves(ref, ["scene"], 0.2)
    far = q.filter("scene = 'far'").select("scene", "pt", "x", "y", "z")
    met = clouds._candidates(far, leaves, ["scene"], 0.2, None).groupBy("qx", "qy", "qz").count().agg({"count": "max"}).first()[0]
    assert met < leaves.filter("scene = 'far'").count() / 8  # a shifted cloud does not meet the whole scene
