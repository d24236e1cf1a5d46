"""Cases that once gave wrong answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerotrace.operators import clusters, clouds, depth, embeddings, identities, ranks, telemetry
from aerotrace.operators import identity_pass as ip
from aerotrace.operators import tracks as tk


def test_centroid_of_wide_vectors(spark):
    df = spark.createDataFrame([("m", 1, [0.0] * 80 + [3.0] * 20), ("m", 1, [0.0] * 80 + [1.0] * 20), ("m", 2, None)], "mission_id string, tid int, embedding array<double>")
    got = {r["tid"]: r["centroid"] for r in identities.centroid(df).collect()}
    assert got[2] is None and np.allclose(got[1], np.array([0.0] * 80 + [1.0] * 20) / np.sqrt(20))


def test_average_passes_over_missing_values(spark):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([None, 4.0, None, float("nan"), 8.0])], "mission_id string, frame long, v double")
    got = [r["ema"] for r in telemetry.ema(df, "v", 0.5).orderBy("frame").collect()]
    assert got == [None, 4.0, 4.0, 4.0, 6.0]


def test_depth_without_values(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 1, 0, 2.0), (0, 0, 2, 0, None), (0, 1, 0, 0, None)], "scene int, view int, u int, v int, depth double")
    norm = {(r["view"], r["u"]): r["norm"] for r in depth.rank_norm(px).collect()}
    assert norm == {(0, 0): 0.5, (0, 1): 1.0, (0, 2): None, (1, 0): None}
    wide = {(r["view"], r["u"]): r["norm"] for r in depth.stretch(px, lo=0.0, hi=1.0).collect()}
    assert wide == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): None, (1, 0): None}
    gt = spark.createDataFrame([(0, 0, 0, 0, 3.0, False), (0, 0, 1, 0, float("nan"), False)], "scene int, view int, u int, v int, gt_depth double, occluded boolean")
    assert {(r["view"], r["u"]): r["depth"] for r in depth.mask_depth(px, gt).collect()} == {(0, 0): 1.0, (0, 1): None, (0, 2): None, (1, 0): None}


def test_points_of_one_frame_stay_apart(spark):
    m = 1 / 111194.9
    df = spark.createDataFrame([("m", 1, 5, 28.0, 77.0), ("m", 1, 5, 28.0 + 0.5 * m, 77.0), ("m", 1, 6, 28.5, 77.0)], "mission_id string, tid int, frame long, lat double, lon double")
    got = clusters.density_clusters(df, ["mission_id", "tid"]).collect()
    assert len(got) == 3 and all(r["cluster"] is None and not r["core"] for r in got)


def test_tracks_with_a_stride(spark):
    rows = [("m", f, f, 0.0, 0.0, 10.0, 10.0) for f in (0, 5, 20, 45)]
    df = spark.createDataFrame(rows, "mission_id string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["frame"]: r["tid"] for r in tk.track_greedy(df, gap=3, stride=5).collect()}
    assert got == {0: 1, 5: 1, 20: 1, 45: 2}


def test_ids_keep_all_digits(spark):
    big = 2**60 + 1
    rows = [("m", f, big + f, 0.0, 0.0, 10.0, 10.0) for f in range(30)]
    df = spark.createDataFrame(rows, "mission_id string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r["det_id"] for r in tk.flush_buffers(df, buffer=20, min_track=3).filter("kind = 'flush'").collect()} == {big + f for f in range(20)}


def test_history_keeps_the_last_known(spark):
    rows = [("m", 1, 1, "new", 7, 5, 1.0, 1.0, 3, 9), ("m", 1, 2, "merge", None, None, 2.0, 1.0, 3, 12)]
    df = spark.createDataFrame(rows, "mission_id string, gid int, update_no int, event string, tid int, cumulative_gallery int, best_conf double, best_sharpness double, first_frame int, last_frame int")
    got = {r["update_no"]: (r["tid"], r["gallery_size"]) for r in identities.gid_summary_asof(df).collect()}
    assert got == {1: (7, 5), 2: (7, 5)}


def test_a_track_without_fixes_gets_no_identity(spark):
    rows = [("m", 10, 1, [], [[1.0, 0.0]]), ("m", 20, 2, [[28.0, 77.0]], [[1.0, 0.0]]), ("m", 30, 3, [[28.0, 77.00001]], [[1.0, 0.1]]), ("m", 40, 4, [[28.0, 77.0]], None)]
    df = spark.createDataFrame(rows, "mission_id string, flush_frame long, tid long, points array<array<double>>, embeds array<array<double>>")
    got = {r["tid"]: (r["gid"], r["event"]) for r in ip.assign_identities(df, "appearance").collect()}
    assert got == {2: (1, "new"), 3: (1, "merge"), 4: (1, "merge")}


def test_rank_holds_every_identity(spark):
    g = spark.createDataFrame([(1, 28.0, 77.0), (2, None, 77.0), (3, 28.1, 77.0), (4, 28.01, 77.0)], "gid int, lat double, lon double")
    p = spark.createDataFrame([(0, 28.0, 77.0)], "probe_id int, lat double, lon double")
    assert [(r["rank"], r["gid"]) for r in identities.rank_by_distance(g, p).orderBy("rank").collect()] == [(1, 1), (2, 4), (3, 3), (4, 2)]


def test_pairs_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(clouds, "PAIR_BLOCK", 8)
    df = spark.createDataFrame([(s, v, v * 10) for s, n in ((0, 150), (1, 1)) for v in range(n)], "scene int, view int, x int")
    got = clouds.pairs(df, ["scene"], "view", [F.col("x").alias("a")], [F.col("x").alias("b")]).collect()
    assert len(got) == 150 * 149 // 2 and all(r["i"] < r["j"] and r["a"] == 10 * r["i"] and r["b"] == 10 * r["j"] for r in got)


def test_percentiles_with_a_far_outlier(spark):
    v = [1e12, *np.linspace(0, 1, 500)]
    df = spark.createDataFrame([("g", float(x)) for x in v], "k string, x double")
    got = ranks.exact_percentile(df, ["k"], "x", {"a": 0.3, "b": 0.9}, direct_rows=20).first()
    assert np.allclose([got["a"], got["b"]], np.percentile(v, [30, 90]))


def test_galleries_compare_as_their_pairs_do():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(7, 24)), rng.normal(size=(5, 24)) + 0.4
    score, support = embeddings.separations(a[None], b[None])
    d = (a[:, None] - b[None]).reshape(-1, 24)
    signal = np.abs(d.mean(0)) / (d.std(0) + 1e-8)
    mutual = np.abs(a).mean(0) * np.abs(b).mean(0)
    top = np.argsort(0.45 * signal / signal.max() + 0.55 * mutual / mutual.max())[-16:]
    unit = lambda x: x[:, top] / np.linalg.norm(x[:, top], axis=1, keepdims=True)
    s = unit(a) @ unit(b).T
    want = (np.mean(np.sort(s, 1)[:, -3:] ** 2) + np.mean(np.sort(s.T, 1)[:, -3:] ** 2)) / 2
    assert np.isclose(support[0], want, atol=1e-6) and np.isfinite(score[0])


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from aerotrace.operators import runtime

    conf = SimpleNamespace(get=lambda *a: None)
    spark = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(spark)


def test_throttle_takes_ties_in_order(spark):
    pdf = pd.DataFrame({"mission_id": "m", "t": [0.0, 0.0, 1.0, 1.0], "k": [2, 1, 4, 3]})
    assert sorted((r["t"], r["k"]) for r in tk.throttle(spark.createDataFrame(pdf), 1.0).collect()) == [(0.0, 1), (1.0, 3)]
