"""Streams that wait for event time give the batch result over the frames the watermark has closed."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from aerotrace.operators import identity_pass as ip
from aerotrace.operators import tracks as tk
from aerotrace.operators.stateful import scan_chunks
from aerotrace.streaming import online
from aerotrace.streaming import streams as st
from tests.test_tracks import clip

T0 = 1_700_000_000


def timed(spark, pdf):
    d = spark.createDataFrame(pdf)
    return d.withColumn("ts", F.timestamp_seconds(F.col("frame") + T0))


def test_split_frames_and_late_rows(spark):
    d = timed(spark, clip(1, 90, 4))
    # every second box of the last frames of a piece comes with the next piece; a few rows come far too late
    part = F.when((F.col("det_id") % 100 == 3) & F.col("frame").between(10, 12), 2).otherwise(F.floor((F.col("frame") + F.col("det_id") % 2 * 5) * 3 / 96))
    got = {r.det_id: (r.birth_frame, r.birth_det) for r in st.replay(d, part, 3, lambda s: online.stream_tracks(s, delay="6 seconds")).collect()}
    on_time = d.filter("NOT (det_id % 100 = 3 AND frame BETWEEN 10 AND 12) AND frame <= 89 - 6")
    want = {r.det_id: (r.birth_frame, r.birth_det) for r in scan_chunks(on_time.drop("ts"), ["mission_id"], "frame", 1000, tk.greedy_step(), tk.TRACK_SCHEMA).collect()}
    assert got == want and len(want) > 200


def test_identities_from_detections(spark):
    pdf = clip(3, 200, 5)
    pdf["conf"], pdf["sharpness"] = 0.5 + pdf.det_id % 7 / 20, 50.0 + pdf.det_id % 11
    pdf["lat"], pdf["lon"] = 28.0 + pdf.y1.round(-1) / 1e5, 77.0 + pdf.x1.round(-1) / 1e5
    pdf.loc[pdf.det_id % 13 == 0, "lat"] = None
    d = timed(spark, pdf)
    got = st.replay(d, F.floor((F.col("frame") + F.col("det_id") % 2 * 7) * 4 / 210), 4, lambda s: online.stream_identities(s, delay="8 seconds", min_track=10)).drop("mission_id")
    done = d.filter(F.col("frame") <= pdf.frame.max() - 8)
    b = tk.flush_buffers(done, min_track=10).join(done.select("mission_id", "frame", "det_id", "conf", "sharpness", "lat", "lon"), ["mission_id", "frame", "det_id"], "left")
    want = ip.assign_identities(b).drop("mission_id")
    rows = lambda x: sorted((tuple(None if v is None or v != v else v for v in r) for r in x.select("flush_frame", "tid", "gid", "event", "n", "lat", "lon").collect()), key=str)
    assert rows(got) == rows(want) and len(rows(want)) > 5


def test_idle_missions_are_forgotten(spark):
    rows = [("a", f, f, 0.0, 0.0, 30.0, 30.0) for f in (0, 1, 2)] + [("b", f, f, 0.0, 0.0, 30.0, 30.0) for f in (0, 50, 100)] + [("a", f, f, 0.0, 0.0, 30.0, 30.0) for f in (101, 102, 160)]
    d = timed(spark, pd.DataFrame(rows, columns=["mission_id", "frame", "det_id", "x1", "y1", "x2", "y2"]))
    run = lambda idle: {(r.mission_id, r.frame): r.birth_frame for r in st.replay(d, F.when(F.col("frame") <= 100, F.floor(F.col("frame") / 40)).otherwise(3), 4, lambda s: online.stream_tracks(
        s, delay="5 seconds", gap=1000, idle=dt.timedelta(seconds=idle))).collect()}
    kept, lost = run(1000), run(40)
    assert kept[("a", 101)] == 0 and lost[("a", 101)] == 101 and lost[("a", 102)] == 101


def test_board_changes_and_equals_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    sig = [(1, n, True, 10.0) for n in st.SIGNALS] + [(1, "link", True, 11.0), (1, "link", False, 11.5), (1, "gps_fix", True, 15.0), (2, "link", None, 12.0), (2, None, True, 13.0), (3, "other", True, 40.0)]
    d = spark.createDataFrame([(u, s, ok, t0 + dt.timedelta(seconds=x)) for u, s, ok, x in sig], "uav_id long, signal string, ok boolean, ts timestamp")
    for parts in (1, 3):
        rows = st.replay(d, F.when(F.lit(parts == 1) | (F.second("ts") < 11), 0).when(F.second("ts") < 14, 1).otherwise(2), parts, lambda s: online.stream_readiness(s)).collect()
        at = lambda u: [((r["at"] - t0).total_seconds(), len(r.missing), r.ready) for r in sorted(rows, key=lambda r: r["at"]) if r.uav_id == u]
        assert at(1) == [(10.0, 0, True), (12.000001, 5, False), (13.000001, 6, False), (15.0, 5, False), (17.000001, 6, False)]
        assert at(2) == [(12.0, 6, False)] and at(3) == []  # the last row is not closed yet
    for s in (10.0, 12.5, 14.0, 16.0, 39.0):
        want = {r.uav_id: (r.missing, r.ready) for r in online.readiness_at(d, F.lit(t0 + dt.timedelta(seconds=s))).collect()}
        last = {}
        for r in sorted(rows, key=lambda r: r["at"]):
            if (r["at"] - t0).total_seconds() <= s:
                last[r.uav_id] = (r.missing, r.ready)
        assert last == want
