import json
import os

import pytest
from pyspark.sql import functions as F

from aerotrace.sources import flight_logs as fl
from aerotrace.sources import runs

HEAD = "frame,t_mono_s, lat_deg,lon_deg,alt_rel_m,roll_deg,pitch_deg,yaw_deg,zoom_ratio"


def test_strict_flight_log(spark, tmp_path):
    p = tmp_path / "flight7.csv"
    p.write_bytes(("﻿" + HEAD + "\n1,0.1,28.7,77.1,20,0,0,90,\n2,0.2,,77.1,20,0,0,90,2\n3,0.3,28.7,77.1,20,nan,x,90,2\n,,,,\n4,0.4,28.7,77.1,20,1,1,90,3\n").encode())
    good, bad = fl.read_flight_log(spark, str(p))
    assert [(r.mission_id, r.t, r.zoom) for r in good.orderBy("t").collect()] == [("flight7", 0.1, None), ("flight7", 0.4, 3.0)]
    assert sorted(tuple(r.failed) for r in bad.collect())[0] == ("lat_deg",) and bad.count() == 3
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        fl.read_flight_log(spark, str(p))


def test_aliased_flight_log(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Timestamp_sec,drone_lat,drone_lon,drone_altitude_agl,yaw\n1,28.7,77.1,10,5\n2,0,0,10,5\n3,nan,77,1,1\n4,28.8,77.2,,6\n")
    rows = fl.read_flight_log_aliased(spark, str(p)).orderBy("t").collect()
    assert [(r.t, r.alt, r.heading, r.zoom) for r in rows] == [(1.0, 10.0, 5.0, None), (4.0, None, 6.0, None)]


RECORD = """====
GLOBAL IDENTITY RECORD
====

GID                 : 3
Created             : 2024-01-01T00:00:00
Mission Folder      : /runs/a

FINAL GPS (medoid over all buffers)
Final GPS Samples   : 12
Final GPS Latitude  : 28.75
Final GPS Longitude : 77.11

----
BUFFER NEW   TID=4
----
ROS Assignment Time : 420.800 sec
First Frame         : 10
Best Confidence     : 0.9100

------------ This Buffer's Entries ------------
Frame      Conf      Sharpness      Latitude      Longitude
000010    0.9100      80.00    28.75    77.11
000011    0.5000      10.00    28.75    77.12

----
BUFFER MERGE   TID=-1
----
First Frame         : None
"""


def test_run_folder(spark, tmp_path):
    run = tmp_path / "20240101_120000"
    (run / "gid_3").mkdir(parents=True)
    (run / "gid_3" / "metadata.txt").write_text(RECORD)
    (run / "mission.log").write_text("[OK     ] GID=3 Folder ready -> x\n\nplain\n[BAD\n[FRAME  ] FPS=2")
    (tmp_path / "empty").mkdir()
    log = runs.read_mission_log(spark, str(run / "mission.log")).orderBy("line_no").collect()
    assert [(r.line_no, r.level) for r in log] == [(1, "OK"), (3, "RAW"), (4, "RAW"), (5, "FRAME")]
    h, b, e = runs.read_identity_records(spark, str(run / "gid_3" / "metadata.txt"))
    h = h.first()
    assert (h.gid, h.samples, h.latitude, h.mission_folder) == (3, 12, 28.75, "/runs/a")
    b = b.orderBy("buffer_no").collect()
    assert [(x.event, x.tid, x.first_frame, x.ros_assignment_time, x.best_confidence) for x in b] == [("new", 4, 10, 420.8, 0.91), ("merge", -1, None, None, None)]
    assert [(x.frame, x.lon) for x in e.orderBy("pos").collect()] == [(10, 77.11), (11, 77.12)]
    r = runs.list_runs(spark, str(tmp_path)).collect()
    assert [(x.run, x.gids, x.started_at) for x in r] == [("20240101_120000", 1, 1704110400.0)]
    assert runs.list_runs(spark, str(tmp_path), since=4e9).count() == 0


def test_log_and_metric_stores(spark, tmp_path):
    log = spark.createDataFrame([("m", 2, "WARN", "b"), ("m", 1, "OK", "a")], "mission_id string, line_no bigint, level string, msg string")
    runs.write_mission_log(log, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).select("value").collect()] == ["[OK     ] a", "[WARN   ] b"]
    m = spark.createDataFrame([("dtu", "pose", "s1", "auc03", 0.5), ("dtu", "pose", "mean", "auc03", 0.5)], "dataset string, mode string, scene string, metric string, value double")
    runs.write_metrics(m, str(tmp_path / "metrics"))
    other = m.withColumns({"dataset": F.lit("dtu_recon"), "mode": F.lit("recon_unposed")})
    runs.write_metrics(other, str(tmp_path / "metrics"))  # leaves the first dataset alone
    m = m.unionByName(other)
    (tmp_path / "metrics" / "dataset=bad" / "mode=x").mkdir(parents=True)
    (tmp_path / "metrics" / "dataset=bad" / "mode=x" / "part.txt").write_text("{broken")
    assert sorted(map(tuple, runs.load_metrics(spark, str(tmp_path / "metrics")).collect())) == sorted(map(tuple, m.collect()))
    runs.write_buffers(log, str(tmp_path / "buf"))
    runs.write_buffers(log, str(tmp_path / "buf"))
    assert spark.read.parquet(str(tmp_path / "buf")).count() == 4


def test_poses_and_lidar(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("frame,x,y,z,roll,pitch,yaw\n0,1,2,3,0,0,90\n1,1,2,bad,0,0,90\n")
    d = runs.read_poses(spark, str(p), "c2w").collect()
    assert len(d) == 1 and abs(d[0].m[1] - 1.0) < 1e-12 and abs(d[0].m[3] + 2.0) < 1e-12
    q = tmp_path / "l.csv"
    head = "lat_deg,lon_deg,alt_rel_m,roll_deg,pitch_deg,yaw_deg,target_angle_deg,cam_angle_deg,cam_range_m\n"
    q.write_text(head + "".join(f"1,1,10,0,0,0,{a},{a},{r}\n" for a, r in ((-10, 5), (0, ""), (10, 6), (-10, 7), (5, 8))))
    s = runs.read_lidar(spark, str(q)).orderBy("sweep_id").collect()
    assert [[b["range"] for b in x.beams] for x in s] == [[5.0, 6.0], [7.0, 8.0]]
