import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from aerotrace.operators import tracks as tk
from aerotrace.streaming import streams as st


def files(spark, df, path, column, cuts):
    """Write rows as several files in order, one micro-batch each."""
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        df.filter((F.col(column) >= lo) & (F.col(column) < hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_link_watch_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 1, 2, 8, 9, 20, 21, 22, 60, 61]
    df = spark.createDataFrame([(1, t0 + dt.timedelta(seconds=s)) for s in secs], "uav_id bigint, ts timestamp")
    stream = files(spark, df, str(tmp_path / "in"), "ts", [F.lit(t0 + dt.timedelta(seconds=s)) for s in (0, 5, 21, 50, 100)])
    got = sorted((r.kind, r["at"]) for r in st.run_to_table(st.link_watch(stream)).collect())
    want = sorted((r.kind, r["at"]) for r in st.link_events(df).collect())
    assert [g for g in got if g in want] == want and len(want) == 6


def test_sync_dedupe_and_stats_on_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    img = spark.createDataFrame([("m", 1, at(10.0)), ("m", 2, at(20.0)), ("m", 3, at(400.0))], "mission_id string, frame int, ts timestamp")
    gps = spark.createDataFrame([("m", at(9.95), 1.0), ("m", at(10.02), 2.0), ("m", at(20.3), 3.0), ("m", at(400.0), 4.0)], "mission_id string, ts timestamp, v double")
    src = {n: (d.coalesce(1).write.parquet(str(tmp_path / n)), spark.readStream.schema(d.schema).parquet(str(tmp_path / n)))[1] for n, d in (("img", img), ("gps", gps), ("imu", gps))}
    rows = st.run_to_table(st.stream_sync3(src["img"], src["gps"], src["imu"])).collect()
    assert [(r.frame, r.gps.v, r.imu.v) for r in rows] == [(1, 2.0, 2.0)]
    sent = spark.createDataFrame([("m", 1, 1, at(1)), ("m", 1, 1, at(2)), ("m", 1, 2, at(3))], "mission_id string, gid int, updates int, ts timestamp")
    sent.coalesce(1).write.parquet(str(tmp_path / "gid"))
    d = st.run_to_table(st.dedupe_gid(spark.readStream.schema(sent.schema).parquet(str(tmp_path / "gid"))))
    assert d.count() == 2


def test_readiness_latest_and_publish(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(1, n, True, t0) for n in st.SIGNALS[:5]] + [(1, "bridge", False, t0)], "uav_id int, signal string, ok boolean, ts timestamp")
    r = st.readiness(s).first()
    assert r.missing == ["bridge"] and not r.ready
    fix = spark.createDataFrame([(1, 1.0, 5.0, 6.0), (1, 2.0, None, 6.0)], "uav_id int, ts double, latitude double, longitude double")
    assert st.stream_latest(fix).first().ts == 1.0
    run = st.with_run(spark.createDataFrame([("/x/20240101_000000/mission.log",)], "path string")).first()
    assert (run.run, run.started_at) == ("20240101_000000", 1704067200.0)
