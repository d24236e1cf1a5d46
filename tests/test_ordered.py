import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aerotrace.operators import ordered, ranks, telemetry


def sample(spark, n=400):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"mission_id": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "t": rng.permutation(n) * 0.5, "frame": np.arange(n), "v": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.5, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return pdf.sort_values(["mission_id", "t"]).reset_index(drop=True), df


def collect(df, *cols):
    return df.select(*cols).toPandas().sort_values(["mission_id", "t"]).reset_index(drop=True)


def test_carry_crosses_segments(spark):
    pdf, df = sample(spark)
    got = collect(ordered.carry(df, ["mission_id"], ["t"], F.floor(F.col("t") / 3), F.col("v"), prev="p", next="n"), "mission_id", "t", "p", "n")
    g = pdf.groupby("mission_id")["v"]
    np.testing.assert_allclose(got["p"].astype(float), g.ffill().astype(float))
    ahead = pdf.groupby("mission_id")["v"].apply(lambda s: s.bfill().shift(-1)).reset_index(drop=True)
    np.testing.assert_allclose(got["n"].astype(float), ahead.astype(float))


def test_running_sum_last_n_and_ema(spark):
    pdf, df = sample(spark)
    pdf["one"] = 1
    got = collect(ordered.running_sum(df, ["mission_id"], ["t"], F.floor(F.col("t") / 3), F.lit(1), "k"), "mission_id", "t", "k")
    assert got["k"].tolist() == pdf.groupby("mission_id")["one"].cumsum().tolist()
    last = collect(ordered.last_n(df, ["mission_id"], ["t"], F.floor(F.col("t") / 3), 17), "mission_id", "t")
    assert last["t"].tolist() == pdf.groupby("mission_id").tail(17)["t"].tolist()
    e = collect(telemetry.ema(df, "t", 0.1, order="frame", segment=F.floor(F.col("frame") / 7)), "mission_id", "t", "frame", "ema").sort_values(["mission_id", "frame"])
    want = pdf.sort_values(["mission_id", "frame"]).groupby("mission_id")["t"].apply(lambda s: s.ewm(alpha=0.1, adjust=False).mean())
    np.testing.assert_allclose(e["ema"], want.to_numpy())


def test_asof_edges(spark):
    telem = spark.createDataFrame([("m", 10.0, 1.0), ("m", 20.0, 2.0)], "mission_id string, t double, v double")
    frames = spark.createDataFrame([("m", 5.0), ("m", 15.0), ("m", 25.0), ("x", 1.0)], "mission_id string, t double")
    rows = {(r.mission_id, r.t): r.match.v if r.match else None for r in telemetry.asof(frames, telem, width=1.0).collect()}
    assert rows == {("m", 5.0): 1.0, ("m", 15.0): 1.0, ("m", 25.0): 2.0, ("x", 1.0): None}
    assert telemetry.latest_cached(frames, telem, 5.0).count() == 2


def test_exact_percentile_of_large_groups(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["cold"] * 40, "v": np.concatenate([rng.lognormal(size=1500), np.full(1500, 2.0), rng.normal(size=40)])})
    ps = {"a": 0.02, "b": 0.5, "c": 0.98}
    got = ranks.exact_percentile(spark.createDataFrame(pdf), ["g"], "v", ps, direct_rows=100).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.percentile(part["v"], [2, 50, 98]))


def test_missing_points_have_no_distance(spark):
    from aerotrace.functions import geo

    d = spark.createDataFrame([(None, 1.0)], "a double, b double").select(geo.haversine("a", "b", 1.0, 1.0).alias("x"), geo.geo_score(5.0).alias("five"),
                                                                       geo.geo_score(3.0).alias("three"), geo.geo_score(7.0).alias("seven")).first()
    assert d.x is None and (d.five, d.three, d.seven) == (0.5, 1.0, 0.0)
