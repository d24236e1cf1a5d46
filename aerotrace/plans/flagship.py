"""Flagship plan: where the aircraft saw each person, and one position per casualty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerotrace.operators import clusters, detections, telemetry, tracks
from aerotrace.operators.runtime import written


def sightings(t) -> DataFrame:
    """Detections placed on the ground with the telemetry row nearest in time."""
    dets = t("detections").withColumn("t", F.col("frame") * 0.01)
    fixes = telemetry.drop_no_fix(t("telemetry"))
    d = telemetry.asof(dets, fixes, cols=["lat", "lon", "alt", "roll", "pitch", "yaw", "zoom"])
    return detections.locate_boxes(d.select("*", "match.*").drop("match"))


def casualty_positions(t) -> DataFrame:
    """Tracks of person boxes with the medoid of their ground positions.

    The sightings and the tracked ones are evaluated once and written out: they are read twice below, and a filter on a ground position that Catalyst pushes
    through the projection would inline its steps into each other.
    """
    seen = written(sightings(t).filter("label = 'person'").select("mission_id", "frame", "det_id", "x1", "y1", "x2", "y2", "conf", "obj_lat", "obj_lon"))
    tracked = tracks.track_greedy(seen)
    placed = written(tracked.join(seen.select("mission_id", "frame", "det_id", "obj_lat", "obj_lon", "conf"), ["mission_id", "frame", "det_id"]))
    spans = placed.groupBy("mission_id", "tid").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("hits"), F.max("conf").alias("best_conf"))
    pos = clusters.medoid(placed, ["mission_id", "tid"], "frame", "obj_lat", "obj_lon")
    return spans.join(pos.select("mission_id", "tid", "lat", "lon"), ["mission_id", "tid"], "left")
