"""Fixture views over the base tables, valid in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    "telemetry": """
SELECT 'm' || CAST(user_id % 6 AS STRING) AS mission_id,
  event_id * CAST(0.25 AS DOUBLE) + ((event_id * 37) % 11) * CAST(0.01 AS DOUBLE) AS t,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 53 = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE CAST(28.75 AS DOUBLE) + ((event_id * 7919) % 2001 - 1000) * CAST(0.0000001 AS DOUBLE) + event_id * CAST(0.000001 AS DOUBLE) END AS lat,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 53 = 0 THEN CAST(0.0 AS DOUBLE)
       ELSE CAST(77.11 AS DOUBLE) + ((event_id * 104729) % 2001 - 1000) * CAST(0.0000001 AS DOUBLE) END AS lon,
  CAST(15.0 AS DOUBLE) + value % 20 AS alt,
  ((event_id * 31) % 41 - 20) * CAST(0.5 AS DOUBLE) AS roll,
  ((event_id * 17) % 21 - 10) * CAST(0.5 AS DOUBLE) AS pitch,
  ((event_id * 13) % 360) * CAST(1.0 AS DOUBLE) AS yaw,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) + (event_id % 3) END AS zoom
FROM events WHERE event_type IN ('view', 'click', 'signup')
""",
    "frames": """
SELECT 'm' || CAST(user_id % 6 AS STRING) AS mission_id, event_id AS frame,
  event_id * CAST(0.25 AS DOUBLE) + ((event_id * 37) % 11) * CAST(0.01 AS DOUBLE) AS t
FROM events WHERE event_type IN ('purchase', 'error')
""",
    "detections": """
SELECT 'm' || CAST(l_orderkey % 6 AS STRING) AS mission_id, l_orderkey AS frame,
  ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS det_id,
  (l_partkey * 131) % 1800 * CAST(1.0 AS DOUBLE) AS x1, (l_suppkey * 71 + l_partkey) % 1000 * CAST(1.0 AS DOUBLE) AS y1,
  (l_partkey * 131) % 1800 + 6 + l_quantity AS x2, (l_suppkey * 71 + l_partkey) % 1000 + 6 + l_quantity * CAST(1.5 AS DOUBLE) AS y2,
  CAST(0.1 AS DOUBLE) + l_discount * 8 AS conf,
  CASE l_returnflag WHEN 'A' THEN 'shadow' ELSE 'person' END AS label,
  l_extendedprice % 200 AS sharpness, l_quantity * 2 AS brightness, l_tax * 400 AS contrast
FROM lineitem
""",
    "observations": """
SELECT 'm' || CAST(label % 3 AS STRING) AS mission_id, label AS tid, vec_id AS frame,
  CAST(0.3 AS DOUBLE) + (vec_id * 7 % 70) * CAST(0.01 AS DOUBLE) AS conf, CAST(20.0 AS DOUBLE) + (vec_id * 53) % 400 AS sharpness,
  CAST(28.75 AS DOUBLE) + label * CAST(0.00002 AS DOUBLE) + ((vec_id * 7919) % 41 - 20) * CAST(0.0000002 AS DOUBLE)
    + CASE WHEN vec_id % 17 = 0 THEN CAST(0.0004 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS lat,
  CAST(77.11 AS DOUBLE) + label * CAST(0.00002 AS DOUBLE) + ((vec_id * 104729) % 41 - 20) * CAST(0.0000002 AS DOUBLE) AS lon,
  embedding FROM embeddings
""",
    "buffers": """
SELECT 'm' || CAST(conv_id % 4 AS STRING) AS mission_id, conv_id AS gid, turn + 1 AS update_no,
  CASE WHEN turn = 0 THEN 'new' ELSE 'merge' END AS event, conv_id * 10 + turn AS tid,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE 1000 + conv_id * 60 - turn * 7 END AS first_frame,
  1060 + conv_id * 60 + turn * 60 AS last_frame, length(text) % 100 * CAST(0.01 AS DOUBLE) AS best_conf,
  (length(text) * 13) % 400 * CAST(1.0 AS DOUBLE) AS best_sharpness, length(text) % 45 AS cumulative_gallery
FROM conversations
""",
    "mission_log": """
SELECT 'm' || CAST(user_id % 6 AS STRING) AS mission_id, event_id AS line_no,
  CASE event_type WHEN 'view' THEN '[FRAME  ] FPS=' || CAST(event_id % 30 AS STRING) || '.5'
    WHEN 'click' THEN '[DET    ] frame=' || CAST(event_id AS STRING) || ' raw=3 final=1'
    WHEN 'signup' THEN '[OK     ] GID=' || CAST(user_id % 20 AS STRING) || ' Folder ready -> /x'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '[WARN   ] link lost' ELSE '[ERROR  ] no fix' END
    ELSE 'plain line without prefix' END AS line
FROM events
""",
    "pixels": """
SELECT l_suppkey AS image_id, l_orderkey AS r, l_linenumber AS c,
  max(CASE WHEN l_partkey % 23 = 0 THEN 255 ELSE l_partkey % 14 END) AS label,
  max(CASE WHEN l_orderkey % 5 = 0 THEN (l_partkey + 3) % 14 ELSE l_partkey % 14 END) AS pred
FROM lineitem GROUP BY 1, 2, 3
""",
    "cells": """
SELECT o_custkey % 8 AS frame, o_orderkey % 24 AS r, CAST(floor(o_orderkey / 24) AS BIGINT) % 32 AS c,
  max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS blocked
FROM orders GROUP BY 1, 2, 3
""",
    "points": """
SELECT CAST(p_size % 3 AS INT) AS scene, p_partkey AS pt,
  (p_partkey * 7919) % 1000 * CAST(0.01 AS DOUBLE) AS x, (p_partkey * 104729) % 1000 * CAST(0.01 AS DOUBLE) AS y, p_size * CAST(0.1 AS DOUBLE) AS z,
  (p_partkey * 7919) % 1000 * CAST(0.01 AS DOUBLE) + (p_partkey % 7) * CAST(0.02 AS DOUBLE) AS gx, (p_partkey * 104729) % 1000 * CAST(0.01 AS DOUBLE) AS gy,
  p_size * CAST(0.1 AS DOUBLE) AS gz FROM part
""",
    "beams": """
SELECT l_orderkey AS seq, l_linenumber AS beam_no, l_orderkey * CAST(1.0 AS DOUBLE) AS lat_deg, CAST(20.0 AS DOUBLE) + l_orderkey % 5 AS alt_rel_m,
  (l_orderkey % 9 - 4) * CAST(1.0 AS DOUBLE) AS roll_deg, (l_linenumber - 4) * CAST(11.0 AS DOUBLE) AS cam_angle_deg,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(15.0 AS DOUBLE) + l_quantity * CAST(0.2 AS DOUBLE) END AS cam_range_m,
  CAST(0.5 AS DOUBLE) + l_quantity * CAST(0.01 AS DOUBLE) AS d_rel FROM lineitem
""",
    "metrics": """
SELECT o_orderpriority AS dataset, o_orderstatus AS mode, 's' || CAST(o_custkey % 10 AS STRING) AS scene,
  CASE o_orderkey % 3 WHEN 0 THEN 'fscore' WHEN 1 THEN 'auc30' ELSE 'overall' END AS metric,
  'run' || CAST(o_orderkey % 2 AS STRING) AS run, avg(o_totalprice) AS value
FROM orders GROUP BY 1, 2, 3, 4, 5
""",
    "decisions": """
SELECT doc_id, quality AS truth, toxic AS pred FROM labels
""",
    "goals": """
SELECT event_id, props AS payload,
  CAST(CAST(28.75 AS DOUBLE) + event_id * CAST(0.00001 AS DOUBLE) AS STRING) || ', 77.11' AS probe FROM events
""",
}

# People who stay at one of four places and are seen in about two of three frames.
VIEWS["stays"] = """
SELECT 'm' || CAST(l_orderkey % 3 AS STRING) AS mission_id, CAST(floor(l_orderkey / 3) AS BIGINT) AS frame, l_suppkey % 4 AS place, max(l_partkey) * 4 + l_suppkey % 4 AS det_id,
  max(l_suppkey % 4 * 300 + l_partkey % 7) * CAST(1.0 AS DOUBLE) AS x1, max(l_suppkey % 4 * 120 + l_partkey % 5) * CAST(1.0 AS DOUBLE) AS y1,
  max(l_suppkey % 4 * 300 + l_partkey % 7 + 60) * CAST(1.0 AS DOUBLE) AS x2, max(l_suppkey % 4 * 120 + l_partkey % 5 + 60) * CAST(1.0 AS DOUBLE) AS y2,
  max(l_discount * 8) AS conf, max(l_tax * 400) AS sharpness, CAST(28.75 AS DOUBLE) + l_suppkey % 4 * CAST(0.0003 AS DOUBLE) AS lat, CAST(77.11 AS DOUBLE) AS lon
FROM lineitem GROUP BY 1, 2, 3
"""
# Views beyond the fixture list: depth maps, cameras and pose pairs derived from the base tables.
VIEWS["depth_px"] = """
SELECT CAST(l_suppkey % 3 AS INT) AS scene, l_linenumber AS view, l_partkey % 40 AS u, l_orderkey % 30 AS v,
  max(CASE WHEN l_partkey % 29 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) + (l_partkey % 40) * CAST(0.01 AS DOUBLE) + (l_orderkey % 3) * CAST(0.05 AS DOUBLE) END) AS depth,
  max(l_quantity * CAST(0.05 AS DOUBLE)) AS conf, max(l_discount * 7) AS sky, max(l_partkey % 256) AS red, max(l_suppkey % 256) AS green, max(l_orderkey % 256) AS blue
FROM lineitem GROUP BY 1, 2, 3, 4
"""
VIEWS["cameras"] = """
SELECT DISTINCT CAST(l_suppkey % 3 AS INT) AS scene, l_linenumber AS view, CAST(50.0 AS DOUBLE) + l_linenumber AS fx, CAST(52.0 AS DOUBLE) AS fy,
  CAST(20.0 AS DOUBLE) AS cx, CAST(15.0 AS DOUBLE) AS cy, l_linenumber * CAST(0.01 AS DOUBLE) AS tx FROM lineitem
"""
VIEWS["pose_pairs"] = """
SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS scene, p_partkey % 50 AS view, (p_partkey * 37) % 360 * CAST(0.0174532925 AS DOUBLE) AS a,
  (p_partkey * 37) % 360 * CAST(0.0174532925 AS DOUBLE) + (p_partkey * 13 % 17) * CAST(0.011 AS DOUBLE) AS pa,
  (p_partkey * 7919) % 101 * CAST(0.1 AS DOUBLE) AS x, (p_partkey * 104729) % 97 * CAST(0.1 AS DOUBLE) AS y,
  (p_partkey * 7919) % 101 * CAST(0.1 AS DOUBLE) + (p_partkey % 5) * CAST(0.031 AS DOUBLE) AS px, (p_partkey * 104729) % 97 * CAST(0.1 AS DOUBLE) - (p_partkey % 7) * CAST(0.023 AS DOUBLE) AS py
FROM part
"""


class Tables:
    """Access to base tables and fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            used = re.findall(r"FROM (\w+)", VIEWS[name])
            text = re.sub(r"FROM (\w+)", r"FROM {\1}", VIEWS[name])
            return self.spark.sql(text, **{base: self._base(base) for base in used})
        return self._base(name)

    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_views(names, body: str) -> str:
    """A statement that sees the named views as CTEs."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = body.lstrip()
    for kw in ("WITH RECURSIVE", "WITH"):
        if rest.upper().startswith(kw):
            return f"{head}{ctes},\n{rest[len(kw):]}"
    return f"{head}{ctes}\n{rest}"
