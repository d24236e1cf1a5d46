"""Flight logs as CSV, in the strict schema or with column aliases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Strict columns and their short names, and the alias lists in order of preference.
NEEDED = {"t_mono_s": "t", "lat_deg": "lat", "lon_deg": "lon", "alt_rel_m": "alt", "roll_deg": "roll", "pitch_deg": "pitch", "yaw_deg": "yaw"}
OPTIONAL = {"zoom_ratio": "zoom"}
ALIASES = {
    "t": ("t_mono_s", "timestamp_sec", "timestamp", "t", "time", "time_s"),
    "lat": ("lat_deg", "drone_lat", "lat", "latitude"),
    "lon": ("lon_deg", "drone_lon", "lon", "longitude"),
    "alt": ("alt_rel_m", "drone_altitude_agl", "rel_alt", "altitude", "alt", "alt_m"),
    "heading": ("heading_deg", "heading", "yaw_deg", "yaw", "hdg"),
    "speed": ("groundspeed_ms", "groundspeed", "gs", "speed"),
    "roll": ("roll_deg", "roll"),
    "pitch": ("pitch_deg", "pitch"),
    "yaw": ("yaw_deg", "yaw"),
    "zoom": ("zoom_ratio", "zoom"),
    "battery": ("battery_pct", "battery_remaining", "batt_pct", "battery"),
    "frame": ("frame", "frame_idx", "frame_id"),
}
BLANK = ("", "nan", "none", "null")


def _csv(spark: SparkSession, path) -> DataFrame:
    """All cells as text, header names without blanks or byte-order mark, and the file of each row.

    All files of one read share a header; logs of different schemas are read apart.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').csv(path)
    clean = [c.replace("﻿", "").strip() for c in raw.columns]
    return raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, clean)], F.col("_metadata.file_path").alias("__path"))


def mission_from_path(path: str = "__path") -> Column:
    """File name without its ending."""
    return F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), r"\.[^.]*$", "")


def cell_number(col: str) -> Column:
    """Number in a text cell; NULL for blanks, words for nothing and damaged text."""
    v = F.trim(F.col(col))
    return F.when(~F.lower(v).isin(*BLANK), v.try_cast("double"))


def parse_strict(rows: DataFrame, mission: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows as typed telemetry, and rejected rows with the fields that failed."""
    missing = [c for c in NEEDED if c not in rows.columns]
    if missing:
        raise ValueError(f"flight log lacks {missing}; found {rows.columns}")
    nums = {s: cell_number(c) for c, s in NEEDED.items()}
    d = rows.select(mission.alias("mission_id"), *[v.alias(s) for s, v in nums.items()],
                    *[(cell_number(c) if c in rows.columns else F.lit(None).cast("double")).alias(s) for c, s in OPTIONAL.items()],
                    F.struct(*[F.col(c) for c in NEEDED]).alias("raw"))
    failed = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(c)) for c, s in NEEDED.items()]))
    d = d.withColumn("failed", failed)
    good = d.filter(F.size("failed") == 0).drop("failed", "raw")
    return good, d.filter(F.size("failed") > 0).select("mission_id", "failed", "raw")


def read_flight_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Strict reader: (good, rejects)."""
    rows = _csv(spark, path)
    return parse_strict(rows, mission_from_path())


def reject_counts(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows kept and skipped per mission, and the number of rows each field spoiled."""
    g = good.groupBy("mission_id").agg(F.count("*").alias("kept"))
    r = rejects.groupBy("mission_id").agg(F.count("*").alias("skipped"), *[
        F.count_if(F.array_contains("failed", c)).alias(f"bad_{s}") for c, s in NEEDED.items()])
    return g.join(r, "mission_id", "full").fillna(0)


def parse_aliased(rows: DataFrame, mission: Column, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Telemetry from whichever names the header uses; time, latitude and longitude are needed."""
    lowered = {c.lower().strip(): c for c in rows.columns}
    found = {f: next((lowered[a] for a in names if a in lowered), None) for f, names in aliases.items()}
    lost = [f for f in ("t", "lat", "lon") if found[f] is None]
    if lost:
        raise ValueError(f"need {lost}; found {rows.columns}")

    def field(f):
        c = F.trim(F.col(f"`{found[f]}`")).try_cast("double") if found[f] else F.lit(None).cast("double")
        return F.floor(c).cast("bigint") if f == "frame" else c

    d = rows.select(mission.alias("mission_id"), *[field(f).alias(f) for f in aliases])
    la, lo = F.col("lat"), F.col("lon")
    fin = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return d.filter(F.col("t").isNotNull() & fin(la) & fin(lo) & ~((la == 0) & (lo == 0)))


def read_flight_log_aliased(spark: SparkSession, path, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    return parse_aliased(_csv(spark, path), mission_from_path(), aliases)
