"""Parsing and formatting of mission text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line, unit and number patterns of the mission files.
LOG_LINE = r"^\[(\w+)\s*\]\s?(.*)$"
QUANTITY = r"^(-?[0-9.eE+]+)\s*(sec|s|m|ms|deg|px)$"
CROP_NAME = r"crop_frame_(\d+)\.jpg"
GID_READY = r"GID=(\d+)\s+Folder ready"
FPS = r"FPS=([0-9.]+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_blank(s: Column) -> Column:
    return F.when(s != "", s)


def parse_quantity(col) -> Column:
    """Strip a trailing unit, then integer, else double, else the text itself."""
    raw = F.trim(_c(col))
    bare = F.coalesce(null_if_blank(F.regexp_extract(raw, QUANTITY, 1)), raw)
    whole = F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("bigint"))
    real = F.when(whole.isNull(), bare.try_cast("double"))
    return F.struct(
        whole.alias("int_value"),
        real.alias("double_value"),
        F.when(whole.isNull() & real.isNull(), bare).alias("text_value"),
    )


def number(col) -> Column:
    """Numeric reading of a quantity, NULL when it is text."""
    q = parse_quantity(col)
    return F.coalesce(q["int_value"].cast("double"), q["double_value"])


def parse_lat_lon(col) -> Column:
    """Two numbers separated by blanks, commas or semicolons, in range; NULL otherwise."""
    parts = F.filter(F.split(F.trim(_c(col)), r"[\s,;]+"), lambda p: p != "")
    lat, lon = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    ok = ((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
          & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180))
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def mission_clock(seconds) -> Column:
    """Elapsed seconds as ``HH:MM:SS.mmm``."""
    s = _c(seconds)
    rest = F.pmod(s, F.lit(60.0))
    return F.format_string(
        "%02d:%02d:%06.3f",
        F.floor(s / 3600).cast("int"),
        F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("int"),
        rest,
    )


def run_started_at(name) -> Column:
    """Unix seconds of a run folder named yyyyMMdd_HHmmss; NULL for other names."""
    s = _c(name)
    stamp = F.when(s.rlike(r"^\d{8}_\d{6}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd_HHmmss")))
    return F.unix_micros(stamp) / 1e6


def run_name(unix_seconds) -> Column:
    return F.date_format(F.timestamp_seconds(_c(unix_seconds)), "yyyyMMdd_HHmmss")


def iso_to_unix(text) -> Column:
    """ISO-8601 start time to Unix seconds."""
    return F.unix_micros(_c(text).try_cast("timestamp")) / 1e6


def crop_frame(path) -> Column:
    return null_if_blank(F.regexp_extract(_c(path), CROP_NAME, 1)).try_cast("bigint")


def path_part(path, i: int) -> Column:
    """The i-th path component from the end (1 = file name)."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-i))


def version_suffix(path, n) -> Column:
    """Replace the ``?v=`` number of a picture link."""
    return F.concat(F.regexp_replace(_c(path), r"\?v=\d+$", ""), F.lit("?v="), _c(n).cast("string"))


def stem(path) -> Column:
    return F.regexp_replace(path_part(path, 1), r"\.[^.]*$", "")


def log_level(line) -> Column:
    return F.coalesce(null_if_blank(F.regexp_extract(_c(line), LOG_LINE, 1)), F.lit("RAW"))


def log_message(line) -> Column:
    line = _c(line)
    return F.when(line.rlike(LOG_LINE), F.regexp_extract(line, LOG_LINE, 2)).otherwise(line)


def fps_value(msg) -> Column:
    return null_if_blank(F.regexp_extract(_c(msg), FPS, 1)).try_cast("double")


def ready_gid(msg) -> Column:
    return null_if_blank(F.regexp_extract(_c(msg), GID_READY, 1)).try_cast("bigint")


def parse_goals(df, col: str = "payload"):
    """Goal commands from JSON: ``status`` accepted, cancel or rejected, with the reason and values.

    The reasons follow the order of the checks: text, command, yaw, then the coordinates.
    """
    j = F.from_json(F.col(col), "cmd string, lat string, lon string, x string, y string, yaw string, frame string")
    d = df.withColumn("__j", j).withColumn("__ok", F.try_parse_json(col).isNotNull() & F.col(col).rlike(r"^\s*\{"))
    f = lambda n: F.col(f"__j.{n}")
    num = lambda n: f(n).try_cast("double")
    cmd = F.coalesce(f("cmd"), F.lit("goal"))
    has_ll, has_xy = f("lat").isNotNull() & f("lon").isNotNull(), f("x").isNotNull() & f("y").isNotNull()
    reason = (F.when(~F.col("__ok"), "malformed JSON").when(cmd == "cancel", None).when(cmd != "goal", F.concat(F.lit("unknown cmd: "), cmd))
              .when(f("yaw").isNotNull() & num("yaw").isNull(), "yaw must be numeric")
              .when(has_ll & (num("lat").isNull() | num("lon").isNull()), "lat/lon must be numeric").when(has_ll, None)
              .when(has_xy & (num("x").isNull() | num("y").isNull()), "x/y must be numeric").when(has_xy, None).otherwise("goal needs lat+lon (or x+y)"))
    d = d.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "rejected").when(cmd == "cancel", "cancel").otherwise("accepted")
    return d.withColumns({"status": status, "yaw": F.coalesce(num("yaw"), F.lit(0.0)), "lat": num("lat"), "lon": num("lon"), "x": num("x"), "y": num("y"),
                          "frame": F.coalesce(f("frame"), F.lit("map"))}).drop("__j", "__ok")
