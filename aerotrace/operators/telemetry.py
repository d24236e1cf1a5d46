"""Telemetry cleaning and its joins to video frames, by frame number or by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerotrace.functions import geo
from aerotrace.operators import ordered

# Fixed values of the mission rules.
ZOOM_RATIO = 2.0
TRAIL_MAX = 12000
STALE_S = 3.0
BATTERY_LOW = 25
BATTERY_CRITICAL = 15

# Width of a time segment: at a few hundred rows per second a segment stays small.
SEGMENT_S = 300.0


def time_segment(t: str = "t", width: float = SEGMENT_S) -> Column:
    return F.floor(F.col(t) / width)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def drop_no_fix(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Keep rows with a real position: present, finite and not exactly (0, 0)."""
    la, lo = F.col(lat), F.col(lon)
    return df.filter(finite(la) & finite(lo) & ~((la == 0) & (lo == 0)))


def known_zoom(col: str = "zoom") -> Column:
    z = F.col(col)
    return F.when(finite(z) & (z > 0), z)


def fill_zoom(df: DataFrame, by: Sequence[str] = ("mission_id",), t: str = "t") -> DataFrame:
    """Fill zoom gaps with the last report; rows before the first report take that one."""
    d = ordered.carry(df, by, [t], time_segment(t), known_zoom(), prev="__back", next="__ahead")
    return d.withColumn("zoom", F.coalesce("__back", "__ahead")).drop("__back", "__ahead")


def zoom_or(col="zoom", default: float = ZOOM_RATIO) -> Column:
    """Zoom for projection: the fallback when missing, not finite or not positive."""
    z = F.col(col) if isinstance(col, str) else col
    return F.when(finite(z) & (z > 0), z).otherwise(F.lit(default))


def join_frame(frames: DataFrame, telem: DataFrame, order: str = "t",
               by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Exact join on frame number; the earliest telemetry row of a frame wins."""
    keys = [*by, "frame"]
    rest = [c for c in telem.columns if c not in keys]
    first = telem.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("telem"))
    return frames.join(first, keys, "left")


def asof(left: DataFrame, right: DataFrame, on: str = "t", by: Sequence[str] = ("mission_id",),
         direction: str = "nearest", tolerance: float | None = None, cols: Sequence[str] | None = None,
         out: str = "match", width: float = SEGMENT_S) -> DataFrame:
    """Match each left row with one right row in time; NULL where none qualifies.

    Both sides are unioned and scanned once per segment, so there is one shuffle of the input
    and no range join. ``direction`` is ``backward``, ``forward`` or ``nearest``; an equal
    distance goes to the earlier row. Right rows with equal ``on`` values count as one, so
    deduplicate them first when they can differ.
    """
    by = list(by)
    cols = list(cols or [c for c in right.columns if c not in by])
    rstruct = F.struct(F.col(on).alias("__on"), *cols)
    lrows = left.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__l_{c}") for c in left.columns])
    rrows = right.select(*by, F.col(on).alias("__t"), F.lit(0).alias("__side"), rstruct.alias("__r"))
    u = lrows.unionByName(rrows, allowMissingColumns=True)
    need_prev, need_next = direction in ("backward", "nearest", "forward"), direction in ("forward", "nearest")
    u = ordered.carry(u, by, ["__t", "__side"], F.floor(F.col("__t") / width),
                      F.when(F.col("__side") == 0, F.col("__r")),
                      prev="__p" if need_prev else None, next="__n" if need_next else None)
    u = u.filter(F.col("__side") == 1)
    t, p, n = F.col("__t"), F.col("__p"), F.col("__n")
    # which side is used is one small column, so later steps do not repeat its condition per field
    if direction == "backward":
        pick = F.when(p.isNotNull(), 1).otherwise(0)
    elif direction == "forward":
        pick = F.when(p["__on"] == t, 1).when(n.isNotNull(), 2).otherwise(0)
    else:
        pick = (F.when(p.isNotNull() & (n.isNull() | (t - p["__on"] <= n["__on"] - t)), 1).when(n.isNotNull(), 2).otherwise(0))
    u = u.withColumn("__pick", pick)
    side = (lambda c: p[c]) if direction == "backward" else (lambda c: F.when(F.col("__pick") == 1, p[c]).otherwise(n[c]))
    if tolerance is not None:
        near = F.abs(side("__on") - t) <= tolerance
        u = u.withColumn("__pick", F.when(near, F.col("__pick")).otherwise(0))
    picked = F.when(F.col("__pick") > 0, F.struct(*[side(c).alias(c) for c in cols]))
    return u.select(*[F.col(f"__l_{c}").alias(c) for c in left.columns], picked.alias(out))


def latest_cached(frames: DataFrame, samples: DataFrame, max_age: float = 1.0, **kw) -> DataFrame:
    """Newest sample at or before each frame; frames with none within ``max_age`` are dropped."""
    return asof(frames, samples, direction="backward", tolerance=max_age, **kw).filter(
        F.col(kw.get("out", "match")).isNotNull())


def sync3(images: DataFrame, gps: DataFrame, imu: DataFrame, slop: float = 0.1, **kw) -> DataFrame:
    """Image rows with the nearest GPS and IMU samples, both within ``slop`` seconds."""
    a = asof(images, gps, tolerance=slop, out="gps", **kw)
    return (asof(a, imu, tolerance=slop, out="imu", **kw)
            .filter(F.col("gps").isNotNull() & F.col("imu").isNotNull()))


STATE_FIELDS = ("t", "lat", "lon", "alt", "heading", "speed", "roll", "pitch", "yaw", "zoom", "battery")


def _with_state_fields(telem: DataFrame) -> DataFrame:
    for c in STATE_FIELDS:
        if c not in telem.columns:
            telem = telem.withColumn(c, F.lit(None).cast("double"))
    return telem


def _state(a: Column, b: Column, f: Column) -> Column:
    """Aircraft state a fraction ``f`` of the way from fix ``a`` to fix ``b``.

    Position is interpolated. Attitude and zoom belong to one exposure and stay those of ``a``.
    """
    same = (a["lat"] == b["lat"]) & (a["lon"] == b["lon"])
    dt = b["t"] - a["t"]
    heading = F.coalesce(a["heading"], F.when(same, 0.0).otherwise(geo.bearing(a["lat"], a["lon"], b["lat"], b["lon"])))
    speed = F.coalesce(a["speed"], F.when(dt > 0, geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"]) / dt)
                       .otherwise(0.0))
    alt = F.when(b["alt"].isNotNull(), a["alt"] + (b["alt"] - a["alt"]) * f).otherwise(a["alt"])
    return F.when(a.isNotNull(), F.struct(
        (a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * f).alias("lon"),
        alt.alias("alt"), heading.alias("heading"), speed.alias("speed"), a["battery"].alias("battery"),
        a["roll"].alias("roll"), a["pitch"].alias("pitch"), a["yaw"].alias("yaw"), a["zoom"].alias("zoom")))


def interpolate_at(frames: DataFrame, telem: DataFrame, by: Sequence[str] = ("mission_id",),
                   offset: float | None = None, out: str = "state", width: float = SEGMENT_S) -> DataFrame:
    """State between the two fixes around each frame, clamped at both ends of the log.

    With ``offset`` given, frame times start at zero and are aligned to the first fix.
    """
    by = list(by)
    fixes = drop_no_fix(_with_state_fields(telem)).select(*by, *STATE_FIELDS)
    fixes = ordered.following(fixes, by, ["t"], time_segment("t", width), list(STATE_FIELDS), "__after")
    if offset is not None:
        start = fixes.groupBy(*by).agg((F.min("t") - F.lit(offset)).alias("__t0"))
        frames = frames.join(start, by, "left").withColumn("__video_t", F.col("t")).withColumn(
            "t", F.col("t") + F.col("__t0")).drop("__t0")
    lrows = frames.select(*by, F.col("t").alias("__t"), F.lit(1).alias("__side"), F.struct(*frames.columns).alias("__l"))
    rrows = fixes.select(*by, F.col("t").alias("__t"), F.lit(0).alias("__side"),
                         F.struct(*STATE_FIELDS, "__after").alias("__r"))
    u = lrows.unionByName(rrows, allowMissingColumns=True)
    u = ordered.carry(u, by, ["__t", "__side"], F.floor(F.col("__t") / width),
                      F.when(F.col("__side") == 0, F.col("__r")), prev="__p", next="__n")
    u = u.filter(F.col("__side") == 1).withColumn("__a", F.coalesce("__p", "__n"))
    u = u.withColumn("__b", F.when(F.col("__a")["__after"].isNotNull(), F.col("__a")["__after"]).otherwise(
        F.struct(*[F.col("__a")[c].alias(c) for c in STATE_FIELDS])))
    a, b = F.col("__a"), F.col("__b")
    span = b["t"] - a["t"]
    f = F.when(F.col("__p").isNull() | (span <= 0), 0.0).otherwise((F.col("__t") - a["t"]) / span)
    d = u.select("__l.*", _state(a, b, f).alias(out))
    if offset is not None:
        d = d.withColumn("t", F.col("__video_t")).drop("__video_t")
    return d


def state_at(frames: DataFrame, telem: DataFrame, by: Sequence[str] = ("mission_id",), out: str = "state") -> DataFrame:
    """State by frame number where the log names the frame, interpolated in time elsewhere."""
    by = list(by)
    fixes = drop_no_fix(_with_state_fields(telem))
    d = interpolate_at(frames, telem, by, out="__interp")
    named = fixes.filter(F.col("frame").isNotNull()).groupBy(*by, "frame").agg(
        F.min_by(F.struct(*STATE_FIELDS), F.col("t")).alias("__a"))
    ahead = named.select(*by, (F.col("frame") - 1).alias("frame"), F.col("__a").alias("__b"))
    d = d.join(named, [*by, "frame"], "left").join(ahead, [*by, "frame"], "left")
    b = F.coalesce(F.col("__b"), F.col("__a"))
    exact = _state(F.col("__a"), b, F.lit(0.0))
    return d.withColumn(out, F.coalesce(exact, F.col("__interp"))).drop("__a", "__b", "__interp")


def trail(telem: DataFrame, n: int = TRAIL_MAX, by: Sequence[str] = ("mission_id",), t: str = "t") -> DataFrame:
    """The newest ``n`` positions of the path, repeats of the previous position dropped."""
    fixes = telem.filter(finite(F.col("lat")) & finite(F.col("lon")))
    d = ordered.previous(fixes, by, [t], time_segment(t), ["lat", "lon"], "__last")
    last = F.col("__last")
    d = d.filter(last.isNull() | (last["lat"] != F.col("lat")) | (last["lon"] != F.col("lon"))).drop("__last")
    return ordered.last_n(d, by, [t], time_segment(t), n)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, "__r.*")


def mask_stale(df: DataFrame, now: Column, ts: str = "ts", limit: float = STALE_S,
               fields: Sequence[str] = ()) -> DataFrame:
    """NULL every field of a sample that is ``limit`` seconds old or more."""
    live = now - F.col(ts) < limit
    return df.withColumns({c: F.when(live, F.col(c)) for c in fields})


def battery_band(pct) -> Column:
    p = F.col(pct) if isinstance(pct, str) else pct
    return (F.when(p.isNull(), "unknown").when(p <= BATTERY_CRITICAL, "critical")
            .when(p <= BATTERY_LOW, "low").otherwise("ok"))


def mode_class(mode) -> Column:
    m = F.upper(F.coalesce(F.col(mode) if isinstance(mode, str) else mode, F.lit("")))
    return (F.when(m.isin("AUTO", "GUIDED"), "mission").when(m.isin("RTL", "LAND"), "return")
            .when(m.isin("STABILIZE", "ALT_HOLD", "LOITER"), "manual").otherwise("other"))


def gps_stability(df: DataFrame, by: Sequence[str] = ("mission_id",), t: str = "t",
                  segment: Column | None = None) -> DataFrame:
    """Mean and largest jump in metres between consecutive fixes, for groups with two or more."""
    fixes = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    d = ordered.previous(fixes, by, [t], time_segment(t) if segment is None else segment, ["lat", "lon"], "__last")
    jump = geo.haversine(F.col("__last")["lat"], F.col("__last")["lon"], "lat", "lon", form="atan2")
    return (d.withColumn("__jump", jump).groupBy(*by)
            .agg(F.count("*").alias("points"), F.avg("__jump").alias("mean_jump"), F.max("__jump").alias("max_jump"))
            .filter(F.col("points") >= 2))


def rolling_rate(df: DataFrame, span: float = 5.0, by: Sequence[str] = ("mission_id",), t: str = "t",
                 width: float = SEGMENT_S) -> DataFrame:
    """Rate over the trailing window: rows minus one over the time they span, 0 below two rows.

    Each row is also placed in the next segment when it can fall in that segment's window, so
    the window runs per segment.
    """
    us = F.round(F.col(t) * 1e6).cast("bigint")
    span_us, width_us = int(span * 1e6), int(width * 1e6)
    d = df.withColumn("__us", us).withColumn("__home", F.floor(us / width_us))
    d = d.withColumn("__seg", F.explode(F.sequence("__home", F.floor((F.col("__us") + span_us) / width_us))))
    # strict: a row exactly ``span`` old has left the window
    w = Window.partitionBy(*by, "__seg").orderBy("__us").rangeBetween(1 - span_us, 0)
    d = d.withColumn("__n", F.count("*").over(w)).withColumn("__lo", F.min("__us").over(w))
    d = d.filter(F.col("__seg") == F.col("__home"))
    secs = (F.col("__us") - F.col("__lo")) / 1e6
    rate = F.when((F.col("__n") >= 2) & (secs > 0), (F.col("__n") - 1) / secs).otherwise(0.0)
    return d.withColumn("rate_hz", rate).drop("__us", "__home", "__seg", "__n", "__lo")


def carry_fit(df: DataFrame, value: str, by: Sequence[str] = ("mission_id",), order: str = "frame",
              segment: Column | None = None, out: str | None = None) -> DataFrame:
    """Last known value of ``value``, NULL before the first."""
    seg = F.floor(F.col(order) / 4096) if segment is None else segment
    return ordered.carry(df, by, [order], seg, F.col(value), prev=out or value + "_held")


def ema(df: DataFrame, value: str, alpha: float, by: Sequence[str] = ("mission_id",), order: str = "frame",
        segment: Column | None = None, out: str = "ema") -> DataFrame:
    """Exponential moving average weighted ``alpha`` on the new value, started at the first value.

    A row without a value keeps the average as it is; rows before the first value have none.
    """
    by = list(by)
    seg = F.floor(F.col(order) / 4096) if segment is None else segment
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    start = df.filter(known).groupBy(*by).agg(F.min(order).alias("__o0"))
    d = df.join(start, by, "left")
    a = F.when(~known, 1.0).when(F.col(order) == F.col("__o0"), 0.0).otherwise(1.0 - alpha)
    b = F.when(~known, 0.0).when(F.col(order) == F.col("__o0"), F.col(value)).otherwise(alpha * F.col(value))
    d = ordered.linear_scan(d, by, [order], seg, a, b, out)
    return d.withColumn(out, F.when(F.col(order) >= F.col("__o0"), F.col(out))).drop("__o0")


def log_position(track: DataFrame, live: DataFrame | None = None, by: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Drone position: the live sample where it has one, else the logged fix of the highest frame."""
    by = list(by)
    logged = track.filter(finite(F.col("lat")) & finite(F.col("lon"))).groupBy(*by).agg(
        F.max_by(F.struct("lat", "lon"), F.struct("frame", -F.col("lat"), -F.col("lon"))).alias("__log"))
    if live is None:
        return logged.select(*by, "__log.lat", "__log.lon")
    cur = live.filter(finite(F.col("lat")) & finite(F.col("lon"))).select(*by, F.struct("lat", "lon").alias("__live"))
    d = logged.join(cur, by, "full")
    return d.withColumn("__pos", F.coalesce("__live", "__log")).select(
        *by, "__pos.lat", "__pos.lon", F.col("__live").isNull().alias("from_log"))


# Names of the vehicle states, by number.
MAV_STATE = {0: "UNINIT", 1: "BOOT", 2: "CALIBRATING", 3: "STANDBY", 4: "ACTIVE", 5: "CRITICAL",
             6: "EMERGENCY", 7: "POWEROFF", 8: "FLIGHT_TERMINATION"}


def normalize_mavlink(df: DataFrame) -> DataFrame:
    """Autopilot samples in engineering units; negative sentinels become NULL."""
    states = F.create_map(*[F.lit(x) for kv in MAV_STATE.items() for x in kv])
    raw = df.filter((F.col("component") == 1) & F.col("lat_e7").isNotNull() & F.col("lon_e7").isNotNull())
    return raw.select(
        "uav_id", "ts",
        (F.col("lat_e7") / 1e7).alias("latitude"), (F.col("lon_e7") / 1e7).alias("longitude"),
        (F.col("relative_alt_mm") / 1000.0).alias("altitude"), "groundspeed",
        (F.col("voltage_mv") / 1000.0).alias("battery"),
        F.when(F.col("battery_remaining") >= 0, F.col("battery_remaining")).alias("battery_pct"),
        F.when(F.col("current_ca") >= 0, F.col("current_ca") / 100.0).alias("current"),
        (F.col("base_mode").bitwiseAND(128) > 0).alias("armed"), "mode", "heading",
        F.coalesce(F.try_element_at(states, F.col("system_status").cast("int")), F.lit("UNKNOWN")).alias("status"))
