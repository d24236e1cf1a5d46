"""Great-circle geometry and pixel-to-ground projection as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in metres, and the match edges of the geo score.
R_EARTH = 6371000.0
R_EARTH_MEAN = 6371008.8
GEO_MATCH_M = 3.0
GEO_FAR_M = 7.0

# Fixed value: metres in one degree of latitude on the flat-earth path.
M_PER_DEG = 111319.4907932736


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = R_EARTH, form: str = "asin") -> Column:
    """Great-circle distance in metres; ``form`` is ``asin`` or ``atan2``."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = p2 - p1, F.radians(_c(lon2) - _c(lon1))
    sp, sl = F.sin(dp / 2), F.sin(dl / 2)
    a = sp * sp + F.cos(p1) * F.cos(p2) * sl * sl
    if form == "atan2":
        return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    # least() skips NULL, so a missing point must be caught first
    return F.when(a.isNotNull(), F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, degrees in [0, 360)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2) - _c(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


@dataclass(frozen=True)
class Camera:
    """Pinhole intrinsics; the defaults are the calibrated wide camera (fixed values)."""

    fx: float = 1584.02798
    fy: float = 1581.52473
    cx: float = 953.27546
    cy: float = 518.97355
    width: int = 1920
    height: int = 1080


def xyz(x, y, z) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(z).alias("z"))


def pixel_ray(u, v, cam: Camera = Camera(), zoom=1.0) -> Column:
    """Unit ray in the camera frame; zoom multiplies both focal lengths."""
    z = F.when(_c(zoom) > 0, _c(zoom)).otherwise(F.lit(1.0))
    x = (_c(u) - cam.cx) / (z * cam.fx)
    y = (_c(v) - cam.cy) / (z * cam.fy)
    n = F.sqrt(x * x + y * y + 1.0)
    return xyz(x / n, y / n, F.lit(1.0) / n)


def cam_to_body(ray: Column) -> Column:
    """Image right is body right (+y), image down is body backward (-x)."""
    return xyz(-ray["y"], ray["x"], ray["z"])


def body_to_world(v: Column, roll, pitch, yaw) -> Column:
    """Rotate a body vector to north/east/down with yaw outermost. Angles in radians."""
    cr, sr = F.cos(_c(roll)), F.sin(_c(roll))
    cp, sp = F.cos(_c(pitch)), F.sin(_c(pitch))
    cw, sw = F.cos(_c(yaw)), F.sin(_c(yaw))
    # roll, then pitch, then yaw, one plane at a time
    y1, z1 = cr * v["y"] - sr * v["z"], sr * v["y"] + cr * v["z"]
    x2, z2 = cp * v["x"] + sp * z1, cp * z1 - sp * v["x"]
    return xyz(cw * x2 - sw * y1, sw * x2 + cw * y1, z2)


def ground_hit(ray: Column, altitude, ground_altitude=0.0) -> Column:
    """Where a downward ray meets flat ground; NULL otherwise.

    ``ground_altitude`` is accepted and not used: altitude is already above ground.
    """
    k = _c(altitude) / ray["z"]
    return F.when(ray["z"] > 0, xyz(ray["x"] * k, ray["y"] * k, ray["z"] * k))


def m_per_deg_lat(lat) -> Column:
    p = F.radians(_c(lat))
    # WGS-84 series for one degree of latitude.
    return (111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p))


def m_per_deg_lon(lat) -> Column:
    p = F.radians(_c(lat))
    # WGS-84 series for one degree of longitude.
    return 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)


def ned_to_gps(north, east, lat, lon) -> Column:
    """Offset a position by metres north and east."""
    return F.struct(
        (_c(lat) + _c(north) / m_per_deg_lat(lat)).alias("lat"),
        (_c(lon) + _c(east) / m_per_deg_lon(lat)).alias("lon"),
    )


def pixel_to_gps(u, v, lat, lon, alt, roll, pitch, yaw, cam: Camera = Camera(), zoom=1.0) -> Column:
    """Ground position of a pixel. Angles in radians. NULL when the ray misses the ground."""
    world = body_to_world(cam_to_body(pixel_ray(u, v, cam, zoom)), roll, pitch, yaw)
    hit = ground_hit(world, alt)
    return F.when(hit.isNotNull(), ned_to_gps(hit["x"], hit["y"], lat, lon))


def local_xy(lat, lon, lat0, lon0, radius: float = R_EARTH) -> Column:
    """Equirectangular metres about a reference point."""
    return F.struct(
        (F.radians(_c(lon) - _c(lon0)) * radius * F.cos(F.radians(_c(lat0)))).alias("x"),
        (F.radians(_c(lat) - _c(lat0)) * radius).alias("y"),
    )


def latlon_to_local(lat, lon, cur_lat, cur_lon, cur_x, cur_y, m_per_deg: float = M_PER_DEG) -> Column:
    """Target position in the map frame from the current fix and map pose; NULL if unknown."""
    north = (_c(lat) - _c(cur_lat)) * m_per_deg
    east = (_c(lon) - _c(cur_lon)) * m_per_deg * F.cos(F.radians(_c(cur_lat)))
    return F.when(
        east.isNotNull() & north.isNotNull() & _c(cur_x).isNotNull() & _c(cur_y).isNotNull(),
        F.struct((_c(cur_x) + east).alias("x"), (_c(cur_y) + north).alias("y")),
    )


def geo_score(d, near: float = GEO_MATCH_M, far: float = GEO_FAR_M) -> Column:
    """1 below ``near`` metres, 0 beyond ``far``, linear between."""
    d = _c(d)
    return (F.when(d.isNull(), F.lit(None).cast("double")).when(d < near, F.lit(1.0))
            .when(d > far, F.lit(0.0)).otherwise(1.0 - (d - near) / (far - near)))


def cross_track(ax, ay, bx, by, px, py) -> Column:
    """Distance from p to the infinite line a-b; to a itself when a and b coincide."""
    dx, dy = _c(bx) - _c(ax), _c(by) - _c(ay)
    qx, qy = _c(px) - _c(ax), _c(py) - _c(ay)
    span = F.hypot(dx, dy)
    return F.when(span < 1e-6, F.hypot(qx, qy)).otherwise(F.abs(dx * qy - dy * qx) / span)


def fov(fx, fy, cx, cy) -> Column:
    """Horizontal and vertical field of view (radians) from intrinsics scaled to a unit image."""
    def angle(f, c, other_f, other_c):
        o = (F.lit(0.5) - _c(other_c)) / _c(other_f)
        a, b = (F.lit(0.0) - _c(c)) / _c(f), (F.lit(1.0) - _c(c)) / _c(f)
        dot = a * b + o * o + 1.0
        return F.acos(dot / (F.sqrt(a * a + o * o + 1.0) * F.sqrt(b * b + o * o + 1.0)))

    return F.struct(angle(fx, cx, fy, cy).alias("fov_x"), angle(fy, cy, fx, cx).alias("fov_y"))


def gsd(alt, zoom=1.0, cam: Camera = Camera()) -> Column:
    """Metres per pixel at nadir; NULL when the altitude is missing or zero."""
    return F.when(_c(alt) != 0, _c(alt) / (_c(zoom) * cam.fx))


def metric_scale(depth, fx, fy, scale_factor: float = 300.0) -> Column:
    """Metric depth from a canonical-focal prediction."""
    return _c(depth) * ((_c(fx) + _c(fy)) / 2.0 / scale_factor)
