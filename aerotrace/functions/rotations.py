"""Rigid transforms as arrays of 16 doubles, row-major 4x4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def _at(m: Column, i: int, j: int) -> Column:
    return m[4 * i + j]


def mat4(r: list[list[Column]], t: list[Column]) -> Column:
    """Assemble a 4x4 from nine rotation cells and three translation cells."""
    cells = []
    for i in range(3):
        cells += [*r[i], t[i]]
    return F.array(*[_c(x).cast("double") for x in cells],
                   F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def quat_to_rot(x, y, z, w) -> list[list[Column]]:
    """Rotation cells of a quaternion of any length, scalar part ``w``."""
    x, y, z, w = map(_c, (x, y, z, w))
    s = F.lit(2.0) / (x * x + y * y + z * z + w * w)
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def quat_to_mat(x, y, z, w, tx=0.0, ty=0.0, tz=0.0) -> Column:
    """Pose from quaternion and translation; the identity rotation for a zero quaternion."""
    n = _c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z) + _c(w) * _c(w)
    unit = F.lit(1.0)
    ok = n > 1e-24
    q = [F.when(ok, _c(v)).otherwise(F.lit(0.0)) for v in (x, y, z)] + [F.when(ok, _c(w)).otherwise(unit)]
    return mat4(quat_to_rot(*q), [tx, ty, tz])


def euler_to_mat(roll, pitch, yaw, tx=0.0, ty=0.0, tz=0.0, order: str = "zyx", radians: bool = False) -> Column:
    """Pose from axis angles multiplied in ``order``; degrees unless ``radians``."""
    conv = (lambda a: _c(a)) if radians else (lambda a: F.radians(_c(a)))
    ang = {"x": conv(roll), "y": conv(pitch), "z": conv(yaw)}
    plane = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}
    r = [[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    for axis in order:
        p, q = plane[axis]
        c, s = F.cos(ang[axis]), F.sin(ang[axis])
        # right-multiply by a plane rotation: only columns p and q change
        r = [[(row[p] * c + row[q] * s) if j == p else (row[q] * c - row[p] * s) if j == q else row[j]
              for j in range(3)] for row in r]
    return mat4(r, [tx, ty, tz])


def mat_to_quat(m: Column) -> Column:
    """Unit quaternion (x, y, z, w) with w >= 0, from the best-conditioned component."""
    a, b, c = _at(m, 0, 0), _at(m, 1, 1), _at(m, 2, 2)
    dw, dx, dy, dz = 1 + a + b + c, 1 + a - b - c, 1 - a + b - c, 1 - a - b + c
    yz, xz, xy = _at(m, 2, 1) + _at(m, 1, 2), _at(m, 0, 2) + _at(m, 2, 0), _at(m, 1, 0) + _at(m, 0, 1)
    wx, wy, wz = _at(m, 2, 1) - _at(m, 1, 2), _at(m, 0, 2) - _at(m, 2, 0), _at(m, 1, 0) - _at(m, 0, 1)
    top = F.greatest(dw, dx, dy, dz)

    def quat(x, y, z, w, d):
        k = F.lit(0.5) / F.greatest(F.sqrt(F.greatest(d, F.lit(0.0))), F.lit(0.1))
        return F.array(x * k, y * k, z * k, w * k)

    q = (F.when(dw == top, quat(wx, wy, wz, dw, dw)).when(dx == top, quat(dx, xy, xz, wx, dx))
         .when(dy == top, quat(xy, dy, yz, wy, dy)).otherwise(quat(xz, yz, dz, wz, dz)))
    return F.when(q[3] < 0, F.transform(q, lambda v: -v)).otherwise(q)


def quat_yaw(x, y, z, w) -> Column:
    """Heading about the vertical axis, radians."""
    x, y, z, w = map(_c, (x, y, z, w))
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def se3_inverse(m: Column) -> Column:
    """Inverse of a rigid transform: transpose and back-rotated translation."""
    r = [[_at(m, j, i) for j in range(3)] for i in range(3)]
    t = [-(r[i][0] * _at(m, 0, 3) + r[i][1] * _at(m, 1, 3) + r[i][2] * _at(m, 2, 3)) for i in range(3)]
    return mat4(r, t)


def matmul(a: Column, b: Column) -> Column:
    """Product of two rigid transforms."""
    r = [[sum((_at(a, i, k) * _at(b, k, j) for k in range(1, 3)), _at(a, i, 0) * _at(b, 0, j))
          for j in range(3)] for i in range(3)]
    t = [sum((_at(a, i, k) * _at(b, k, 3) for k in range(3)), _at(a, i, 3)) for i in range(3)]
    return mat4(r, t)


def apply(m: Column, x, y, z) -> Column:
    """Transform a point."""
    x, y, z = map(_c, (x, y, z))
    row = lambda i: _at(m, i, 0) * x + _at(m, i, 1) * y + _at(m, i, 2) * z + _at(m, i, 3)
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def apply_sim3(r: Column, t: Column, s: Column, x, y, z, inverse: bool = False) -> Column:
    """Similarity transform of a point; ``r`` has 9 cells row-major, ``t`` has 3."""
    p = list(map(_c, (x, y, z)))
    if inverse:
        d = [p[i] - t[i] for i in range(3)]
        out = [(r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2]) / s for i in range(3)]
    else:
        out = [s * (r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2]) + t[i] for i in range(3)]
    return F.struct(*[c.alias(n) for c, n in zip(out, "xyz")])


def unproject(u, v, depth, fx, fy, cx, cy) -> Column:
    """Camera-space point of a pixel at a depth along the optical axis."""
    d = _c(depth)
    return F.struct(((_c(u) - _c(cx)) / _c(fx) * d).alias("x"),
                    ((_c(v) - _c(cy)) / _c(fy) * d).alias("y"), d.alias("z"))


def project(x, y, z, fx, fy, cx, cy) -> Column:
    """Pixel of a camera-space point."""
    return F.struct((_c(fx) * _c(x) / _c(z) + _c(cx)).alias("u"), (_c(fy) * _c(y) / _c(z) + _c(cy)).alias("v"))


def rot_angle(m_gt: Column, m_pred: Column) -> Column:
    """Angle in degrees between two rotations."""
    a, b = mat_to_quat(m_gt), mat_to_quat(m_pred)
    d = sum((a[i] * b[i] for i in range(1, 4)), a[0] * b[0])
    loss = F.greatest(1 - d * d, F.lit(1e-15))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), 1 - 2 * loss)))


def trans_angle(gt: list[Column], pred: list[Column], ambiguity: bool = True) -> Column:
    """Angle in degrees between two translation directions; 1e6 radians when undefined."""
    ln = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) + 1e-15
    d = sum((gt[i] * pred[i] for i in range(1, 3)), gt[0] * pred[0]) / (ln(gt) * ln(pred))
    loss = F.greatest(1 - d * d, F.lit(1e-15))
    e = F.acos(F.sqrt(1 - loss))
    e = F.degrees(F.when(e.isNull() | F.isnan(e), F.lit(1e6)).otherwise(e))
    return F.least(e, F.abs(180 - e)) if ambiguity else e
