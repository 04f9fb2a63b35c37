"""Vectors as array<double>, 4x4 matrices as array<double> of 16 in row order, quaternions as (x, y, z, w): plain column arithmetic, so it stays inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, although use names it often; without this an expression doubles at each step."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def vec(*xs: Num) -> Column:
    return F.array(*(col(x).cast("double") for x in xs))


def items(v: Column | Sequence[Num], n: int) -> list[Column]:
    return [v[k] for k in range(n)] if isinstance(v, Column) else [col(x) for x in v]


def dot(a, b, n: int = 3) -> Column:
    out = None
    for x, y in zip(items(a, n), items(b, n), strict=True):
        out = x * y if out is None else out + x * y
    return out


def cross(a, b) -> Column:
    (ax, ay, az), (bx, by, bz) = items(a, 3), items(b, 3)
    return vec(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def sub(a, b, n: int = 3) -> Column:
    return vec(*(x - y for x, y in zip(items(a, n), items(b, n), strict=True)))


def add(a, b, n: int = 3) -> Column:
    return vec(*(x + y for x, y in zip(items(a, n), items(b, n), strict=True)))


def scale(a, k: Num, n: int = 3) -> Column:
    return vec(*(x * col(k) for x in items(a, n)))


def norm(a, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def distance2(a, b) -> Column:
    out = None
    for x, y in zip(items(a, 3), items(b, 3), strict=True):
        d = x - y
        out = d * d if out is None else out + d * d
    return out


def distance(a, b) -> Column:
    return F.sqrt(distance2(a, b))


def normalize(a, n: int = 3) -> Column:
    """A vector over its length; a zero vector stays as it is."""
    length = norm(a, n)
    return vec(*(x / F.when(length == 0, F.lit(1.0)).otherwise(length) for x in items(a, n)))


IDENTITY = tuple(float(r == c) for r in range(4) for c in range(4))


def identity() -> Column:
    return vec(*IDENTITY)


def mat4_mul(a, b) -> Column:
    p, q = items(a, 16), items(b, 16)
    return vec(*(p[4 * r] * q[c] + p[4 * r + 1] * q[4 + c] + p[4 * r + 2] * q[8 + c] + p[4 * r + 3] * q[12 + c] for r in range(4) for c in range(4)))


def mat4_apply(m, p) -> Column:
    a, (x, y, z) = items(m, 16), items(p, 3)
    return vec(*(a[4 * r] * x + a[4 * r + 1] * y + a[4 * r + 2] * z + a[4 * r + 3] for r in range(3)))


def mat4_rotate(m, p) -> Column:
    """Directions, such as normals: without the translation."""
    a, (x, y, z) = items(m, 16), items(p, 3)
    return vec(*(a[4 * r] * x + a[4 * r + 1] * y + a[4 * r + 2] * z for r in range(3)))


def mat4_inv_rigid(m) -> Column:
    """Inverse of a rotation and translation."""
    a = items(m, 16)
    t = [-(a[r] * a[3] + a[4 + r] * a[7] + a[8 + r] * a[11]) for r in range(3)]
    return vec(*(x for r in range(3) for x in (a[r], a[4 + r], a[8 + r], t[r])), 0, 0, 0, 1)


def mat4_of(rotation: Sequence[Num], translation) -> Column:
    t = items(translation, 3)
    return vec(*(x for r in range(3) for x in (*rotation[3 * r : 3 * r + 3], t[r])), 0, 0, 0, 1)


def translation_of(m) -> Column:
    a = items(m, 16)
    return vec(a[3], a[7], a[11])


def rotation_of(m) -> list[Column]:
    a = items(m, 16)
    return [a[4 * r + c] for r in range(3) for c in range(3)]


def rotation_from_euler(x: Num, y: Num, z: Num) -> list[Column]:
    """3x3 of angles in degrees about the fixed axes x, then y, then z."""
    a, b, c = (F.radians(col(k)) for k in (x, y, z))
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    return [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa, sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa, -sb, cb * sa, cb * ca]


def rotation_from_quat(q) -> list[Column]:
    """3x3 of a quaternion (x, y, z, w), which need not have length 1."""
    x, y, z, w = items(q, 4)
    n = x * x + y * y + z * z + w * w
    two = F.lit(2.0) / n
    return [1 - two * (y * y + z * z), two * (x * y - z * w), two * (x * z + y * w), two * (x * y + z * w), 1 - two * (x * x + z * z), two * (y * z - x * w), two * (x * z - y * w), two * (y * z + x * w), 1 - two * (x * x + y * y)]


def mat4_from_euler(angles, translation=(0, 0, 0)) -> Column:
    return mat4_of(rotation_from_euler(*items(angles, 3)), translation)


def mat4_from_quat(q, translation=(0, 0, 0)) -> Column:
    return mat4_of(rotation_from_quat(q), translation)


def rotation_from_forward_up(forward, up) -> list[Column]:
    """Columns are right, up and forward."""
    m = let(normalize(forward), lambda f: let(normalize(cross(up, f)), lambda r: let(cross(f, r), lambda u: F.array(*(x[k] for k in range(3) for x in (r, u, f))))))
    return items(m, 9)


def euler_from_rotation(r: Sequence[Column]) -> Column:
    """Angles in degrees about the fixed axes x, y, z."""
    return vec(F.degrees(F.atan2(r[7], r[8])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[6])))), F.degrees(F.atan2(r[3], r[0])))


def euler_from_mat(m) -> Column:
    return euler_from_rotation(rotation_of(m))


def quat_mul(a, b) -> Column:
    (ax, ay, az, aw), (bx, by, bz, bw) = items(a, 4), items(b, 4)
    return vec(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def quat_rotate(q, p) -> Column:
    r, (x, y, z) = rotation_from_quat(q), items(p, 3)
    return vec(*(r[3 * k] * x + r[3 * k + 1] * y + r[3 * k + 2] * z for k in range(3)))


def heading(q) -> Column:
    """Angle about z of a quaternion, in degrees from 0 to 360."""
    e = euler_from_rotation(rotation_from_quat(q))[2]
    return F.when(e < 0, e + 360).otherwise(e)


def pitch(q) -> Column:
    return euler_from_rotation(rotation_from_quat(q))[1]


def roll(q) -> Column:
    return euler_from_rotation(rotation_from_quat(q))[0]


def bearing(a, b) -> Column:
    """Direction in the xy plane from a to b, in degrees from 0 to 360."""
    d = F.degrees(F.atan2(items(b, 3)[1] - items(a, 3)[1], items(b, 3)[0] - items(a, 3)[0]))
    return F.when(d < 0, d + 360).otherwise(d)


def sym3_inverse(a: Sequence[Column]) -> tuple[list[Column], Column]:
    """Adjugate and determinant of the symmetric matrix with the entries xx, xy, xz, yy, yz, zz."""
    xx, xy, xz, yy, yz, zz = a
    adj = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    return adj, xx * adj[0] + xy * adj[1] + xz * adj[2]


def sym3_apply(a: Sequence[Column], v) -> Column:
    xx, xy, xz, yy, yz, zz = a
    x, y, z = items(v, 3)
    return vec(xx * x + xy * y + xz * z, xy * x + yy * y + yz * z, xz * x + yz * y + zz * z)


def angle_between_lines(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees from 0 to 180 between segments (x0, y0, x1, y1), by the difference of their directions."""
    d = F.abs(F.degrees(F.atan2(a[3] - a[1], a[2] - a[0]) - F.atan2(b[3] - b[1], b[2] - b[0])))
    return d - 180 * F.floor(d / 180)


TAU = 2 * math.pi
