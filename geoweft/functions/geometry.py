"""Predicates and derived shapes: boxes, hulls, voxels, cameras, as columns.

An oriented box is (centre, extent, Euler xyz in degrees), 9 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.functions.linalg import items, vec


def box_rotation(box) -> list[Column]:
    return L.rotation_from_euler(*items(box, 9)[6:])


def obb_contains(box, p, margin=(0.0, 0.0, 0.0)) -> Column:
    """Whether p lies in the box, its extent enlarged by the margin."""
    b, r = items(box, 9), box_rotation(box)
    d = [x - c for x, c in zip(items(p, 3), b[:3], strict=True)]
    inside = None
    for k in range(3):
        along = F.abs(d[0] * r[k] + d[1] * r[3 + k] + d[2] * r[6 + k])
        test = along <= (b[3 + k] + L.col(margin[k])) / 2
        inside = test if inside is None else inside & test
    return inside


CORNERS = tuple((x, y, z) for z in (-0.5, 0.5) for y in (-0.5, 0.5) for x in (-0.5, 0.5))


def obb_corners(box) -> Column:
    """The 8 corners, x changing fastest, then y, then z."""
    b, r = items(box, 9), box_rotation(box)
    return F.array(*(vec(*(b[k] + r[3 * k] * b[3] * x + r[3 * k + 1] * b[4] * y + r[3 * k + 2] * b[5] * z for k in range(3))) for x, y, z in CORNERS))


def aabb_corners(bounds) -> Column:
    x0, x1, y0, y1, z0, z1 = items(bounds, 6)
    return F.array(*(vec(x1 if x > 0 else x0, y1 if y > 0 else y0, z1 if z > 0 else z0) for x, y, z in CORNERS))


def aabb_overlaps(a, b) -> Column:
    """Whether bounds (xmin, xmax, ymin, ymax, zmin, zmax) touch or overlap."""
    p, q = items(a, 6), items(b, 6)
    out = None
    for k in (0, 2, 4):
        test = (p[k] <= q[k + 1]) & (q[k] <= p[k + 1])
        out = test if out is None else out & test
    return out


def obb_bounds(box) -> Column:
    """Axis-aligned bounds of an oriented box."""
    b, r = items(box, 9), box_rotation(box)
    half = [(F.abs(r[3 * k]) * b[3] + F.abs(r[3 * k + 1]) * b[4] + F.abs(r[3 * k + 2]) * b[5]) / 2 for k in range(3)]
    return vec(*(x for k in range(3) for x in (b[k] - half[k], b[k] + half[k])))


def obb_expand(box, u, v, w) -> Column:
    b = items(box, 9)
    return vec(*b[:3], b[3] + L.col(u), b[4] + L.col(v), b[5] + L.col(w), *b[6:])


def obb_intersects(a, b, ra: Column, rb: Column) -> Column:
    """Separating axes of two oriented boxes: 3 of each and 9 cross products. ra, rb: their rotations as columns of 9 numbers."""
    p, q, r, s = items(a, 9), items(b, 9), items(ra, 9), items(rb, 9)
    d = [q[k] - p[k] for k in range(3)]
    t = [d[0] * r[k] + d[1] * r[3 + k] + d[2] * r[6 + k] for k in range(3)]
    c = [[r[i] * s[j] + r[3 + i] * s[3 + j] + r[6 + i] * s[6 + j] for j in range(3)] for i in range(3)]
    e, f = [x / 2 for x in p[3:6]], [x / 2 for x in q[3:6]]
    tiny = F.lit(1e-9)
    ac = [[F.abs(x) + tiny for x in row] for row in c]
    tests = [F.abs(t[i]) <= e[i] + f[0] * ac[i][0] + f[1] * ac[i][1] + f[2] * ac[i][2] for i in range(3)]
    tests += [F.abs(t[0] * c[0][j] + t[1] * c[1][j] + t[2] * c[2][j]) <= f[j] + e[0] * ac[0][j] + e[1] * ac[1][j] + e[2] * ac[2][j] for j in range(3)]
    for i in range(3):
        i1, i2 = (i + 1) % 3, (i + 2) % 3
        for j in range(3):
            j1, j2 = (j + 1) % 3, (j + 2) % 3
            tests.append(F.abs(t[i2] * c[i1][j] - t[i1] * c[i2][j]) <= e[i1] * ac[i2][j] + e[i2] * ac[i1][j] + f[j1] * ac[i][j2] + f[j2] * ac[i][j1])
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def hull_contains(planes: Column, p) -> Column:
    """Whether p is on the inner side of every plane (nx, ny, nz, d) of an array: n·p <= d."""
    x, y, z = items(p, 3)
    return F.forall(planes, lambda q: q[0] * x + q[1] * y + q[2] * z <= q[3])


def hull_touches(planes: Column, vertices: Column) -> Column:
    """Whether any vertex is in the hull."""
    return F.exists(vertices, lambda v: hull_contains(planes, v))


def voxel(p, size: float, origin=(0.0, 0.0, 0.0)) -> list[Column]:
    return [F.floor((x - L.col(o)) / size).cast("long") for x, o in zip(items(p, 3), items(origin, 3), strict=True)]


def morton(i: Column, j: Column, k: Column, depth: int) -> Column:
    """Interleaved bits of three cell numbers, the octree's path as one number."""
    out = F.lit(0).cast("long")
    for b in range(depth):
        for n, x in enumerate((i, j, k)):
            out = out + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("long"), 3 * b + n)
    return out


def ray_triangle(o, d, a, b, c) -> Column:
    """Distance along the ray to the triangle in units of d, null for a miss (Möller and Trumbore)."""
    e1, e2, s = L.sub(b, a), L.sub(c, a), L.sub(o, a)

    def solve(w: Column) -> Column:
        e1, e2, p, s, q = (w[k] for k in range(5))
        det = F.nullif(L.dot(e1, p), F.lit(0.0))
        return L.let(vec(det, L.dot(s, p) / det, L.dot(d, q) / det, L.dot(e2, q) / det), lambda x: F.when((F.abs(x[0]) > 1e-12) & (x[1] >= 0) & (x[2] >= 0) & (x[1] + x[2] <= 1) & (x[3] >= 0), x[3]))

    return L.let(F.array(e1, e2, L.cross(d, e2), s, L.cross(s, e1)), solve)


def triangle_area(a, b, c) -> Column:
    return L.norm(L.cross(L.sub(b, a), L.sub(c, a))) / 2


# cameras: pose is a 4x4 from camera to world


def intrinsics(focal35: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Focal length in pixels and the principal point, from a focal length for 36 mm film."""
    return focal35 / 36 * width, width / 2, height / 2


def pinhole_project(pose, k, p) -> Column:
    """(u, v, depth along the axis) of a world point; k: focal length in pixels, principal point."""
    f, cu, cv = k
    return L.let(L.mat4_apply(L.mat4_inv_rigid(pose), p), lambda q: vec(f * q[0] / F.nullif(q[2], F.lit(0.0)) + cu, f * q[1] / F.nullif(q[2], F.lit(0.0)) + cv, q[2]))


def pinhole_unproject(pose, k, u, v, depth) -> Column:
    """The world point at a pixel and a depth along the axis."""
    f, cu, cv = k
    return L.mat4_apply(pose, vec((u - cu) / f * depth, (v - cv) / f * depth, depth))


def pinhole_direction(pose, k, u, v) -> Column:
    f, cu, cv = k
    return L.normalize(L.mat4_rotate(pose, vec((u - cu) / f, (v - cv) / f, 1.0)))


def equirect_direction(u: Column, v: Column, width: Column, height: Column) -> Column:
    """Direction of a panorama's pixel: u across, v down."""
    theta = u / (width - 1) * (2 * math.pi) - math.pi
    phi = v / (height - 1) * math.pi - math.pi / 2
    return vec(F.cos(phi) * F.sin(theta), -F.sin(phi), F.cos(phi) * F.cos(theta))


def equirect_project(pose, p, width: Column, height: Column) -> Column:
    """(u, v, distance): the inverse of equirect_direction, with the pose applied."""

    def pixel(q: Column) -> Column:
        d = L.norm(q)
        return vec((F.atan2(q[0], q[2]) + math.pi) / (2 * math.pi) * (width - 1), (F.asin(-q[1] / F.nullif(d, F.lit(0.0))) + math.pi / 2) / math.pi * (height - 1), d)

    return L.let(L.mat4_apply(L.mat4_inv_rigid(pose), p), pixel)


def ortho_project(pose, p, gsd: Column, width: Column, height: Column) -> Column:
    """(row, column) of a world point in an orthophoto."""
    return L.let(L.mat4_apply(L.mat4_inv_rigid(pose), p), lambda q: vec(height / 2 - q[1] / gsd, q[0] / gsd + width / 2))


def ortho_unproject(pose, row: Column, column: Column, gsd: Column, width: Column, height: Column, depth: Column) -> Column:
    return L.mat4_apply(pose, vec((column - width / 2) * gsd, (height / 2 - row) * gsd, depth))


def frustum(pose, focal35: Column, depth: Column) -> Column:
    """5 vertices of a camera's pyramid for a sensor of 36 by 24 mm: the tip, then the corners."""
    x, y = depth * 18 / focal35, depth * 12 / focal35
    return F.array(*(L.mat4_apply(pose, p) for p in (vec(0, 0, 0), vec(-x, -y, depth), vec(x, -y, depth), vec(x, y, depth), vec(-x, y, depth))))


def depth_from_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Metres from the four bytes of a depth pixel, the red one lowest."""
    return (r + g * 256 + b * 65536 + a * 16777216.0) / 1000
