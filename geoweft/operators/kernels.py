"""Geometry that no relational form expresses, in numpy on one subject's points at a time: hulls, oriented boxes, normals, occupancy, mean rotations.

A subject's vertices are first reduced to the extreme points of each of many directions where only the hull counts, so what one task sees stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.operators.joins import within_distance


def hull(points: np.ndarray, eps: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(faces, planes) of the convex hull: triangles of point numbers, outward planes (nx, ny, nz, d). Points are added one by one, each in place of the faces that it sees.

    Points on a line or plane raise ValueError; pad() makes them a body.
    """
    p = np.asarray(points, float)
    centre = p.mean(0)
    p = p - centre
    size = max(np.abs(p).max(), 1e-300) if len(p) else 0
    a = int(np.argmax(((p - p[0]) ** 2).sum(1)))
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    line = np.linalg.norm(np.cross(p - p[a], p[b] - p[a]), axis=1)
    c = int(np.argmax(line))
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    height = (p - p[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if line[c] <= eps * size**2 or abs(height[d]) <= eps * size**3:
        raise ValueError("the points lie in a plane")
    middle = p[[a, b, c, d]].mean(0)

    def plane(t: tuple[int, int, int]) -> tuple[tuple[int, int, int], np.ndarray]:
        n = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
        n = n / np.linalg.norm(n)
        if n @ (middle - p[t[0]]) > 0:
            t, n = (t[0], t[2], t[1]), -n
        return t, np.append(n, n @ p[t[0]])

    faces = [plane(t) for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))]
    for k in range(len(p)):
        planes = np.array([f[1] for f in faces])
        seen = planes[:, :3] @ p[k] - planes[:, 3] > eps * size
        if not seen.any():
            continue
        edges = [e for f, s in zip(faces, seen, strict=True) if s for t in [f[0]] for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        rim = set(edges) - {(v, u) for u, v in edges}
        faces = [f for f, s in zip(faces, seen, strict=True) if not s] + [plane((u, v, k)) for u, v in rim]
    planes = np.array([f[1] for f in faces])
    planes[:, 3] += planes[:, :3] @ centre
    return np.array([f[0] for f in faces]), planes


def pad(points: np.ndarray, thickness: float = 0.001) -> np.ndarray:
    """Points with a little thickness in every direction in which they have none: a point becomes a box, a line a bar, a plane a slab."""
    p = np.unique(np.asarray(points, float), axis=0)
    centre = p.mean(0)
    _, s, axes = np.linalg.svd(p - centre, full_matrices=True) if len(p) > 1 else (None, np.zeros(3), np.eye(3))
    s = np.append(s, np.zeros(3 - len(s)))
    for k in range(3):
        if s[k] <= 1e-9 * max(1.0, s[0]):
            p = np.concatenate([p - axes[k] * thickness / 2, p + axes[k] * thickness / 2])
    return p


def oriented_box(points: np.ndarray) -> np.ndarray:
    """(centre, extent, Euler xyz in degrees) along the principal axes, the longest first, right-handed; the largest component of the first two axes is positive."""
    p = np.asarray(points, float)
    mean = p.mean(0)
    _, _, axes = np.linalg.svd(p - mean, full_matrices=True)
    for k in range(2):
        if axes[k][np.argmax(np.abs(axes[k]))] < 0:
            axes[k] = -axes[k]
    axes[2] = np.cross(axes[0], axes[1])
    along = (p - mean) @ axes.T
    low, high = along.min(0), along.max(0)
    r = axes.T
    angles = np.degrees([np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])])
    return np.concatenate([mean + r @ ((low + high) / 2), high - low, angles])


def mean_rotation(quaternions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The quaternion nearest to all by weight: the main axis of their outer products, its largest component positive."""
    q = np.asarray(quaternions, float)
    w, v = np.linalg.eigh((q * np.asarray(weights, float)[:, None]).T @ q)
    best = v[:, np.argmax(w)]
    return best * np.sign(best[np.argmax(np.abs(best))])


def signed_distance_inside(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Whether points are inside a closed mesh (n, 3, 3), by its winding number."""
    out = np.zeros(len(points))
    for start in range(0, len(points), 256):
        v = triangles[None] - points[start : start + 256, None, None]
        a, b, c = v[:, :, 0], v[:, :, 1], v[:, :, 2]
        la, lb, lc = (np.linalg.norm(x, axis=2) for x in (a, b, c))
        det = (a * np.cross(b, c)).sum(2)
        base = la * lb * lc + (a * b).sum(2) * lc + (b * c).sum(2) * la + (c * a).sum(2) * lb
        out[start : start + 256] = np.arctan2(det, base).sum(1) / (2 * np.pi)
    return np.abs(out) > 0.5


#: Directions whose extreme points stand for a subject: the corners, edges and faces of a cube and steps between.
DIRECTIONS = tuple((x, y, z) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if (x, y, z) != (0, 0, 0))


def extremes(points: DataFrame, by: str = "subject") -> DataFrame:
    """A few points of each subject that its hull touches, by aggregates with map-side combine: a cheap inner hull, exact for boxes."""
    along = [F.col("x") * x + F.col("y") * y + F.col("z") * z for x, y, z in DIRECTIONS]
    best = points.groupBy(by).agg(F.array(*(F.max_by(F.struct("x", "y", "z"), a) for a in along)).alias("best"))
    return best.select(by, F.explode(F.array_distinct("best")).alias("p")).select(by, "p.*")


def _outermost(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Of each batch and subject the corners of its hull; few or flat points as they are."""
    for b in batches:
        for _, own in b.groupby(by, sort=False, dropna=False):
            if len(own) > 64:
                p = own[["x", "y", "z"]].to_numpy(float)
                try:
                    own = own.iloc[np.unique(hull(p)[0])]
                except ValueError:
                    p = own.drop_duplicates(["x", "y", "z"])
                    own = p
            yield own


def hulls(points: DataFrame, by: str = "subject") -> DataFrame:
    """The hull of each subject: vertices, planes (nx, ny, nz, d), volume. Flat subjects are padded.

    Every batch of points first leaves the corners of its own hull only; the hull of these is that of all, so a large subject comes to one task as few points.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        try:
            faces, planes = hull(p)
        except ValueError:
            p = pad(p)
            faces, planes = hull(p)
        t = p[faces] - p.mean(0)
        volume = np.abs((t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum(1)).sum() / 6
        return pd.DataFrame({by: [pdf[by].iloc[0]], "vertices": [p[np.unique(faces)].tolist()], "planes": [planes.tolist()], "volume": [float(volume)]})

    kind = points.schema[by].dataType.simpleString()
    few = points.select(by, "x", "y", "z").mapInPandas(lambda batches: _outermost(batches, by), f"{by} {kind}, x double, y double, z double")
    return few.groupBy(by).applyInPandas(build, f"{by} {kind}, vertices array<array<double>>, planes array<array<double>>, volume double")


def oriented_boxes(points: DataFrame, by: str = "subject") -> DataFrame:
    """The oriented box of each subject, as 9 numbers: (centre, extent, Euler xyz in degrees) along the principal axes, as oriented_box has it.

    Means and covariances are aggregates; the axes of each subject's 3x3 join its points, whose extent along them is another aggregate. No subject comes to one task.
    """
    second = ("xx", "xy", "xz", "yy", "yz", "zz")
    kind = points.schema[by].dataType.simpleString()
    sums = points.groupBy(by).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in second))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            axes = []
            for row in b[list(second)].to_numpy(float):
                xx, xy, xz, yy, yz, zz = row
                v = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))[1][:, ::-1].T
                for k in range(2):
                    if v[k][np.argmax(np.abs(v[k]))] < 0:
                        v[k] = -v[k]
                v[2] = np.cross(v[0], v[1])
                axes.append(v.ravel().tolist())
            yield b[[by, "mx", "my", "mz"]].assign(axes=axes)

    frames = sums.mapInPandas(solve, f"{by} {kind}, mx double, my double, mz double, axes array<double>")
    along = [sum((F.col(c) - F.col(f"m{c}")) * F.col("axes")[3 * k + n] for n, c in enumerate("xyz")) for k in range(3)]
    # Spark may know the size of what the points are made from only, and would broadcast far larger ones
    spans = points.select(by, "x", "y", "z").join(frames.hint("merge"), by).groupBy(by).agg(F.first("axes").alias("a"), F.first(F.array("mx", "my", "mz")).alias("m"), *(f(along[k]).alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))))
    a, half = F.col("a"), [(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2 for k in range(3)]
    centre = [F.col("m")[n] + sum(half[k] * a[3 * k + n] for k in range(3)) for n in range(3)]
    rotation = [a[3 * c + r] for r in range(3) for c in range(3)]
    return spans.select(by, F.concat(L.vec(*centre, *(F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(3))), L.euler_from_rotation(rotation)).alias("box"))


def normals(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """The normal of each point from the neighbours within the radius: sums of their products by aggregates, then the smallest axis of each 3x3 in batches. Fewer than 3 neighbours give none."""
    pairs = within_distance(points.select(key, "x", "y", "z"), points.select("x", "y", "z"), radius)
    d = {c: F.col(f"r.{c}") - F.col(f"q.{c}") for c in "xyz"}
    sums = [F.sum(d[c]).alias(c) for c in "xyz"] + [F.sum(d[a] * d[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    grouped = pairs.groupBy(F.col(f"q.{key}").alias(key)).agg(F.count(F.lit(1)).alias("n"), *sums).where("n >= 3")

    def solve(batches):
        for b in batches:
            m = np.zeros((len(b), 3, 3))
            for i, p in enumerate("xyz"):
                for j, q in enumerate("xyz"):
                    m[:, i, j] = b["".join(sorted(p + q))] - b[p] * b[q] / b["n"]
            v = np.linalg.eigh(m)[1][:, :, 0] if len(b) else np.zeros((0, 3))
            if len(b):
                v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
            yield pd.DataFrame({key: b[key], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    kind = points.schema[key].dataType.simpleString()
    return grouped.mapInPandas(solve, f"{key} {kind}, nx double, ny double, nz double")


def feature_edges(faces: DataFrame, vertices: DataFrame, degrees: float = 45.0) -> DataFrame:
    """Edges between faces that meet at more than the angle, and edges of one face: subject, u, v."""
    pos = vertices.select("subject", F.col("pid"), F.array("x", "y", "z").alias("p"))
    t = faces
    for c in "abc":
        t = t.join(pos.select("subject", F.col("pid").alias(c), F.col("p").alias(f"p{c}")), ["subject", c])
    sub = lambda a, b: [F.col(a)[k] - F.col(b)[k] for k in range(3)]
    u, v = sub("pb", "pa"), sub("pc", "pa")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    t = t.withColumn("n", F.array(*n))
    edges = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    e = t.select("subject", "n", F.explode(edges).alias("e")).select("subject", "e.u", "e.v", "n")
    w = Window.partitionBy("subject", "u", "v").orderBy("n")
    e = e.withColumn("m", F.lead("n").over(w)).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("subject", "u", "v")))
    length = lambda a: F.sqrt(F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x * x))
    cos = F.aggregate(F.zip_with("n", "m", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (length("n") * length("m"))
    return e.where((F.col("k") == 1) | (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))) > degrees)).select("subject", "u", "v").distinct()
