"""Rasters as pixels (subject, row, col, values), and numpy kernels on one image's array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G


def depth_points(pixels: DataFrame, focal: float, cu: float, cv: float) -> DataFrame:
    """Pinhole back-projection of depth pixels (row, col, depth): x, y, z in the camera's frame; no depth, no point."""
    z = F.col("depth")
    return pixels.where(z > 0).withColumns({"x": (F.col("col") - cu) / focal * z, "y": (F.col("row") - cv) / focal * z, "z": z})


def panorama_points(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Points of panorama pixels (row, col, depth) in the camera's frame."""
    rows = pixels.where("depth > 0").withColumn("_d", G.equirect_direction(F.col("col"), F.col("row"), F.lit(width), F.lit(height)))
    return rows.withColumns({c: F.col("_d")[k] * F.col("depth") for k, c in enumerate("xyz")}).drop("_d")


def splat(points: DataFrame, by: tuple[str, ...] = ("subject",), most: float = 15.0) -> DataFrame:
    """The nearest of the projected points (u, v, depth, value) of each pixel, no farther than most: row, col, depth, value."""
    rows = points.where((F.col("depth") > 0) & (F.col("depth") <= most))
    keys = [*(F.col(c) for c in by), F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col")]
    return rows.groupBy(*keys).agg(F.min(F.struct("depth", "value")).alias("m")).select(*by, "row", "col", "m.depth", "m.value")


def majority(pixels: DataFrame, value: str = "value", centre_weight: int = 1, reach: int = 1) -> DataFrame:
    """The most frequent value around each pixel, the pixel itself counted centre_weight times, ties to the smallest; every pixel sees the old values."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(centre_weight if (i, j) == (0, 0) else 1).alias("w")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    votes = pixels.select("subject", "row", "col", value, F.explode(steps).alias("s")).select("subject", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), value, "s.w")
    counted = votes.groupBy("subject", "row", "col", value).agg(F.sum("w").alias("w"))
    best = counted.groupBy("subject", "row", "col").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(value).alias("v"))).alias("m")).select("subject", "row", "col", F.col("m.v").alias(value))
    return best.join(pixels.select("subject", "row", "col"), ["subject", "row", "col"], "left_semi")


def masks(pixels: DataFrame, levels: list[float], tolerance: float = 0.01) -> DataFrame:
    """The number of the first level within the tolerance of each grey value; null for none."""
    out = F.lit(None).cast("int")
    for k, level in reversed(list(enumerate(levels))):
        out = F.when(F.abs(F.col("value") - level) <= tolerance, k).otherwise(out)
    return pixels.withColumn("mask", out)


def close_black(image: np.ndarray, region: int = 5) -> np.ndarray:
    """Greatest, then least value of each square region: small black spots go."""
    out = np.asarray(image)
    for f, edge in ((np.maximum, out.min() if out.size else 0), (np.minimum, out.max() if out.size else 0)):
        for axis in (0, 1):
            half = region // 2
            padded = np.pad(out, [(half, half) if k == axis else (0, 0) for k in range(out.ndim)], constant_values=edge)
            out = f.reduce([np.take(padded, range(k, k + out.shape[axis]), axis) for k in range(region)])
    return out


def box_sum(a: np.ndarray, reach: int) -> np.ndarray:
    """Sum of the values at most reach rows and columns away, from running sums."""
    p = np.pad(a, [(reach + 1, reach)] * 2 + [(0, 0)] * (a.ndim - 2)).cumsum(0).cumsum(1)
    n = 2 * reach + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def plane_normals(z: np.ndarray, focal: float, cu: float, cv: float, reach: int = 3) -> np.ndarray:
    """Normals of planes fitted to the points around each depth pixel; zero where too few have a depth. They look at the camera."""
    v, u = np.indices(z.shape)
    ok = z > 0
    points = np.stack([(u - cu) / focal * z, (v - cv) / focal * z, z], -1) * ok[..., None]
    n = box_sum(ok.astype(float), reach)
    mean = box_sum(points, reach) / np.maximum(n, 1)[..., None]
    second = box_sum(points[..., :, None] * points[..., None, :], reach) / np.maximum(n, 1)[..., None, None] - mean[..., :, None] * mean[..., None, :]
    normal = np.linalg.eigh(second)[1][..., :, 0]
    normal *= np.where((normal * mean).sum(-1) > 0, -1.0, 1.0)[..., None]
    return normal * (ok & (n >= 3))[..., None]


#: Fixed values of the published method: angles within which normals count, and rounds at each.
ANGLES, ROUNDS = (45.0, 15.0), 5


def gravity(normals: np.ndarray, start: np.ndarray, angles: tuple[float, ...] = ANGLES, rounds: int = ROUNDS) -> np.ndarray:
    """The direction that floors follow and walls avoid: at each angle, the main axis of normals near the last direction against those across it."""
    n = normals.reshape(-1, 3)
    n = n[(n != 0).any(1)]
    y = np.asarray(start, float) / np.linalg.norm(start)
    for angle in angles:
        for _ in range(rounds):
            along = np.abs(n @ y)
            floor, wall = n[along > np.cos(np.radians(angle))], n[along < np.sin(np.radians(angle))]
            best = np.linalg.eigh(wall.T @ wall - floor.T @ floor)[1][:, 0]
            y = best * np.sign(best @ y or 1.0)
    return y


#: Fixed values of the published encoding: what disparity is divided from, what the angle is raised by.
DISPARITY, ANGLE = 31000, 38


def hha(z: np.ndarray, focal: float, cu: float, cv: float) -> np.ndarray:
    """Disparity, height above the lowest point, and angle with gravity, as bytes: 31000 / z in centimetres, height in centimetres, angle + 38."""
    normal = plane_normals(z, focal, cu, cv)
    y = gravity(normal, np.array([0.0, 1.0, 0.0]))
    v, u = np.indices(z.shape)
    points = np.stack([(u - cu) / focal * z, (v - cv) / focal * z, z], -1)
    height = -(points @ y)
    ok = z > 0
    low = np.percentile(height[ok], 1) if ok.any() else 0.0
    angle = np.degrees(np.arccos(np.clip(-(normal @ y), -1, 1)))
    bands = [np.where(ok, DISPARITY / np.maximum(z * 100, 1e-9), 0), (height - low) * 100, angle + ANGLE]
    return np.clip(np.rint(np.stack(bands, -1)), 0, 255).astype(np.uint8) * ok[..., None]


def line_between_rays(o1: np.ndarray, d1: np.ndarray, o2: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, float]:
    """The middle of the shortest segment between two lines, and its length."""
    a = np.stack([d1, -d2], 1)
    t, *_ = np.linalg.lstsq(a, o2 - o1, rcond=None)
    p, q = o1 + t[0] * d1, o2 + t[1] * d2
    return (p + q) / 2, float(np.linalg.norm(p - q))
