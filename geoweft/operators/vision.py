"""Images as lines of pixels (subject, row, values): kernels of one image as verbs of tables, corners with binary descriptors, and drawn marks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.operators import raster

#: The circle of 16 pixels around a corner, and how many of them in a row must differ.
CIRCLE = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
ARC = 9
#: Side of the patch that a descriptor sees.
PATCH = 31


def whole_images(lines: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str, out: str = "values") -> DataFrame:
    """A kernel on every image: lines (subject, row, column array<double>) in, lines with its result (subject, row, out) out. An image is one group, as the kernels see all of it."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("row")
        a = np.stack(rows[column].to_numpy()).astype(float)
        done = np.asarray(kernel(a), float)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "row": rows["row"].to_numpy()[: len(done)], out: [x.ravel().tolist() for x in done]})

    return lines.select("subject", "row", column).groupBy("subject").applyInPandas(build, f"subject {dict(lines.dtypes)['subject']}, row int, {out} array<double>")


def without_black(lines: DataFrame, region: int = 5, column: str = "values") -> DataFrame:
    """Images with their small black spots closed."""
    return whole_images(lines, lambda a: raster.close_black(a, region), column)


def depth_normals(lines: DataFrame, focal: float, cu: float, cv: float, reach: int = 3) -> DataFrame:
    """Normals of depth images, three numbers for each pixel of a line."""
    return whole_images(lines, lambda z: raster.plane_normals(z, focal, cu, cv, reach), "depths")


def gravity_directions(lines: DataFrame, focal: float, cu: float, cv: float, start: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> DataFrame:
    """The direction of gravity in each depth image: subject, x, y, z."""
    one = whole_images(lines, lambda z: raster.gravity(raster.plane_normals(z, focal, cu, cv), np.array(start))[None], "depths")
    return one.select("subject", *(F.col("values")[k].alias(c) for k, c in enumerate("xyz")))


def hha_images(lines: DataFrame, focal: float, cu: float, cv: float) -> DataFrame:
    """Disparity, height and angle with gravity as bytes, three for each pixel of a line of a depth image."""
    return whole_images(lines, lambda z: raster.hha(z, focal, cu, cv), "depths")


def corners(image: np.ndarray, threshold: float = 20.0, most: int = 1000) -> np.ndarray:
    """(u, v, score) of the strongest corners: pixels with an arc of their circle brighter or darker by the threshold, and none stronger beside them."""
    a = np.asarray(image, float)
    h, w = a.shape
    if h < 7 or w < 7:
        return np.zeros((0, 3))
    middle = a[3:-3, 3:-3]
    ring = np.stack([a[3 + dv : h - 3 + dv, 3 + du : w - 3 + du] for du, dv in CIRCLE]) - middle
    score = np.zeros_like(middle)
    for sign in (1, -1):
        beyond = sign * ring > threshold
        run = np.zeros(middle.shape, bool)
        for k in range(16):
            run |= np.logical_and.reduce([beyond[(k + j) % 16] for j in range(ARC)])
        score = np.maximum(score, np.where(run, np.where(beyond, np.abs(ring) - threshold, 0).sum(0), 0))
    padded = np.pad(score, 1)
    beside = np.maximum.reduce([padded[1 + i : 1 + i + score.shape[0], 1 + j : 1 + j + score.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    v, u = np.nonzero((score > 0) & (score >= beside))
    order = np.lexsort((u, v, -score[v, u]))[:most]
    return np.c_[u[order] + 3, v[order] + 3, score[v[order], u[order]]]


def descriptors(image: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 comparisons of smoothed pixels around each corner, turned by the patch's own direction, as signed numbers of 64 bits."""
    half = PATCH // 2
    smooth = raster.box_sum(np.pad(np.asarray(image, float), half, mode="edge"), 2)
    pairs = np.clip(np.random.default_rng(seed).normal(0, PATCH / 5, (64, 2, 2)), -half + 1, half - 1)
    dv, du = np.mgrid[-half : half + 1, -half : half + 1]
    inside = du**2 + dv**2 <= half * half
    out = []
    for u, v in at[:, :2].astype(int):
        patch = smooth[v : v + PATCH, u : u + PATCH] * inside
        turn = np.arctan2((patch * dv).sum(), (patch * du).sum())
        c, s = np.cos(turn), np.sin(turn)
        moved = np.rint(pairs @ np.array([[c, s], [-s, c]])).astype(int)
        x = np.clip(moved[:, :, 0] + half, 0, PATCH - 1)
        y = np.clip(moved[:, :, 1] + half, 0, PATCH - 1)
        bits = smooth[v + y[:, 0], u + x[:, 0]] < smooth[v + y[:, 1], u + x[:, 1]]
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return np.array(out, np.int64)


def features(lines: DataFrame, most: int = 1000, threshold: float = 20.0, column: str = "values") -> DataFrame:
    """Corners of grey images (lines of numbers) with their descriptors: subject, id (from 0 by strength), u, v, score, code. Descriptors are matched by joins.mutual_matches or joins.ratio_matches."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf.sort_values("row")[column].to_numpy()).astype(float)
        found = corners(a, threshold, most)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "id": np.arange(len(found)), "u": found[:, 0], "v": found[:, 1], "score": found[:, 2], "code": descriptors(a, found)})

    return lines.select("subject", "row", column).groupBy("subject").applyInPandas(build, f"subject {dict(lines.dtypes)['subject']}, id long, u double, v double, score double, code long")


def marks(points: DataFrame, size: int = 3) -> DataFrame:
    """Pixels of a square outline about each point (subject, u, v): subject, row, col, each once, as drawn over an image."""
    step = F.sequence(F.lit(-size), F.lit(size))
    rows = points.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).where((F.abs("_i") == size) | (F.abs("_j") == size))
    return rows.select("subject", (F.round("v").cast("int") + F.col("_i")).alias("row"), (F.round("u").cast("int") + F.col("_j")).alias("col")).where("row >= 0 AND col >= 0").distinct()


def painted(pixels: DataFrame, over: DataFrame, color: tuple[int, ...]) -> DataFrame:
    """Pixels (subject, row, col, values) with those of over (subject, row, col) in a colour."""
    mark = over.select("subject", "row", "col").distinct().withColumn("_m", F.lit(True))
    return pixels.join(mark, ["subject", "row", "col"], "left").withColumn("values", F.when(F.col("_m"), F.array(*map(F.lit, color))).otherwise(F.col("values"))).drop("_m")


def grey(lines: DataFrame) -> DataFrame:
    """Grey lines of colour ones (subject, row, width, channels, values): the mean of the first three channels, or the only one."""
    n = F.least("channels", F.lit(3))
    pixel = lambda k: F.aggregate(F.slice("values", k * F.col("channels") + 1, n), F.lit(0.0), lambda s, x: s + x) / n
    return lines.select("subject", "row", F.transform(F.sequence(F.lit(0), F.col("width") - 1), pixel).alias("values"))
