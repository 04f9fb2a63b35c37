"""Selections of nodes and points: radius, boxes, hulls, nearest; each is a filter, or a join whose keys are cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L

XYZ = ("x", "y", "z")


def xyz(alias: str = "") -> list[Column]:
    return [F.col(f"{alias}.{c}" if alias else c) for c in XYZ]


def within_radius(points: DataFrame, centre: Sequence[float], radius: float) -> DataFrame:
    """Points at most radius from the centre. The bounds around it are implied and reach the scan."""
    near = F.lit(True)
    for c, x in zip(XYZ, centre, strict=True):
        near &= F.col(c).between(x - radius, x + radius)
    return points.where(near & (L.distance2(xyz(), [F.lit(float(x)) for x in centre]) <= radius * radius))


def within_box(points: DataFrame, box: Sequence[float], margin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points in an oriented box (centre, extent, Euler xyz in degrees), enlarged by the margin."""
    return points.where(G.obb_contains([F.lit(float(v)) for v in box], xyz(), margin))


def within_hull(points: DataFrame, planes: Sequence[Sequence[float]]) -> DataFrame:
    """Points on the inner side of all planes (nx, ny, nz, d)."""
    inside = F.lit(True)
    for nx, ny, nz, d in planes:
        inside &= F.col("x") * float(nx) + F.col("y") * float(ny) + F.col("z") * float(nz) <= float(d)
    return points.where(inside)


def nearest(points: DataFrame, centre: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """The k points nearest to the centre with their distance, ties by key; a top-k, not a sort of everything."""
    d = L.distance2(xyz(), [F.lit(float(x)) for x in centre])
    return points.withColumn("d2", d).orderBy("d2", key).limit(k).withColumn("distance", F.sqrt("d2")).drop("d2")


def overlapping_boxes(boxes: DataFrame, others: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """Pairs (id, other) of axis-aligned boxes (xmin .. zmax) that touch or overlap, joined by the cells of size cell that both cover; the pair is reported in the first common cell only."""

    def spread(df: DataFrame, name: str) -> DataFrame:
        spans = [F.sequence(F.floor(F.col(f"{c}min") / cell).cast("long"), F.floor(F.col(f"{c}max") / cell).cast("long")) for c in "xyz"]
        cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("cx"), j.alias("cy"), k.alias("cz")))))))
        own = F.struct(F.col(key).alias("id"), *(F.col(f"{c}{s}") for c in "xyz" for s in ("min", "max")))
        return df.select(own.alias(name), F.explode(cells).alias("_c")).select(name, "_c.cx", "_c.cy", "_c.cz")

    joined = spread(boxes, "a").join(spread(others, "b"), ["cx", "cy", "cz"])
    test, first = F.lit(True), F.lit(True)
    for c in "xyz":
        test &= (F.col(f"a.{c}min") <= F.col(f"b.{c}max")) & (F.col(f"b.{c}min") <= F.col(f"a.{c}max"))
        first &= F.col(f"c{c}") == F.floor(F.greatest(f"a.{c}min", f"b.{c}min") / cell).cast("long")
    return joined.where(test & first).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


def thin_by_overlap(images: DataFrame, by: str, order: str, ground: float, overlap: float, fov: float = 94.0) -> DataFrame:
    """Images kept when each must be farther from the last kept one, in the xy plane, than the overlap allows.

    The overlap is a share of the mean width that the images of a group see at the ground. The choice of each image depends on the one before, so a group passes, in order, through one
    task, which holds the last kept image alone; groups are independent.
    """
    wide = (F.avg(F.col("z") - ground) * 2 * F.tan(F.radians(F.lit(fov / 2))) * overlap).alias("_least")
    rows = images.select(by, order, "x", "y").join(images.groupBy(by).agg(wide), by)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, x, y = None, 0.0, 0.0
        for b in batches:
            kept = []
            for g, u, v, least in zip(b[by], b["x"], b["y"], b["_least"], strict=True):
                keep = g != group or math.hypot(u - x, v - y) > least
                if keep:
                    group, x, y = g, u, v
                kept.append(keep)
            yield b.loc[kept, [by, order]]

    kinds = dict(images.dtypes)
    # a shuffle of its own: one by the join's key would be left out, and Spark splits large partitions of joins
    return rows.repartition(F.xxhash64(by)).sortWithinPartitions(by, order, "x", "y").mapInPandas(walk, f"{by} {kinds[by]}, {order} {kinds[order]}")
