"""Groups of points by their classes: sizes, the largest, those of a least size, shapes, and means over classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import linalg as L


def by_classes(points: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The number of points of each combination of classes."""
    return points.groupBy(*classes).agg(F.count(F.lit(1)).alias("n"))


def largest(points: DataFrame, classes: Sequence[str], k: int = 1) -> DataFrame:
    """The k largest groups, ties in the order of their classes."""
    return by_classes(points, classes).orderBy(F.desc("n"), *classes).limit(k)


def of_least_size(points: DataFrame, classes: Sequence[str], least: int) -> DataFrame:
    """Points of groups that have so many; the groups, which are few beside the points, are counted with map-side combine."""
    kept = by_classes(points, classes).where(F.col("n") >= least).select(*(F.col(c).alias(f"_{c}") for c in classes))
    test = F.lit(True)
    for c in classes:
        test &= points[c].eqNullSafe(kept[f"_{c}"])
    return points.join(kept, test, "left_semi")


def variances(second: Sequence[Column]) -> Column:
    """The eigenvalues of the symmetric matrix with the entries xx, xy, xz, yy, yz, zz, the largest first, by the angle of its cubic."""

    def solve(m: Column) -> Column:
        xx, xy, xz, yy, yz, zz = (m[k] for k in range(6))
        q = (xx + yy + zz) / 3

        def shifted(b: Column) -> Column:
            a, d, f, p = b[0], b[1], b[2], b[3]
            det = a * (d * f - yz * yz) - xy * (xy * f - yz * xz) + xz * (xy * yz - d * xz)
            r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det / F.nullif(2 * p * p * p, F.lit(0.0)), F.lit(0.0))))
            phi = F.acos(r) / 3
            return L.let(L.vec(q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)), lambda e: L.vec(e[0], 3 * q - e[0] - e[1], e[1]))

        spread = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
        return L.let(L.vec(xx - q, yy - q, zz - q, spread), shifted)

    return L.let(L.vec(*second), solve)


def features(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """The shape of each group in one pass of aggregates: n, extent (x, y, z), volume, flatness (least over greatest extent), variances along the principal axes, the largest first."""
    spans = [(F.max(c) - F.min(c)).alias(f"_{c}") for c in "xyz"]
    second = [F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    own = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *spans, *second)
    side = [F.col(f"_{c}") for c in "xyz"]
    most = F.greatest(*side)
    return own.select(*by, "n", F.array(*side).alias("extent"), (side[0] * side[1] * side[2]).alias("volume"), F.coalesce(F.least(*side) / F.nullif(most, F.lit(0.0)), F.lit(0.0)).alias("flatness"), variances([F.col(f"_{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("variances"))


def averages(rows: DataFrame, classes: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Means of the values by each class alone, by grouping sets in one pass: the classes, null but for the one that a row is of, and the means."""
    named = rows.select(*classes, *(v.alias(n) for n, v in values.items()))
    return named.groupingSets([[F.col(c)] for c in classes], *(F.col(c) for c in classes)).agg(*(F.avg(n).alias(n) for n in values))
