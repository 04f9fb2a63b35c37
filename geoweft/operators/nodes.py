"""Nodes, one row per resource with pose t, box, hull: completing, moving and composing them, and joining them with faces, lines, classes and matches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.operators.generate import sample_lines
from geoweft.operators.measures import bounds


def hull_centre(hull: Column) -> Column:
    """Mean of an array of vertices."""
    return L.vec(*(_mean(hull, k) for k in range(3)))


def _mean(hull: Column, k: int) -> Column:
    return F.aggregate(_axis(hull, k), F.lit(0.0).cast("double"), lambda s, x: s + x) / F.size(hull)


def bounds_box(b: Column) -> Column:
    """An oriented box without rotation from bounds (xmin, xmax, ymin, ymax, zmin, zmax)."""
    return L.vec((b[0] + b[1]) / 2, (b[2] + b[3]) / 2, (b[4] + b[5]) / 2, b[1] - b[0], b[3] - b[2], b[5] - b[4], 0, 0, 0)


def hull_bounds(hull: Column) -> Column:
    return L.vec(*(f(_axis(hull, k)) for k in range(3) for f in (F.array_min, F.array_max)))


def _axis(hull: Column, k: int) -> Column:
    return F.transform(hull, lambda v: v[k])


def complete(nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Nodes (subject, t, box, hull) with what is missing: the pose from the resource's centre, the hull's, or the box, else the identity; the hull from the box, else
    a unit cube about the pose; the box from the resource's bounds or the hull's. points are the resources' points, aggregated once."""
    rows = nodes
    if points is not None:
        own = points.groupBy("subject").agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"), F.array(*(f(c) for c in "xyz" for f in (F.min, F.max))).alias("_bounds"))
        rows = rows.join(own, "subject", "left")
    else:
        rows = rows.withColumns({f"_{c}": F.lit(None).cast("double") for c in "xyz"} | {"_bounds": F.lit(None).cast("array<double>")})
    at = lambda p: L.mat4_of([F.lit(float(k in (0, 4, 8))) for k in range(9)], p)
    centre = F.when(F.col("_x").isNotNull(), at([F.col(f"_{c}") for c in "xyz"]))
    from_hull = F.when(F.col("hull").isNotNull(), at(hull_centre(F.col("hull"))))
    from_box = F.when(F.col("box").isNotNull(), L.mat4_of(G.box_rotation(F.col("box")), [F.col("box")[k] for k in range(3)]))
    rows = rows.withColumn("t", F.coalesce("t", centre, from_hull, from_box, L.identity()))
    cube = G.obb_corners(L.vec(F.col("t")[3], F.col("t")[7], F.col("t")[11], 1, 1, 1, 0, 0, 0))
    rows = rows.withColumn("hull", F.coalesce("hull", F.when(F.col("_bounds").isNotNull(), G.aabb_corners(F.col("_bounds"))), F.when(F.col("box").isNotNull(), G.obb_corners(F.col("box"))), cube))
    return rows.withColumn("box", F.coalesce("box", F.when(F.col("_bounds").isNotNull(), bounds_box(F.col("_bounds"))), bounds_box(hull_bounds(F.col("hull"))))).drop("_x", "_y", "_z", "_bounds")


def move(nodes: DataFrame, m: Column) -> DataFrame:
    """Nodes moved by a rigid transform: pose and box from the left, hull by vertex."""
    rows = nodes.withColumn("_m", m)
    turned = L.mat4_mul(F.col("_m"), L.mat4_from_euler([F.col("box")[k] for k in (6, 7, 8)], [F.col("box")[k] for k in range(3)]))
    box = L.let(turned, lambda t: F.concat(L.translation_of(t), F.slice(F.col("box"), 4, 3), L.euler_from_mat(t)))
    return rows.withColumns({"t": L.mat4_mul(F.col("_m"), F.col("t")), "box": box, "hull": F.transform("hull", lambda v: L.mat4_apply(F.col("_m"), v))}).drop("_m")


def set_bounds(members: DataFrame, hulls: DataFrame) -> DataFrame:
    """Bounds of each set over all vertices of its members' hulls: members (parent, child), hulls (subject, hull)."""
    v = members.join(hulls.select(F.col("subject").alias("child"), F.explode("hull").alias("v")), "child").select("parent", *(F.col("v")[k].alias(c) for k, c in enumerate("xyz")))
    return bounds(v, ["parent"])


def crop_faces(faces: DataFrame, vertices: DataFrame, inside: Column, least: int = 3) -> DataFrame:
    """Faces (subject, fid, a, b, c) with at least so many corners whose vertex (subject, pid, x, y, z) passes the test."""
    kept = vertices.where(inside).select("subject", "pid")
    corners = faces.select("subject", "fid", F.explode(F.array("a", "b", "c")).alias("pid"))
    good = corners.join(kept, ["subject", "pid"], "left_semi").groupBy("subject", "fid").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    return faces.join(good.select("subject", "fid"), ["subject", "fid"], "left_semi")


def first_box(points: DataFrame, boxes: Sequence[Sequence[float]]) -> DataFrame:
    """Points with the number of the first of a few boxes (xmin .. zmax) that holds them; the others are left out."""
    at = F.lit(None).cast("int")
    for k, b in reversed(list(enumerate(boxes))):
        test = F.lit(True)
        for n, c in enumerate("xyz"):
            test &= F.col(c).between(float(b[2 * n]), float(b[2 * n + 1]))
        at = F.when(test, k).otherwise(at)
    return points.withColumn("box", at).where(F.col("box").isNotNull())


def lines_in_box(lines: DataFrame, box: Sequence[float], step: float) -> DataFrame:
    """Lines with a sample point, one each step, in the bounds; lines keep their columns."""
    samples = sample_lines(lines, step)
    for n, c in enumerate("xyz"):
        samples = samples.where(F.col(c).between(float(box[2 * n]), float(box[2 * n + 1])))
    return lines.join(samples.select("id").distinct(), "id", "left_semi")


def without_edges(cells: DataFrame, reach: int) -> DataFrame:
    """Grid cells (subject, row, col, depth) with the depth gone (null) where a cell without one lies at most reach rows and columns away: the few empty cells spread, not the full ones."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = cells.where("depth IS NULL").select("subject", F.col("row"), F.col("col"), F.explode(steps).alias("i")).select("subject", (F.col("row") + F.col("i")).alias("row"), "col", F.explode(steps).alias("j")).select("subject", "row", (F.col("col") + F.col("j")).alias("col")).distinct().withColumn("_edge", F.lit(True))
    return cells.join(near, ["subject", "row", "col"], "left").withColumn("depth", F.when(F.col("_edge").isNull(), F.col("depth"))).drop("_edge")


def scaled(values: DataFrame, column: str, by: Sequence[str], out: str) -> DataFrame:
    """Values between 0 and 1 by the least and greatest of their group; 0 where these are equal."""
    span = values.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return values.join(span, list(by)).withColumn(out, F.coalesce(share, F.lit(0.0))).drop("_lo", "_hi")


def numbered_values(rows: DataFrame, column: str, out: str = "number") -> DataFrame:
    """Rows with the number (from 0) of their value among the different values in order, as for one colour each. The order is found over the values alone, by ranges."""
    from geoweft.operators.space import ranked

    values, _ = ranked(rows.select(column).distinct(), [column])
    return rows.join(values.select(column, F.col("number").cast("int").alias(out)), column)


def best_matches(pairs: DataFrame, by: str, error: str, k: int, key: str) -> DataFrame:
    """The k pairs with the least error of each group, ties by key."""
    w = Window.partitionBy(by).orderBy(error, key)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_class(nodes: DataFrame, classes: DataFrame, column: str, default: str) -> DataFrame:
    """Nodes with the attributes of their class; those of an unknown class get the default's."""
    names = classes.select(F.col(column).alias("_c"))
    known = nodes.join(names, nodes[column] == F.col("_c"), "left").withColumn("_use", F.coalesce("_c", F.lit(default))).drop("_c")
    return known.join(classes.withColumnRenamed(column, "_use"), "_use").drop("_use")


def perpendicular_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Of lines (x0, y0, x1, y1): from their crossing to the nearer first end; for parallel lines between the first ends."""
    d1, d2 = (a[2] - a[0], a[3] - a[1]), (b[2] - b[0], b[3] - b[1])
    det = d1[0] * d2[1] - d1[1] * d2[0]
    s = ((b[0] - a[0]) * d2[1] - (b[1] - a[1]) * d2[0]) / F.nullif(det, F.lit(0.0))
    x, y = a[0] + s * d1[0], a[1] + s * d1[1]
    gap = lambda p: F.sqrt((x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1]))
    return F.when(F.abs(det) < 1e-12, F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))).otherwise(F.least(gap(a), gap(b)))


def move_poses(poses: DataFrame, q: Sequence[float], t: Sequence[float]) -> DataFrame:
    """Poses x, y, z and quaternion qx .. qw, turned by q and then moved by t."""
    own = [F.lit(float(v)) for v in q]
    p, r = L.quat_rotate(own, [F.col(c) for c in "xyz"]), L.quat_mul(own, [F.col(f"q{c}") for c in "xyzw"])
    rows = poses.withColumns({"_p": p, "_r": r})
    return rows.withColumns({c: F.col("_p")[k] + float(t[k]) for k, c in enumerate("xyz")} | {f"q{c}": F.col("_r")[k] for k, c in enumerate("xyzw")}).drop("_p", "_r")


def ellipsoids(rows: DataFrame, resolution: int = 30) -> DataFrame:
    """Vertices of an ellipsoid of each row's radii rx, ry, rz: i, j and x, y, z."""
    out = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resolution)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    v, u = F.col("i") * (math.pi / resolution), F.col("j") * (2 * math.pi / resolution)
    return out.withColumns({"x": F.col("rx") * F.sin(v) * F.cos(u), "y": F.col("ry") * F.sin(v) * F.sin(u), "z": F.col("rz") * F.cos(v)})
