"""Rows from rows: grids, rays, samples, edges, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L


def steps(lo: Column, hi: Column, resolution: float) -> Column:
    """lo, lo + resolution, ... below hi; lo alone if the span is empty. Whole-number steps, so nothing drifts."""
    n = F.greatest(F.ceil(F.round((hi - lo) / resolution, 9)).cast("long") - 1, F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: lo + k * resolution)


def xyz_grid(bounds: DataFrame, resolution: float) -> DataFrame:
    """Grid points of each row's bounds (xmin .. zmax)."""
    out = bounds
    for c in "xyz":
        out = out.withColumn(c, F.explode(steps(F.col(f"{c}min"), F.col(f"{c}max"), resolution)))
    return out


def vertical_rays(bounds: DataFrame, resolution: float, down: bool = True, offset: float = 10.0) -> DataFrame:
    """Vertical rays over each row's bounds: ox, oy, oz, dz; from offset above downwards, or from below upwards."""
    out = bounds
    for c in "xy":
        out = out.withColumn(f"o{c}", F.explode(steps(F.col(f"{c}min"), F.col(f"{c}max"), resolution)))
    return out.withColumn("oz", F.col("zmax") + offset if down else F.col("zmin") - offset).withColumn("dz", F.lit(-1.0 if down else 1.0))


def sample_lines(lines: DataFrame, step: float) -> DataFrame:
    """Points along each segment (x0, y0, z0) to (x1, y1, z1), ends included: int(length / step) + 1 of them evenly; none if it is shorter than a step."""
    length = L.distance([F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}1") for c in "xyz"])
    rows = lines.withColumn("n", F.floor(length / step).cast("long")).where(F.col("n") >= 1).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    for c in "xyz":
        rows = rows.withColumn(c, F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col("s") / F.col("n")))
    return rows


def sample_triangles(triangles: DataFrame, density: float, seed: int = 0) -> DataFrame:
    """About area * density points on each triangle, uniformly; the same for the same seed, whatever the partitions."""
    a, b, c = (L.vec(*(F.col(f"{v}{k}") for k in "xyz")) for v in "abc")
    area = L.norm(L.cross(L.sub(b, a), L.sub(c, a))) / 2
    unit = lambda salt: F.pmod(F.xxhash64("subject", "fid", "s", F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(area * density + F.pmod(F.xxhash64("subject", "fid", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("long")
    rows = triangles.withColumn("n", whole).where(F.col("n") >= 1).withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    rows = rows.withColumn("r", F.sqrt(unit(1))).withColumn("w", unit(2))
    for k in "xyz":
        rows = rows.withColumn(k, (1 - F.col("r")) * F.col(f"a{k}") + F.col("r") * (1 - F.col("w")) * F.col(f"b{k}") + F.col("r") * F.col("w") * F.col(f"c{k}"))
    return rows


def mesh_edges(faces: DataFrame) -> DataFrame:
    """The different edges of the faces (subject, a, b, c): subject, u < v."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select("subject", F.explode(pairs).alias("e")).select("subject", "e.u", "e.v").distinct()


def split_quads(faces: DataFrame, corners: str = "corners") -> DataFrame:
    """Polygons as triangles a, b, c around their first corner, numbered by part."""
    n = F.size(corners)
    parts = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.struct((k - 1).alias("part"), F.get(F.col(corners), F.lit(0)).alias("a"), F.get(F.col(corners), k).alias("b"), F.get(F.col(corners), k + 1).alias("c")))
    return faces.where(n >= 3).withColumn("_t", F.explode(parts)).select(*(c for c in faces.columns if c != corners), "_t.*")


def tiles(images: DataFrame, width: int, height: int, include_last: bool = True) -> DataFrame:
    """Tiles of each image (image_width, image_height): row, col, x0, y0, x1, y1; without include_last only whole ones."""

    def count(size: str, side: int) -> Column:
        whole = F.floor(F.col(size) / side).cast("long")
        return F.ceil(F.col(size) / side).cast("long") if include_last else whole

    rows = images.where((count("image_width", width) >= 1) & (count("image_height", height) >= 1))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), count("image_height", height) - 1))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), count("image_width", width) - 1)))
    return rows.withColumns({"x0": F.col("col") * width, "y0": F.col("row") * height, "x1": F.least((F.col("col") + 1) * width, F.col("image_width")), "y1": F.least((F.col("row") + 1) * height, F.col("image_height"))})


#: The 12 triangles of a box, by the numbers of its corners as geometry.obb_corners has them, turned outwards.
BOX = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def box_triangles(boxes: DataFrame) -> DataFrame:
    """Boxes (subject, box as 9 numbers) as meshes: subject, fid, ax .. cz."""
    rows = boxes.withColumn("_c", G.obb_corners(F.col("box")))
    faces = F.array(*(F.struct(F.lit(k).cast("long").alias("fid"), *(F.lit(x).alias(v) for v, x in zip("abc", t, strict=True))) for k, t in enumerate(BOX)))
    rows = rows.select("subject", "_c", F.explode(faces).alias("f"))
    return rows.select("subject", "f.fid", *(F.get(F.get(F.col("_c"), F.col(f"f.{v}")), F.lit(n)).alias(f"{v}{c}") for v in "abc" for n, c in enumerate("xyz")))


def joined_meshes(vertices: DataFrame, faces: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """The meshes of each group (column by) as one: vertices (subject, pid, ..) and faces (subject, fid, a, b, c) with numbers that go on from mesh to mesh, by subject; their subject is the group's."""
    w = Window.partitionBy(by).orderBy("subject").rowsBetween(Window.unboundedPreceding, -1)

    def starts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(by, "subject").agg((F.max(name) + 1).alias("_n")).select(by, "subject", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_{name}"))

    pids, fids = starts(vertices, "pid"), starts(faces, "fid")
    v = vertices.join(pids, [by, "subject"]).withColumn("pid", F.col("pid") + F.col("_pid")).drop("_pid", "subject").withColumnRenamed(by, "subject")
    f = faces.join(pids, [by, "subject"]).join(fids, [by, "subject"]).withColumns({"fid": F.col("fid") + F.col("_fid")} | {c: F.col(c) + F.col("_pid") for c in "abc"}).drop("_pid", "_fid", "subject").withColumnRenamed(by, "subject")
    return v, f


def identity_points(triangles: DataFrame, resolution: float, seed: int = 0) -> DataFrame:
    """One point for each voxel of the resolution's size that a subject's surface crosses, with the subject: samples, four for a voxel's side, of which the first of each voxel stays."""
    samples = sample_triangles(triangles, 4 / (resolution * resolution), seed).select("subject", "fid", "s", "x", "y", "z")
    cell = [F.floor(F.col(c) / resolution).alias(f"_{c}") for c in "xyz"]
    first = samples.groupBy("subject", *cell).agg(F.min(F.struct("fid", "s", "x", "y", "z")).alias("m"))
    return first.select("subject", "m.x", "m.y", "m.z")


def as_points(value: Column) -> Column:
    """An array of points of bounds (6 numbers) or of an oriented box (9): their corners."""
    return F.when(F.size(value) == 6, G.aabb_corners(value)).when(F.size(value) == 9, G.obb_corners(value))


def homogeneous(p: Column) -> Column:
    """Points of 3 numbers with a 1, points of 4 divided by their last."""
    return F.when(F.size(p) == 3, F.concat(p, F.array(F.lit(1.0)))).when(F.size(p) == 4, F.transform(p, lambda x: x / F.nullif(F.get(p, F.lit(3)), F.lit(0.0))))
