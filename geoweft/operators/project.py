"""Lines on images: projected ends, drawn pixels, masks of outlines and crops; and frames of cameras and orthophotos."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L


def pinhole(p: list[Column]) -> tuple[Column, Column, Column]:
    """u, v and whether the point is in front, for cameras with t, focal, cu, cv."""
    at = G.pinhole_project(F.col("t"), (F.col("focal"), F.col("cu"), F.col("cv")), p)
    return at[0], at[1], at[2] > 0


def ortho(p: list[Column]) -> tuple[Column, Column, Column]:
    """The same for orthophotos with t and gsd."""
    at = G.ortho_project(F.col("t"), p, F.col("gsd"), F.col("width"), F.col("height"))
    return at[1], at[0], F.lit(True)


def panorama(p: list[Column]) -> tuple[Column, Column, Column]:
    """The same for panoramas with t: every point has a pixel but the camera's own."""
    at = G.equirect_project(F.col("t"), p, F.col("width"), F.col("height"))
    return at[0], at[1], at[2] > 0


def lines_on_images(lines: DataFrame, images: DataFrame, view: Callable = pinhole) -> DataFrame:
    """Ends of lines (line, x0 .. z1) on images (image, t, width, height and what the view needs) whose both ends are in the frame: image, line, u0, v0, u1, v1.

    images is a stated, small set (a row each, without pixels): it is gathered in one row that every line looks through.
    """
    gathered = images.agg(F.collect_list(F.struct(*images.columns)).alias("_images"))
    both = lines.select("line", *(f"{c}{n}" for n in "01" for c in "xyz")).join(F.broadcast(gathered)).withColumn("_i", F.explode("_images")).select("line", *(f"{c}{n}" for n in "01" for c in "xyz"), "_i.*")
    cols, seen = {}, F.lit(True)
    for n in "01":
        u, v, front = view([F.col(f"{c}{n}") for c in "xyz"])
        cols |= {f"u{n}": u, f"v{n}": v, f"_f{n}": front}
        seen &= F.col(f"_f{n}") & (F.col(f"u{n}") >= 0) & (F.col(f"v{n}") >= 0) & (F.col(f"u{n}") < F.col("width")) & (F.col(f"v{n}") < F.col("height"))
    return both.withColumns(cols).where(seen).select("image", "line", "u0", "v0", "u1", "v1")


def draw(lines: DataFrame, thickness: int = 2) -> DataFrame:
    """The pixels of lines on images (image, u0 .. v1), with a square brush: image, row, col, each once."""
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("u1") - F.col("u0")), F.abs(F.col("v1") - F.col("v0")))).cast("int"), F.lit(1))
    rows = lines.withColumn("_n", steps).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    brush = F.sequence(F.lit(-((thickness - 1) // 2)), F.lit(thickness // 2))
    at = lambda c: F.floor(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("_s") / F.col("_n")).cast("int")
    rows = rows.select("image", at("v").alias("row"), at("u").alias("col")).distinct()
    rows = rows.withColumn("_i", F.explode(brush)).select("image", (F.col("row") + F.col("_i")).alias("row"), "col").withColumn("_j", F.explode(brush))
    return rows.select("image", "row", (F.col("col") + F.col("_j")).alias("col")).where("row >= 0 AND col >= 0").distinct()


def outline_mask(lines: DataFrame) -> DataFrame:
    """The pixels inside closed outlines of lines on images (image, u0 .. v1), by the even-odd rule at pixel middles: image, row, col0, col1 of each run of columns.

    Every line tells the rows that it crosses; the crossings of a row, in order, are the runs' ends. A row of an image is a group.
    """
    low, high = F.least("v0", "v1"), F.greatest("v0", "v1")
    first, last = F.ceil(low - 0.5).cast("int"), F.ceil(high - 0.5).cast("int") - 1
    rows = lines.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    crossing = F.col("u0") + (F.col("row") + 0.5 - F.col("v0")) * (F.col("u1") - F.col("u0")) / F.nullif(F.col("v1") - F.col("v0"), F.lit(0.0))
    found = rows.select("image", "row", crossing.alias("_x")).groupBy("image", "row").agg(F.array_sort(F.collect_list("_x")).alias("_xs")).where(F.size("_xs") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get(F.col("_xs"), 2 * k) - 0.5).cast("int").alias("col0"), (F.ceil(F.get(F.col("_xs"), 2 * k + 1) - 0.5).cast("int") - 1).alias("col1")))
    return found.withColumn("_p", F.explode(pairs)).where("_p.col0 <= _p.col1").select("image", "row", "_p.col0", "_p.col1")


def grown_runs(runs: DataFrame, buffer: int = 0, band: int = 64) -> DataFrame:
    """Runs of columns grown by a square of buffer pixels: image, row, col0, col1, no pixel in two of them.

    A band of rows of an image is a group, which also gets the runs that reach into it; each row then takes the runs within the buffer and merges them.
    """
    near = F.explode(F.sequence(F.floor((F.col("row") - buffer) / band).cast("int"), F.floor((F.col("row") + buffer) / band).cast("int")))
    run = F.struct(F.greatest(F.col("col0") - buffer, F.lit(0)).cast("int").alias("col0"), (F.col("col1") + buffer).cast("int").alias("col1"), F.col("row").cast("int").alias("row"))
    groups = runs.select("image", run.alias("r"), near.alias("_b")).where("r.col1 >= 0").groupBy("image", "_b").agg(F.sort_array(F.collect_list("r")).alias("_r"))
    first = F.greatest(F.col("_b") * band, F.array_min("_r.row") - buffer, F.lit(0))
    last = F.least(F.col("_b") * band + band - 1, F.array_max("_r.row") + buffer)
    rows = groups.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("row", F.explode(F.sequence("_first", "_last")))
    own = F.transform(F.filter("_r", lambda r: F.abs(r["row"] - F.col("row")) <= buffer), lambda r: F.struct(r["col0"].alias("col0"), r["col1"].alias("col1")))

    def merged(done, r):
        end = F.get(done, F.size(done) - 1)
        wider = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(end["col0"].alias("col0"), F.greatest(end["col1"], r["col1"]).alias("col1"))))
        return F.when(F.size(done) == 0, F.array(r)).when(r["col0"] <= end["col1"] + 1, wider).otherwise(F.concat(done, F.array(r)))

    whole = F.aggregate(own, F.array().cast("array<struct<col0:int,col1:int>>"), merged)
    return rows.select("image", "row", F.explode(whole).alias("_p")).select("image", "row", "_p.col0", "_p.col1")


def mask_pixels(runs: DataFrame, buffer: int = 0) -> DataFrame:
    """Pixels of runs of columns, grown by a square of buffer pixels: image, row, col."""
    return grown_runs(runs, buffer).select("image", "row", F.explode(F.sequence("col0", "col1")).alias("col"))


def crop_to_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels (image, row, col, ..) of the mask, counted anew from the mask's first row and column of each image that has a pixel."""
    kept = pixels.join(mask.select("image", "row", "col"), ["image", "row", "col"], "left_semi")
    corner = kept.groupBy("image").agg(F.min("row").alias("_r"), F.min("col").alias("_c"))
    return kept.join(corner, "image").withColumns({"row": F.col("row") - F.col("_r"), "col": F.col("col") - F.col("_c")}).drop("_r", "_c")


# frames


def sensor_frustum(t: Column, width: Column, height: Column, focal35: Column, depth: Column) -> Column:
    """5 vertices of a camera's pyramid, the tip first, for a sensor 36 mm wide with the image's own shape."""
    x = depth * 18 / focal35
    y = x * height / width
    return L.let(t, lambda m: F.array(*(L.mat4_apply(m, p) for p in (L.vec(0, 0, 0), L.vec(-x, -y, depth), L.vec(x, -y, depth), L.vec(x, y, depth), L.vec(-x, y, depth)))))


#: The 8 edges of a pyramid of 5 vertices.
PYRAMID = ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4), (4, 1))


def frustum_lines(vertices: Column) -> Column:
    """The edges of a pyramid as an array of (start, end)."""
    return L.let(vertices, lambda v: F.array(*(F.array(F.get(v, F.lit(a)), F.get(v, F.lit(b))) for a, b in PYRAMID)))


def backface_pose(box: Column) -> Column:
    """A pose with a box's rotation, in the middle of its lower z side."""
    r = G.box_rotation(box)
    return L.mat4_of(r, [box[k] - r[3 * k + 2] * box[5] / 2 for k in range(3)])


def ortho_box(t: Column, width: Column, height: Column, gsd: Column, depth: Column) -> Column:
    """The box of an orthophoto: its ground, and depth along the pose's z."""
    return L.let(t, lambda m: F.concat(L.mat4_apply(m, L.vec(0, 0, depth / 2)), L.vec(width * gsd, height * gsd, depth), L.euler_from_mat(m)))


def ortho_rays(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rays of orthophoto pixels (image, row, col): all along the pose's z, from the pixel's place on the ground plane of the pose; columns ox .. dz."""
    rows = pixels.join(images, "image")
    at = G.ortho_unproject(F.col("t"), F.col("row"), F.col("col"), F.col("gsd"), F.col("width"), F.col("height"), F.lit(0.0))
    rows = rows.withColumns({"_o": at, "_d": L.mat4_rotate(F.col("t"), L.vec(0, 0, 1))})
    return rows.select("image", "row", "col", *(F.col("_o")[k].alias(f"o{c}") for k, c in enumerate("xyz")), *(F.col("_d")[k].alias(f"d{c}") for k, c in enumerate("xyz")))


def pinhole_rays(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """Rays of length 1 from the camera through pixels (image, row, col): columns ox .. dz."""
    rows = pixels.join(images, "image").withColumn("_d", G.pinhole_direction(F.col("t"), (F.col("focal"), F.col("cu"), F.col("cv")), F.col("col"), F.col("row")))
    return rows.select("image", "row", "col", *(F.col("t")[4 * k + 3].alias(f"o{c}") for k, c in enumerate("xyz")), *(F.col("_d")[k].alias(f"d{c}") for k, c in enumerate("xyz")))


def panorama_sphere(t: Column, depth: Column, around: int = 12, levels: int = 6) -> Column:
    """Vertices of a sphere of radius depth about a panorama's place, by rings: its hull."""
    out = []
    for i in range(levels + 1):
        polar = math.pi * i / levels
        for j in range(around if 0 < i < levels else 1):
            turn = 2 * math.pi * j / around
            out.append((math.sin(polar) * math.cos(turn), math.sin(polar) * math.sin(turn), math.cos(polar)))
    return L.let(L.translation_of(t), lambda c: F.array(*(L.vec(*(c[k] + depth * x for k, x in enumerate(v))) for v in out)))


def pose_of_pyramid(vertices: Column, tolerance: float = 1e-6) -> Column:
    """The pose of a camera from the 5 vertices of its pyramid in any order: at the one off the plane of the other four, z to their middle, y along the side nearest to +y.

    Null where no four are in a plane, or all five are.
    """

    def volume(v: Column, a: int, b: int, c: int, d: int) -> Column:
        p = [F.get(v, F.lit(k)) for k in (a, b, c, d)]
        return L.let(F.array(*(L.sub(x, p[0]) for x in p[1:])), lambda e: F.abs(L.dot(e[0], L.cross(e[1], e[2]))))

    def pose(v: Column, tip: int) -> Column:
        base = [k for k in range(5) if k != tip]
        at = lambda k: F.get(v, F.lit(k))
        middle = L.vec(*(sum(at(k)[c] for k in base) / 4 for c in range(3)))
        # of the six differences of corners, turned upwards, the one that points most along +y
        sides = F.array(*(L.sub(at(j), at(i)) for n, i in enumerate(base) for j in base[n + 1 :]))
        upward = F.transform(F.transform(sides, lambda x: L.normalize(x)), lambda x: F.struct(F.round(F.abs(x[1]), 9).alias("k"), F.when(x[1] < 0, L.scale(x, -1.0)).otherwise(x).alias("v")))
        ahead = L.let(L.sub(middle, at(tip)), lambda d: L.normalize(d))
        return L.let(F.array(ahead, F.array_max(upward)["v"], at(tip)), lambda f: L.let(F.array(*L.rotation_from_forward_up(f[0], f[1])), lambda r: L.mat4_of([r[k] for k in range(9)], f[2])))

    def found(v: Column) -> Column:
        out = F.lit(None).cast("array<double>")
        for tip in range(4, -1, -1):
            base = [k for k in range(5) if k != tip]
            out = F.when((volume(v, *base) <= tolerance) & (volume(v, tip, *base[:3]) > tolerance), pose(v, tip)).otherwise(out)
        return out

    return L.let(vertices, found)
