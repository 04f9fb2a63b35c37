"""Voxels, octrees, subdivisions, epochs, clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.operators.joins import near_and_far, within_distance
from geoweft.operators.select import xyz
from geoweft.shared import table

CELL = ("i", "j", "k")


def with_voxel(points: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return points.withColumns(dict(zip(CELL, G.voxel(xyz(), size, origin), strict=True)))


def voxel_downsample(points: DataFrame, size: float, values: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """One row per occupied voxel: means of the values, number of points."""
    return with_voxel(points, size).groupBy(*CELL).agg(*(F.avg(c).alias(c) for c in values), F.count(F.lit(1)).alias("n"))


def voxel_majority(points: DataFrame, size: float, column: str) -> DataFrame:
    """The most frequent value of each voxel, ties to the smallest."""
    counts = with_voxel(points, size).groupBy(*CELL, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*CELL).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("b")).select(*CELL, F.col("b.v").alias(column), (-F.col("b.m")).alias("n"))


def voxel_cubes(voxels: DataFrame, size: float) -> DataFrame:
    """The 8 corners of each voxel's cube."""
    return voxels.withColumn("corners", G.aabb_corners(F.array(*(e * size for c in CELL for e in (F.col(c), F.col(c) + 1)))))


def octree_counts(points: DataFrame, origin: Sequence[float], size: float, depth: int) -> DataFrame:
    """Number of points in every occupied node of an octree over a cube, from level 1 to depth: level, node (its Morton path), n. Leaves are counted once and rolled up."""
    i, j, k = G.voxel(xyz(), size / 2**depth, origin)
    leaves = points.withColumns({"i": i, "j": j, "k": k}).where(F.col("i").between(0, 2**depth - 1) & F.col("j").between(0, 2**depth - 1) & F.col("k").between(0, 2**depth - 1))
    counted = leaves.groupBy(G.morton(F.col("i"), F.col("j"), F.col("k"), depth).alias("leaf")).agg(F.count(F.lit(1)).alias("c"))
    levels = counted.select(F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level"), "leaf", "c")
    return levels.groupBy("level", F.expr(f"shiftright(leaf, 3 * ({depth} - level))").alias("node")).agg(F.sum("c").alias("n"))


def octree_split(points: DataFrame, origin: Sequence[float], size: float, depth: int, low: int, high: int) -> DataFrame:
    """Nodes kept when a subdivision descends until a node has between low and high points: level, node, n."""
    counts = octree_counts(points, origin, size, depth)
    fits = counts.withColumn("fits", (F.col("n") > low) & (F.col("n") < high))
    kept = fits.where("fits")
    # a node's ancestors are the leading parts of its path, so the test for one is an equi-join
    above = kept.where("level > 1").select("level", "node", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("up")).withColumn("upper", F.expr("shiftright(node, 3 * (level - up))"))
    inner = above.join(kept.select(F.col("level").alias("up"), F.col("node").alias("upper")), ["up", "upper"], "left_semi").select("level", "node").distinct()
    return kept.join(inner, ["level", "node"], "left_anti").select("level", "node", "n")


def subdivide(points: DataFrame, bounds: Sequence[float], parts: Sequence[int]) -> DataFrame:
    """Points with the number (i, j, k) of their box in a regular division of the bounds; the far faces belong to the last boxes."""
    out = points
    for n, (c, cell) in enumerate(zip("xyz", CELL, strict=True)):
        lo, hi = bounds[2 * n], bounds[2 * n + 1]
        at = F.floor((F.col(c) - lo) / ((hi - lo) / parts[n])).cast("long")
        out = out.where(F.col(c).between(lo, hi)).withColumn(cell, F.least(at, F.lit(parts[n] - 1).cast("long")))
    return out


def by_height(points: DataFrame, heights: Sequence[float]) -> DataFrame:
    """Points with the number of heights at or below their z."""
    band = F.lit(0)
    for h in heights:
        band = band + (F.col("z") >= float(h)).cast("int")
    return points.withColumn("band", band)


def combine_epochs(old: DataFrame, new: DataFrame, new_bounds: Sequence[float], radius: float) -> DataFrame:
    """Old points outside the new bounds, old points near new ones, and new points far from old ones, with the column origin."""
    x0, x1, y0, y1, z0, z1 = new_bounds
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & F.col("z").between(z0, z1)
    kept, _ = near_and_far(old.where(inside), new, radius)
    _, added = near_and_far(new, old, radius)
    parts = ((old.where(~inside), "outside"), (kept, "kept"), (added, "added"))
    out = None
    for df, name in parts:
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that the edges u, v (longs, both directions present) lead to.

    Each round takes the least label among a node and its neighbours and then the label of that label, so long chains halve; rounds are written to the shared folder.
    """
    labels = table(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    before = None
    while True:
        check = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if check is None or check == before:
            return labels
        before = check
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "near").alias("root"))
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("next"))
        labels = table(hooked.join(up, F.col("root") == F.col("up")).select("node", F.least("root", "next").alias("root")))


def dbscan(points: DataFrame, eps: float, min_points: int, key: str = "id") -> DataFrame:
    """Points in clusters: key, cluster (the smallest key of its core points), core. Noise is left out; a border point joins the smallest cluster in reach.

    All points of a cell of side eps / sqrt(3) are in reach of each other. So cells with min_points or more are core without a look at any pair; only the others' points count their
    neighbours. Cells that hold core points are the nodes: neighbouring ones are linked where some of six outermost points of each are in reach. What that leaves apart is decided by
    all their core points, so no pair within a cluster that already hangs together is written.
    """
    side = eps / math.sqrt(3) * (1 - 1e-9)
    placed = with_voxel(points.select(F.col(key).alias("id"), "x", "y", "z"), side)
    counts = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    placed = table(placed.join(counts, list(CELL)))
    sparse = placed.where(F.col("n") < min_points)
    pairs = table(within_distance(sparse.select("id", "x", "y", "z"), placed.select("id", "x", "y", "z"), eps).select(F.col("q.id").alias("u"), F.col("r.id").alias("v")))
    enough = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_points).select(F.col("u").alias("id"))
    core = table(placed.where(F.col("n") >= min_points).unionByName(sparse.join(enough, "id", "left_semi")).select("id", "x", "y", "z", *CELL))
    at = F.struct("x", "y", "z")
    outer = F.array_distinct(F.array(*(f(at, c) for c in "xyz" for f in (F.min_by, F.max_by))))
    cells = table(core.groupBy(*CELL).agg(F.min("id").alias("node"), outer.alias("outer"), *(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("0", F.min), ("1", F.max)))))
    near = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    steps = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(s, CELL, strict=True))) for s in near))
    a = cells.select(F.struct("*").alias("a"), F.explode(steps).alias("s")).select("a", *((F.col(f"a.{n}") + F.col(f"s.{n}")).alias(n) for n in CELL))
    met = a.join(cells.select(F.struct("*").alias("b"), *CELL), list(CELL))
    gap = [F.greatest(F.lit(0.0), F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1")) for c in "xyz"]
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) + (p["z"] - q["z"]) * (p["z"] - q["z"])
    sure = F.exists(F.col("a.outer"), lambda p: F.exists(F.col("b.outer"), lambda q: square(p, q) <= eps * eps))
    beside = table(met.where(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= eps * eps).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), sure.alias("sure")))
    both = lambda e: e.select("u", "v").union(e.select("v", "u")).toDF("u", "v")
    linked = beside.where("sure").select("u", "v")
    groups = components(both(linked))
    root = lambda name: groups.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    apart = beside.where("NOT sure").join(root("u"), "u", "left").join(root("v"), "v", "left").where(~F.coalesce("_u", "u").eqNullSafe(F.coalesce("_v", "v"))).select("u", "v")
    own = core.join(cells.select(*CELL, "node"), list(CELL)).select("id", "node", at.alias("p"))
    touching = apart.join(own.select(F.col("node").alias("u"), F.col("p").alias("p")), "u").join(own.select(F.col("node").alias("v"), F.col("p").alias("q")), "v").where(square(F.col("p"), F.col("q")) <= eps * eps).select("u", "v").distinct()
    roots = components(both(table(linked.union(touching))))
    inside = own.join(roots, "node", "left").select(F.col("id").alias(key), F.coalesce("root", "node").alias("cluster"), F.lit(True).alias("core"))
    inside = table(inside)
    border = pairs.join(inside.select(F.col(key).alias("v"), "cluster"), "v").join(inside.select(F.col(key).alias("u")), "u", "left_anti").groupBy(F.col("u").alias(key)).agg(F.min("cluster").alias("cluster"))
    return inside.unionByName(border.withColumn("core", F.lit(False)))


def ranked(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with their number (from 0) in a total order, and how many there are.

    The rows are dealt to tasks by range and written; each range is numbered by itself and starts where the ranges before it end, so no task sees more than its range.
    """
    ranges = table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_at", at).join(starts, "_range").withColumn("number", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start"), ranges.count()


def chunks(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Rows with the number (from 1) of their chunk, of n nearly equal ones in order, the first ones larger."""
    out, total = ranked(rows, order)
    q, r = divmod(total, n)
    k = F.col("number")
    chunk = F.when(k < r * (q + 1), F.floor(k / (q + 1))).otherwise(r + F.floor((k - r * (q + 1)) / max(q, 1))) + 1
    return out.withColumn("chunk", chunk.cast("int")).drop("number")


def every_nth(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first row of each group in order, and every n-th after it."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("_at", at).where(F.col("_at") % n == 0).drop("_at")
