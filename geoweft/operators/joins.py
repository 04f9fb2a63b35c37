"""Spatial joins: within a distance, nearest, rays against triangles. Cells of space are the equi-join keys, so no join compares everything with everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.operators.select import XYZ, xyz
from geoweft.shared import drop, table


def _cells(size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long") for c in XYZ]


def within_distance(queries: DataFrame, references: DataFrame, radius: float, salts: int = 1) -> DataFrame:
    """Every pair of a query and a reference (structs q and r) at most radius apart, with the distance d.

    Cells are twice the radius wide. Queries go to their cell, references to those, 8 at most, that the radius around them reaches; equal cells join. Both
    sides should carry only what the pairs need: a reference is copied with all its columns. Spark splits the partition of a dense cell; in salts copies references
    meet queries dealt at random, where that is not enough.
    """
    size = 2 * radius
    q = queries.select(F.struct("*").alias("q"), *(c.alias(n) for c, n in zip(_cells(size), ("cx", "cy", "cz"), strict=True)), F.pmod(F.xxhash64(*XYZ), F.lit(salts)).alias("salt"))
    # a little more than the radius, for rounding at the borders of cells
    reach = radius * (1 + 1e-9)
    spans = [F.sequence(F.floor((F.col(c) - reach) / size).cast("long"), F.floor((F.col(c) + reach) / size).cast("long")) for c in XYZ]
    cells = F.flatten(F.transform(spans[0], lambda i: F.flatten(F.transform(spans[1], lambda j: F.transform(spans[2], lambda k: F.struct(i.alias("cx"), j.alias("cy"), k.alias("cz")))))))
    copies = F.flatten(F.transform(cells, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")), lambda n: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), c["cz"].alias("cz"), n.alias("salt")))))
    r = references.select(F.struct("*").alias("r"), F.explode(copies).alias("c")).select("r", "c.cx", "c.cy", "c.cz", "c.salt")
    d2 = L.distance2(xyz("q"), xyz("r"))
    # Spark knows the references' size before they are copied only, and would broadcast far larger ones
    return q.join(r.hint("merge"), ["cx", "cy", "cz", "salt"]).select("q", "r", d2.alias("d2")).where(F.col("d2") <= radius * radius).select("q", "r", F.sqrt("d2").alias("d"))


def nearest_within(queries: DataFrame, references: DataFrame, radius: float, key: str = "id", ref_key: str = "id") -> DataFrame:
    """Each query with its nearest reference within the radius: key, ref, d; queries without any are left out. An aggregate with map-side combine, ties by the reference's key."""
    pairs = within_distance(queries.select(key, *XYZ), references.select(ref_key, *XYZ), radius)
    best = pairs.groupBy(F.col(f"q.{key}").alias(key)).agg(F.min(F.struct("d", F.col(f"r.{ref_key}").alias("ref"))).alias("m"))
    return best.select(key, "m.ref", "m.d")


def nearest_join(queries: DataFrame, references: DataFrame, start: float, key: str = "id", ref_key: str = "id") -> DataFrame:
    """Each query with its nearest reference, however far: key, ref, d; no references give no rows.

    A join within start settles most queries. The others go down a tree of cells that hold references, each level half as wide as the one above: of the cells that a query
    still has, one reference each bounds its distance from above, and cells that begin beyond that bound are dropped. So a query far from everything meets a few
    cells on each level and the references of a few smallest ones, never all. The driver sees the references' bounds.
    """
    refs = references.select(F.col(ref_key).alias("ref"), *XYZ)
    near = table(nearest_within(queries, references, start, key, ref_key))
    left = table(queries.select(F.col(key).alias("_q"), *XYZ).join(near.select(F.col(key).alias("_q")), "_q", "left_anti"))
    if left.isEmpty():
        return near
    row = refs.agg(*(f(c) for c in XYZ for f in (F.min, F.max))).first()
    if row[0] is None:
        return near
    levels = max(0, math.ceil(math.log2(max(row[k + 1] - row[k] for k in (0, 2, 4)) / start + 1)))
    names = ("i", "j", "k")
    cells = [refs.groupBy(*(c.alias(n) for c, n in zip(_cells(start), names, strict=True))).agg(F.min(F.struct("ref", *XYZ)).alias("one"))]
    cells[0] = table(cells[0])
    for _ in range(levels):
        cells.append(cells[-1].groupBy(*(F.shiftright(n, 1).alias(n) for n in names)).agg(F.min("one").alias("one")))

    def bounded(pairs: DataFrame, size: float) -> DataFrame:
        """Pairs of a query and a cell, without those that begin farther than some reference is."""
        gap = [F.greatest(F.lit(0.0), F.col(n) * size - F.col(c), F.col(c) - (F.col(n) + 1) * size) for n, c in zip(names, XYZ, strict=True)]
        begin = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
        reach = F.min(L.distance(xyz(), [F.col(f"one.{c}") for c in XYZ])).over(Window.partitionBy("_q"))
        return pairs.withColumn("_reach", reach).where(begin <= F.col("_reach") * (1 + 1e-9)).select("_q", *XYZ, *names)

    # the widest level has 8 cells at most, which one row holds
    top = cells[-1].agg(F.collect_list(F.struct(*names, "one")).alias("_top"))
    now = table(bounded(left.join(F.broadcast(top)).withColumn("_c", F.explode("_top")).select("_q", *XYZ, "_c.*"), start * 2**levels))
    for level in range(levels - 1, -1, -1):
        parents = now.select("_q", *XYZ, *(F.col(n).alias(f"p{n}") for n in names))
        children = cells[level].select(*names, "one", *(F.shiftright(n, 1).alias(f"p{n}") for n in names))
        now, old = table(bounded(parents.join(children, [f"p{n}" for n in names]), start * 2**level)), now
        drop(old)
    members = refs.select("ref", *(F.col(c).alias(f"r{c}") for c in XYZ), *(c.alias(n) for c, n in zip(_cells(start), names, strict=True)))
    d = L.distance(xyz(), [F.col(f"r{c}") for c in XYZ])
    far = now.join(members, list(names)).groupBy(F.col("_q").alias(key)).agg(F.min(F.struct(d.alias("d"), "ref")).alias("m")).select(key, "m.ref", "m.d")
    return near.unionByName(far)


def nearest_k_within(queries: DataFrame, references: DataFrame, radius: float, k: int, key: str = "id", ref_key: str = "id") -> DataFrame:
    """Each query with its k nearest references within the radius, ranked from 1: key, ref, d, rank."""
    w = Window.partitionBy(f"q.{key}").orderBy("d", f"r.{ref_key}")
    return within_distance(queries.select(key, *XYZ), references.select(ref_key, *XYZ), radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col(f"q.{key}").alias(key), F.col(f"r.{ref_key}").alias("ref"), "d", "rank")


def near_and_far(points: DataFrame, references: DataFrame, radius: float, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Points with a reference within the radius, and the others."""
    near = within_distance(points.select(key, *XYZ), references.select(*XYZ), radius).select(F.col(f"q.{key}").alias(key)).distinct()
    return points.join(near, key, "left_semi"), points.join(near, key, "left_anti")


def match_points(queries: DataFrame, references: DataFrame, radius: float = 0.15, most: int = 20, weight_normal: float = 0.38, weight_distance: float = 0.62, threshold: float = 0.7, key: str = "id", ref_key: str = "id") -> DataFrame:
    """Each query with the best of its nearest references (at most `most`, within the radius): key, ref, d, score.

    score = weight_normal * |n·n'|^3 + weight_distance * (radius - d) / radius, and must exceed the threshold. Both tables have normals nx, ny, nz.
    The defaults are fixed values: radius, neighbours, weights and threshold of the published method.
    """
    w = Window.partitionBy(f"q.{key}").orderBy("d", f"r.{ref_key}")
    wide = [*XYZ, *(f"n{c}" for c in XYZ)]
    pairs = within_distance(queries.select(key, *wide), references.select(ref_key, *wide), radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    facing = F.abs(L.dot([F.col(f"q.n{c}") for c in "xyz"], [F.col(f"r.n{c}") for c in "xyz"]))
    score = weight_normal * facing * facing * facing + weight_distance * (radius - F.col("d")) / radius
    best = pairs.withColumn("score", score).groupBy(F.col(f"q.{key}").alias(key)).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(f"r.{ref_key}").alias("ref"), "d")).alias("m"))
    return best.select(key, "m.ref", "m.d", (-F.col("m.s")).alias("score")).where(F.col("score") > threshold)


def cast_vertical(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """First hit of each vertical ray (ray_id, ox, oy, oz, dz = 1 or -1) on the triangles (subject, fid, ax .. cz): ray_id, subject, fid, t; rays that miss are left out.

    A triangle goes to all cells of the xy plane that its bounds cover, a ray to its one.
    """
    r = rays.select("*", F.floor(F.col("ox") / cell).cast("long").alias("i"), F.floor(F.col("oy") / cell).cast("long").alias("j"))
    spans = [F.sequence(F.floor(F.least(*(f"{v}{c}" for v in "abc")) / cell).cast("long"), F.floor(F.greatest(*(f"{v}{c}" for v in "abc")) / cell).cast("long")) for c in "xy"]
    t = triangles.select("*", F.explode(spans[0]).alias("i"), spans[1].alias("js")).withColumn("j", F.explode("js")).drop("js")
    hit = G.ray_triangle(L.vec(F.col("ox"), F.col("oy"), F.col("oz")), L.vec(0.0, 0.0, F.col("dz")), *(L.vec(*(F.col(f"{v}{c}") for c in "xyz")) for v in "abc"))
    hits = r.join(t.hint("merge"), ["i", "j"]).withColumn("t", hit).where(F.col("t").isNotNull())
    # a level face lies at its own height exactly, so faces of one height tie
    hits = hits.withColumn("t", F.when((F.col("az") == F.col("bz")) & (F.col("az") == F.col("cz")), (F.col("az") - F.col("oz")) / F.col("dz")).otherwise(F.col("t")))
    return hits.groupBy("ray_id").agg(F.min(F.struct("t", "subject", "fid")).alias("m")).select("ray_id", "m.subject", "m.fid", "m.t")


def mutual_matches(a: DataFrame, b: DataFrame, bits: int = 64, key: str = "id", code: str = "code", block: int = 2048) -> DataFrame:
    """Cross-checked matches of binary descriptors: pairs that are each other's nearest by Hamming distance: a, b, d; equal distances go to the smaller key.

    Codes nearer than their number of bytes share a byte, so a best match found among those is the best of all. The rows without one, the queries that are left, are
    compared with all codes of the other side in blocks of block by block rows, each a task's work. Rows without a code match nothing.
    """
    p, q = (x.select(F.col(key).alias(n), F.col(code).alias(f"{n}code")).where(F.col(code).isNotNull()) for x, n in ((a, "a"), (b, "b")))
    cuts = lambda c: F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(c), k).bitwiseAND(F.lit(255)).alias("v")) for k in range(0, bits, 8))))
    d = F.bit_count(F.col("acode").bitwiseXOR(F.col("bcode"))).alias("d")
    close = p.withColumn("cut", cuts("acode")).join(q.withColumn("cut", cuts("bcode")), "cut").select("a", "b", d).where(F.col("d") < -(-bits // 8)).distinct()
    parts = {n: max(1, -(-x.count() // block)) for n, x in (("a", p), ("b", q))}

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows in their block, once for each block of the other side."""
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[other] - 1).cast("long")))
        return rows.withColumns({f"_{own}": F.pmod(F.xxhash64(own), F.lit(parts[own])), f"_{other}": spread})

    def nearest(own: DataFrame, others: DataFrame, mine: str, other: str) -> DataFrame:
        best = lambda pairs: pairs.groupBy(mine).agg(F.min(F.struct("d", other)).alias("m")).select(mine, f"m.{other}", "m.d")
        known = best(close)
        rest = dealt(own.join(known, mine, "left_anti"), mine, other).join(dealt(others, other, mine), ["_a", "_b"]).select("a", "b", d)
        return known.unionByName(best(rest))

    return nearest(p, q, "a", "b").join(nearest(q, p, "b", "a").select("a", "b"), ["a", "b"])


def ratio_matches(a: DataFrame, b: DataFrame, radius: int, share: float = 0.75, key: str = "id", code: str = "code", bits: int = 64) -> DataFrame:
    """Matches of binary descriptors by the ratio test: a's nearest code of b within radius bits, if it is nearer than share times the second nearest: a, b, d.

    radius + 1 blocks of bits are the keys of the join, so no pair within the radius is missed; a second one beyond it counts as radius + 1 bits away.
    """
    cuts = [round(k * bits / (radius + 1)) for k in range(radius + 2)]
    keys = lambda c: F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.shiftrightunsigned(F.col(c), lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("v")) for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)))))
    p, q = (x.select(F.col(key).alias(n), F.col(code).alias(f"{n}code")).where(F.col(code).isNotNull()) for x, n in ((a, "a"), (b, "b")))
    d = F.bit_count(F.col("acode").bitwiseXOR(F.col("bcode"))).alias("d")
    pairs = p.withColumn("_k", keys("acode")).join(q.withColumn("_k", keys("bcode")), "_k").select("a", "b", d).where(F.col("d") <= radius).distinct()
    w = Window.partitionBy("a").orderBy("d", "b")
    ranked = pairs.withColumns({"_n": F.row_number().over(w), "_next": F.lead("d").over(w)}).where("_n = 1")
    return ranked.where(F.col("d") < share * F.coalesce(F.col("_next"), F.lit(radius + 1))).select("a", "b", "d")


def best_of_matches(matches: DataFrame, by: list[str], most: int = 2000) -> DataFrame:
    """The most nearest matches of each pair of images (columns by, d): their mean distance as error, infinite for pairs with fewer than most."""
    w = Window.partitionBy(*by).orderBy("d", "a", "b")
    top = matches.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return top.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("_e")).select(*by, "n", F.when(F.col("n") < most, float("inf")).otherwise(F.col("_e")).alias("error"))
