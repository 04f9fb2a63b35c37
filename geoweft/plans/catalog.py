"""The registered queries, each beside its DuckDB SQL. Coordinates and ratios are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.functions import literals as X
from geoweft.operators import generate, joins, kernels, measures, nodes, raster, select, space
from geoweft.operators import triples as rdf
from geoweft.plans.inputs import BOXES, CELLS, POINTS, TRIPLES, boxes, cells, points, read, triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points of the labels other than 0, and the reference points of label 0."""
    p = points(spark, sf_dir)
    return p.where("label <> 0"), p.where("label = 0")


D2 = "((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z))"
NN = f"nn AS (SELECT q.id, q.label, min(sqrt({D2})) AS d, arg_min(r.id, ({D2}, r.id)) AS ref FROM p q, p r WHERE q.label <> 0 AND r.label = 0 GROUP BY ALL)"
EPS = 0.06


# nearest neighbours and accuracy


@query(f"""WITH {POINTS}, {NN}, i AS (SELECT * FROM nn WHERE d <= 0.15),
g AS (SELECT label, count(*) AS n, avg((d <= 0.1)::INT) AS r10, avg((d <= 0.05)::INT) AS r20, avg((d <= 0.015)::INT) AS r30 FROM i GROUP BY label)
SELECT label, n, round(r10, 6) AS r10, round(r20, 6) AS r20, round(r30, 6) AS r30, CASE WHEN r30 > 0.95 THEN 'LOA30' WHEN r20 > 0.95 THEN 'LOA20' WHEN r10 > 0.95 THEN 'LOA10' ELSE 'NO_LOA' END AS loa FROM g""")
def loa_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    nn = joins.nearest_within(q, r, 0.15).join(q.select("id", "label"), "id")
    return rounded(measures.loa(nn, ["label"]), "r10", "r20", "r30")


@query(f"WITH {POINTS}, {NN} SELECT label, round(avg((d <= 0.1)::INT), 6) AS coverage FROM nn GROUP BY label")
def coverage_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    near = q.select("id", "label").join(joins.nearest_within(q, r, 0.1), "id", "left")
    return rounded(measures.coverage(near, ["label"], threshold=0.1), "coverage")


@query(f"WITH {POINTS}, {NN} SELECT id, ref, round(d, 6) AS d FROM nn")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return rounded(joins.nearest_join(q, r, 0.2), "d")


@query(f"""WITH {POINTS}, c AS (SELECT q.id, r.id AS ref, sqrt({D2}) AS d FROM p q, p r WHERE q.label <> 0 AND r.label = 0 AND {D2} <= 0.15::DOUBLE * 0.15),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rank FROM c) SELECT id, ref, round(d, 6) AS d, rank::INT AS rank FROM k WHERE rank <= 5""")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return rounded(joins.nearest_k_within(q, r, 0.15, 5), "d")


@query(f"""WITH {POINTS}, c AS (SELECT q.id, r.id AS ref, sqrt({D2}) AS d, abs(q.nx * r.nx + q.ny * r.ny + q.nz * r.nz) AS f FROM p q, p r WHERE q.label <> 0 AND r.label = 0 AND {D2} <= 0.15::DOUBLE * 0.15),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rank FROM c), s AS (SELECT id, ref, d, 0.38::DOUBLE * f * f * f + 0.62::DOUBLE * (0.15::DOUBLE - d) / 0.15::DOUBLE AS score FROM k WHERE rank <= 20),
b AS (SELECT id, arg_min(ref, (-score, ref)) AS ref, arg_min(d, (-score, ref)) AS d, max(score) AS score FROM s GROUP BY id) SELECT id, ref, round(d, 6) AS d, round(score, 6) AS score FROM b WHERE score > 0.7""")
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return rounded(joins.match_points(q, r), "d", "score")


@query(f"""WITH {POINTS}, c AS (SELECT q.id, r.id AS ref, sqrt({D2}) AS d, abs(q.nx * r.nx + q.ny * r.ny + q.nz * r.nz) AS f FROM p q, p r WHERE q.label <> 0 AND r.label = 0 AND {D2} <= 0.15::DOUBLE * 0.15),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref) AS rank FROM c) SELECT id, arg_min(ref, (-f, ref)) AS ref, round(max(f), 6) AS facing FROM k WHERE rank <= 5 GROUP BY id""")
def nn_normal_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    near = joins.nearest_k_within(q, r, 0.15, 5)
    n = [f"n{c}" for c in "xyz"]
    both = near.join(q.select("id", *n), "id").join(r.select(F.col("id").alias("ref"), *(F.col(c).alias(f"r{c}") for c in n)), "ref")
    facing = F.abs(L.dot([F.col(c) for c in n], [F.col(f"r{c}") for c in n]))
    best = both.groupBy("id").agg(F.min(F.struct((-facing).alias("f"), "ref")).alias("m"))
    return best.select("id", "m.ref", r6(-F.col("m.f")).alias("facing"))


@query(f"WITH {POINTS} SELECT q.id, arg_min(r.label, ({D2}, r.id)) AS label FROM p q, p r WHERE q.label <= 2 AND r.label > 2 GROUP BY q.id")
def label_transfer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for all points that aren't references."""
    p = points(spark, sf_dir)
    r = p.where("label > 2")
    nn = joins.nearest_join(p.where("label <= 2").select("id", "x", "y", "z"), r, 0.05)
    return nn.join(r.select(F.col("id").alias("ref"), "label"), "ref").select("id", "label")


@query(f"WITH {POINTS} SELECT q.id, q.label FROM p q WHERE q.label <> 0 AND EXISTS (SELECT 1 FROM p r WHERE r.label = 0 AND {D2} <= {EPS}::DOUBLE * {EPS})")
def crop_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return joins.near_and_far(q, r, EPS)[0].select("id", "label")


@query(f"WITH {POINTS} SELECT q.id, q.label FROM p q WHERE q.label <> 0 AND NOT EXISTS (SELECT 1 FROM p r WHERE r.label = 0 AND {D2} <= {EPS}::DOUBLE * {EPS})")
def crop_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    return joins.near_and_far(q, r, EPS)[1].select("id", "label")


@query(f"WITH {POINTS}, v AS (SELECT q.label, NOT EXISTS (SELECT 1 FROM p r WHERE r.label <> q.label AND {D2} <= 0.02::DOUBLE * 0.02) AS free FROM p q) SELECT label, round(avg(free::INT), 6) AS visible FROM v GROUP BY label")
def visible_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    hidden = joins.within_distance(p, p, 0.02).where("q.label <> r.label").select("q.id").distinct().withColumn("hidden", F.lit(1))
    return p.join(hidden, "id", "left").groupBy("label").agg(r6(measures.share(F.col("hidden").isNull())).alias("visible"))


@query(f"""WITH {POINTS}, {NN} SELECT id, CASE WHEN d <= 0.015 THEN 'LOA30' WHEN d <= 0.05 THEN 'LOA20' WHEN d <= 0.1 THEN 'LOA10' WHEN d <= 0.15 THEN 'LOA00' ELSE 'NONE' END AS color FROM nn""")
def color_by_loa(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = sides(spark, sf_dir)
    near = q.select("id").join(joins.nearest_within(q, r, 0.15), "id", "left")
    c = X.color_by_loa(F.col("d"))
    names = F.when(c == L.vec(0, 1, 0), "LOA30").when(c == L.vec(1, 1, 0), "LOA20").when(c == L.vec(1, 0.76, 0), "LOA10").when(c == L.vec(1, 0, 0), "LOA00").otherwise("NONE")
    return near.select("id", names.alias("color"))


# selections


CENTRE, RADIUS = (0.0, 0.05, -0.05), 0.15
BOX = (0.0, 0.0, 0.0, 0.2, 0.3, 0.25, 10.0, 20.0, 30.0)
HULL = ((1.0, 1.0, 1.0, 0.1), (-1.0, 0.5, 0.2, 0.1), (0.1, -1.0, 0.4, 0.12), (0.0, 0.3, -1.0, 0.11))


@query(f"WITH {POINTS} SELECT id, label FROM p WHERE (x - 0.0) * (x - 0.0) + (y - 0.05) * (y - 0.05) + (z + 0.05) * (z + 0.05) <= 0.15::DOUBLE * 0.15")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.within_radius(points(spark, sf_dir), CENTRE, RADIUS).select("id", "label")


def _box_sql() -> str:
    rad = [f"radians({a})" for a in BOX[6:]]
    sa, sb, sc = (f"sin({a})" for a in rad)
    ca, cb, cc = (f"cos({a})" for a in rad)
    r = [f"{cc}*{cb}", f"{cc}*{sb}*{sa}-{sc}*{ca}", f"{cc}*{sb}*{ca}+{sc}*{sa}", f"{sc}*{cb}", f"{sc}*{sb}*{sa}+{cc}*{ca}", f"{sc}*{sb}*{ca}-{cc}*{sa}", f"-{sb}", f"{cb}*{sa}", f"{cb}*{ca}"]
    return " AND ".join(f"abs(x * ({r[k]}) + y * ({r[3 + k]}) + z * ({r[6 + k]})) <= {BOX[3 + k] / 2}" for k in range(3))


@query(f"WITH {POINTS} SELECT id, label FROM p WHERE {_box_sql()}")
def within_obb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.within_box(points(spark, sf_dir), BOX).select("id", "label")


@query(f"WITH {POINTS} SELECT id, label FROM p WHERE " + " AND ".join(f"x * ({a}) + y * ({b}) + z * ({c}) <= {d}" for a, b, c, d in HULL))
def within_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.within_hull(points(spark, sf_dir), HULL).select("id", "label")


@query(f"WITH {POINTS} SELECT id, round(sqrt(d2), 6) AS distance FROM (SELECT id, (x - 0.0) * (x - 0.0) + (y - 0.05) * (y - 0.05) + (z + 0.05) * (z + 0.05) AS d2 FROM p) ORDER BY d2, id LIMIT 10")
def knn_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.nearest(points(spark, sf_dir), CENTRE, 10).select("id", "distance"), "distance")


@query(f"WITH {BOXES} SELECT a.id, o.id AS other FROM b a, b o WHERE a.id < o.id AND a.xmin <= o.xmax AND o.xmin <= a.xmax AND a.ymin <= o.ymax AND o.ymin <= a.ymax AND a.zmin <= o.zmax AND o.zmin <= a.zmax")
def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return select.overlapping_boxes(b, b, 4.0).where("id < other")


@query(f"WITH {BOXES} SELECT id FROM b WHERE cx BETWEEN 10 AND 40 AND cy BETWEEN 10 AND 40 AND cz BETWEEN 5 AND 15")
def box_centres_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("cx BETWEEN 10 AND 40 AND cy BETWEEN 10 AND 40 AND cz BETWEEN 5 AND 15").select("id")


@query(f"WITH {BOXES}, e AS (SELECT id, unnest([xmin, xmax]) AS x, ymin, ymax, zmin, zmax FROM b), f AS (SELECT id, x, unnest([ymin, ymax]) AS y, zmin, zmax FROM e), g AS (SELECT id, x, y, unnest([zmin, zmax]) AS z FROM f) SELECT DISTINCT id FROM g WHERE abs(x - 20) <= 10.25 AND abs(y - 20) <= 10.25 AND abs(z - 10) <= 5.25")
def box_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [F.lit(float(v)) for v in (20, 20, 10, 20, 20, 10, 0, 0, 0)]
    corners = G.aabb_corners(L.vec(*(F.col(f"{c}{s}") for c in "xyz" for s in ("min", "max"))))
    return boxes(spark, sf_dir).where(F.exists(corners, lambda p: G.obb_contains(box, [p[k] for k in range(3)], (0.5, 0.5, 0.5)))).select("id")


# voxels, octree, clusters


@query(f"WITH {POINTS} SELECT floor(x / 0.1)::BIGINT AS i, floor(y / 0.1)::BIGINT AS j, floor(z / 0.1)::BIGINT AS k, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM p GROUP BY 1, 2, 3")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(space.voxel_downsample(points(spark, sf_dir), 0.1), "x", "y", "z")


@query(f"WITH {POINTS}, c AS (SELECT floor(x / 0.2)::BIGINT AS i, floor(y / 0.2)::BIGINT AS j, floor(z / 0.2)::BIGINT AS k, label, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY n DESC, label) AS o FROM c) SELECT i, j, k, label, n FROM r WHERE o = 1")
def voxel_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.voxel_majority(points(spark, sf_dir), 0.2, "label")


def _morton_sql(depth: int) -> str:
    return " + ".join(f"(((({c}) >> {b}) & 1) << {3 * b + n})" for b in range(depth) for n, c in enumerate("ijk"))


@query(f"WITH {POINTS}, c AS (SELECT floor((x + 1) / 0.125)::BIGINT AS i, floor((y + 1) / 0.125)::BIGINT AS j, floor((z + 1) / 0.125)::BIGINT AS k FROM p), m AS (SELECT {_morton_sql(4)} AS leaf FROM c WHERE i BETWEEN 0 AND 15 AND j BETWEEN 0 AND 15 AND k BETWEEN 0 AND 15) SELECT l.level::INT AS level, leaf >> (3 * (4 - l.level)) AS node, count(*) AS n FROM m, (SELECT unnest([1, 2, 3, 4]) AS level) l GROUP BY 1, 2")
def octree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.octree_counts(points(spark, sf_dir), (-1.0, -1.0, -1.0), 2.0, 4)


@query(f"""WITH {POINTS}, c AS (SELECT floor((x + 1) / 0.125)::BIGINT AS i, floor((y + 1) / 0.125)::BIGINT AS j, floor((z + 1) / 0.125)::BIGINT AS k FROM p), m AS (SELECT {_morton_sql(4)} AS leaf FROM c WHERE i BETWEEN 0 AND 15 AND j BETWEEN 0 AND 15 AND k BETWEEN 0 AND 15),
n AS (SELECT l.level::INT AS level, leaf >> (3 * (4 - l.level)) AS node, count(*) AS n FROM m, (SELECT unnest([1, 2, 3, 4]) AS level) l GROUP BY 1, 2), f AS (SELECT * FROM n WHERE n > 2 AND n < 100)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f u WHERE u.level < f.level AND u.node = f.node >> (3 * (f.level - u.level)))""")
def octree_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.octree_split(points(spark, sf_dir), (-1.0, -1.0, -1.0), 2.0, 4, 2, 100)


@query(f"WITH {POINTS} SELECT least(floor((x + 0.4) / 0.2), 3)::BIGINT AS i, least(floor((y + 0.4) / 0.2), 3)::BIGINT AS j, least(floor((z + 0.4) / 0.4), 1)::BIGINT AS k, count(*) AS n FROM p WHERE x BETWEEN -0.4 AND 0.4 AND y BETWEEN -0.4 AND 0.4 AND z BETWEEN -0.4 AND 0.4 GROUP BY 1, 2, 3")
def subdivide_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.subdivide(points(spark, sf_dir), (-0.4, 0.4, -0.4, 0.4, -0.4, 0.4), (4, 4, 2)).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS} SELECT (z >= -0.1)::INT + (z >= 0.0)::INT + (z >= 0.1)::INT AS band, count(*) AS n FROM p GROUP BY 1")
def divide_per_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.by_height(points(spark, sf_dir), (-0.1, 0.0, 0.1)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query()
def dbscan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the whole cloud, too many for recursive SQL."""
    return space.dbscan(points(spark, sf_dir), 0.05, 4)


@query(f"""WITH {POINTS}, o AS (SELECT * FROM p WHERE label % 2 = 0), n AS (SELECT * FROM p WHERE label % 2 = 1),
i AS (SELECT *, x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.2 AND 0.2 AND z BETWEEN -0.2 AND 0.2 AS ins FROM o)
SELECT id, 'outside' AS origin FROM i WHERE NOT ins UNION ALL SELECT q.id, 'kept' FROM i q WHERE ins AND EXISTS (SELECT 1 FROM n r WHERE {D2} <= 0.03::DOUBLE * 0.03)
UNION ALL SELECT q.id, 'added' FROM n q WHERE NOT EXISTS (SELECT 1 FROM o r WHERE {D2} <= 0.03::DOUBLE * 0.03)""")
def combine_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return space.combine_epochs(p.where("label % 2 = 0"), p.where("label % 2 = 1"), (-0.2, 0.2, -0.2, 0.2, -0.2, 0.2), 0.03).select("id", "origin")


@query(f"WITH {POINTS} SELECT label, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, round(max(y), 6) AS ymax, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax FROM p GROUP BY label")
def set_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.bounds(points(spark, sf_dir), ["label"]), *(f"{c}{s}" for c in "xyz" for s in ("min", "max")))


# volumes, histograms, balances


@query(f"WITH {CELLS} SELECT element, round(sum(CASE WHEN abs(low) < 100 AND abs(high) < 100 AND abs(mesh) < 100 THEN greatest(0, least(mesh - low, high - low)) * 0.1::DOUBLE * 0.1::DOUBLE ELSE 0 END), 6) AS built FROM c GROUP BY element")
def volume_asbuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.built_volume(cells(spark, sf_dir), ["element"], "mesh", "low", "high", 0.1), "built")


@query(f"WITH {CELLS} SELECT element, round(sum(CASE WHEN abs(low) < 1000 AND abs(high) < 1000 THEN abs(high - low) * 0.1::DOUBLE * 0.1::DOUBLE ELSE 0 END), 6) AS \"full\" FROM c GROUP BY element")
def volume_theoretical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.full_volume(cells(spark, sf_dir), ["element"], "low", "high", 0.1), "full")


@query(f"""WITH {CELLS}, v AS (SELECT element, sum(greatest(0, least(mesh - low, high - low)) * 0.1::DOUBLE * 0.1::DOUBLE) AS b, sum(abs(high - low) * 0.1::DOUBLE * 0.1::DOUBLE) AS f FROM c GROUP BY element), r AS (SELECT element, b / nullif(f, 0) AS q FROM v)
SELECT element, round(q, 6) AS completion, CASE WHEN q >= 0.95 THEN 'green' WHEN q <= 0.25 THEN 'red' WHEN q <= 0.5 THEN 'amber' WHEN q < 0.95 THEN 'yellow' END AS color FROM r""")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    out = measures.completion(measures.built_volume(c, ["element"], "mesh", "low", "high", 0.1, None), measures.full_volume(c, ["element"], "low", "high", 0.1, None), ["element"])
    return rounded(out.select("element", "completion", "color"), "completion")


@query(f"WITH {CELLS}, g AS (SELECT element, count(*) AS n, avg((d <= 0.06)::INT) AS r10, avg((d <= 0.04)::INT) AS r20, avg((d <= 0.02)::INT) AS r30 FROM c WHERE d <= 0.08 GROUP BY element) SELECT element, n, round(r10, 6) AS r10, round(r20, 6) AS r20, round(r30, 6) AS r30, CASE WHEN r30 > 0.95 THEN 'LOA30' WHEN r20 > 0.95 THEN 'LOA20' WHEN r10 > 0.95 THEN 'LOA10' ELSE 'NO_LOA' END AS loa FROM g")
def loa_by_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.loa(cells(spark, sf_dir), ["element"], thresholds=(0.08, 0.06, 0.04, 0.02)), "r10", "r20", "r30")


@query(f"WITH {CELLS} SELECT floor(d / 0.003)::BIGINT AS bucket, count(*) AS n FROM c WHERE d <= 0.07 GROUP BY 1")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.histogram(cells(spark, sf_dir), "d", 0.003, 0.07)


@query("SELECT l_returnflag AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 2) AS share FROM lineitem GROUP BY 1")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.balance(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("class")), "class")


@query(f"WITH {POINTS} SELECT label, CASE WHEN z >= 0 THEN 'up' ELSE 'down' END AS half, count(*) AS n, round(avg(x), 6) AS x FROM p GROUP BY GROUPING SETS ((label, half), (label), ())")
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("half", F.when(F.col("z") >= 0, "up").otherwise("down"))
    out = p.groupingSets([["label", "half"], ["label"], []], "label", "half").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("x"))
    return out


@query(f"WITH {POINTS} SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM p GROUP BY label")
def mean_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.mean_pose(points(spark, sf_dir), ["label"]), "x", "y", "z")


# poses and cameras: a supplier is a camera turned about z


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    t = [(F.col("s_suppkey") % 13).cast("double"), (F.col("s_suppkey") % 7).cast("double"), F.lit(1.5)]
    return s.select(F.col("s_suppkey").alias("id"), L.mat4_from_euler((0.0, 0.0, F.col("s_nationkey") * 14.4), t).alias("t"), (F.col("s_nationkey") * 14.4).alias("yaw"), *(x.alias(c) for x, c in zip(t, "xyz", strict=True)))


POSES = "s AS (SELECT s_suppkey AS id, (s_suppkey % 13)::DOUBLE AS x, (s_suppkey % 7)::DOUBLE AS y, 1.5::DOUBLE AS z, radians(s_nationkey * 14.4::DOUBLE) AS a, s_nationkey * 14.4::DOUBLE AS yaw FROM supplier)"


def _entries(m: Column) -> list[Column]:
    return [r6(m[k]).alias(f"m{k:02d}") for k in range(12)]


@query(f"WITH {POSES} SELECT id, round(cos(a), 6) AS m00, round(-sin(a), 6) AS m01, 0.0::DOUBLE AS m02, x AS m03, round(sin(a), 6) AS m04, round(cos(a), 6) AS m05, 0.0::DOUBLE AS m06, y AS m07, 0.0::DOUBLE AS m08, 0.0::DOUBLE AS m09, 1.0::DOUBLE AS m10, z AS m11 FROM s")
def pose_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir)
    return p.select("id", *((F.col("t")[k] if k in (3, 7, 11) else r6(F.col("t")[k]) + 0.0).alias(f"m{k:02d}") for k in range(12)))


@query(f"WITH {POSES} SELECT id, round(cos(a) * 1 - sin(a) * 2 + x, 6) AS px, round(sin(a) * 1 + cos(a) * 2 + y, 6) AS py, 3 + z AS pz FROM s")
def transform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = L.mat4_apply(F.col("t"), L.vec(1, 2, 3))
    return poses(spark, sf_dir).select("id", r6(q[0]).alias("px"), r6(q[1]).alias("py"), q[2].alias("pz"))


@query(f"WITH {POSES} SELECT id, round(cos(a) * x - sin(a) * y + x, 6) AS px, round(sin(a) * x + cos(a) * y + y, 6) AS py, z + z AS pz, round(cos(2 * a), 6) AS c FROM s")
def compose_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = poses(spark, sf_dir).withColumn("m", L.mat4_mul(F.col("t"), F.col("t")))
    return m.select("id", r6(F.col("m")[3]).alias("px"), r6(F.col("m")[7]).alias("py"), F.col("m")[11].alias("pz"), r6(F.col("m")[0]).alias("c"))


@query(f"WITH {POSES}, d AS (SELECT p.id, q.id AS other, degrees(atan2(q.y - p.y, q.x - p.x)) AS b FROM s p JOIN s q ON q.id = p.id + 1) SELECT id, other, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing FROM d")
def bearing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir).select("id", "x", "y", "z")
    q = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"))
    return p.join(q, "id").select("id", "other", r6(L.bearing([F.col(c) for c in "xyz"], [F.col(f"o{c}") for c in "xyz"])).alias("bearing"))


@query(f"WITH {POINTS} SELECT id, round(1000.0::DOUBLE * x / (z + 2) + 960, 6) AS u, round(1000.0::DOUBLE * y / (z + 2) + 540, 6) AS v, round(z + 2, 6) AS depth FROM p")
def pinhole_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = L.mat4_of([F.lit(float(k in (0, 4, 8))) for k in range(9)], (0.0, 0.0, -2.0))
    rows = points(spark, sf_dir).withColumn("q", G.pinhole_project(pose, (F.lit(1000.0), F.lit(960.0), F.lit(540.0)), [F.col(c) for c in "xyz"]))
    return rows.select("id", r6(F.col("q")[0]).alias("u"), r6(F.col("q")[1]).alias("v"), r6(F.col("q")[2]).alias("depth"))


@query("SELECT p_partkey AS id, round(cos(v) * sin(u), 6) AS dx, round(-sin(v), 6) AS dy, round(cos(v) * cos(u), 6) AS dz FROM (SELECT p_partkey, (p_partkey % 100) / 99.0::DOUBLE * 2 * pi() - pi() AS u, (p_partkey % 50) / 49.0::DOUBLE * pi() - pi() / 2 AS v FROM part)")
def equirect_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.equirect_direction(F.col("p_partkey") % 100, F.col("p_partkey") % 50, F.lit(100), F.lit(50)).alias("d"))
    return d.select("id", *((r6(F.col("d")[k]) + 0.0).alias(f"d{c}") for k, c in enumerate("xyz")))


@query(f"WITH {POINTS} SELECT id, round(1024 - (y - 0.1::DOUBLE) / 0.01::DOUBLE, 6) AS row, round((x - 0.2::DOUBLE) / 0.01::DOUBLE + 1024, 6) AS col FROM p")
def ortho_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    pose = L.mat4_of([F.lit(float(k in (0, 4, 8))) for k in range(9)], (0.2, 0.1, 0.0))
    rows = points(spark, sf_dir).withColumn("q", G.ortho_project(pose, [F.col(c) for c in "xyz"], F.lit(0.01), F.lit(2048.0), F.lit(2048.0)))
    return rows.select("id", r6(F.col("q")[0]).alias("row"), r6(F.col("q")[1]).alias("col"))


@query("SELECT o_orderkey AS id, (o_orderkey % 256 + (o_custkey % 256) * 256 + (o_orderkey % 7) * 65536 + 0 * 16777216.0::DOUBLE) / 1000 AS depth FROM orders")
def depth_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), G.depth_from_rgba(F.col("o_orderkey") % 256, F.col("o_custkey") % 256, F.col("o_orderkey") % 7, F.lit(0)).alias("depth"))


# geodesy and literals


@query("SELECT c_custkey AS id, round(c_acctbal, 6) AS dd FROM customer")
def dms_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("p", X.dd_to_dms(F.abs("c_acctbal")))
    dd = X.dms_to_dd(F.col("p")[0], F.col("p")[1], F.col("p")[2], F.when(F.col("c_acctbal") < 0, "S").otherwise("N"))
    return c.select(F.col("c_custkey").alias("id"), r6(dd).alias("dd"))


@query("SELECT c_custkey AS id, round(100000 + (c_custkey % 1000) * 100.0::DOUBLE, 1) AS x, round(150000 + (c_custkey % 700) * 100.0::DOUBLE, 1) AS y FROM customer")
def lambert72_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("w", X.l72_to_wgs84(100000 + (F.col("c_custkey") % 1000) * 100.0, 150000 + (F.col("c_custkey") % 700) * 100.0))
    back = c.withColumn("l", X.wgs84_to_l72(F.col("w")[0], F.col("w")[1]))
    return back.select(F.col("c_custkey").alias("id"), F.round(F.round(F.col("l")[0] / 0.1, 0) * 0.1, 1).alias("x"), F.round(F.round(F.col("l")[1] / 0.1, 0) * 0.1, 1).alias("y"))


@query("SELECT p_partkey AS id, p_partkey::DOUBLE AS v0, p_size::DOUBLE AS v1, 0.5::DOUBLE AS v2, p_retailprice AS v3, 2 AS ncols FROM part")
def literal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("[["), F.col("p_partkey"), F.lit(" "), F.col("p_size"), F.lit("]\n [.5, "), F.format_string("%.10f", "p_retailprice"), F.lit("]]"))
    m = read(spark, sf_dir, "part").select("p_partkey", X.to_matrix(text).alias("m"))
    return m.select(F.col("p_partkey").alias("id"), *(F.col("m.values")[k].alias(f"v{k}") for k in range(4)), F.col("m.ncols").alias("ncols"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t FROM orders")
def literal_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    kinds = [F.date_format("o_orderdate", f) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")] + [F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")]
    text = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), X.datetime_text(X.to_datetime(text)).alias("t"))


@query("SELECT p_partkey AS id, 'file:///' || regexp_replace(p_name || ' ' || p_type || '#', '[^A-Za-z0-9_./\\\\-]', '_', 'g') AS name FROM part")
def validate_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.validate_string(F.concat(F.lit("file:///"), "p_name", F.lit(" "), "p_type", F.lit("#"))).alias("name"))


@query(f"WITH {TRIPLES} SELECT DISTINCT subject, regexp_extract(subject, '([^/#]*)$', 1) AS name FROM t")
def subject_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select("subject", X.subject_name(F.col("subject")).alias("name")).distinct()


@query("SELECT s_suppkey AS id, round(abs(degrees(atan2(3, 1 + s_nationkey) - atan2(1, 2))), 6) AS angle FROM supplier")
def angle_between_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [F.lit(0.0), F.lit(0.0), 1 + F.col("s_nationkey").cast("double"), F.lit(3.0)]
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), r6(L.angle_between_lines(a, [F.lit(x) for x in (0.0, 0.0, 2.0, 1.0)])).alias("angle"))


# generators


def _ray_grid(part: DataFrame) -> DataFrame:
    b = part.select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("xmin"), (F.col("p_size") / 10.0).alias("xmax"), F.lit(0.0).alias("ymin"), (F.col("p_size") / 20.0).alias("ymax"), F.lit(0.0).alias("zmin"), F.lit(1.0).alias("zmax"))
    return generate.vertical_rays(b, 0.5).select("id", F.col("ox").alias("x"), F.col("oy").alias("y"))


@query("SELECT p_partkey AS id, i * 0.5::DOUBLE AS x, j * 0.5::DOUBLE AS y FROM (SELECT p_partkey, greatest(ceil(round((p_size / 10.0::DOUBLE) / 0.5, 9)), 1)::BIGINT AS nx, greatest(ceil(round((p_size / 20.0::DOUBLE) / 0.5, 9)), 1)::BIGINT AS ny FROM part), unnest(range(nx)) a(i), unnest(range(ny)) b(j)")
def xy_ray_grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rays of every part."""
    return _ray_grid(read(spark, sf_dir, "part"))


@query("SELECT p_partkey AS id, s, round(p_size * (s / n::DOUBLE), 6) AS x FROM (SELECT p_partkey, p_size, floor(p_size::DOUBLE / 3)::BIGINT AS n FROM part), generate_series(0, 20) g(s) WHERE n >= 1 AND s <= n")
def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.lit(0.0).alias(f"{c}0") for c in "xyz"), F.col("p_size").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("z1"))
    return rounded(generate.sample_lines(lines, 3.0).select("id", "s", "x"), "x")


@query("SELECT p_partkey AS id, r AS row, c AS col, least((c + 1) * 3, p_size)::BIGINT AS x1 FROM part, generate_series(0, 20) a(r), generate_series(0, 20) b(c) WHERE r < ceil(p_size / 5.0) AND c < ceil(p_size / 3.0)")
def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("image_width"), F.col("p_size").alias("image_height"))
    return generate.tiles(images, 3, 5).select("id", "row", "col", F.col("x1").cast("long").alias("x1"))


@query(f"""WITH {BOXES}, g AS (SELECT row_number() OVER () AS o, i, j FROM generate_series(0, 24) a(i), generate_series(0, 22) c(j)), h AS (SELECT i * 100 + j AS ray_id, b.id AS subject, 40 - zmax AS t FROM g, b WHERE i * 4 + 0.37::DOUBLE BETWEEN xmin AND xmax AND j * 4 + 0.21::DOUBLE BETWEEN ymin AND ymax)
SELECT ray_id, arg_min(subject, (t, subject)) AS subject, round(min(t), 6) AS t FROM h GROUP BY ray_id""")
def ray_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    corner = lambda x, y: [F.col(f"x{x}"), F.col(f"y{y}"), F.col("zmax")]
    quads = [(corner("min", "min"), corner("max", "min"), corner("max", "max")), (corner("min", "min"), corner("max", "max"), corner("min", "max"))]
    faces = F.array(*(F.struct(F.lit(k).alias("fid"), *(x.alias(f"{v}{c}") for v, p in zip("abc", t, strict=True) for x, c in zip(p, "xyz", strict=True))) for k, t in enumerate(quads)))
    triangles = b.select(F.col("id").alias("subject"), F.explode(faces).alias("f")).select("subject", "f.*")
    rays = spark.range(25).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(22)))).select((F.col("i") * 100 + F.col("j")).alias("ray_id"), (F.col("i") * 4 + 0.37).alias("ox"), (F.col("j") * 4 + 0.21).alias("oy"), F.lit(40.0).alias("oz"), F.lit(-1.0).alias("dz"))
    return rounded(joins.cast_vertical(rays, triangles, 4.0).select("ray_id", "subject", "t"), "t")


# linked data and ordered rows


@query(f"WITH {TRIPLES} SELECT * FROM t")
def nodes_to_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).select(*rdf.SPO)


@query(f"WITH {TRIPLES} SELECT subject, min(CASE WHEN predicate = 'type' THEN object END) AS type, min(CASE WHEN predicate = 'label' THEN object END) AS label, min(CASE WHEN predicate = 'isPartOf' THEN object END) AS part FROM t GROUP BY subject")
def triples_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.from_triples(triples(spark, sf_dir), {"type": "type", "label": "label", "part": "isPartOf"})


@query(f"WITH {TRIPLES}, a AS (SELECT * FROM t WHERE subject NOT LIKE '%1'), b AS (SELECT * FROM t WHERE subject NOT LIKE '%2'), i AS (SELECT subject FROM a WHERE predicate = 'type' INTERSECT SELECT subject FROM b WHERE predicate = 'type') SELECT DISTINCT * FROM t WHERE subject IN (SELECT subject FROM i)")
def graph_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    return rdf.graph_intersection([t.where("subject NOT LIKE '%1'"), t.where("subject NOT LIKE '%2'")])


@query(f"WITH {TRIPLES} SELECT a.subject AS s, b.object AS p, l.object AS name FROM t a JOIN t b ON a.subject = b.subject AND b.predicate = 'isPartOf' LEFT JOIN t l ON l.subject = a.subject AND l.predicate = 'label' WHERE a.predicate = 'type' AND a.object = 'Supplier'")
def sparql_bgp_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.match(triples(spark, sf_dir), [("?s", "type", "Supplier"), ("?s", "isPartOf", "?p")], [("?s", "label", "?name")]).select("s", "p", "name")


@query(f"WITH {TRIPLES} SELECT * FROM t WHERE subject = 'nation/3'")
def subject_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.subject_graph(triples(spark, sf_dir), "nation/3").select(*rdf.SPO)


@query("SELECT o_orderkey AS id, ntile(7) OVER (ORDER BY o_orderkey)::INT AS chunk FROM orders")
def ntile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.chunks(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), ["id"], 7)


@query("SELECT id, c FROM (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders) WHERE nth % 3 = 0")
def skip_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.every_nth(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c")), ["c"], ["id"], 3)


# hulls, normals, rasters, colours


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("label").cast("string").alias("subject"), "id", "x", "y", "z")


@query()
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.hulls(labelled(spark, sf_dir)).select("subject", F.size("vertices").alias("n"), r6("volume").alias("volume"))


@query()
def oriented_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.oriented_boxes(labelled(spark, sf_dir)).select("subject", F.transform("box", lambda v: F.round(v, 6)).alias("box"))


@query()
def point_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.normals(points(spark, sf_dir), 0.1), "nx", "ny", "nz")


@query("SELECT DISTINCT s AS subject, least(u, v) AS u, greatest(u, v) AS v FROM (SELECT p_size AS s, unnest([p_partkey % 50, p_partkey % 31 + 50, p_partkey % 17 + 90]) AS u, unnest([p_partkey % 31 + 50, p_partkey % 17 + 90, p_partkey % 50]) AS v FROM part)")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return generate.mesh_edges(read(spark, sf_dir, "part").select(F.col("p_size").alias("subject"), (k % 50).alias("a"), (k % 31 + 50).alias("b"), (k % 17 + 90).alias("c")))


PIXELS = "px AS (SELECT p_size AS subject, (p_partkey // 40)::BIGINT AS row, p_partkey % 40 AS col, (p_partkey * 7 % 11) % 3 AS value FROM part)"


@query(f"""WITH {PIXELS}, w AS (SELECT a.subject, a.row, a.col, b.value, count(*) AS n FROM px a JOIN px b ON a.subject = b.subject AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)
SELECT subject, row, col, arg_min(value, (-n, value)) AS value FROM w GROUP BY subject, row, col""")
def majority_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    px = read(spark, sf_dir, "part").select(F.col("p_size").alias("subject"), F.floor(k / 40).alias("row"), (k % 40).alias("col"), (k * 7 % 11 % 3).alias("value"))
    return raster.majority(px)


@query("SELECT l_suppkey AS subject, (l_orderkey % 32)::INT AS row, (l_partkey % 64)::INT AS col, min(l_quantity) AS depth, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS value FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 15 GROUP BY ALL")
def depth_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_partkey") % 64 + 0.5).alias("u"), (F.col("l_orderkey") % 32 + 0.25).alias("v"), F.col("l_quantity").alias("depth"), F.col("l_linenumber").alias("value"))
    return raster.splat(li)


@query("SELECT o_orderkey AS id, round((o_orderkey % 640 - 320.0::DOUBLE) / 500 * (o_custkey % 50 / 10.0), 6) AS x, round((o_orderkey % 480 - 240.0::DOUBLE) / 500 * (o_custkey % 50 / 10.0), 6) AS y, round(o_custkey % 50 / 10.0::DOUBLE, 6) AS z FROM orders WHERE o_custkey % 50 > 0")
def depth_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    px = read(spark, sf_dir, "orders").select(k.alias("id"), (k % 640).alias("col"), (k % 480).alias("row"), (F.col("o_custkey") % 50 / 10.0).alias("depth"))
    return rounded(raster.depth_points(px, 500.0, 320.0, 240.0).select("id", "x", "y", "z"), "x", "y", "z")


@query("SELECT p_partkey AS id, CASE WHEN abs(p_size / 50.0::DOUBLE - 0.1) <= 0.01 THEN 0 WHEN abs(p_size / 50.0::DOUBLE - 0.5) <= 0.01 THEN 1 WHEN abs(p_size / 50.0::DOUBLE - 0.9) <= 0.01 THEN 2 END::INT AS mask FROM part")
def color_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("value"))
    return raster.masks(px, [0.1, 0.5, 0.9]).select("id", "mask")


@query("SELECT s_suppkey AS id, [[0,0,0],[255,0,0],[255,255,0],[0,255,0],[0,255,255],[0,0,255],[255,0,255],[255,255,255],[65,65,65],[128,128,128]][(s_suppkey % 10 + 1)::INT][1]::DOUBLE AS r, [[0,0,0],[255,0,0],[255,255,0],[0,255,0],[0,255,255],[0,0,255],[255,0,255],[255,255,255],[65,65,65],[128,128,128]][(s_suppkey % 10 + 1)::INT][3]::DOUBLE AS b FROM supplier")
def aci_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "supplier").withColumn("c", X.aci_rgb(F.col("s_suppkey") % 10))
    return c.select(F.col("s_suppkey").alias("id"), F.col("c")[0].alias("r"), F.col("c")[2].alias("b"))


@query("""WITH RECURSIVE i AS (SELECT o_custkey % 20 AS flight, o_orderkey AS image, (o_orderkey % 100)::DOUBLE AS x, (o_custkey % 100)::DOUBLE AS y, o_totalprice / 10000 AS z FROM orders),
w AS (SELECT flight, avg(z) * 2 * tan(radians(47.0)) * 0.5 AS least FROM i GROUP BY flight),
n AS (SELECT i.*, least, row_number() OVER (PARTITION BY flight ORDER BY image) AS k FROM i JOIN w USING (flight)),
s(flight, k, image, x, y, kept) AS (SELECT flight, k, image, x, y, TRUE FROM n WHERE k = 1 UNION ALL
  SELECT flight, k, image, CASE WHEN far THEN x ELSE lx END, CASE WHEN far THEN y ELSE ly END, far FROM (
    SELECT n.flight, n.k, n.image, n.x, n.y, s.x AS lx, s.y AS ly, sqrt((n.x - s.x) * (n.x - s.x) + (n.y - s.y) * (n.y - s.y)) > least AS far FROM s JOIN n ON n.flight = s.flight AND n.k = s.k + 1))
SELECT flight, image FROM s WHERE kept""")
def image_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    images = o.select((F.col("o_custkey") % 20).alias("flight"), F.col("o_orderkey").alias("image"), (F.col("o_orderkey") % 100).cast("double").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"), (F.col("o_totalprice") / 10_000).alias("z"))
    return select.thin_by_overlap(images, "flight", "image", 0.0, 0.5)


@query("SELECT p_partkey AS id, CASE WHEN h >= 24 THEN 4 WHEN h >= 12 THEN 3 WHEN h >= 6 THEN 2 ELSE 1 END::INT AS bucket FROM (SELECT p_partkey, p_size::DOUBLE AS h FROM part)")
def color_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("z"))
    return space.by_height(p, (6.0, 12.0, 24.0)).select("id", (F.col("band") + 1).alias("bucket"))


@query(
    """SELECT doc_id AS id, CASE WHEN text NOT LIKE '%None%' THEN len(list_filter(regexp_split_to_array(regexp_replace(text, '[\\[\\](){}''\"]', ' ', 'g'), '[\\s,;]+'), lambda x: x <> '')) END AS n FROM documents"""
)
def literal_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, null where its text is null or stands for none."""
    tokens = X.to_list(F.col("text"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(tokens.isNotNull(), F.size(tokens)).cast("long").alias("n"))


@query("SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END * (user_id % 90 + (user_id % 60) / 60.0::DOUBLE) AS dd FROM events")
def gps_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    text = F.concat(F.lit("["), u % 90, F.lit(", "), u % 60, F.lit(", 0, "), F.when(u % 2 == 0, "N").otherwise("S"), F.lit("]"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.parse_dms(text).alias("dd"))


@query("SELECT n_nationkey AS id, 0.4::DOUBLE * (n_nationkey % 5) / 4 + 0.6::DOUBLE * (n_nationkey % 3) / 2 AS confidence FROM nation")
def pose_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5 / 4.0).alias("error"), (F.col("n_nationkey") % 3 / 2.0).alias("amount"))
    return n.select("id", measures.pose_confidence({"error": 0.4, "amount": 0.6}).alias("confidence"))


# nodes, classes, lines


@query("WITH f AS (SELECT p_size AS s, p_partkey AS fid, [p_partkey % 40, p_partkey % 41, p_partkey % 43] AS c FROM part), e AS (SELECT s, fid, unnest(c) AS v FROM f) SELECT s AS subject, fid FROM e WHERE v % 10 BETWEEN 2 AND 7 AND v % 7 BETWEEN 1 AND 5 GROUP BY s, fid HAVING count(*) >= 2")
def crop_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    faces = read(spark, sf_dir, "part").select(F.col("p_size").alias("subject"), k.alias("fid"), (k % 40).alias("a"), (k % 41).alias("b"), (k % 43).alias("c"))
    vertices = faces.select("subject").distinct().withColumn("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(42).cast("long")))).withColumns({"x": F.col("pid") % 10, "y": F.col("pid") % 7, "z": F.lit(0)})
    return nodes.crop_faces(faces, vertices, F.col("x").between(2, 7) & F.col("y").between(1, 5), 2).select("subject", "fid")


@query(f"WITH {POINTS}, b AS (SELECT id, CASE WHEN x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1 THEN 0 WHEN x BETWEEN -0.2 AND 0.3 AND y BETWEEN -0.2 AND 0.3 AND z BETWEEN -0.2 AND 0.3 THEN 1 END::INT AS box FROM p) SELECT * FROM b WHERE box IS NOT NULL")
def crop_by_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.first_box(points(spark, sf_dir), [(-0.1, 0.1) * 3, (-0.2, 0.3) * 3]).select("id", "box")


@query("SELECT DISTINCT p_partkey AS id FROM part, generate_series(0, 60) g(s) WHERE floor(p_size::DOUBLE) >= 1 AND s <= floor(p_size::DOUBLE) AND p_size * (s / floor(p_size::DOUBLE)) BETWEEN 9.5 AND 11.5")
def lines_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.lit(0.0).alias(f"{c}0") for c in "xyz"), F.col("p_size").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("z1"))
    return nodes.lines_in_box(lines, (9.5, 11.5, -1, 1, -1, 1), 1.0).select("id")


@query("""WITH g AS (SELECT p_size AS subject, (p_partkey // 40)::BIGINT AS row, p_partkey % 40 AS col, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS depth FROM part)
SELECT a.subject, a.row, a.col, CASE WHEN NOT EXISTS (SELECT 1 FROM g b WHERE b.subject = a.subject AND b.depth IS NULL AND abs(b.row - a.row) <= 3 AND abs(b.col - a.col) <= 3) THEN a.depth END AS depth FROM g a""")
def remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    g = read(spark, sf_dir, "part").select(F.col("p_size").alias("subject"), F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.when(k % 9 > 0, F.col("p_retailprice")).alias("depth"))
    return nodes.without_edges(g, 3)


@query("SELECT o_orderkey AS id, round((o_totalprice - min(o_totalprice) OVER w) / nullif(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 0), 6) AS gray FROM orders WINDOW w AS (PARTITION BY o_custkey % 50)")
def intensity_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("g"), "o_totalprice")
    return rounded(nodes.scaled(o, "o_totalprice", ["g"], "gray").select("id", "gray"), "gray")


@query("SELECT p_partkey AS id, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS number FROM part")
def value_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.numbered_values(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "p_brand").select("id", "number")


@query("SELECT c AS test, o AS ref, rank FROM (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test"), F.col("o_orderkey").alias("ref"), "o_totalprice")
    return nodes.best_matches(o, "test", "o_totalprice", 2, "ref").select("test", "ref", "rank")


@query("SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 30 WHEN 'MACHINERY' THEN 10 ELSE 20 END::INT AS loa FROM customer")
def loa_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("BUILDING", 30), ("MACHINERY", 10), ("OTHER", 20)], "c_mktsegment string, loa int")
    return nodes.with_class(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), classes, "c_mktsegment", "OTHER").select("id", "loa")


@query("""WITH l AS (SELECT s_suppkey AS id, 1.0::DOUBLE + s_nationkey AS x1, 3.0::DOUBLE AS y1 FROM supplier), c AS (SELECT id, x1 * 2 - y1 * 5 AS det, (1 * 2 - 2.0::DOUBLE * 5) / nullif(x1 * 2 - y1 * 5, 0) AS s, x1, y1 FROM l)
SELECT id, round(CASE WHEN abs(det) < 1e-12 THEN sqrt(5.0::DOUBLE) ELSE least(sqrt(s * x1 * s * x1 + s * y1 * s * y1), sqrt((s * x1 - 1) * (s * x1 - 1) + (s * y1 - 2) * (s * y1 - 2))) END, 6) AS d FROM c""")
def perpendicular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [F.lit(0.0), F.lit(0.0), 1.0 + F.col("s_nationkey"), F.lit(3.0)]
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), r6(nodes.perpendicular_distance(a, [F.lit(x) for x in (1.0, 2.0, 6.0, 4.0)])).alias("d"))


@query(f"WITH {POINTS}, g AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(x) - min(x) AS ex, max(z) - min(z) AS ez FROM p GROUP BY label) SELECT label::VARCHAR AS subject, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(ex, 6) AS ex, round(ez, 6) AS ez FROM g")
def complete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir)
    bare = p.select("subject").distinct().withColumns({"t": F.lit(None).cast("array<double>"), "box": F.lit(None).cast("array<double>"), "hull": F.lit(None).cast("array<array<double>>")})
    n = nodes.complete(bare, p)
    return n.select("subject", *(r6(F.col("t")[k]).alias(c) for k, c in ((3, "x"), (7, "y"), (11, "z"))), r6(F.col("box")[3]).alias("ex"), r6(F.col("box")[5]).alias("ez"))


@query(f"WITH {POSES} SELECT id, round(-y + 5, 6) AS x, round(x + 6, 6) AS y, round(z + 7, 6) AS z FROM s")
def transform_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = poses(spark, sf_dir).select("id", "x", "y", "z").withColumns({"qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0), "qw": F.lit(1.0)})
    half = 0.5**0.5
    return rounded(nodes.move_poses(p, (0, 0, half, half), (5, 6, 7)).select("id", "x", "y", "z"), "x", "y", "z")
