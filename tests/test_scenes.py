"""Rays, meshes, projections, registration, ontologies and groups against brute force and closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.functions import literals as X
from geoweft.functions import sql
from geoweft.operators import generate, groups, joins, kernels, ontology, project, rays, registration, select, space
from geoweft.operators import triples as rdf
from geoweft.streaming import accuracy

CORNERS = [f"{v}{c}" for v in "abc" for c in "xyz"]


def triangles(spark, t, subject="m"):
    return spark.createDataFrame([(subject if isinstance(subject, str) else subject[k], k, *map(float, x.ravel())) for k, x in enumerate(t)], "subject string, fid long, " + ", ".join(f"{c} double" for c in CORNERS))


def boxed(spark, *boxes):
    df = spark.createDataFrame([(f"b{k}", [float(x) for x in b]) for k, b in enumerate(boxes)], "subject string, box array<double>")
    return generate.box_triangles(df)


def brute_hit(o, d, tri):
    best = (math.inf, None)
    for k, (a, b, c) in enumerate(tri):
        m = np.stack([b - a, c - a, -d], 1)
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        u, v, t = np.linalg.solve(m, o - a)
        if u >= 0 and v >= 0 and u + v <= 1 and t >= 0:
            best = min(best, (t, k))
    return best


def test_rays_in_any_direction(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(-4, 4, (60, 1, 3)) + rng.uniform(-1.5, 1.5, (60, 3, 3))
    o, d = rng.uniform(-9, 9, (80, 3)), rng.standard_normal((80, 3))
    d[:6] = np.concatenate([np.eye(3), -np.eye(3)])
    o[:6] = t.mean((0, 1)) - 9 * d[:6] + rng.uniform(-1, 1, (6, 3))
    want = {k: brute_hit(o[k], d[k], t) for k in range(80)}
    df = spark.createDataFrame([(k, *map(float, (*o[k], *d[k]))) for k in range(80)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    for cell in (0.7, 3.0):
        got = {r.ray_id: (r.t, r.fid) for r in rays.first_hits(df, triangles(spark, t), cell).collect()}
        assert set(got) == {k for k, (x, _) in want.items() if x < math.inf} and len(got) > 5
        assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)
    near = df.withColumn("reach", F.lit(2.0))
    assert {r.ray_id for r in rays.first_hits(near, triangles(spark, t), 1.0).collect()} == {k for k, (x, _) in want.items() if x <= 2}
    assert rays.first_hits(df, triangles(spark, t).limit(0), 1.0).count() == 0
    assert {(r.fid, round(r.t, 9)) for r in rays.hit_faces(df, triangles(spark, t), 2.0).collect()} == {(f, round(min(x for x, g in want.values() if g == f), 9)) for _, f in want.values() if f is not None}


def test_scene_distances_and_own_hits(spark):
    mesh = boxed(spark, (0, 0, 0, 2, 2, 2, 0, 0, 0), (0, 0, 5, 2, 2, 2, 0, 0, 0))
    down = spark.createDataFrame([(1, "b0", 0.1, 0.2, 9.0, 0.0, 0.0, -1.0), (2, "b1", 5.0, 5.0, 9.0, 0.0, 0.0, -1.0)], "ray_id long, subject string, ox double, oy double, oz double, dx double, dy double, dz double")
    rows = {r.ray_id: (r.b0, r.b1) for r in rays.scene_distances(down, mesh, ["b0", "b1"], 1.5).collect()}
    assert rows == {1: (8.0, 3.0), 2: (None, None)}
    assert [(r.ray_id, r.subject, r.t) for r in rays.own_hits(down, mesh, 1.5).collect()] == [(1, "b0", 8.0)]
    lines = {r.ray_id: (r.z0, r.z1) for r in rays.segments(down.join(rays.first_hits(down, mesh, 1.5).select("ray_id", "t"), "ray_id", "left"), F.col("t")).collect()}
    assert lines == {1: (9.0, 6.0), 2: (9.0, -41.0)}
    ends = {r.ray_id: r.z for r in rays.ends(down, 2.0).collect()}
    assert ends == {1: 7.0, 2: 7.0}
    regions = down.withColumn("region", F.lit("r"))
    assert rays.selection_boxes(regions, mesh, 1.5).count() == 0
    (b,) = rays.selection_boxes(regions.where("ray_id = 1"), mesh, 1.5, z=2.0).collect()
    assert (b.zmin, b.zmax, b.xmin) == (4.0, 8.0, 0.1)


def test_inside_and_crops(spark):
    mesh = boxed(spark, (0, 0, 0, 2, 2, 2, 20, 30, 40), (10, 0, 0, 1, 1, 1, 0, 0, 0))
    r = np.random.default_rng(2).uniform(-2, 2, (300, 3))
    pts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(r)] + [(900, 10.2, 0.1, 0.1)], "id long, x double, y double, z double")
    a, b, c = np.radians((20, 30, 40))
    rx = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    ry = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    rz = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    inside = {k for k, p in enumerate(r) if (np.abs((rz @ ry @ rx).T @ p) < 1).all()}
    got = {(x.id, x.subject) for x in rays.inside_meshes(pts, mesh, 0.8).collect()}
    assert got == {(k, "b0") for k in inside} | {(900, "b1")} and len(inside) > 20
    assert rays.invisible_points(pts, mesh, 0.8).count() == len(inside) + 1
    order = spark.createDataFrame([("b0", 1), ("b1", 0)], "subject string, rank int")
    assert {x.id for x in rays.split_by_meshes(pts, mesh, order, 0.8).where("mesh = 'b1'").collect()} == {900}
    v = spark.createDataFrame([("m", k, x, 0.0, 0.0) for k, x in enumerate((0.0, 0.1, 5.0, 0.2))], "subject string, pid long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 3), ("m", 1, 0, 1, 2), ("m", 2, 2, 2, 0)], "subject string, fid long, a long, b long, c long")
    kept = lambda **k: {x.fid for x in rays.crop_faces_by_meshes(f, v, mesh, 0.8, **k).collect()}
    assert (kept(), kept(strict=False), kept(inside=False, strict=False), kept(inside=False)) == ({0}, {0, 1}, {2}, set())


def test_visibility_and_depth(spark):
    wall = boxed(spark, (0, 0, 5, 4, 4, 0.5, 0, 0, 0))
    pts = spark.createDataFrame([(1, 0.0, 0.1, 9.0), (2, 0.1, 0.0, 4.0), (3, 9.0, 0.0, 9.0), (4, 0.05, 0.02, 4.75)], "id long, x double, y double, z double")
    assert {r.id for r in rays.visible(pts, (0.01, 0.02, 0.0), wall, 1.0).collect()} == {2, 3, 4}
    cam = spark.createDataFrame([("c", list(map(float, np.eye(4).ravel())), 10.0, 8.0, 6.0, 16, 12)], "camera string, t array<double>, focal double, cu double, cv double, width int, height int")
    image = rays.depth_images(cam, wall, 1.0).collect()
    assert {r.depth for r in image} == {4.75} and len(image) == 8 * 8 and min(r.row for r in image) == 2 and max(r.col for r in image) == 11
    assert rays.pixel_rays(cam, 0.5).count() == 8 * 6
    bounds = spark.createDataFrame([("w", -1.0, 1.0, -1.0, 1.0, 4.0, 6.0)], "subject string, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    top = rays.top_faces(bounds, wall, 0.3, 1.0)
    z = wall.join(top, ["subject", "fid"], "left_semi").collect()
    assert len(z) == 2 and all(r.az == r.bz == r.cz == 5.25 for r in z)
    centre = rays.face_centres(wall).groupBy("subject").agg(F.avg("z").alias("z")).first()
    assert centre.z == pytest.approx(5)


def test_collisions_and_clipping(spark):
    a, b = boxed(spark, (0, 0, 0, 2, 2, 2, 0, 0, 0)), boxed(spark, (1.5, 0.2, 0.1, 2, 2, 2, 10, 20, 30), (9, 0, 0, 1, 1, 1, 0, 0, 0), (0.1, 0, 0, 0.5, 0.5, 0.5, 0, 0, 0)).withColumn("subject", F.concat(F.lit("o"), "subject"))
    assert {r.other for r in rays.collisions(a, b, 1.0).collect()} == {"ob0"}
    assert {r.other for r in rays.hull_collisions(a, b, 1.0).collect()} == {"ob0", "ob2"}
    t = np.array([[[0, 0, 0], [4, 0, 0], [0, 4, 0]]], float)
    planes = [(1, 0, 0, 1), (-1, 0, 0, 1), (0, 1, 0, 1), (0, -1, 0, 1)]
    area = lambda df: sum(np.linalg.norm(np.cross(q[1] - q[0], q[2] - q[0])) / 2 for q in (np.array([r[c] for c in CORNERS]).reshape(3, 3) for r in df.collect()))
    assert area(rays.clipped_faces(triangles(spark, t), planes)) == pytest.approx(1) and area(rays.clipped_faces(triangles(spark, t), planes, inside=False)) == pytest.approx(7)


def test_projected_lines(spark):
    image = spark.createDataFrame([("i", list(map(float, np.eye(4).ravel())), 10.0, 8.0, 6.0, 16, 12, 0.5)], "image string, t array<double>, focal double, cu double, cv double, width int, height int, gsd double")
    lines = spark.createDataFrame([(1, -1.0, 0.0, 5.0, 1.0, 0.5, 5.0), (2, 0.0, 0.0, 5.0, 99.0, 0.0, 5.0), (3, 0.0, 0.0, -5.0, 0.1, 0.0, -5.0)], "line int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    (r,) = project.lines_on_images(lines, image).collect()
    assert tuple(r) == ("i", 1, 6.0, 6.0, 10.0, 7.0)
    assert {x.line for x in project.lines_on_images(lines, image, project.ortho).collect()} == {1, 3} and {x.line for x in project.lines_on_images(lines, image, project.panorama).collect()} == {1, 2, 3}
    px = {(x.row, x.col) for x in project.draw(project.lines_on_images(lines, image), 1).collect()}
    assert (6, 6) in px and (7, 10) in px and len(px) == 5
    square = spark.createDataFrame([("i", 2.0, 3.0, 6.0, 3.0), ("i", 6.0, 3.0, 6.0, 5.0), ("i", 6.0, 5.0, 2.0, 5.0), ("i", 2.0, 5.0, 2.0, 3.0)], "image string, u0 double, v0 double, u1 double, v1 double")
    mask = project.mask_pixels(project.outline_mask(square))
    assert {(x.row, x.col) for x in mask.collect()} == set(itertools.product((3, 4), range(2, 6)))
    pixels = spark.createDataFrame([("i", r, c, 10 * r + c) for r in range(8) for c in range(8)], "image string, row int, col int, value int")
    assert {(x.row, x.col): x.value for x in project.crop_to_mask(pixels, mask).collect()} == {(r, c): 10 * (r + 3) + c + 2 for r in range(2) for c in range(4)}


def test_frames(spark):
    pose, pyramid, shuffled, box = (F.col(c) for c in ("pose", "p", "q", "box"))
    rows = spark.range(1).select(L.mat4_from_euler((10, 20, 30), (1, 2, 3)).alias("pose"), L.vec(1, 2, 3, 4, 5, 6, 0, 0, 90).alias("box"))
    rows = rows.withColumn("p", project.sensor_frustum(pose, F.lit(400.0), F.lit(300.0), F.lit(18.0), F.lit(2.0))).withColumn("q", F.array(*(F.get(F.col("p"), F.lit(k)) for k in (3, 1, 0, 4, 2))))
    r = rows.select("pose", project.pose_of_pyramid(shuffled).alias("t"), pyramid.alias("p"), project.backface_pose(box).alias("b"), project.ortho_box(L.identity(), F.lit(10), F.lit(20), F.lit(0.5), F.lit(4.0)).alias("o"), project.frustum_lines(pyramid).alias("l"), project.panorama_sphere(pose, F.lit(2.0)).alias("s"), project.pose_of_pyramid(F.array(*[L.vec(0, 0, 0)] * 5)).alias("none")).first()
    assert [r.t[k] for k in (2, 6, 10, 3, 7, 11)] == pytest.approx([r.pose[k] for k in (2, 6, 10, 3, 7, 11)]) and np.allclose(np.array(r.t).reshape(4, 4)[:3, :3] @ np.array(r.t).reshape(4, 4)[:3, :3].T, np.eye(3)) and r.none is None
    assert np.linalg.norm(np.subtract(r.p[1], r.p[2])) == pytest.approx(4) and np.linalg.norm(np.subtract(r.p[2], r.p[3])) == pytest.approx(3) and len(r.l) == 8
    assert [r.b[k] for k in (3, 7, 11)] == pytest.approx([1, 2, 0]) and r.o == pytest.approx([0, 0, 2, 5, 10, 4, 0, 0, 0]) and all(np.linalg.norm(np.subtract(v, (1, 2, 3))) == pytest.approx(2) for v in r.s)
    image = spark.createDataFrame([("i", list(map(float, np.eye(4).ravel())), 10.0, 8.0, 6.0, 16, 12, 0.5)], "image string, t array<double>, focal double, cu double, cv double, width int, height int, gsd double")
    px = spark.createDataFrame([("i", 6, 8), ("i", 6, 18)], "image string, row int, col int")
    a, b = (f(image, px).orderBy("col").collect() for f in (project.ortho_rays, project.pinhole_rays))
    assert [(x.ox, x.oy, x.dz) for x in a] == [(0, 0, 1), (5, 0, 1)] and (b[1].dx, b[1].dz) == pytest.approx((0.5**0.5, 0.5**0.5))


def test_meshes_of_boxes_and_joins(spark):
    b = boxed(spark, (0, 0, 0, 1, 2, 3, 10, 20, 30)).toPandas()[CORNERS].to_numpy()
    assert (b[:, :3] * np.cross(b[:, 3:6], b[:, 6:])).sum() / 6 == pytest.approx(6)
    v = spark.createDataFrame([("g", "a", 0, 0.0), ("g", "a", 1, 1.0), ("g", "b", 0, 5.0), ("g", "b", 1, 6.0)], "grp string, subject string, pid long, x double")
    f = spark.createDataFrame([("g", "a", 0, 0, 1, 0), ("g", "b", 0, 1, 0, 1)], "grp string, subject string, fid long, a long, b long, c long")
    jv, jf = generate.joined_meshes(v, f, "grp")
    assert {(r.subject, r.pid): r.x for r in jv.collect()} == {("g", 0): 0, ("g", 1): 1, ("g", 2): 5, ("g", 3): 6} and {(r.fid, r.a, r.b) for r in jf.collect()} == {(0, 0, 1), (1, 3, 2)}
    cloud = generate.identity_points(boxed(spark, (0, 0, 0, 4, 4, 4, 0, 0, 0)), 1.0)
    cells = cloud.select(*(F.floor(c).alias(c) for c in "xyz"))
    assert 70 < cloud.count() == cells.distinct().count()
    r = spark.range(1).select(generate.homogeneous(L.vec(2, 4, 6)).alias("a"), generate.homogeneous(L.vec(2, 4, 6, 2)).alias("b"), F.size(generate.as_points(L.vec(0, 1, 0, 1, 0, 1))).alias("n")).first()
    assert (r.a, r.b, r.n) == ([2, 4, 6, 1], [1, 2, 3, 1], 8)


def test_nearest_join_far_away(spark):
    rng = np.random.default_rng(7)
    q = np.concatenate([rng.uniform(0, 1, (60, 3)), rng.uniform(50, 200, (40, 3)), [[-3000, 10, 5], [0, 0, 0]]])
    r = np.concatenate([rng.uniform(0, 1, (80, 3)), rng.uniform(30, 90, (30, 3)), [[0, 0, 0], [0, 0, 0]]])
    table = lambda p: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")
    d = np.linalg.norm(q[:, None] - r[None], axis=2)
    got = {x.id: (x.ref, x.d) for x in joins.nearest_join(table(q), table(r), 0.05).collect()}
    assert len(got) == len(q) and all(got[k][0] == int(d[k].argmin()) and got[k][1] == pytest.approx(d[k].min()) for k in got)
    assert joins.nearest_join(table(q), table(r).limit(0), 1.0).count() == 0


@pytest.mark.parametrize(("eps", "least"), [(0.3, 4), (0.3, 1), (0.6, 9), (0.15, 3)])
def test_dbscan_like_brute_force(spark, eps, least):
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.normal(c, 0.25, (50, 3)) for c in ((0, 0, 0), (1.2, 0, 0), (4, 4, 4))] + [rng.uniform(-3, 6, (60, 3))])
    near = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core = near.sum(1) >= least
    cluster = {}
    for k in np.flatnonzero(core):
        todo = [] if k in cluster else [k]
        while todo:
            if (at := todo.pop()) not in cluster:
                cluster[at] = int(k)
                todo += np.flatnonzero(near[at] & core).tolist()
    want = {int(k): (c, True) for k, c in cluster.items()} | {int(k): (min(cluster[o] for o in np.flatnonzero(near[k] & core)), False) for k in np.flatnonzero(~core & (near & core).any(1))}
    got = {r.id: (r.cluster, r.core) for r in space.dbscan(spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double"), eps, least).collect()}
    assert got == want


def test_hulls_of_many_points(spark):
    rng = np.random.default_rng(5)
    p = rng.standard_normal((3000, 3))
    flat = np.c_[rng.uniform(0, 1, (200, 2)), np.zeros(200)]
    rows = [("ball", *map(float, x)) for x in p] + [("flat", *map(float, x)) for x in flat]
    got = {r.subject: r for r in kernels.hulls(spark.createDataFrame(rows, "subject string, x double, y double, z double").repartition(5)).collect()}
    faces, planes = kernels.hull(p)
    assert sorted(map(tuple, got["ball"].vertices)) == sorted(map(tuple, p[np.unique(faces)].tolist())) and got["flat"].volume < 0.01
    boxes = {r.subject: r.box for r in kernels.oriented_boxes(spark.createDataFrame(rows, "subject string, x double, y double, z double")).collect()}
    assert boxes["ball"] == pytest.approx(kernels.oriented_box(p).tolist(), abs=1e-6)


# registration


def pose(rng):
    return registration.matrix(registration.rodrigues(rng.uniform(-1, 1, 3)), rng.uniform(-2, 2, 3))


def test_poses_from_pixels(spark):
    rng = np.random.default_rng(3)
    world = rng.uniform(-2, 2, (60, 3)) + [0, 0, 8]
    second = registration.matrix(registration.rodrigues(np.array([0.05, -0.1, 0.02])), [0.8, 0.1, -0.2])
    inv = np.linalg.inv(second)
    see = lambda m: (lambda q: q[:, :2] / q[:, 2:] * 500 + 250)(world @ m[:3, :3].T + m[:3, 3])
    a, b = see(np.eye(4)), see(inv)
    b[:8] += rng.uniform(40, 90, (8, 2))
    rows = [("p", *map(float, (*a[k], *b[k])), *([500.0, 250.0, 250.0] * 2)) for k in range(60)]
    m = spark.createDataFrame([*rows, ("few", *rows[0][1:])], "pair string, u1 double, v1 double, u2 double, v2 double, f1 double, cu1 double, cv1 double, f2 double, cu2 double, cv2 double")
    got = {r.pair: r for r in registration.pair_poses(m, ["pair"]).collect()}
    t = np.array(got["p"].t).reshape(4, 4)
    way = second[:3, 3] / np.linalg.norm(second[:3, 3])
    assert got["few"].t is None and got["p"].inliers >= 50 and np.allclose(t[:3, :3], second[:3, :3], atol=5e-3) and np.allclose(t[:3, 3], way, atol=2e-2)
    known = spark.createDataFrame([("i", float(round(u)), float(round(v)), *map(float, w)) for (u, v), w in zip(a, world, strict=True)], "image string, u double, v double, x double, y double, z double")
    links = registration.point_links(known, spark.createDataFrame([("i", *map(float, p), "j", *map(float, q)) for p, q in zip(a, b, strict=True)], "image string, u1 double, v1 double, other string, u2 double, v2 double"))
    assert links.count() >= 55
    exact = spark.createDataFrame([("j", *map(float, (*w, *q))) for w, q in zip(world, b, strict=True)] + [("k", 0.0, 0.0, 1.0, 250.0, 250.0)], "other string, x double, y double, z double, u double, v double")
    cams = spark.createDataFrame([("j", 500.0, 250.0, 250.0), ("k", 500.0, 250.0, 250.0)], "other string, focal double, cu double, cv double")
    found = {r.other: r.t for r in registration.linked_poses(exact, cams).collect()}
    assert found["k"] is None and np.allclose(np.array(found["j"]).reshape(4, 4), second, atol=1e-5)


def test_pose_columns(spark):
    rng = np.random.default_rng(9)
    m = [pose(rng) for _ in range(30)]
    m[0][:3, :3] = np.diag([1, -1, -1])
    df = spark.createDataFrame([(k, x.ravel().tolist()) for k, x in enumerate(m)], "id int, t array<double>")
    for r in df.withColumn("q", registration.quaternion(L.rotation_of(F.col("t")))).withColumn("back", L.mat4_from_quat(F.col("q"))).collect():
        assert np.allclose(np.array(r.back).reshape(4, 4)[:3, :3], m[r.id][:3, :3])
    mean = registration.weighted_poses(df.where("id IN (3, 4)").withColumns({"g": F.lit(1), "confidence": F.when(F.col("id") == 3, 1.0).otherwise(0.0)}), ["g"]).first()
    assert np.allclose(np.array(mean.t).reshape(4, 4), m[3])
    r = spark.range(1).select(registration.scaled_translation(L.mat4_from_euler((0, 0, 0), (3, 4, 0)), F.lit(10.0)).alias("t"), F.array(*(registration.rotation_between(a, b)[k] for a, b in (((1, 2, 3), (-3, 1, 2)), ((0, 0, 1), (0, 0, -1))) for k in range(9))).alias("r"), registration.meeting_point((0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 0)).alias("p")).first()
    assert [r.t[k] for k in (3, 7)] == [6, 8] and r.p[3] == pytest.approx(1)
    one, two = np.array(r.r).reshape(2, 3, 3)
    assert np.allclose(one @ np.array([1, 2, 3]) / 14**0.5, np.array([-3, 1, 2]) / 14**0.5) and np.allclose(two @ [0, 0, 1], [0, 0, -1]) and np.linalg.det(two) == pytest.approx(1)
    target = registration.matrix(np.eye(3), [2.0, 3.0, 1.0])
    best = [("x", k + 1, ref, (np.linalg.inv(np.array(ref).reshape(4, 4)) @ target)) for k, ref in enumerate((np.eye(4).ravel().tolist(), registration.matrix(np.eye(3), [5.0, 0, 0]).ravel().tolist()))]
    # relative poses with a translation of length 1 only
    rows = []
    for test, rank, ref, rel in best:
        rel = rel.copy()
        rel[:3, 3] /= np.linalg.norm(rel[:3, 3])
        rows.append((test, rank, ref, rel.ravel().tolist()))
    (c,) = registration.cross_referenced(spark.createDataFrame(rows, "test string, rank int, t array<double>, rel array<double>")).collect()
    assert [c.t[k] for k in (3, 7, 11)] == pytest.approx([2, 3, 1]) and c.gap == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("fast", [False, True])
def test_registered_clouds(spark, fast):
    rng = np.random.default_rng(6)
    p = np.concatenate([np.c_[rng.uniform(0, 2, (60, 2)), np.zeros(60)], np.c_[rng.uniform(0, 2, 60), np.zeros(60), rng.uniform(0, 1, 60)], rng.normal((1.4, 0.7, 0.5), 0.15, (40, 3))])
    move = registration.matrix(registration.rodrigues(np.array([0.2, 0.4, -0.7])), [3.0, -1.0, 0.5])
    q = p @ move[:3, :3].T + move[:3, 3]

    def cloud(x):
        df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, x double, y double, z double")
        n = kernels.normals(df, 0.6)
        # normals look away from the cloud's middle, in either frame
        middle = x.mean(0)
        both = df.join(n, "id")
        away = sum((F.col(c) - float(m)) * F.col(f"n{c}") for c, m in zip("xyz", middle, strict=True))
        both = both.withColumn("_s", F.when(away < 0, -1).otherwise(1)).withColumns({f"n{c}": F.col(f"n{c}") * F.col("_s") for c in "xyz"})
        return both.join(registration.fpfh(both, 0.9), "id").withColumn("pair", F.lit("a")).select("pair", "x", "y", "z", "feature")

    (r,) = registration.registered(cloud(p), cloud(q), 0.1, fast=fast).collect()
    assert r.fitness > 0.8 and np.allclose(np.array(r.t).reshape(4, 4), move, atol=0.05)


def test_calibrated_camera(spark):
    rng = np.random.default_rng(8)
    k = np.array([[800, 0, 320], [0, 780, 240], [0, 0, 1.0]])
    board = np.array([(x, y) for x in range(7) for y in range(7)], float)
    rows = []
    for view in range(5):
        m = registration.matrix(registration.rodrigues(rng.uniform(-0.5, 0.5, 3)), [-3 + view * 0.3, -3, 14 + view])
        q = np.c_[board, np.zeros(49)] @ m[:3, :3].T + m[:3, 3]
        px = (q @ k.T)[:, :2] / q[:, 2:]
        rows += [("c", view, *map(float, (*b, *p))) for b, p in zip(board, px, strict=True)]
    df = spark.createDataFrame([*rows, ("few", 0, 0.0, 0.0, 1.0, 1.0)], "camera string, view int, x double, y double, u double, v double")
    got = {r.camera: r for r in registration.calibrated_cameras(df).collect()}
    assert (got["c"].fx, got["c"].fy, got["c"].cu, got["c"].cv) == pytest.approx((800, 780, 320, 240), rel=1e-4) and got["few"].fx is None


def test_matches_by_ratio_and_best(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**62, 60)
    b = np.concatenate([a[:30] ^ 1, a[:10] ^ 2, rng.integers(0, 2**62, 40)])
    table = lambda x: spark.createDataFrame([(k, int(v)) for k, v in enumerate(x)], "id long, code long")
    pairs = {(r.a, r.b) for r in joins.ratio_matches(table(a), table(b), 7).collect()}
    assert pairs == {(k, k) for k in range(10, 30)}
    m = joins.mutual_matches(table(a), table(b), block=16)
    d = np.array([[bin(int(x) ^ int(y)).count("1") for y in b] for x in a])
    assert {(r.a, r.b, r.d) for r in m.collect()} == {(i, int(d[i].argmin()), int(d[i].min())) for i in range(60) if int(d[:, d[i].argmin()].argmin()) == i}
    top = joins.best_of_matches(m.withColumn("pair", F.lit(1)), ["pair"], 20).first()
    assert top.n == 20 and top.error < math.inf and joins.best_of_matches(m.withColumn("pair", F.lit(1)), ["pair"], 2000).first().error == math.inf


# linked data


def test_ontology(spark):
    o, s = ontology.OWL, ontology.RDFS
    rows = [("urn:x#Node", f"{ontology.RDF}type", f"{o}Class"), ("urn:x#ImageNode", f"{ontology.RDF}type", f"{o}Class"), ("urn:x#name", f"{ontology.RDF}type", f"{o}DatatypeProperty"), ("urn:x#name", f"{s}range", "urn:xsd#string"), ("urn:x#matrix", f"{ontology.RDF}type", f"{s}Datatype"), ("urn:x#matrix", "urn:x#method", "to_matrix"), ("urn:i#IfcWall", f"{s}subClassOf", "urn:i#IfcBuildingElement"), ("urn:i#IfcDoor", f"{s}subClassOf", "urn:i#IfcBuildingElement"), ("urn:x#ImageNode", f"{ontology.PREFIXES['dbp']}extension", ".jpg")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert {r.subject for r in ontology.classes(t).collect()} == {"urn:x#Node", "urn:x#ImageNode"} and [r.subject for r in ontology.datatype_properties(t).collect()] == ["urn:x#name"]
    assert [tuple(r) for r in ontology.datatype_methods(t, "urn:x#method").collect()] == [("urn:x#matrix", "to_matrix")] and [tuple(r) for r in ontology.extensions(t).collect()] == [("urn:x#ImageNode", ".jpg")]
    assert {r.name: r.type for r in ontology.node_types(names("Node", "ode"), t).collect()} == {"Node": "urn:x#Node", "ode": None}
    assert {r.name: (r.predicate, r.datatype) for r in ontology.attribute_predicates(names("name", "other"), t, "urn:y#").collect()} == {"name": ("urn:x#name", "urn:xsd#string"), "other": ("urn:y#other", None)}
    assert {r.name: r.type for r in ontology.subclass_for(names("wall", "DOOR", "x"), t, "urn:i#IfcBuildingElement").collect()} == {"wall": "urn:i#IfcWall", "DOOR": "urn:i#IfcDoor", "x": "urn:i#IfcBuildingElement"}
    lit = spark.createDataFrame([("s", "p", "12", "urn:xsd#integer"), ("s", "p", "[[1 2]]", "urn:x#matrix"), ("s", "p", "t", "urn:other")], "subject string, predicate string, object string, datatype string")
    values = [r.value for r in ontology.parsed(lit).collect()]
    assert values[0].integer == 12 and values[1].matrix["values"] == [1, 2] and values[2].integer is None
    nodes = ontology.with_constants(spark.createDataFrame([("s1", [1.0, 2.0], None)], "subject string, t array<double>, gone string"), source="x")
    out = {(r.predicate, r.object, r.datatype) for r in ontology.written(nodes, [ontology.Property("t", "urn:x#t", "matrix", lambda x: F.concat(F.lit("["), F.array_join(x.cast("array<string>"), " "), F.lit("]"))), ontology.Property("gone", "urn:x#gone"), ontology.Property("missing", "urn:x#m")], {"source": "urn:x#source"}).collect()}
    assert out == {("urn:x#t", "[1.0 2.0]", "matrix"), ("urn:x#source", "x", "string")}
    r = spark.range(1).select(ontology.shortened(F.lit("http://www.w3.org/2002/07/owl#Class")).alias("a"), ontology.shortened(F.lit("urn:z")).alias("b")).first()
    assert tuple(r) == ("owl:Class", "urn:z")
    sets = rdf.with_members(spark.createDataFrame([("g", "type", "Set")], "subject string, predicate string, object string"), spark.createDataFrame([("g", "a")], "parent string, child string"), inner=spark.createDataFrame([("a", "label", "x"), ("z", "label", "y")], "subject string, predicate string, object string"))
    assert {tuple(r) for r in sets.collect()} == {("g", "type", "Set"), ("g", "hasPart", "a"), ("a", "label", "x")}


def test_paths_and_values(spark):
    cases = {("/a/b/c.jpg", "/a/b"): "c.jpg", ("/a/b/c.jpg", "/a/d/e"): "../../b/c.jpg", ("/a", "/a"): ".", ("x/y", "x"): "y", ("/a/b", "/c"): "../a/b", ("file.txt", "/abs"): "file.txt"}
    df = spark.createDataFrame([(p, f) for p, f in cases], "p string, f string")
    assert {(r.p, r.f): r.o for r in df.withColumn("o", X.relative_path(F.col("p"), F.col("f"))).collect()} == cases
    r = spark.range(1).select(X.xml_number(F.lit(" 2.5 ")).alias("a"), X.xml_number(F.lit(None).cast("string")).alias("b"), X.as_list(F.lit(3), "int").alias("c"), X.as_list(F.array(F.array(F.lit(1)), F.array(F.lit(2))), "array<array<int>>").alias("d"), X.in_any(F.lit("ab"), F.array(F.lit("x"), F.lit("xaby"))).alias("e"), X.random_rgb(F.lit("k"), 1, 255).alias("f"), X.random_rgb(F.lit("k"), 1, 255).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (2.5, None, [3], [1, 2], True, r.g) and all(0 <= x <= 255 and x == int(x) for x in r.f)


def test_sql_names(spark):
    names = set(sql.register(spark))
    scalar = "mat4_from_quat mat4_from_euler mat4_mul mat4_inv_rigid mat4_apply quat_mul euler_from_mat obb_contains obb_corners obb_intersects aabb_overlaps hull_contains dist3 voxel_id morton ray_tri_t pinhole_project pinhole_unproject equirect_dir ortho_project dms_to_dd dd_to_dms l72_to_wgs84 wgs84_to_l72 parse_matrix parse_literal loa_label aci_rgb xyz_grid xy_rays sample_line tiles"
    assert {f"cr_{x}" for x in scalar.split()} <= names
    r = spark.sql("""SELECT cr_euler_from_mat(cr_mat4_from_euler(array(10D, 20D, 30D), array(1D, 2D, 3D))) AS e, cr_ray_tri_t(array(0.2D, 0.2D, 5D), array(0D, 0D, -1D), array(0D, 0D, 0D), array(1D, 0D, 0D), array(0D, 1D, 0D)) AS t,
        cr_obb_intersects(array(0D, 0D, 0D, 2D, 2D, 2D, 0D, 0D, 0D), array(1.5D, 0D, 0D, 2D, 2D, 2D, 0D, 0D, 45D)) AS i, cr_wgs84_to_l72(51.060265D, 3.710094D) AS l, cr_l72_to_wgs84(103824.557675D, 194661.815941D) AS w, cr_parse_matrix('[[1,2],[3,4]]') AS m, cr_aci_rgb(20) AS c,
        cr_pinhole_unproject(cr_mat4_from_euler(array(0D, 0D, 0D), array(0D, 0D, 0D)), 100D, 32D, 24D, 42D, 24D, 10D) AS u, cr_ortho_project(cr_mat4_from_euler(array(0D, 0D, 0D), array(0D, 0D, 0D)), array(1D, 2D, 0D), 0.5D, 10D, 20D) AS o, size(cr_obb_corners(array(0D, 0D, 0D, 2D, 2D, 2D, 0D, 0D, 0D))) AS n""").first()
    assert r.e == pytest.approx([10, 20, 30]) and r.t == 5 and r.i and r.l == pytest.approx([103824.557675, 194661.815941], abs=0.05) and r.w == pytest.approx([51.060265, 3.710094], abs=1e-5)
    assert (r.m, r.c, r.n) == ([1, 2, 3, 4], [255, 63, 0], 8) and r.u == pytest.approx([1, 0, 10]) and r.o == pytest.approx([6, 7])
    assert spark.sql("SELECT * FROM cr_xyz_grid(0D, 1D, 0D, 2D, 0D, 1D, 0.5D)").count() == 2 * 4 * 2 and spark.sql("SELECT * FROM cr_xy_rays(0D, 1D, 0D, 2D, 0D, 1D, 0.5D, 10D)").count() == 8
    assert [x.x for x in spark.sql("SELECT * FROM cr_sample_line(array(0D, 0D, 0D), array(6D, 0D, 0D), 2D) ORDER BY s").collect()] == [0, 2, 4, 6] and spark.sql("SELECT * FROM cr_sample_line(array(0D, 0D, 0D), array(1D, 0D, 0D), 2D)").count() == 0
    assert [(x.x0, x.x1, x.y1) for x in spark.sql("SELECT * FROM cr_tiles(10, 5, 4, 5) ORDER BY tile_col").collect()] == [(0, 4, 5), (4, 8, 5), (8, 10, 5)]


# groups and streams


def test_group_shapes(spark):
    rng = np.random.default_rng(4)
    p = rng.standard_normal((200, 3)) * [3, 2, 1] @ np.linalg.qr(rng.standard_normal((3, 3)))[0]
    df = spark.createDataFrame([("a", *map(float, x)) for x in p] + [("b", 1.0, 1.0, 1.0)] * 3, "c string, x double, y double, z double")
    f = {r.c: r for r in groups.features(df, ["c"]).collect()}
    assert f["a"].variances == pytest.approx(np.linalg.eigvalsh(np.cov(p.T, bias=True))[::-1].tolist()) and f["a"].extent == pytest.approx(np.ptp(p, axis=0).tolist()) and f["b"].variances == pytest.approx([0, 0, 0], abs=1e-12)
    assert groups.of_least_size(df, ["c"], 10).count() == 200 and tuple(groups.largest(df, ["c"]).first()) == ("a", 200)


def test_late_events(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([(at(1, 10), "a", 1.0), (at(5, 0), "a", 2.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    counts = accuracy.windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))

    def run():
        q = counts.select(F.col("window.start").alias("start"), "n").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(at(1, 20), "a", 9.0), (at(9, 0), "a", 3.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([(at(20, 0), "a", 3.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    # the event of 1:20 came after the watermark had passed its window
    assert {(r.start.hour, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 1), (5, 1), (9, 1)}


def test_thinning_passes_groups_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), k, float(x), float(y), 10.0) for k, (g, x, y) in enumerate(zip(rng.integers(0, 3, 200), rng.uniform(0, 60, 200), rng.uniform(0, 60, 200), strict=True))]
    least = 10 * 2 * math.tan(math.radians(47)) * 0.5
    want = set()
    for g in range(3):
        last = None
        for _, k, x, y, _ in (r for r in rows if r[0] == g):
            if last is None or math.hypot(x - last[0], y - last[1]) > least:
                want.add(k)
                last = (x, y)
    df = spark.createDataFrame(rows, "flight int, image int, x double, y double, z double").repartition(4)
    assert {r.image for r in select.thin_by_overlap(df, "flight", "image", 0.0, 0.5).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_triangles_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 9.0, 0.0, 0.0, -1.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert "SortMergeJoin" in _plan(rays.hits(df, boxed(spark, (0, 0, 0, 2, 2, 2, 0, 0, 0)), 1.0))


def test_no_ray_slips_between_faces(spark):
    mesh = boxed(spark, (0.15, 0.35, 9.77, 2.3, 2.3, 2.3, 0, 0, 0))
    # aimed at points of the diagonal that the two faces of a side share
    aims = [(0.15 - 1.15 + 2.3 * k / 97, 0.35 - 1.15 + 2.3 * k / 97, 9.77 + 1.15) for k in range(1, 97)]
    df = spark.createDataFrame([(k, 0.31, 0.17, 40.07, x - 0.31, y - 0.17, z - 40.07) for k, (x, y, z) in enumerate(aims)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray_id: r.t for r in rays.first_hits(df, mesh, 1.0).collect()}
    assert len(got) == 96 and all(t == pytest.approx(1) for t in got.values())


def test_rays_meet_no_faces_beyond_their_first_hits(spark, monkeypatch):
    # walls, one behind the other, two on each border of cells, the nearer of equal ones being named last
    at = [x for x in range(2, 42, 2) for _ in range(2)]
    mesh = triangles(spark, np.array([[(x, -9.0, -9.0), (x, 9.0, -9.0), (x, 0.0, 18.0)] for x in at]), [f"w{99 - k}" for k in range(len(at))])
    rows = [(k, 1.0 if k % 2 else 41.0, 0.01 * k, 0.3, 1.0 if k % 2 else -1.0, 0.0, 0.0) for k in range(20)]
    df = spark.createDataFrame(rows, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    pairs, crossings = [], rays._crossings
    monkeypatch.setattr(rays, "_crossings", lambda met: pairs.append(met.count()) or crossings(met))
    got = {r.ray_id: (r.t, r.subject) for r in rays.first_hits(df, mesh, 2.0).collect()}
    assert got == {k: (1.0, "w98" if k % 2 else "w60") for k in range(20)}
    assert sum(pairs) < 20 * len(at) / 2


def test_copied_points_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    other = spark.read.schema(df.schema).parquet(_stored(df, spark))
    assert "SortMergeJoin" in _plan(joins.within_distance(other, other, 1.0))


def test_points_of_boxes_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 0.0)], "subject string, x double, y double, z double")
    corners = spark.read.schema(df.schema).parquet(_stored(df, spark)).withColumn("x", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    plan = _plan(kernels.oriented_boxes(corners))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _stored(df, spark):
    from geoweft.shared import table

    return table(df).inputFiles()[0]


def test_grown_runs_hold_each_pixel_once(spark):
    rng = np.random.default_rng(4)
    runs = [(int(i), int(r), int(c), int(c + w)) for i, r, c, w in zip(rng.integers(0, 3, 60), rng.integers(0, 150, 60), rng.integers(0, 30, 60), rng.integers(0, 9, 60), strict=True)]
    df = spark.createDataFrame(runs, "image long, row int, col0 int, col1 int")
    for buffer in (0, 2):
        want = {(i, r + a, c) for i, r, c0, c1 in runs for a in range(-buffer, buffer + 1) for c in range(c0 - buffer, c1 + buffer + 1) if r + a >= 0 and c >= 0}
        assert sorted(map(tuple, project.mask_pixels(df, buffer).collect())) == sorted(want)
        assert project.grown_runs(df, buffer).selectExpr("sum(col1 - col0 + 1)").first()[0] == len(want)


def test_points_on_faces_are_inside(spark):
    mesh = boxed(spark, (0, 0, 0, 2, 2, 2, 0, 0, 0))
    pts = spark.createDataFrame([(1, 0.3, 0.2, 1.0), (2, 0.3, 0.2, -1.0), (3, 1.0, 0.2, 0.1), (4, 0.2, -1.0, 0.1), (5, 1.0, 1.0, 1.0), (6, 0.3, 0.2, 1.0000001), (7, 1.1, 0.2, 1.0)], "id long, x double, y double, z double")
    assert {r.id for r in rays.inside_meshes(pts, mesh, 0.8).collect()} == {1, 2, 3, 4, 5}


def test_level_faces_of_one_height_tie(spark):
    rng = np.random.default_rng(5)
    flat = lambda s, x: (s, 0, *(float(v) for p in ((-x, -x), (3 + x, -x), (-x, 3 + x)) for v in (*p, 11.027)))
    mesh = spark.createDataFrame([flat(k, float(x)) for k, x in enumerate(rng.uniform(0.1, 2, 30))], "subject long, fid int, " + ", ".join(f"{c} double" for c in CORNERS))
    df = spark.createDataFrame([(k, float(x), float(y), 40.0, -1.0) for k, (x, y) in enumerate(rng.uniform(0, 1, (20, 2)))], "ray_id long, ox double, oy double, oz double, dz double")
    assert {(r.subject, r.t) for r in joins.cast_vertical(df, mesh, 4.0).collect()} == {(0, 40 - 11.027)}


def test_thinning_shuffles_after_its_join(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0)], "flight long, image long, x double, y double, z double")
    plan = _plan(select.thin_by_overlap(df.hint("merge"), "flight", "image", 0.0, 0.5))
    assert "Exchange" in plan.partition("Join")[0]
