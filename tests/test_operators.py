"""Functions, kernels and file formats against closed forms and brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.functions import literals as X
from geoweft.functions import sql
from geoweft.operators import generate, joins, kernels, measures, raster, space
from geoweft.operators import triples as rdf
from geoweft.sources import files, formats, turtle

CUBE = np.array(list(itertools.product((0.0, 1.0), repeat=3)))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_literals(spark):
    r = one(
        spark,
        w=X.l72_to_wgs84(F.lit(103824.557675), F.lit(194661.815941)),
        b=X.wgs84_to_l72(F.lit(51.060265), F.lit(3.710094)),
        dms=X.parse_dms(F.lit("[[6 , 30 , 0, N ]]")),
        bad=X.parse_dms(F.lit("six")),
        m=X.to_matrix(F.lit("[[1,2][3 4.5]]\r\n")),
        ragged=X.to_matrix(F.lit("[[1,2],[3]]")),
        none=X.to_double(F.lit("None")),
        t=X.datetime_text(X.to_datetime(F.lit("2022:03:13 13:55:26"))),
        lat=X.signed_coordinate(F.lit("51.2S")),
        alt=X.ratio(F.lit("10000/1600")),
        at=X.replace_at(F.lit("abc"), -1),
        out=X.replace_at(F.lit("abc"), 3),
        items=X.to_list(F.lit("['a', 2, 3.5]")),
    )
    assert r.w == pytest.approx([51.060265, 3.710094], abs=1e-5) and r.b == pytest.approx([103824.557675, 194661.815941], abs=0.05)
    assert (r.dms, r.bad, r.m["values"], r.m.ncols, r.ragged, r.none) == (6.5, None, [1, 2, 3, 4.5], 2, None, None)
    assert (r.t, r.lat, r.alt, r["at"], r.out, r["items"]) == ("2022-03-13T13:55:26", -51.2, 6.25, "ab_", None, ["a", "2", "3.5"])


def test_poses(spark):
    m = L.mat4_from_euler((10, 20, 30), (1, 2, 3))
    r = one(spark, e=L.euler_from_mat(m), i=L.mat4_mul(m, L.mat4_inv_rigid(m)), q=L.mat4_apply(L.mat4_from_quat((0.0, 0.0, 2.0, 2.0)), (1, 0, 0)), h=L.heading(L.vec(0, 0, -(0.5**0.5), 0.5**0.5)), f=F.array(*L.rotation_from_forward_up(L.vec(0, 0, 2), L.vec(0, 3, 0))))
    assert r.e == pytest.approx([10, 20, 30]) and r.i == pytest.approx(L.IDENTITY, abs=1e-12) and r.q == pytest.approx([0, 1, 0]) and r.h == pytest.approx(270)
    assert r.f == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1])


def test_cameras_invert(spark):
    pose = L.mat4_from_euler((5, 15, 25), (1, 2, 3))
    k = tuple(F.lit(x) for x in (1000.0, 960.0, 540.0))
    pinhole = L.let(G.pinhole_project(pose, k, (3, 4, 9)), lambda q: G.pinhole_unproject(pose, k, q[0], q[1], q[2]))
    pano = L.let(G.equirect_project(L.identity(), (3, -2, 1), F.lit(800), F.lit(400)), lambda q: L.scale(G.equirect_direction(q[0], q[1], F.lit(800), F.lit(400)), q[2]))
    ortho = L.let(G.ortho_project(pose, (3, 4, 9), F.lit(0.01), F.lit(200), F.lit(100)), lambda q: G.ortho_project(pose, G.ortho_unproject(pose, q[0], q[1], F.lit(0.01), F.lit(200), F.lit(100), F.lit(2.0)), F.lit(0.01), F.lit(200), F.lit(100)))
    r = one(spark, p=pinhole, e=pano, o=ortho, q=G.ortho_project(pose, (3, 4, 9), F.lit(0.01), F.lit(200), F.lit(100)))
    assert r.p == pytest.approx([3, 4, 9]) and r.e == pytest.approx([3, -2, 1]) and r.o == pytest.approx(r.q)


def test_boxes_intersect(spark):
    def test(b):
        a = [F.lit(float(x)) for x in (0, 0, 0, 2, 2, 2, 0, 0, 0)]
        b = [F.lit(float(x)) for x in b]
        return G.obb_intersects(a, b, F.array(*G.box_rotation(a)), F.array(*G.box_rotation(b)))

    r = one(spark, near=test((1.9, 0, 0, 2, 2, 2, 0, 0, 0)), far=test((2.3, 0, 0, 2, 2, 2, 0, 0, 0)), turned=test((2.3, 0, 0, 2, 2, 2, 0, 0, 45)), corner=test((2.2, 2.2, 0, 2, 2, 2, 0, 0, 45)))
    assert (r.near, r.far, r.turned, r.corner) == (True, False, True, False)


def test_rays(spark):
    tri = [(0, 0, 1), (1, 0, 1), (0, 1, 1)]
    r = one(spark, hit=G.ray_triangle(L.vec(0.2, 0.2, 0), L.vec(0, 0, 1), *(L.vec(*v) for v in tri)), miss=G.ray_triangle(L.vec(0.9, 0.9, 0), L.vec(0, 0, 1), *(L.vec(*v) for v in tri)), back=G.ray_triangle(L.vec(0.2, 0.2, 2), L.vec(0, 0, 1), *(L.vec(*v) for v in tri)))
    assert (r.hit, r.miss, r.back) == (1.0, None, None)


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    r = spark.sql("SELECT cr_dist3(array(0D, 0D, 0D), array(3D, 4D, 0D)) AS d, cr_mat4_apply(cr_mat4_inv_rigid(array(0D, -1D, 0D, 5D, 1D, 0D, 0D, 6D, 0D, 0D, 1D, 7D, 0D, 0D, 0D, 1D)), array(5D, 7D, 7D)) AS p, cr_subject_name('http://a/b#c') AS s, cr_loa_label(0.9D, 0.96D, 1D) AS l").first()
    assert (r.d, r.p, r.s, r.l) == (5.0, [1.0, 0.0, 0.0], "c", "LOA20")


# kernels


@settings(max_examples=40, deadline=None)
@given(st.integers(5, 60), st.integers(0, 1000))
def test_hull_holds_its_points(n, seed):
    p = np.random.default_rng(seed).standard_normal((n, 3))
    faces, planes = kernels.hull(p)
    assert (p @ planes[:, :3].T <= planes[:, 3] + 1e-7).all()
    edges = [e for t in faces.tolist() for e in zip(t, t[1:] + t[:1], strict=True)]
    assert len(edges) == len(set(edges)) and {(b, a) for a, b in edges} == set(edges)


def test_hulls_and_boxes(spark):
    rows = [("cube", *map(float, p)) for p in CUBE] + [("flat", float(x), float(y), 0.0) for x in range(3) for y in range(3)] + [("dot", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "subject string, x double, y double, z double")
    got = {r.subject: r for r in kernels.hulls(df).collect()}
    assert got["cube"].volume == pytest.approx(1) and len(got["cube"].vertices) == 8 and got["flat"].volume == pytest.approx(0.004) and got["dot"].volume > 0
    box = {r.subject: r.box for r in kernels.oriented_boxes(df).collect()}["flat"]
    assert box[:3] == pytest.approx([1, 1, 0]) and sorted(box[3:6]) == pytest.approx([0, 2, 2], abs=1e-9)
    assert {r.subject for r in kernels.extremes(df).collect()} == {"cube", "flat", "dot"}


def test_inside_and_normals(spark):
    faces, _ = kernels.hull(CUBE)
    inside = kernels.signed_distance_inside(np.array([[0.5, 0.5, 0.5], [1.5, 0.5, 0.5], [0.1, 0.9, 0.2]]), CUBE[faces])
    assert inside.tolist() == [True, False, True]
    grid = spark.createDataFrame([(k, float(k % 5), float(k // 5), 2.0) for k in range(25)], "id long, x double, y double, z double")
    for r in kernels.normals(grid, 1.5).collect():
        assert (r.nx, r.ny, r.nz) == pytest.approx((0, 0, 1), abs=1e-9)
    q = kernels.mean_rotation(np.array([[0, 0, 0.1, 1], [0, 0, -0.1, 1.0]]), np.ones(2))
    assert q == pytest.approx([0, 0, 0, 1])


def test_nearest_goldens(spark):
    refs = spark.createDataFrame([(k, float(k), float(k), float(k)) for k in range(4)], "id long, x double, y double, z double")
    queries = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 2.1, 2.1, 2.1), (2, 90.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: (r.ref, r.d) for r in joins.nearest_join(queries, refs, 0.5).collect()}
    assert got[0] == (0, pytest.approx(0.1 * 3**0.5)) and got[1] == (2, pytest.approx(0.1 * 3**0.5)) and got[2][0] in (3,)


def test_salted_join_is_the_same(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.random((200, 3)))], "id long, x double, y double, z double")
    pairs = [sorted((r.q.id, r.r.id) for r in joins.within_distance(df, df, 0.2, salts).collect()) for salts in (1, 4)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 200


def test_samples(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert generate.sample_lines(lines, 0.1).count() == 18
    tri = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 10.0, 0.0)], "subject string, fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    rows = generate.sample_triangles(tri, 4.0).collect()
    assert len(rows) in (200, 201) and all(r.x >= 0 and r.y >= 0 and r.x + r.y <= 10 + 1e-9 for r in rows)
    quads = spark.createDataFrame([("m", [1, 2, 3, 4]), ("m", [5, 6, 7])], "subject string, corners array<int>")
    assert sorted(tuple(r[2:]) for r in generate.split_quads(quads).collect()) == [(1, 2, 3), (1, 3, 4), (5, 6, 7)]


def test_dbscan_blobs(spark):
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 0.05, (40, 3)), rng.normal(3, 0.05, (30, 3)), [[10, 10, 10]]])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "id long, x double, y double, z double")
    got = {r.id: r.cluster for r in space.dbscan(df, 0.3, 5).collect()}
    assert {got[k] for k in range(40)} == {0} and {got[k] for k in range(40, 70)} == {40} and 70 not in got


def test_mutual_matches_of_distant_codes(spark):
    rng = np.random.default_rng(2)
    a = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)]
    b = []
    for k, x in enumerate(a):
        flips = rng.choice(64, k % 21, replace=False)
        b.append(int(np.int64(x) ^ np.bitwise_xor.reduce(np.left_shift(np.int64(1), flips.astype(np.int64)), initial=np.int64(0))))
    # a code that differs in one bit of every byte shares none
    a.append(0)
    b.append(0x0101010101010101)
    far = [[(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for y in b] for x in a]
    best_a = [min(range(len(b)), key=lambda j: (far[i][j], j)) for i in range(len(a))]
    best_b = [min(range(len(a)), key=lambda i: (far[i][j], i)) for j in range(len(b))]
    want = [(i, j, far[i][j]) for i, j in enumerate(best_a) if best_b[j] == i]
    left, right = (spark.createDataFrame([*enumerate(x), (99, None)], "id long, code long") for x in (a, b))
    assert sorted(map(tuple, joins.mutual_matches(left, right).collect())) == want and (60, 60, 8) in want


def test_rasters(spark):
    image = np.full((7, 7), 9)
    image[3, 3] = 0
    assert (raster.close_black(image, 3) == 9).all() and raster.box_sum(np.ones((4, 4)), 1)[1, 1] == 9
    z = np.full((20, 20), 2.0)
    assert np.allclose(raster.plane_normals(z, 100, 10, 10)[10, 10], [0, 0, -1], atol=1e-6) and raster.hha(z, 100, 10, 10).shape == (20, 20, 3)
    px = spark.createDataFrame([("i", r, c, 1 if (r, c) != (1, 1) else 2) for r in range(3) for c in range(3)], "subject string, row int, col int, value int")
    assert {r.value for r in raster.majority(px).collect()} == {1} and raster.majority(px).count() == 9


# formats


POINTS = {"x": np.array([0.5, 1.25, -3.0]), "y": np.array([1.0, 2.0, 3.0]), "z": np.array([0.0, -1.0, 7.125])}
COLORS = {"r": np.array([0.0, 1.0, 0.2]), "g": np.array([1.0, 0.0, 0.4]), "b": np.array([0.2, 0.6, 1.0])}


@pytest.mark.parametrize("binary", [True, False])
def test_ply(binary):
    columns, faces, _ = formats.read_ply(formats.write_ply(POINTS | COLORS, [(0, 1, 2)], binary))
    assert all(np.allclose(columns[c], v) for c, v in (POINTS | COLORS).items()) and faces == [(0, 1, 2)]


def test_clouds():
    for back in (formats.read_pcd(formats.write_pcd(POINTS | COLORS)), formats.read_las(formats.write_las(POINTS | COLORS))):
        assert all(np.allclose(back[c], v, atol=1e-3) for c, v in (POINTS | COLORS).items())
    columns, faces, edges = formats.read_obj(formats.write_obj(POINTS, [(0, 1, 2)]) + b"l 1 2 -1\n")
    assert np.allclose(columns["z"], POINTS["z"]) and faces == [(0, 1, 2)] and edges == [(0, 1), (1, 2)]
    text = b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n"
    assert formats.read_pcd(text)["y"].tolist() == [2, 5]


TTL = """@prefix e: <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
e:a a e:Node ; e:n 12 , 1.5, -2e3 ; # a remark
  e:m \"\"\"[[1 2]
 [3 4]]\"\"\" ; e:l "it \\"is\\"" ; e:t "2022-01-01"^^xsd:date ; e:ok true ; e:next <http://e/b> .
e:b e:l "x"@en .
"""


def test_turtle():
    rows = list(turtle.parse(TTL))
    assert len(rows) == 10 and rows[0][:3] == ("http://e/a", turtle.RDF_TYPE, "http://e/Node")
    assert set(turtle.parse(turtle.serialize(rows))) == set(rows)
    with pytest.raises(ValueError, match="unknown prefix"):
        list(turtle.parse("x:a x:b x:c ."))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ply").write_bytes(formats.write_ply(POINTS, [(0, 1, 2)]))
    (tmp_path / "in/b.las").write_bytes(formats.write_las(POINTS | COLORS))
    (tmp_path / "in/c.tfw").write_text("0.5\n0\n0\n-0.5\n100\n200\n")
    (tmp_path / "in/g.ttl").write_text(TTL)
    (tmp_path / "in/d.dxf").write_text("0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nwall\n10\n0\n20\n0\n30\n0\n11\n1\n21\n2\n31\n3\n0\nLWPOLYLINE\n8\nroof\n70\n1\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n0\nCIRCLE\n8\nc\n10\n0\n20\n0\n40\n2\n0\nENDSEC\n0\nEOF\n")
    (tmp_path / "in/e.xmp").write_text('<x:m xmlns:x="u" xmlns:c="v"><d c:FocalLength35mm="24" c:PrincipalPointU="0.1"><c:Rotation>1 2 3 4 5 6 7 8 9</c:Rotation><c:Position>1 2 3</c:Position></d></x:m>')
    (tmp_path / "in/s.xml").write_text('<e57Root xmlns="u"><data3D><vectorChild><name>one</name><pose><rotation><w>1</w><x/><y/><z/></rotation><translation><x>4</x><y>5</y><z/></translation></pose><cartesianBounds><xMinimum>0</xMinimum><xMaximum>1</xMaximum></cartesianBounds><points recordCount="9"/></vectorChild></data3D></e57Root>')
    (tmp_path / "p.csv").write_text("# poses: ID; filename\n0; a.jpg; 1.5; 1; 2; 3; 1; 0; 0; 0\n1; b.jpg; 2.5; 4; 5; 6; 1; 0; 0; 0\n")
    at = str(tmp_path / "in")
    pts, fcs = files.points(spark, at), files.faces(spark, at)
    assert pts.count() == 6 and fcs.count() == 1 and files.triangles(pts, fcs).first().bx == 1.25
    lines = files.entity_lines(files.entities(spark, at)).collect()
    assert [sum(r.layer == x for r in lines) for x in ("wall", "roof", "c")] == [1, 3, 35]
    assert files.triples(spark, at).count() == 10 and files.world_files(spark, at).first().f == 200
    assert files.camera_sidecars(spark, at).first().rotation == [1, 4, 7, 2, 5, 8, 3, 6, 9]
    scan = files.scan_headers(spark, at).first()
    assert (scan.name, scan["count"], scan.t[3], scan.t[0]) == ("one", 9, 4.0, 1.0)
    assert [r.filename for r in files.panoramas(spark, str(tmp_path / "p.csv"), 2).collect()] == ["a.jpg"]
    for kind, read in (("ply", lambda d: formats.read_ply(d)[0]), ("pcd", formats.read_pcd), ("las", formats.read_las), ("obj", lambda d: formats.read_obj(d)[0])):
        for r in files.encoded(pts, kind, fcs).collect():
            assert np.allclose(read(bytes(r.content))["x"], POINTS["x"], atol=1e-3)
    text = files.encoded_graphs(files.triples(spark, at)).first().content
    assert set(turtle.parse(text)) == set(turtle.parse(TTL))
    assert formats.tfw_centre([0.5, 0, 0, -0.5, 100, 200], 10, 20) == (0.5, 102.25, 195.25)


def test_graph_patterns(spark):
    t = spark.createDataFrame([("a", "type", "N", None), ("a", "has", "b", None), ("b", "type", "N", None), ("b", "label", "B", None)], "subject string, predicate string, object string, datatype string")
    got = rdf.match(t, [("?x", "type", "N"), ("?x", "has", "?y")], [("?y", "label", "?l")]).collect()
    assert [(r.x, r.y, r.l) for r in got] == [("a", "b", "B")] and rdf.has_subject(t, "a").first().found
    with pytest.raises(ValueError, match="no variable"):
        rdf.match(t, [("?x", "type", "N"), ("?z", "has", "b")])


def test_streaming(spark, tmp_path):
    from geoweft.streaming import accuracy

    spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:10:00' AS ts, 1L AS user_id, 'a' AS event_type, 2D AS value, '' AS props").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(f"{tmp_path}/events")
    q = accuracy.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r["mean"]) for r in spark.table("counts").collect()] == [("a", 1, 2.0)]


def test_nodes_move_and_sets(spark):
    from geoweft.operators import nodes

    rows = [("a", None, None, [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 4.0, 6.0]]), ("b", None, [1.0, 2.0, 3.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0], None), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "subject string, t array<double>, box array<double>, hull array<array<double>>")
    full = {r.subject: r for r in nodes.complete(df).collect()}
    assert full["a"].box == pytest.approx([1, 2, 3, 2, 4, 6, 0, 0, 0]) and full["b"].t[3] == 1 and len(full["c"].hull) == 8
    turn = L.mat4_from_euler((0.0, 0.0, 90.0), (10.0, 0.0, 0.0))
    moved = {r.subject: r for r in nodes.move(nodes.complete(df), turn).collect()}
    assert moved["b"].box == pytest.approx([8, 1, 3, 2, 2, 2, 0, 0, 90]) and moved["a"].hull[1] == pytest.approx([10, 2, 0])
    sets = spark.createDataFrame([("s", "a"), ("s", "b")], "parent string, child string")
    b = nodes.set_bounds(sets, nodes.complete(df)).first()
    assert (b.xmin, b.xmax, b.zmax) == (0, 2, 6)
    e = nodes.ellipsoids(spark.createDataFrame([(1.0, 2.0, 3.0)], "rx double, ry double, rz double"), 8).collect()
    assert all((r.x / 1) ** 2 + (r.y / 2) ** 2 + (r.z / 3) ** 2 == pytest.approx(1) for r in e)


def test_building_elements(spark, tmp_path):
    text = "ISO-10303-21;\nDATA;\n#1=IFCWALL('0123456789012345678901',#2,'Wall, (a)',$,'Basic');\n#2= IFCOWNERHISTORY(#3,(1,2),.T.);\nENDSEC;\n"
    (tmp_path / "m.ifc").write_text(text)
    rows = {r.id: r for r in files.building_elements(spark, str(tmp_path)).collect()}
    assert (rows[1].class_name, rows[1].name, rows[1].object_type, rows[2].global_id) == ("IFCWALL", "Wall, (a)", "Basic", None)
    assert files.building_elements(spark, str(tmp_path), ("IFCWALL",)).count() == 1


def test_color_index(spark):
    want = {0: [0, 0, 0], 7: [255, 255, 255], 10: [255, 0, 0], 11: [255, 170, 170], 50: [255, 255, 0], 90: [0, 255, 0], 170: [0, 0, 255], 12: [189, 0, 0], 250: [51, 51, 51]}
    df = spark.createDataFrame([(k,) for k in (*want, 256)], "k int")
    got = {r.k: r.c for r in df.select("k", X.aci_rgb(F.col("k")).alias("c")).collect()}
    assert got == {**{k: [float(x) for x in v] for k, v in want.items()}, 256: None}


def test_ranks_and_thinning(spark):
    from geoweft.operators import select

    df = spark.createDataFrame([(k * 7 % 100,) for k in range(100)], "id int")
    out, total = space.ranked(df, ["id"])
    assert total == 100 and all(r.id == r.number for r in out.collect())
    sizes = [n for _, n in sorted(space.chunks(df, ["id"], 7).groupBy("chunk").count().collect())]
    assert sizes == [15, 15, 14, 14, 14, 14, 14]
    images = spark.createDataFrame([(1, k, float(k), 0.0, 2.0) for k in range(10)], "flight int, image int, x double, y double, z double")
    step = 2 * 2.0 * np.tan(np.radians(47)) * 0.5
    want, last = [], None
    for k in range(10):
        if last is None or k - last > step:
            want, last = [*want, k], k
    assert [r.image for r in select.thin_by_overlap(images, "flight", "image", 0.0, 0.5).orderBy("image").collect()] == want


def test_completion_at_a_limit(spark):
    # sums whose last digits depend on the order of their terms
    df = spark.createDataFrame([("a", 0.1 + 0.05, 0.3), ("b", 0.05 + 0.1 + 0.1, 1.0), ("c", 0.95 - 1e-15, 1.0), ("d", 0.0, 0.0)], "element string, built double, full double")
    rows = measures.completion(df.select("element", "built"), df.select("element", "full"), ["element"]).collect()
    assert {r.element: (r.completion, r.color) for r in rows} == {"a": (0.5, "amber"), "b": (0.25, "red"), "c": (0.95, "green"), "d": (None, None)}
