"""Images, camera projects, E57, building solids, drawings, sheets: files made here, read back through Spark."""


import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.operators import loa, vision
from geoweft.sources import cameras, e57, files, formats, images, solids


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{folder}"


def exif(order="<"):
    """A TIFF block with a date, size, focal lengths and a place south and west."""
    body = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8))

    def directory(at, entries):
        nonlocal body
        body = body.ljust(at, b"\0")
        head, extra = struct.pack(f"{order}H", len(entries)), b""
        base = at + 2 + 12 * len(entries) + 4
        for tag, kind, n, data in entries:
            if len(data) <= 4:
                head += struct.pack(f"{order}HHI", tag, kind, n) + data.ljust(4, b"\0")
            else:
                head += struct.pack(f"{order}HHII", tag, kind, n, base + len(extra))
                extra += data
        body += head + bytes(4) + extra

    long = lambda v: struct.pack(f"{order}I", v)
    ratio = lambda *v: b"".join(struct.pack(f"{order}II", *x) for x in v)
    directory(8, [(306, 2, 20, b"2022:03:13 13:55:26\0"), (34665, 4, 1, long(200)), (34853, 4, 1, long(400))])
    directory(200, [(37386, 5, 1, ratio((24, 1))), (40962, 4, 1, long(6000)), (40963, 4, 1, long(4000)), (41989, 3, 1, struct.pack(f"{order}H", 36))])
    directory(400, [(1, 2, 2, b"S\0"), (2, 5, 3, ratio((51, 1), (30, 1), (36, 1))), (3, 2, 2, b"W\0"), (4, 5, 3, ratio((3, 1), (15, 1), (0, 1))), (6, 5, 1, ratio((85, 2)))])
    return bytes(body)


def jpeg(meta, w=640, h=480):
    app = b"Exif\0\0" + meta
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes(9)
    return b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\0\2" + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, tmp_path, order):
    png = images.write_png(np.zeros((3, 5, 3), np.uint8))
    at = png.index(b"IDAT") - 4
    meta = exif(order)
    png = png[:at] + struct.pack(">I", len(meta)) + b"eXIf" + meta + struct.pack(">I", zlib.crc32(b"eXIf" + meta)) + png[at:]
    for name, data in (("a.jpg", jpeg(meta)), ("b.png", png), ("c.tif", meta), ("d.jpg", b"no image"), ("e.jpeg", jpeg(b"")), ("f.png", b"\x89PNG")):
        where = put(tmp_path / "x", name, data)
    heads = {r.subject.rpartition("/")[2]: r for r in images.headers(spark, where).where("subject NOT LIKE '%f.png'").collect()}
    assert (heads["a.jpg"].format, heads["a.jpg"].width, heads["a.jpg"].height, heads["b.png"].width, heads["d.jpg"].format, heads["e.jpeg"].exif) == ("jpeg", 640, 480, 5, None, {})
    facts = {r.subject.rpartition("/")[2]: r for r in images.exif_facts(images.headers(spark, where).where("subject NOT LIKE '%f.png'")).collect()}
    for name in ("a.jpg", "b.png", "c.tif"):
        r = facts[name]
        assert (str(r.timestamp), r.image_width, r.image_height, r.focal35, r.coordinate_system) == ("2022-03-13 13:55:26", 6000, 4000, 36.0, "geospatial-wgs84")
        assert (r.focal_x, r.focal_y, r.cu, r.cv) == (6000.0, 6000.0, 3000.0, 2000.0) and (r.latitude, r.longitude, r.altitude) == pytest.approx((-51.51, -3.25, 42.5))
    assert facts["e.jpeg"].latitude is None and facts["e.jpeg"].image_width == 640
    nodes = spark.createDataFrame([(heads["a.jpg"].subject, 100, None)], "subject string, image_width int, focal35 double")
    r = images.filled(nodes, images.exif_facts(images.headers(spark, where).where("subject LIKE '%a.jpg'"))).first()
    assert (r.image_width, r.focal35, r.image_height) == (100, 36.0, 4000)


def test_png_of_every_filter():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (10, 7, 3)).astype(np.uint8)
    rows, before = [], np.zeros(21, int)
    for k, line in enumerate(a.reshape(10, 21).astype(int)):
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, before[:-3]]
        p = left + before - corner
        paeth = np.array([min((abs(q - x), n, x) for n, x in enumerate((u, v, w)))[2] for q, u, v, w in zip(p, left, before, corner, strict=True)])
        rows.append(np.r_[k % 5, (line - (0, left, before, (left + before) // 2, paeth)[k % 5]) % 256].astype(np.uint8))
        before = line
    assert (images._unfiltered(np.array(rows), 3).reshape(10, 7, 3) == a).all()
    for dtype, n in itertools.product((np.uint8, np.uint16), (1, 2, 3, 4)):
        b = rng.integers(0, np.iinfo(dtype).max, (4, 5, n)).astype(dtype)
        assert (images.read_png(images.write_png(b)) == b).all()
    assert (images.read_pnm(b"P2\n# text\n2 1\n255\n7 9\n") == [[[7], [9]]]).all() and (images.read_pnm(b"P6 1 1 255\n" + bytes([1, 2, 3])) == [[[1, 2, 3]]]).all()


def test_pixels_depths_and_saving(spark, tmp_path):
    a = np.arange(2 * 3 * 4, dtype=np.uint8).reshape(2, 3, 4)
    where = put(tmp_path / "p", "a.png", images.write_png(a))
    px = images.pixels(images.lines(spark, where))
    assert {(r.row, r.col): r["values"] for r in px.collect()} == {(i, j): a[i, j].tolist() for i in range(2) for j in range(3)}
    d = {(r.row, r.col): r.depth for r in images.depths(px).collect()}
    assert d[0, 1] == pytest.approx((4 + 5 * 256 + 6 * 65536 + 7 * 16777216) / 1000)
    out = tmp_path / "out" / "deep"
    saved = files.save_files(images.encoded_images(px), F.lit(f"file://{out}/b.png"))
    assert saved == 1 and (images.read_png((out / "b.png").read_bytes()) == a).all() and [x.name for x in out.iterdir()] == ["b.png"]


def test_panorama_sidecars(spark, tmp_path):
    where = put(tmp_path / "j", "pano1.json", '{"timestamp": 1647179726.0, "footprint": {"position": [1, 2, 3], "quaternion": [0, 0, 1, 0]}}')
    r = images.panorama_sidecars(spark, where).first()
    assert (r.name, r.position) == ("pano1", [1, 2, 3]) and r.t == pytest.approx([-1, 0, 0, 1, 0, -1, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1])


PROJECT = """<document><chunk><sensors><sensor id="0"><resolution width="4000" height="3000"/><property name="pixel_width" value="0.002"/><property name="pixel_height" value="0.002"/><property name="focal_length" value="8"/>
<calibration><f>4100</f><cx>10</cx><cy>-5</cy></calibration></sensor><sensor id="1"><resolution width="100" height="50"/></sensor></sensors>
<components><component id="7"><transform><rotation>0 -1 0 1 0 0 0 0 1</rotation><translation>10 20 30</translation><scale>2</scale></transform></component></components>
<cameras><camera label="a.JPG" sensor_id="0" component_id="7"><transform>1 0 0 1 0 1 0 2 0 0 1 3 0 0 0 1</transform></camera><camera label="b" sensor_id="0"><transform>1 0 0 1 0 1 0 0 0 0 1 0 0 0 0 1</transform></camera><camera label="c" sensor_id="0"/></cameras>
<transform><rotation>1 0 0 0 1 0 0 0 1</rotation><translation>100 0 0</translation><scale>3</scale></transform></chunk></document>"""


def test_project_cameras(spark, tmp_path):
    where = put(tmp_path / "x", "p.xml", PROJECT)
    listed = spark.createDataFrame([("/data/a.jpg",), ("/data/z.jpg",)], "path string")
    rows = {r.name: r for r in cameras.project_cameras(spark, where, files=listed).collect()}
    assert set(rows) == {"a.JPG", "b"} and rows["a.JPG"].path == "/data/a.jpg" and rows["b"].path is None
    # turned by a quarter, after scaling: (2, 4, 6) becomes (-4, 2, 6)
    assert [rows["a.JPG"].t[k] for k in (3, 7, 11)] == [6, 22, 36] and [rows["b"].t[k] for k in (3, 7, 11)] == [103, 0, 0]
    assert (rows["a.JPG"].focal, rows["a.JPG"].cu, rows["a.JPG"].cv, rows["a.JPG"].width) == (4100, 2010, 1495, 4000) and rows["a.JPG"].focal35 == pytest.approx(8 / (np.hypot(36, 24) / 10))
    assert cameras.project_cameras(spark, where, names=["b"]).count() == 1 and [r.name for r in cameras.project_cameras(spark, where, skip=2).collect()] == ["a.JPG"]
    assert cameras.project_cameras(spark, where, files=listed, only_files=True).count() == 1


def test_scanner_panoramas_and_alignments(spark, tmp_path):
    head = '<e57Root xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><images2D>'
    node = "<vectorChild><acquisitionDateTime><dateTimeValue>5</dateTimeValue></acquisitionDateTime>{}</vectorChild>"
    pose = "<pose><rotation><w>1</w><x/><y/><z/></rotation><translation><x>1</x><y>2</y><z>3</z></translation></pose>"
    where = put(tmp_path / "x", "a.xml", head + node.format("") + node.format(pose) + "</images2D></e57Root>")
    rows = cameras.scanner_panoramas(spark, where).orderBy("seq").collect()
    assert len(rows) == 2 and (rows[0].x, rows[1].x, rows[1].z, rows[0].time) == (0, 1, 3, 5) and [rows[1].t[k] for k in (0, 1, 4, 5)] == pytest.approx([0, -1, 1, 0], abs=1e-12)
    text = "<a><dataset><name>d1</name><pose><position><x>1</x><y>2</y><z>3</z></position><orientation><x>0</x><y>0</y><z>0</z><w>1</w></orientation></pose></dataset><dataset><name>none</name></dataset></a>"
    rows = cameras.alignments(spark, put(tmp_path / "y", "b.xml", text)).collect()
    assert [(r.name, r.x, r.qw) for r in rows] == [("d1", 1, 1)] and rows[0].t[11] == 3


def test_e57(spark, tmp_path):
    rng = np.random.default_rng(1)
    half = 0.5**0.5
    clouds = [({"name": "one", "rotation": (0, 0, half, half), "translation": (1, 2, 3)}, {c: rng.standard_normal(1300) for c in "xyz"} | {c: rng.integers(0, 256, 1300) / 255 for c in "rgb"} | {"nx": np.ones(1300), "ny": np.zeros(1300), "nz": np.zeros(1300)}), ({"name": "two"}, {c: rng.standard_normal(3) for c in "xyz"} | {"intensity": np.array([1.0, 2.0, 5.0])})]
    data = e57.write(clouds)
    assert len(data) % 1024 == 0 and struct.unpack_from("<Q", data, 16)[0] == len(data)
    back = list(e57.scans(data))
    assert [f["name"] for f, _ in back] == ["one", "two"] and all(np.array_equal(c["x"], own["x"]) for (_, c), (_, own) in zip(back, clouds, strict=True))
    where = put(tmp_path / "e", "a.e57", data)
    rows = e57.points(spark, where).collect()
    first = {r.pid: r for r in rows if r.scan == 0}
    own = clouds[0][1]
    assert len(first) == 1300 and len(rows) == 1303
    assert (first[5].x, first[5].y, first[5].z) == pytest.approx((1 - own["y"][5], 2 + own["x"][5], 3 + own["z"][5])) and (first[5].nx, first[5].ny) == pytest.approx((0, 1), abs=1e-12) and first[5].r == pytest.approx(own["r"][5])
    assert [r.r for r in sorted((r for r in rows if r.scan == 1), key=lambda r: r.pid)] == pytest.approx([0, 0.25, 1])
    nodes = {r.scan: r for r in e57.scan_nodes(e57.raw_points(spark, where)).collect()}
    assert nodes[0]["count"] == 1300 and nodes[0].t[3] == 1 and e57.points(spark, where, scan=1).count() == 3 and 300 < e57.points(spark, where, share=0.5).count() < 1000
    again = e57.encoded(e57.points(spark, where, scan=1)).first()
    assert next(iter(e57.scans(bytes(again.content))))[1]["x"] == pytest.approx(clouds[1][1]["x"])


def test_e57_bits_and_angles(spark):
    values = np.array([3, 0, 7, 5, 1, 6, 2, 4, 3])
    packed = np.packbits((values[:, None] >> np.arange(3) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
    assert (e57._decoded(packed, 9, "Integer", {"minimum": "10", "maximum": "17"}) == values + 10).all()
    assert (e57._decoded(packed, 9, "ScaledInteger", {"minimum": "0", "maximum": "7", "scale": "0.5", "offset": "1"}) == values * 0.5 + 1).all()
    assert (e57._decoded(b"", 2, "Integer", {"minimum": "4", "maximum": "4"}) == 4).all()
    r = spark.range(1).select(e57.spherical(F.lit(2.0), F.lit(np.pi / 2), F.lit(np.pi / 6)).alias("p")).first()
    assert r.p == pytest.approx([0, 3**0.5, 1], abs=1e-12)


IFC = """ISO-10303-21; HEADER; ENDSEC; DATA;
#1=IFCSIUNIT(*,.LENGTHUNIT.,.MILLI.,.METRE.);
#10=IFCCARTESIANPOINT((0.,0.,0.)); #11=IFCCARTESIANPOINT((1000.,2000.,0.)); #12=IFCDIRECTION((0.,0.,1.)); #13=IFCDIRECTION((0.,1.,0.));
#20=IFCAXIS2PLACEMENT3D(#10,$,$); #21=IFCAXIS2PLACEMENT3D(#11,#12,#13); #22=IFCLOCALPLACEMENT($,#20); #23=IFCLOCALPLACEMENT(#22,#21);
#24=IFCCARTESIANPOINT((0.,0.)); #25=IFCAXIS2PLACEMENT2D(#24,$);
#30=IFCRECTANGLEPROFILEDEF(.AREA.,$,#25,2000.,4000.); #31=IFCEXTRUDEDAREASOLID(#30,#20,#12,3000.);
#32=IFCSHAPEREPRESENTATION($,'Body','SweptSolid',(#31)); #33=IFCPRODUCTDEFINITIONSHAPE($,$,(#32));
#40=IFCWALL('0123456789012345678901',$,'Wall',$,$,#23,#33,$);
#50=IFCCARTESIANPOINTLIST3D(((0.,0.,0.),(1000.,0.,0.),(0.,1000.,0.),(0.,0.,1000.))); #51=IFCTRIANGULATEDFACESET(#50,$,.T.,((1,3,2),(1,2,4),(2,3,4),(1,4,3)),$);
#52=IFCSHAPEREPRESENTATION($,'Body','Tessellation',(#51)); #53=IFCPRODUCTDEFINITIONSHAPE($,$,(#52)); #54=IFCSLAB('1123456789012345678901',$,'Tetra',$,$,#22,#53,$);
#60=IFCMATERIAL('Brick'); #61=IFCMATERIAL('Air'); #62=IFCMATERIALLAYER(#60,100.,$); #63=IFCMATERIALLAYER(#61,50.,$); #64=IFCMATERIALLAYERSET((#62,#63),$); #65=IFCMATERIALLAYERSETUSAGE(#64,.AXIS2.,.POSITIVE.,0.);
#66=IFCRELASSOCIATESMATERIAL('2123456789012345678901',$,$,$,(#40),#65); #67=IFCMATERIALLIST((#60)); #68=IFCRELASSOCIATESMATERIAL('3123456789012345678901',$,$,$,(#54),#67); #69=IFCRELASSOCIATESMATERIAL('4123456789012345678901',$,$,$,(#54),#61);
#70=IFCSPACE('5123456789012345678901',$,'Room',$,$,#22,$,$);
ENDSEC; END-ISO-10303-21;"""


def volume(t):
    a, b, c = t[:, :3], t[:, 3:6], t[:, 6:]
    return (a * np.cross(b, c)).sum() / 6


def test_building_solids(spark, tmp_path):
    where = put(tmp_path / "i", "a.ifc", IFC)
    rows = solids.element_triangles(spark, where).toPandas()
    corners = [f"{v}{c}" for v in "abc" for c in "xyz"]
    wall, slab = (rows[rows.name == n][corners].to_numpy() for n in ("Wall", "Tetra"))
    assert len(wall) == 12 and volume(wall) == pytest.approx(24) and volume(slab) == pytest.approx(1 / 6)
    # x goes along the file's y here
    assert wall.reshape(-1, 3).min(0) == pytest.approx([-1, 1, 0]) and wall.reshape(-1, 3).max(0) == pytest.approx([3, 3, 3])
    assert solids.element_triangles(spark, where, ids=("1123456789012345678901",)).count() == 4 and solids.element_triangles(spark, where, classes=("IFCDOOR",)).count() == 0
    got = sorted((r.id, r.material) for r in solids.element_materials(spark, where).collect())
    assert got == [(40, "Air"), (40, "Brick"), (54, "Air"), (54, "Brick")]


def test_triangulated_polygons():
    star = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    for p in (star, star[::-1]):
        t = solids.triangulated(p)
        area = sum((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0]) for a, b, c in t) / 2
        assert len(t) == 3 and area == pytest.approx(10)


DXF = """0\nSECTION\n2\nTABLES\n0\nLAYER\n2\nwalls\n62\n1\n0\nENDSEC\n0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nchair\n10\n1\n20\n0\n0\nLINE\n8\n0\n10\n1\n20\n0\n11\n3\n21\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES
0\nINSERT\n8\nwalls\n2\nchair\n10\n10\n20\n5\n41\n2\n42\n2\n43\n2\n50\n90\n0\nELLIPSE\n8\nwalls\n10\n0\n20\n0\n11\n2\n21\n0\n40\n0.5\n41\n0\n42\n3.141592653589793\n0\nPOINT\n8\np\n10\n7\n20\n8\n30\n9
0\nINSERT\n8\nwalls\n2\nnothing\n10\n0\n20\n0\n30\n0\n41\n0.5\n42\n1\n43\n1\n0\nENDSEC\n0\nEOF\n"""


def test_drawings(spark, tmp_path):
    where = put(tmp_path / "d", "a.dxf", DXF)
    every = files.drawing(spark, where)
    model = files.entities(spark, where)
    assert [r.dtype for r in model.orderBy("seq").collect()] == ["INSERT", "ELLIPSE", "POINT", "INSERT"] and files.entities(spark, where, dtypes=("POINT",)).count() == 1 and files.entities(spark, where, layers=("p",)).count() == 1
    assert files.layer_colors(every).first().rgb == [255, 0, 0]
    exploded = files.exploded_blocks(every)
    (line,) = exploded.where("dtype = 'LINE'").collect()
    assert line.layer == "walls" and np.allclose(line.points, [[10, 5, 0], [10, 9, 0]]) and exploded.where("dtype = 'INSERT'").count() == 1
    lines = files.entity_lines(model).toPandas()
    oval = lines[lines.dtype == "ELLIPSE"].sort_values("lid")
    assert len(oval) == 9 and oval.iloc[0][["x0", "y0"]].tolist() == [2, 0] and oval.iloc[-1][["x1", "y1"]].tolist() == pytest.approx([-2, 0], abs=1e-12) and oval[["y0", "y1"]].max().max() <= 1
    cube = lines[(lines.dtype == "INSERT") & (lines.seq == lines[lines.dtype == "INSERT"].seq.max())]
    assert len(cube) == 12 and cube[["x0", "x1"]].max().max() == pytest.approx(2) and cube[["z0", "z1"]].max().max() == pytest.approx(1)
    assert tuple(files.entity_points(model).select("x", "y", "z").first()) == (7, 8, 9)
    assert files.layer_lines(files.entity_lines(exploded), files.layer_colors(every)).where("dtype = 'LINE'").first().rgb == [1, 0, 0]


def test_ortho_frames(spark, tmp_path):
    text = "0\nSECTION\n2\nENTITIES\n0\nINSERT\n2\nb\n10\n0\n20\n0\n0\nATTRIB\n1\n/x/photo.tif\n0\nLWPOLYLINE\n70\n1\n38\n2\n10\n0\n20\n0\n10\n4\n20\n0\n10\n4\n20\n2\n10\n0\n20\n2\n0\nENDSEC\n0\nEOF\n"
    rows = files.entities(spark, put(tmp_path / "d", "a.dxf", text))
    (r,) = files.ortho_frames(rows, image_width=100, height=1.0).collect()
    assert (r.name, r.gsd) == ("photo", 0.04) and [r.t[k] for k in (3, 7, 11)] == [2, 1, 3] and [r.t[k] for k in (2, 6, 10)] == pytest.approx([0, 0, 1])
    assert files.ortho_frames(rows, name="other").count() == 0


def test_las_extras(spark, tmp_path):
    rng = np.random.default_rng(3)
    own = {c: rng.random(50).round(3) for c in "xyz"} | {"nx": rng.random(50), "ny": rng.random(50), "nz": rng.random(50), "height": rng.random(50)}
    data = formats.write_las(own, extra=("height",))
    back = formats.read_las(data, extra=True)
    assert np.allclose(back["x"], own["x"], atol=1e-3) and np.array_equal(back["nx"], own["nx"]) and np.array_equal(back["height"], own["height"]) and "height" not in formats.read_las(data)
    where = put(tmp_path / "l", "a.las", data)
    r = files.las_points(spark, where, ("height", "other")).where("pid = 7").first()
    assert (r.height, r.other, r.nz) == (own["height"][7], None, own["nz"][7]) and files.points(spark, where).where("pid = 7").first().nx == own["nx"][7]


def test_lines_and_resources(spark, tmp_path):
    lines = spark.createDataFrame([("s", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), ("s", 1.0, 0.0, 0.0, 1.0, 2.0, 0.0)], "subject string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    out = tmp_path / "sets"
    assert files.save_files(files.encoded_lines(lines), files.resource_path(F.lit(f"file://{out}/"), F.lit("http://x/a b.ply"), "ply")) == 1
    back = files.line_sets(spark, f"file://{out}").orderBy("lid").collect()
    assert [x.name for x in out.iterdir()] == ["a_b.ply"] and sorted((r.x0, r.y0, r.x1, r.y1) for r in back) == [(0, 0, 1, 0), (1, 0, 1, 2)]
    listed = files.listed(spark, f"file://{out}")
    path = listed.first().path
    nodes = spark.createDataFrame([("a", "LineSetNode", path), ("b", "ImageNode", path), ("c", "LineSetNode", "file:/none.ply")], "subject string, kind string, path string")
    assert [r.subject for r in files.loadable(nodes, listed).collect()] == ["a"] and listed.first().modified is not None
    cloud = spark.range(10_000).select(F.lit("s").alias("subject"), F.col("id").alias("pid"))
    assert 2300 < files.sampled(cloud, 0.25).count() < 2700


def test_workbooks(spark, tmp_path):
    rows = [["", "", "", "roof construction", "", "", "x", "", "", "", "C", "", "", "", "", "", "x"], ["a & b", 1, 2.5, None, "é"], [], ["", "walls"]]
    data = loa.write_workbook(rows)
    back = loa.read_workbook(data)
    assert back[0][3] == "roof construction" and back[1][:3] == ["a & b", "1", "2.5"] and back[1][4] == "é"
    where = put(tmp_path / "w", "a.xlsx", data)
    found = {r.name: r for r in loa.sheet_overrides(loa.sheets(spark, where)).collect()}
    assert (found["roof construction"].LOAm, found["roof construction"].LOAr, found["roof construction"].validation) == (20, 40, "C") and found["walls"].LOAm is None
    put(tmp_path / "w", "LOA.csv", "subject;CSI;LOAm;LOAr;validation\nB1020_ROOF_CONSTRUCTION;B1020;10;10;B\nB2010_EXTERIOR_WALLS;B2010;30;30;A\n")
    table = loa.read_specification(spark, f"file://{tmp_path}/w/LOA.csv")
    got = {r.subject: (r.LOAm, r.LOAr, r.validation) for r in loa.overridden(table, loa.sheet_overrides(loa.sheets(spark, where))).collect()}
    assert got == {"B1020_ROOF_CONSTRUCTION": (20, 40, "C"), "B2010_EXTERIOR_WALLS": (30, 30, "A")}
    levels = spark.createDataFrame([("w1", "LOA20", 1.0, 0.99, 0.5), ("0", "NO_LOA", 0.0, 0.0, 0.0)], "name string, loa string, r10 double, r20 double, r30 double")
    seen = spark.createDataFrame([("w1", 0.8)], "name string, visible double")
    report = loa.report(levels, seen)
    assert loa.read_workbook(loa.workbook_report(report)) == [["Name", "LOA", "LOA10", "LOA20", "LOA30", "Theoretical visibility"], ["w1", "LOA20", "1.0", "0.99", "0.5", "0.8"]]
    loa.write_csv_report(report, f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).first().LOA == "LOA20"


def test_corners_and_descriptors(spark):
    rng = np.random.default_rng(4)
    a = np.full((80, 90), 40.0)
    for k in range(12):
        v, u = rng.integers(8, 60, 2)
        a[v : v + 9, u : u + 9] = 60 + 15 * k
    shifted = np.full((80, 90), 40.0)
    shifted[5:, 4:] = a[:-5, :-4]
    rows = [(name, k, x.tolist()) for name, image in (("a", a), ("b", shifted)) for k, x in enumerate(image)]
    lines = spark.createDataFrame(rows, "subject string, row int, values array<double>")
    found = vision.features(lines, most=200).toPandas()
    p, q = (found[found.subject == s] for s in "ab")
    assert len(p) > 10
    from geoweft.operators.joins import mutual_matches

    pairs = mutual_matches(spark.createDataFrame(p[["id", "code"]]), spark.createDataFrame(q[["id", "code"]])).toPandas()
    at = lambda df, ids: df.set_index("id").loc[ids, ["u", "v"]].to_numpy()
    step = at(q, pairs["b"]) - at(p, pairs["a"])
    assert (np.abs(step - [4, 5]).max(1) < 0.5).mean() > 0.6
    marks = vision.marks(spark.createDataFrame([("a", 10.0, 10.0)], "subject string, u double, v double"), 2)
    assert marks.count() == 16
    px = spark.createDataFrame([("a", 8, 8, [1, 1, 1]), ("a", 10, 10, [1, 1, 1])], "subject string, row int, col int, values array<int>")
    assert sorted(tuple(r["values"]) for r in vision.painted(px, marks, (9, 0, 0)).collect()) == [(1, 1, 1), (9, 0, 0)]
    grey = vision.grey(spark.createDataFrame([("a", 0, 2, 3, [3, 6, 9, 1, 1, 1])], "subject string, row int, width int, channels int, values array<int>")).first()
    assert grey["values"] == [6, 1]


def test_images_as_verbs(spark):
    z = np.full((12, 12), 2.0)
    lines = spark.createDataFrame([("s", k, x.tolist()) for k, x in enumerate(z)], "subject string, row int, depths array<double>")
    n = np.array([r["values"] for r in vision.depth_normals(lines, 100.0, 6.0, 6.0).orderBy("row").collect()]).reshape(12, 12, 3)
    assert np.allclose(n[3:-3, 3:-3], [0, 0, -1], atol=1e-6)
    assert len(vision.hha_images(lines, 100.0, 6.0, 6.0).first()["values"]) == 36
    g = vision.gravity_directions(lines, 100.0, 6.0, 6.0).first()
    assert np.hypot(np.hypot(g.x, g.y), g.z) == pytest.approx(1)
    black = spark.createDataFrame([("s", k, [9.0] * 3 + [0.0] + [9.0] * 3) for k in range(7)], "subject string, row int, values array<double>")
    assert all(set(r["values"]) == {9.0} for r in vision.without_black(black, 3).collect())

