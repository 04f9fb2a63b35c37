"""Readers that turn folders of files into tables, a task for several files each, through Spark's own file sources, so any store that Spark reads will do."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.functions import literals as X
from geoweft.sources import formats, turtle

POINTS = "subject string, pid long, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double, intensity double"
#: So many rows of one file are handed on at once.
BATCH = 100_000
CLOUDS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {"ply": lambda d: formats.read_ply(d)[0], "pcd": formats.read_pcd, "las": formats.read_las, "obj": lambda d: formats.read_obj(d)[0]}
MESHES = {"ply": formats.read_ply, "obj": formats.read_obj}
#: Which file types each kind of node may have.
EXTENSIONS = {"PointCloudNode": ("pcd", "e57", "pts", "ply", "las", "laz"), "MeshNode": ("obj", "ply", "fbx"), "LineSetNode": ("ply", "dxf", "tfw"), "BIMNode": ("ply", "dxf", "tfw", "ifc", "obj", "fbx"), "ImageNode": ("jpg", "png", "jpeg", "tif"), "OrthoNode": ("jpg", "png", "jpeg", "tif"), "PanoNode": ("jpg", "png", "jpeg", "tif"), "Node": ("ttl",)}


def extension(path: str) -> str:
    return path.rpartition(".")[2].lower()


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _each(parse: Callable[[str, bytes], Iterator[pd.DataFrame]], columns: list[str]):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for part in parse(path, content):
                    # what isn't there is None, not a number, so that arrays may be missing too
                    own = {c: part[c] if c in part else pd.Series([None] * len(part), part.index, object) for c in columns}
                    yield pd.DataFrame({c: v.where(v.notna(), None) if v.dtype == object else v for c, v in own.items()}, columns=columns)

    return make


def _names(schema: str) -> list[str]:
    depth, out, now = 0, [], ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now.strip().split(" ")[0])
            now = ""
        else:
            now += ch
    return out


def read_each(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[pd.DataFrame]], schema: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows that parse makes of each file of the kinds; files of other kinds aren't read."""
    files = binary(spark, path).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds))
    return files.mapInPandas(_each(parse, _names(schema)), schema)


def points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all PLY, PCD, LAS and OBJ files, subject being the file's path."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        columns = CLOUDS[extension(path)](content)
        n = len(columns["x"])
        for k in range(0, n, BATCH):
            yield pd.DataFrame({c: v[k : k + BATCH] for c, v in columns.items()} | {"subject": path, "pid": np.arange(k, min(k + BATCH, n))})

    return read_each(spark, path, parse, POINTS, tuple(CLOUDS))


def faces(spark: SparkSession, path: str) -> DataFrame:
    """Faces of PLY and OBJ files as triangles around their first corner."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        triangles = [(f[0], f[k], f[k + 1]) for f in MESHES[extension(path)](content)[1] for k in range(1, len(f) - 1)]
        for k in range(0, len(triangles), BATCH):
            a = np.array(triangles[k : k + BATCH], np.int64)
            yield pd.DataFrame({"subject": path, "fid": np.arange(k, k + len(a)), "a": a[:, 0], "b": a[:, 1], "c": a[:, 2]})

    return read_each(spark, path, parse, "subject string, fid long, a long, b long, c long", tuple(MESHES))


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: subject, fid, ax .. cz. One join of all corners, gathered by face."""
    corners = faces.select("subject", "fid", F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), F.col(c).alias("pid")) for c in "abc"))).alias("v")).select("subject", "fid", "v.corner", "v.pid")
    placed = corners.join(vertices.select("subject", "pid", "x", "y", "z"), ["subject", "pid"])
    return placed.groupBy("subject", "fid").agg(*(F.max(F.when(F.col("corner") == c, F.col(k))).alias(f"{c}{k}") for c in "abc" for k in "xyz"))


ENTITY = "subject string, seq int, dtype string, owner string, layer string, handle string, color int, text string, block string, radius double, start double, end double, closed boolean, points array<array<double>>, scale array<double>, extrusion array<double>"


def drawing(spark: SparkSession, path: str) -> DataFrame:
    """All rows of DXF files: entities of model space (owner null) and of blocks, blocks and layers."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = formats.read_dxf(content)
        if rows:
            yield pd.DataFrame(rows, dtype=object).assign(subject=path)

    return read_each(spark, path, parse, ENTITY, ("dxf",))


def entities(spark: SparkSession, path: str, dtypes: tuple[str, ...] | None = None, layers: tuple[str, ...] | None = None) -> DataFrame:
    """Entities in the model space of DXF files, of the types and on the layers if given."""
    rows = drawing(spark, path).where("owner IS NULL AND dtype NOT IN ('BLOCK', 'LAYER')").drop("owner")
    rows = rows if dtypes is None else rows.where(F.col("dtype").isin(*dtypes))
    return rows if layers is None else rows.where(F.col("layer").isin(*layers))


def layer_colors(rows: DataFrame) -> DataFrame:
    """Layers of drawings with their colour: subject, layer, rgb (from 0 to 255)."""
    return rows.where("dtype = 'LAYER'").groupBy("subject", F.col("block").alias("layer")).agg(X.aci_rgb(F.abs(F.min("color"))).alias("rgb"))


def exploded_blocks(rows: DataFrame, depth: int = 4) -> DataFrame:
    """Entities in model space, with the parts of blocks in place of the inserts that name them: scaled, turned and moved, block within block, at most so deep.

    Circles and arcs of blocks keep their shape only under equal scales. An insert whose block has no part stays.
    """
    blocks = rows.where("dtype = 'BLOCK'").select("subject", F.col("block").alias("owner"), F.get("points", F.lit(0)).alias("_base"))
    parts = rows.where("owner IS NOT NULL AND dtype NOT IN ('BLOCK', 'LAYER')").join(blocks, ["subject", "owner"])
    inner = parts.select(F.col("subject").alias("_file"), F.col("owner").alias("_name"), "_base", F.struct("seq", "dtype", "layer", "handle", "color", "text", "block", "radius", "start", "end", "closed", "points", "scale", "extrusion").alias("_e"))
    now = rows.where("owner IS NULL AND dtype NOT IN ('BLOCK', 'LAYER')").drop("owner")
    done = now.where("dtype <> 'INSERT'")
    inserts = now.where("dtype = 'INSERT'")
    for _ in range(depth):
        # named apart, so that the new columns of the same names don't stand in for them
        own = {"_at": F.get("points", F.lit(0)), "_size": F.array(*(F.coalesce(F.get("scale", F.lit(k)), F.lit(1.0)) for k in range(3))), "_turn": F.coalesce("start", F.lit(0.0))}
        at, size, turn = F.col("_at"), F.col("_size"), F.radians("_turn")
        placed = lambda p: L.let(L.vec(*((p[k] - F.col("_base")[k]) * size[k] for k in range(3))), lambda q: L.vec(at[0] + q[0] * F.cos(turn) - q[1] * F.sin(turn), at[1] + q[0] * F.sin(turn) + q[1] * F.cos(turn), at[2] + q[2]))  # noqa: E731, B023
        met = inserts.join(inner, (F.col("subject") == F.col("_file")) & (F.col("block") == F.col("_name")), "left").withColumns(own)
        e = F.col("_e")
        moved = met.where("_e IS NOT NULL").select(
            "subject", "seq", e["dtype"].alias("dtype"), F.coalesce(F.nullif(e["layer"], F.lit("0")), "layer").alias("layer"), e["handle"].alias("handle"), F.coalesce(e["color"], F.col("color")).alias("color"), F.coalesce(e["text"], F.col("text")).alias("text"), e["block"].alias("block"),
            F.when(e["dtype"].isin("CIRCLE", "ARC"), e["radius"] * F.abs(size[0])).otherwise(e["radius"]).alias("radius"),
            F.when(e["dtype"].isin("ARC", "INSERT"), F.coalesce(e["start"], F.lit(0.0)) + F.col("_turn")).otherwise(e["start"]).alias("start"),
            F.when(e["dtype"] == "ARC", e["end"] + F.col("_turn")).otherwise(e["end"]).alias("end"), e["closed"].alias("closed"),
            F.transform(e["points"], placed).alias("points"), F.when(e["dtype"] == "INSERT", F.array(*(F.coalesce(F.get(e["scale"], F.lit(k)), F.lit(1.0)) * size[k] for k in range(3)))).otherwise(e["scale"]).alias("scale"), e["extrusion"].alias("extrusion"),
        )
        done = done.unionByName(met.where("_e IS NULL").drop("_file", "_name", "_base", "_e", *own)).unionByName(moved.where("dtype <> 'INSERT'"))
        inserts = moved.where("dtype = 'INSERT'")
    return done.unionByName(inserts)


#: The 12 edges of a unit cube, by the numbers of its corners (1 for x, 2 for y, 4 for z).
CUBE = tuple((k, k | b) for b in (1, 2, 4) for k in range(8) if not k & b)


def entity_lines(rows: DataFrame) -> DataFrame:
    """Segments of the entities: consecutive points of lines, polylines, splines and faces, closed ones with their last segment, circles every 10 degrees, arcs and ellipses by 10 points, and a cube for each insert, whose sides are one over its scales."""
    p = F.col("points")
    centre = p[0]
    angle = lambda lo, hi, k, n: F.radians(lo + (hi - lo) * k / n)
    end = F.when(F.col("end") < F.col("start"), F.col("end") + 360).otherwise(F.col("end"))
    ring = lambda lo, hi, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.array(centre[0] + F.col("radius") * F.cos(angle(lo, hi, k, n)), centre[1] + F.col("radius") * F.sin(angle(lo, hi, k, n)), centre[2]))
    major, normal = F.get(p, F.lit(1)), F.col("extrusion")
    first, last = (F.coalesce(F.get("scale", F.lit(k)), F.lit(v)) for k, v in ((0, 0.0), (1, 2 * math.pi)))
    minor = L.scale(L.cross(L.normalize(normal), major), F.col("radius"))
    oval = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: L.let(first + (F.when(last <= first, last + 2 * math.pi).otherwise(last) - first) * k / 9, lambda t: L.vec(*(centre[c] + F.cos(t) * major[c] + F.sin(t) * minor[c] for c in range(3)))))
    path = F.when(F.col("dtype") == "CIRCLE", ring(F.lit(0.0), F.lit(350.0), 35)).when(F.col("dtype") == "ARC", ring(F.col("start"), end, 9)).when(F.col("dtype") == "ELLIPSE", oval)
    path = path.otherwise(F.when(F.col("closed") | F.col("dtype").isin("3DFACE", "SOLID"), F.concat(p, F.slice(p, 1, 1))).otherwise(p))
    turn = F.radians(F.coalesce("start", F.lit(0.0)))
    side = [1 / F.coalesce(F.nullif(F.get("scale", F.lit(k)), F.lit(0.0)), F.lit(1.0)) for k in range(3)]
    up = L.normalize(normal)

    def corner(k: int) -> Column:
        x, y, z = (side[n] if k >> n & 1 else F.lit(0.0) for n in range(3))
        return L.let(L.vec(x * F.cos(turn) - y * F.sin(turn), x * F.sin(turn) + y * F.cos(turn), z), lambda q: L.vec(centre[0] + q[0] + up[0] * q[2], centre[1] + q[1] + up[1] * q[2], centre[2] + up[2] * q[2]))

    kinds = ("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "ELLIPSE", "SPLINE", "3DFACE", "SOLID")
    out = rows.where(F.col("dtype").isin(*kinds)).withColumn("_path", path).where(F.size("_path") >= 2)
    segments = F.transform(F.sequence(F.lit(0), F.size("_path") - 2), lambda k: F.struct(k.alias("lid"), F.get(F.col("_path"), k).alias("p"), F.get(F.col("_path"), k + 1).alias("q")))
    cubes = F.array(*(F.struct(F.lit(n).alias("lid"), corner(a).alias("p"), corner(b).alias("q")) for n, (a, b) in enumerate(CUBE)))
    every = out.select("subject", "seq", "layer", "dtype", F.explode(segments).alias("s")).union(rows.where("dtype = 'INSERT' AND size(points) >= 1").select("subject", "seq", "layer", "dtype", F.explode(cubes).alias("s")))
    return every.select("subject", "seq", "layer", "dtype", "s.lid", *(F.col(f"s.{v}")[k].alias(f"{c}{n}") for v, n in (("p", 0), ("q", 1)) for k, c in enumerate("xyz")))


def entity_points(rows: DataFrame) -> DataFrame:
    """Places of point entities: subject, seq, layer, x, y, z."""
    at = F.get("points", F.lit(0))
    return rows.where("dtype = 'POINT' AND size(points) >= 1").select("subject", "seq", "layer", *(at[k].alias(c) for k, c in enumerate("xyz")))


def layer_lines(lines: DataFrame, colors: DataFrame) -> DataFrame:
    """Lines of each layer with its colour as shares of 1; white where the layer has none."""
    white = L.vec(1, 1, 1)
    return lines.join(colors, ["subject", "layer"], "left").withColumn("rgb", F.coalesce(F.transform("rgb", lambda x: x / 255), white))


def ortho_frames(rows: DataFrame, name: str | None = None, image_width: int = 1, height: float = 0.0) -> DataFrame:
    """Orthophotos whose frames a drawing holds as pairs of an insert with a text and a polyline: subject, seq, name, t, gsd.

    The pose stands in the frame's middle, raised by height, z along its normal and y along its fourth corner; gsd is the length of its first side along x over the image's width.
    """
    w = Window.partitionBy("subject").orderBy("seq")
    stem = F.regexp_extract("text", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    pairs = rows.withColumns({"_k": F.row_number().over(w) - 1, "_p": F.lead("points").over(w)}).where("_k % 2 = 0 AND text IS NOT NULL AND size(_p) >= 4").withColumn("name", stem)
    pairs = pairs if name is None else pairs.where(F.col("name") == name)
    p = F.col("_p")
    side, up = (L.sub(F.get(p, F.lit(k)), F.get(p, F.lit(0))) for k in (1, 3))
    mean = lambda k: F.aggregate(F.transform(p, lambda q: q[k]), F.lit(0.0), lambda s, x: s + x) / F.size(p)
    middle = L.vec(mean(0), mean(1), mean(2) + height)
    pose = L.let(F.array(L.normalize(L.cross(side, up)), up, middle), lambda v: L.mat4_of(L.rotation_from_forward_up(v[0], v[1]), v[2]))
    return pairs.select("subject", "seq", "name", pose.alias("t"), (F.abs(side[0]) / image_width).alias("gsd"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files: subject, predicate, object, datatype, graph (the file's path)."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = list(turtle.parse(content.decode()))
        if rows:
            yield pd.DataFrame(rows, columns=["subject", "predicate", "object", "datatype"]).assign(graph=path)

    return read_each(spark, path, parse, "subject string, predicate string, object string, datatype string, graph string", ("ttl",))


def panoramas(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """Every skip-th pose of semicolon-separated pose lists, whose first line begins with #: id, filename, timestamp, position, quaternion (x, y, z, w) and pose t."""
    schema = "id int, filename string, timestamp double, x double, y double, z double, qw double, qx double, qy double, qz double"
    rows = spark.read.csv(path, sep=";", comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    pose = L.mat4_from_quat([F.col(f"q{c}") for c in "xyzw"], [F.col(c) for c in "xyz"])
    return rows.where(F.col("id").isNotNull() & (F.col("id") % skip == 0)).withColumn("t", pose)


def world_files(spark: SparkSession, path: str) -> DataFrame:
    """World files: subject and the numbers a, d, b, e, c, f."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([[path, *formats.read_tfw(content)]], columns=["subject", *"adbecf"])

    return read_each(spark, path, parse, "subject string, a double, d double, b double, e double, c double, f double", ("tfw",))


def camera_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Camera sidecar files: focal length, principal point, coordinates, rotation by rows, position, distortion."""
    schema = "subject string, focal35 double, ppu double, ppv double, coordinates string, rotation array<double>, position array<double>, distortion array<double>"

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        x = formats.read_xmp(content)
        number = lambda k: float(x[k]) if k in x else None
        yield pd.DataFrame([{"subject": path, "focal35": number("FocalLength35mm"), "ppu": number("PrincipalPointU"), "ppv": number("PrincipalPointV"), "coordinates": x.get("Coordinates"), "rotation": x.get("Rotation"), "position": x.get("Position"), "distortion": x.get("DistortionCoeficients")}])

    return read_each(spark, path, parse, schema, ("xmp",))


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """Scans of E57 descriptions in XML: subject, scan, name, count, rotation, translation, bounds and pose t."""
    schema = "subject string, scan int, name string, count long, rotation array<double>, translation array<double>, bounds array<double>"

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = formats.read_e57_xml(content)
        if rows:
            yield pd.DataFrame(rows).assign(subject=path, scan=range(len(rows)))

    rows = read_each(spark, path, parse, schema, ("xml",))
    return rows.withColumn("t", L.mat4_from_quat(F.col("rotation"), F.col("translation")))


def encoded(points: DataFrame, kind: str, faces: DataFrame | None = None) -> DataFrame:
    """Files of the kind (ply, pcd, las, obj), one of each subject: subject, content. A subject's points meet in one task, as its file must."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf["pid"].notna()].sort_values("pid")
        own = {c: rows[c].to_numpy() for c in formats.POINT if c in rows and rows[c].notna().all() and len(rows)} or {c: np.zeros(0) for c in "xyz"}
        ends = pdf[pdf["fid"].notna()].sort_values("fid") if "fid" in pdf else pdf.iloc[:0]
        corners = [tuple(map(int, t)) for t in ends[["a", "b", "c"]].itertuples(index=False)] if len(ends) else []
        content = {"ply": lambda: formats.write_ply(own, corners), "obj": lambda: formats.write_obj(own, corners), "pcd": lambda: formats.write_pcd(own), "las": lambda: formats.write_las(own)}[kind]()
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "content": [content]})

    rows = points if faces is None else points.unionByName(faces, allowMissingColumns=True)
    return rows.groupBy("subject").applyInPandas(build, "subject string, content binary")


def encoded_graphs(triples: DataFrame, by: str = "graph") -> DataFrame:
    """Turtle text of each graph: graph, content."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(s, p, o, None if d is None or d != d else d) for s, p, o, d in pdf[["subject", "predicate", "object", "datatype"]].itertuples(index=False)]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "content": [turtle.serialize(rows)]})

    return triples.groupBy(by).applyInPandas(build, f"{by} string, content string")


def building_elements(spark: SparkSession, path: str, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Records of IFC files, of the classes if given; the class is upper case as in the file."""
    schema = "subject string, id long, class_name string, arguments array<string>, global_id string, name string, object_type string"

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = [r for r in formats.read_step(content) if not classes or r["class_name"] in classes]
        for k in range(0, len(rows), BATCH):
            yield pd.DataFrame(rows[k : k + BATCH], dtype=object).assign(subject=path)

    return read_each(spark, path, parse, schema, ("ifc",))


# resources of nodes


def allowed(path: Column, kind: Column) -> Column:
    """Whether a file's type is one of those that a node of the kind may have."""
    table = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(table, kind), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(False))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, length, modified."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def loadable(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes (subject, kind, path) whose file is there and of an allowed type."""
    return nodes.where(allowed(F.col("path"), F.col("kind"))).join(files.select("path").distinct(), "path", "left_semi")


def resource_path(directory: Column, subject: Column, ending: str) -> Column:
    """Where a node's resource is kept: the directory, the last part of the subject without its ending, and the file type."""
    name = X.validate_string(F.regexp_replace(X.subject_name(subject), r"\.[A-Za-z0-9]{1,4}$", ""))
    return F.concat(F.regexp_replace(directory, r"/+$", ""), F.lit("/"), name, F.lit(ending if ending.startswith(".") else f".{ending}"))


def sampled(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A random share of points, the same for the same seed and files."""
    return points.where(F.pmod(F.xxhash64("subject", "pid", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def save_files(encoded: DataFrame, path: Column) -> int:
    """Writes each row's content (bytes or text) to its path, by the tasks that hold them, through Arrow's file systems (file, hdfs, s3, gs); how many were written.

    A file is written beside its place and then moved there, so a task that is run again leaves whole files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                store, place = fs.FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                beside = f"{place}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content.encode() if isinstance(content, str) else bytes(content))
                store.move(beside, place)
            yield pd.DataFrame({"n": [len(b)]})

    return encoded.select(path.alias("path"), "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def encoded_lines(lines: DataFrame) -> DataFrame:
    """A PLY file of the lines (subject, x0 .. z1) of each subject: subject, content. Equal ends become one vertex."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = pdf[[f"{c}{n}" for n in "01" for c in "xyz"]].to_numpy(float).reshape(-1, 3)
        corners, at = np.unique(ends, axis=0, return_inverse=True)
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "content": [formats.write_ply(dict(zip("xyz", corners.T, strict=True)), edges=at.reshape(-1, 2).tolist())]})

    return lines.groupBy("subject").applyInPandas(build, "subject string, content binary")


def line_sets(spark: SparkSession, path: str) -> DataFrame:
    """Lines of PLY and OBJ files: subject, lid, x0 .. z1."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        points, _, edges = MESHES[extension(path)](content)
        if len(edges):
            p, e = np.stack([points[c] for c in "xyz"], 1), np.array(edges, np.int64)
            for k in range(0, len(e), BATCH):
                part = np.concatenate([p[e[k : k + BATCH, 0]], p[e[k : k + BATCH, 1]]], axis=1)
                yield pd.DataFrame(part, columns=[f"{c}{n}" for n in "01" for c in "xyz"]).assign(subject=path, lid=np.arange(k, k + len(part)))

    return read_each(spark, path, parse, "subject string, lid long, " + ", ".join(f"{c}{n} double" for n in "01" for c in "xyz"), tuple(MESHES))


def las_points(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Points of LAS files with extra dimensions by name, null where a file has not. A file is read in one task."""
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".las"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                columns = formats.read_las(content, bool(extra))
                n = len(columns["x"])
                for k in range(0, n, BATCH):
                    yield pd.DataFrame({c: v[k : k + BATCH] for c, v in columns.items()} | {"subject": name, "pid": np.arange(k, min(k + BATCH, n))}).reindex(columns=[*_names(POINTS), *extra])

    return heads.select("path", "content").mapInPandas(parse, POINTS + "".join(f", `{c}` double" for c in extra))
