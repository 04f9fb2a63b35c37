"""E57 files: their description, the points of every scan, and a plain writer.

A file is pages of 1024 bytes that end in a checksum of four; without those it is one run of bytes. The description, in XML, says where each scan's points begin and of
what fields they are; they come in packets, in which every field has a stream of its own, of whole numbers packed by bits or of floating point ones.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.sources.files import BATCH, read_each

# Fixed values of the format: signature, bytes of a page and of its checksum, of the file's and a section's head, kind of a data packet.
SIGNATURE, PAGE, CHECK, HEAD, SECTION, DATA = b"ASTM-E57", 1024, 4, 48, 32, 1
#: The columns that fields become.
NAMES = {"cartesianX": "x", "cartesianY": "y", "cartesianZ": "z", "sphericalRange": "range", "sphericalAzimuth": "azimuth", "sphericalElevation": "elevation", "colorRed": "red", "colorGreen": "green", "colorBlue": "blue", "intensity": "intensity", "normalX": "nx", "normalY": "ny", "normalZ": "nz", "cartesianInvalidState": "invalid", "sphericalInvalidState": "invalid"}
RAW = ("x", "y", "z", "range", "azimuth", "elevation", "red", "green", "blue", "intensity", "nx", "ny", "nz")


def whole(data: bytes) -> bytes:
    """The file without its pages' checksums."""
    a = np.frombuffer(data, np.uint8)
    full = len(a) // PAGE
    body = a[: full * PAGE].reshape(full, PAGE)[:, : PAGE - CHECK].ravel()
    return body.tobytes() + a[full * PAGE :].tobytes()


def _logical(physical: int) -> int:
    return physical // PAGE * (PAGE - CHECK) + physical % PAGE


def description(data: bytes) -> bytes:
    """The XML in a file."""
    if data[:8] != SIGNATURE:
        raise ValueError("no E57 header")
    at, n = struct.unpack_from("<QQ", data, 24)
    at = _logical(at)
    return whole(data)[at : at + n]


def _fields(points: ET.Element) -> list[tuple[str, str, dict]]:
    out = []
    for f in points.find("prototype"):
        name = f.tag.rpartition("}")[2].rpartition(":")[2]
        out.append((name, f.get("type", "Float"), dict(f.attrib)))
    return out


def _decoded(stream: bytes, n: int, kind: str, facts: dict) -> np.ndarray:
    if kind == "Float":
        return np.frombuffer(stream, "<f4" if facts.get("precision") == "single" else "<f8", n).astype(float)
    low, high = int(facts.get("minimum", -(1 << 63))), int(facts.get("maximum", (1 << 63) - 1))
    bits = (high - low).bit_length()
    if not bits:
        values = np.full(n, low, np.int64)
    elif bits in (8, 16, 32, 64):
        values = np.frombuffer(stream, f"<u{bits // 8}", n).astype(np.int64) + low
    else:
        values = np.zeros(n, np.int64)
        for k in range(0, n, 1 << 20):
            m = min(1 << 20, n - k)
            first, last = k * bits // 8, -(-(k + m) * bits // 8)
            flat = np.unpackbits(np.frombuffer(stream, np.uint8, last - first, first), bitorder="little")[k * bits - 8 * first :][: m * bits].reshape(m, bits)
            values[k : k + m] = (flat.astype(np.int64) << np.arange(bits)).sum(axis=1) + low
    if kind == "ScaledInteger":
        return values * float(facts.get("scale", 1)) + float(facts.get("offset", 0))
    return values.astype(float)


def _strip(root: ET.Element) -> ET.Element:
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2].rpartition(":")[2]
    return root


def scans(data: bytes) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """(facts, columns) of each scan: name, rotation (x, y, z, w) and translation; the fields as NAMES has them, as doubles."""
    root, flat = _strip(ET.fromstring(description(data))), whole(data)
    for scan in root.iter("vectorChild"):
        points = scan.find("points")
        if points is None or points.get("fileOffset") is None:
            continue
        number = lambda path, default=0.0, scan=scan: float(scan.findtext(path) or default)
        facts = {"name": scan.findtext("name"), "rotation": [number(f"pose/rotation/{c}", float(c == "w")) for c in "xyzw"], "translation": [number(f"pose/translation/{c}") for c in "xyz"]}
        n, fields = int(points.get("recordCount", 0)), _fields(points)
        _, length, first, _ = struct.unpack_from("<QQQQ", flat, _logical(int(points.get("fileOffset"))))
        at, end = _logical(first), _logical(int(points.get("fileOffset"))) + length
        streams: list[list[bytes]] = [[] for _ in fields]
        while at < end:
            kind, _, size, count = struct.unpack_from("<BBHH", flat, at)
            if kind == DATA:
                sizes = struct.unpack_from(f"<{count}H", flat, at + 6)
                place = at + 6 + 2 * count
                for k, m in enumerate(sizes):
                    streams[k].append(flat[place : place + m])
                    place += m
            at += size + 1
        columns = {}
        for (name, kind, own), parts in zip(fields, streams, strict=True):
            if name in NAMES:
                columns[NAMES[name]] = _decoded(b"".join(parts), n, kind, own)
        yield facts, columns


def write(clouds: list[tuple[dict, dict[str, np.ndarray]]]) -> bytes:
    """A file of scans: facts may have name, rotation and translation; columns are x, y, z, and may be r, g, b (from 0 to 1), intensity and nx, ny, nz."""
    body, parts = bytearray(HEAD), []
    physical = lambda at: at // (PAGE - CHECK) * PAGE + at % (PAGE - CHECK)
    back = {v: k for k, v in NAMES.items() if v != "invalid"} | {"r": "colorRed", "g": "colorGreen", "b": "colorBlue"}
    for facts, columns in clouds:
        names = [c for c in ("x", "y", "z", "r", "g", "b", "intensity", "nx", "ny", "nz") if c in columns]
        n = len(columns["x"])
        flat = {c: np.rint(np.clip(columns[c], 0, 1) * 255).astype(np.uint8) if c in "rgb" else np.asarray(columns[c], "<f8") for c in names}
        body += bytes(-len(body) % 4)
        start = len(body)
        body += bytes(SECTION)
        for k in range(0, n, 500):
            streams = [flat[c][k : k + 500].tobytes() for c in names]
            packet = struct.pack("<BBHH", DATA, 0, 0, len(streams)) + struct.pack(f"<{len(streams)}H", *map(len, streams)) + b"".join(streams)
            packet += bytes(-len(packet) % 4)
            body += packet[:2] + struct.pack("<H", len(packet) - 1) + packet[4:]
        struct.pack_into("<QQQQ", body, start, 1, len(body) - start, physical(start + SECTION), 0)
        fields = "".join(f'<{"nor:" if c[0] == "n" and c != "name" else ""}{back[c]} type="Integer" minimum="0" maximum="255"/>' if c in "rgb" else f'<{"nor:" if c in ("nx", "ny", "nz") else ""}{back[c]} type="Float"/>' for c in names)
        q, t = facts.get("rotation", (0, 0, 0, 1)), facts.get("translation", (0, 0, 0))
        pose = "<pose type='Structure'><rotation type='Structure'>" + "".join(f"<{c} type='Float'>{v!r}</{c}>" for c, v in zip("xyzw", map(float, q), strict=True)) + "</rotation><translation type='Structure'>" + "".join(f"<{c} type='Float'>{v!r}</{c}>" for c, v in zip("xyz", map(float, t), strict=True)) + "</translation></pose>"
        parts.append(f"<vectorChild type='Structure'><name type='String'>{facts.get('name', '')}</name>{pose}<points type='CompressedVector' fileOffset='{physical(start)}' recordCount='{n}'><prototype type='Structure'>{fields}</prototype></points></vectorChild>")
    xml = ("<?xml version='1.0' encoding='UTF-8'?><e57Root type='Structure' xmlns='http://www.astm.org/COMMIT/E57/2010-e57-v1.0' xmlns:nor='http://www.libe57.org/E57_NOR_surface_normals.txt'><data3D type='Vector'>" + "".join(parts) + "</data3D></e57Root>").encode()
    at = len(body)
    body += xml
    body += bytes(-len(body) % (PAGE - CHECK))
    struct.pack_into("<8sIIQQQQ", body, 0, SIGNATURE, 1, 0, len(body) // (PAGE - CHECK) * PAGE, physical(at), len(xml), PAGE)
    pages = [bytes(body[k : k + PAGE - CHECK]) for k in range(0, len(body), PAGE - CHECK)]
    return b"".join(p + struct.pack(">I", zlib.crc32(p)) for p in pages)


def raw_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of all scans of E57 files as the files have them: subject, scan, pid, name, rotation, translation, and the fields RAW, null where a scan has not. Points that a scan marks as invalid are left out."""
    schema = "subject string, scan int, pid long, name string, rotation array<double>, translation array<double>, " + ", ".join(f"{c} double" for c in RAW)

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        for k, (facts, columns) in enumerate(scans(content)):
            n = len(next(iter(columns.values()), ()))
            for at in range(0, n, BATCH):
                part = pd.DataFrame({c: v[at : at + BATCH] for c, v in columns.items()}).assign(subject=path, scan=k, pid=np.arange(at, min(n, at + BATCH)), name=facts["name"])
                part["rotation"], part["translation"] = [facts["rotation"]] * len(part), [facts["translation"]] * len(part)
                yield part[part["invalid"] == 0] if "invalid" in part else part

    return read_each(spark, path, parse, schema, ("e57",))


def spherical(r: Column, azimuth: Column, elevation: Column) -> Column:
    """The point at a distance and two angles in radians."""
    return L.vec(r * F.cos(elevation) * F.cos(azimuth), r * F.cos(elevation) * F.sin(azimuth), r * F.sin(elevation))


def with_colors(points: DataFrame, by: tuple[str, ...] = ("subject", "scan")) -> DataFrame:
    """Points with r, g, b from 0 to 1: colours up to 1 stay, up to 255 are divided, others are spread from each channel's least to its greatest value; scans without colours are grey by intensity. What holds is decided for a whole scan, by its red."""
    spans = [f(c).alias(f"_{c}{n}") for c in ("red", "green", "blue", "intensity") for n, f in (("0", F.min), ("1", F.max))]
    own = points.groupBy(*by).agg(*spans)
    rows = points.join(own, [*by])
    spread = lambda c: (F.col(c) - F.col(f"_{c}0")) / F.nullif(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(0.0))
    grey = F.coalesce(spread("intensity"), F.when(F.col("intensity").isNotNull(), 0.0))
    color = lambda c: F.when(F.col("_red1").isNull(), grey).when(F.col("_red1") <= 1, F.col(c)).when(F.col("_red1") <= 255, F.col(c) / 255).otherwise(F.coalesce(spread(c), F.lit(0.0)))
    return rows.withColumns({s: color(c) for s, c in zip("rgb", ("red", "green", "blue"), strict=True)}).drop(*(f"_{c}{n}" for c in ("red", "green", "blue", "intensity") for n in "01"))


def points(spark: SparkSession, path: str, scan: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """Points of E57 files in the world: subject, scan, pid, name, x, y, z, r, g, b, nx, ny, nz, intensity. scan picks one scan of each file, share a random part of the points.

    Points with angles instead of coordinates are turned into such; the scan's pose moves points and turns normals.
    """
    rows = raw_points(spark, path)
    if scan is not None:
        rows = rows.where(F.col("scan") == scan)
    if share is not None:
        rows = rows.sample(fraction=share, seed=seed)
    rows = with_colors(rows)
    at = F.when(F.col("x").isNotNull(), L.vec(*(F.col(c) for c in "xyz"))).otherwise(spherical(F.col("range"), F.col("azimuth"), F.col("elevation")))
    rows = rows.withColumn("_t", L.mat4_from_quat(F.col("rotation"), F.col("translation"))).withColumns({"_p": L.mat4_apply(F.col("_t"), at), "_n": L.mat4_rotate(F.col("_t"), [F.col(f"n{c}") for c in "xyz"])})
    return rows.select("subject", "scan", "pid", "name", *(F.col("_p")[k].alias(c) for k, c in enumerate("xyz")), "r", "g", "b", *(F.col("_n")[k].alias(f"n{c}") for k, c in enumerate("xyz")), "intensity")


def scan_nodes(points: DataFrame) -> DataFrame:
    """A row for each scan of raw points: subject, scan, name, pose t, count."""
    first = F.first(F.struct("name", "rotation", "translation")).alias("f")
    return points.groupBy("subject", "scan").agg(first, F.count(F.lit(1)).alias("count")).select("subject", "scan", "f.name", L.mat4_from_quat(F.col("f.rotation"), F.col("f.translation")).alias("t"), "count")


def corrected_rotation(r: list[Column]) -> list[Column]:
    """A 3x3 rotation with the signs that some scanners' exports turn around."""
    signs = (-1, -1, 1, 1, 1, -1, 1, 1, -1)
    return [x * s for x, s in zip(r, signs, strict=True)]


def encoded(points: DataFrame) -> DataFrame:
    """An E57 file of one scan for each subject: subject, content. A subject's points meet in one task, as its file must."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pid")
        own = {c: rows[c].to_numpy(float) for c in ("x", "y", "z", "r", "g", "b", "intensity", "nx", "ny", "nz") if c in rows and rows[c].notna().all()}
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "content": [write([({"name": str(pdf["subject"].iloc[0])}, own)])]})

    return points.groupBy("subject").applyInPandas(build, "subject string, content binary")


