"""Poses of cameras in XML: photogrammetry projects, scanner panoramas, alignments of datasets."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import linalg as L
from geoweft.sources.files import read_each


def _root(data: bytes) -> ET.Element:
    """The document without namespaces."""
    return ET.fromstring(re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", data))


def _numbers(node: ET.Element | None, path: str = ".") -> list[float] | None:
    found = node.find(path) if node is not None else None
    return [float(x) for x in re.split(r"[\s,]+", found.text.strip())] if found is not None and found.text and found.text.strip() else None


def _one(node: ET.Element | None, path: str) -> float | None:
    return (_numbers(node, path) or [None])[0]


def _placed(node: ET.Element | None) -> dict:
    """rotation (by rows), translation and scale of a transform element."""
    return {"rotation": _numbers(node, "rotation"), "translation": _numbers(node, "translation"), "scale": _one(node, "scale")}


def read_project(data: bytes) -> tuple[list[dict], list[dict], list[dict]]:
    """Sensors, components and cameras of a photogrammetry project; component -1 is the whole chunk."""
    root = _root(data)
    sensors, cameras = [], []
    for s in root.iter("sensor"):
        size = s.find("resolution")
        if size is None:
            continue
        own = {p.get("name"): float(p.get("value")) for p in s.findall("property") if p.get("name") in ("pixel_width", "pixel_height", "focal_length")}
        calibration = s.find("calibration")
        f = _one(calibration, "f")
        sensors.append({"sensor": int(s.get("id")), "width": int(size.get("width")), "height": int(size.get("height")), "pixel_width": own.get("pixel_width"), "pixel_height": own.get("pixel_height"), "focal_mm": own.get("focal_length"), "f": f if f is not None else _one(calibration, "fx"), "cx": _one(calibration, "cx"), "cy": _one(calibration, "cy")})
    components = [{"component": int(c.get("id"))} | _placed(c.find("transform")) for c in root.iter("component") if c.get("id")]
    chunk = root.find(".//chunk") if root.tag != "chunk" else root
    components.append({"component": -1} | _placed(chunk.find("transform") if chunk is not None else None))
    for k, c in enumerate(root.iter("camera")):
        cameras.append({"seq": k, "name": c.get("label"), "sensor": int(c.get("sensor_id")) if c.get("sensor_id") else None, "component": int(c.get("component_id")) if c.get("component_id") else -1, "own": _numbers(c, "transform")})
    return sensors, components, cameras


PROJECT = "subject string, kind string, seq int, name string, sensor int, component int, own array<double>, width int, height int, pixel_width double, pixel_height double, focal_mm double, f double, cx double, cy double, rotation array<double>, translation array<double>, scale double"
#: Fixed value: the sensor to which focal lengths are compared, in mm.
FULL_FRAME = (36.0, 24.0)


def project_cameras(spark: SparkSession, path: str, names: list[str] | None = None, skip: int = 1, files: DataFrame | None = None, only_files: bool = False) -> DataFrame:
    """Cameras of photogrammetry projects with a pose: subject, seq, name, t, width, height, focal35, focal, cu, cv, path.

    A camera's place is scaled and then moved by its component, or by the chunk. names picks cameras, skip every n-th of those found. files (path) are matched by
    name without ending; only_files leaves out cameras without a file. Cameras without a transform, sensor or component are left out.
    """

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = [r | {"kind": kind} for kind, group in zip(("sensor", "component", "camera"), read_project(content), strict=True) for r in group]
        if rows:
            yield pd.DataFrame(rows, dtype=object).assign(subject=path)

    rows = read_each(spark, path, parse, PROJECT, ("xml",))
    sensors = rows.where("kind = 'sensor'").select("subject", "sensor", "width", "height", "pixel_width", "pixel_height", "focal_mm", "f", "cx", "cy")
    components = rows.where("kind = 'component' AND size(rotation) = 9 AND size(translation) = 3").select("subject", "component", "rotation", "translation", F.coalesce("scale", F.lit(1.0)).alias("scale"))
    cameras = rows.where("kind = 'camera' AND size(own) = 16").select("subject", "seq", "name", "sensor", "component", "own")
    if names is not None:
        cameras = cameras.where(F.col("name").isin(names))
    joined = cameras.join(sensors, ["subject", "sensor"]).join(components, ["subject", "component"])
    own = F.col("own")
    scaled = L.mat4_of([own[4 * r + c] for r in range(3) for c in range(3)], [own[4 * r + 3] * F.col("scale") for r in range(3)])
    pose = L.mat4_mul(L.mat4_of([F.col("rotation")[k] for k in range(9)], F.col("translation")), scaled)
    diagonal = lambda w, h: F.sqrt(w * w + h * h)
    crop = diagonal(*map(F.lit, FULL_FRAME)) / diagonal(F.col("width") * F.col("pixel_width"), F.col("height") * F.col("pixel_height"))
    out = joined.select("subject", "seq", "name", pose.alias("t"), "width", "height", (F.col("focal_mm") / crop).alias("focal35"), F.coalesce(F.col("f"), F.col("focal_mm") / F.col("pixel_width")).alias("focal"), (F.col("width") / 2 + F.coalesce("cx", F.lit(0.0))).alias("cu"), (F.col("height") / 2 + F.coalesce("cy", F.lit(0.0))).alias("cv"))
    stem = lambda c: F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)
    if files is not None:
        found = files.groupBy(stem("path").alias("_stem")).agg(F.min("path").alias("path"))
        out = out.withColumn("_stem", stem("name")).join(found, "_stem", "inner" if only_files else "left").drop("_stem")
    else:
        out = out.withColumn("path", F.lit(None).cast("string"))
    if skip > 1:
        # numbered within each project, whose cameras one file holds
        from pyspark.sql import Window

        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy("seq"))).where((F.col("_n") - 1) % skip == 0).drop("_n")
    return out


def read_scanner_panoramas(data: bytes) -> list[dict]:
    """time, position and quaternion of each panorama in a scanner's XML; missing parts of a rotation are those of the identity, and so is a missing first pose."""
    out = []
    for k, node in enumerate(_root(data).iter("vectorChild")):
        pose = node.find("pose")
        if pose is None and k:
            continue
        q = [_one(pose, f"rotation/{c}") for c in "xyzw"]
        p = [_one(pose, f"translation/{c}") for c in "xyz"]
        out.append({"seq": k, "time": _one(node, "acquisitionDateTime/dateTimeValue"), "quaternion": [float(c == "w") if v is None else v for c, v in zip("xyzw", q, strict=True)], "position": [v or 0.0 for v in p]})
    return out


def scanner_panoramas(spark: SparkSession, path: str) -> DataFrame:
    """Poses of panoramas in scanner exports, turned by 90 degrees about their own z, so that x is ahead: subject, seq, time, x, y, z, qx .. qw, t."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = read_scanner_panoramas(content)
        if rows:
            yield pd.DataFrame(rows, dtype=object).assign(subject=path)

    rows = read_each(spark, path, parse, "subject string, seq int, time double, position array<double>, quaternion array<double>", ("xml",))
    half = 0.5**0.5
    turned = L.quat_mul(F.col("quaternion"), [F.lit(v) for v in (0.0, 0.0, half, half)])
    rows = rows.withColumn("_q", turned)
    return rows.select("subject", "seq", "time", *(F.col("position")[k].alias(c) for k, c in enumerate("xyz")), *(F.col("_q")[k].alias(f"q{c}") for k, c in enumerate("xyzw")), L.mat4_from_quat(F.col("_q"), F.col("position")).alias("t"))


def read_alignment(data: bytes) -> list[dict]:
    """name, position and quaternion of each dataset of an alignment."""
    out = []
    for node in _root(data).iter("dataset"):
        p, q = node.find(".//position"), node.find(".//orientation")
        if p is not None and q is not None:
            out.append({"name": node.findtext("name"), "position": [_one(p, c) for c in "xyz"], "quaternion": [_one(q, c) for c in "xyzw"]})
    return out


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Poses of aligned datasets: subject, name, x, y, z, qx .. qw, t."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows = read_alignment(content)
        if rows:
            yield pd.DataFrame(rows, dtype=object).assign(subject=path)

    rows = read_each(spark, path, parse, "subject string, name string, position array<double>, quaternion array<double>", ("xml",))
    return rows.select("subject", "name", *(F.col("position")[k].alias(c) for k, c in enumerate("xyz")), *(F.col("quaternion")[k].alias(f"q{c}") for k, c in enumerate("xyzw")), L.mat4_from_quat(F.col("quaternion"), F.col("position")).alias("t"))
