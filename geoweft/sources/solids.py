"""Geometry and materials of building models in STEP text: extruded, faceted, triangulated and mapped shapes as triangles in the model's own metres."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.sources import formats
from geoweft.sources.files import BATCH, read_each

#: Steps around a circle.
AROUND = 24
# Classes below that of all building elements, and the powers of ten of unit prefixes.
ELEMENTS = ("IFCBEAM", "IFCBUILDINGELEMENTPROXY", "IFCCHIMNEY", "IFCCOLUMN", "IFCCOVERING", "IFCCURTAINWALL", "IFCDOOR", "IFCFOOTING", "IFCMEMBER", "IFCPILE", "IFCPLATE", "IFCRAILING", "IFCRAMP", "IFCRAMPFLIGHT", "IFCROOF", "IFCSHADINGDEVICE", "IFCSLAB", "IFCSLABSTANDARDCASE", "IFCSTAIR", "IFCSTAIRFLIGHT", "IFCWALL", "IFCWALLSTANDARDCASE", "IFCWINDOW", "IFCBEAMSTANDARDCASE", "IFCCOLUMNSTANDARDCASE", "IFCDOORSTANDARDCASE", "IFCWINDOWSTANDARDCASE", "IFCMEMBERSTANDARDCASE", "IFCPLATESTANDARDCASE", "IFCWALLELEMENTEDCASE", "IFCSLABELEMENTEDCASE")
PREFIX = {".MILLI.": 1e-3, ".CENTI.": 1e-2, ".DECI.": 1e-1, ".KILO.": 1e3}

Mesh = tuple[np.ndarray, list[tuple[int, int, int]]]


def _refs(text: str) -> list[int]:
    return [int(x) for x in re.findall(r"#(\d+)", text)]


def _items(text: str) -> list[str]:
    """Items of a list in parentheses."""
    return formats._arguments(text.strip()[1:-1]) if text.strip()[:1] == "(" and len(text.strip()) > 2 else []


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?", text)]


def triangulated(polygon: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon in the plane, by cutting ears; for one that isn't simple, a fan of what is left."""
    p = np.asarray(polygon, float)
    left = list(range(len(p)))
    area = sum(p[a][0] * p[b][1] - p[b][0] * p[a][1] for a, b in zip(left, left[1:] + left[:1], strict=True))
    if area < 0:
        left.reverse()
    turn = lambda a, b, c: (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(a, b, c) <= 0:
                continue
            if not any(turn(a, b, x) >= 0 and turn(b, c, x) >= 0 and turn(c, a, x) >= 0 for x in left if x not in (a, b, c)):
                out.append((a, b, c))
                del left[k]
                break
        else:
            break
    return out + [(left[0], left[k], left[k + 1]) for k in range(1, len(left) - 1)]


class Model:
    """The records of one file, and what they describe."""

    def __init__(self, data: bytes) -> None:
        self.records = formats.read_step(data)
        self.by = {r["id"]: r for r in self.records}
        self.unit = next((PREFIX.get(r["arguments"][2], 1.0) for r in self.records if r["class_name"] == "IFCSIUNIT" and r["arguments"][1] == ".LENGTHUNIT."), 1.0)

    def get(self, ref: int | str | None) -> dict | None:
        if isinstance(ref, str):
            found = _refs(ref)
            ref = found[0] if found else None
        return self.by.get(ref)

    def vector(self, ref: str, default: tuple[float, ...]) -> np.ndarray:
        r = self.get(ref)
        return np.array((_numbers(r["arguments"][0]) + [0.0, 0.0, 0.0])[:3] if r else default, float)

    def axes(self, ref: str) -> np.ndarray:
        """The 4x4 of a placement of two or three axes."""
        r, out = self.get(ref), np.eye(4)
        if r is None:
            return out
        a = r["arguments"]
        out[:3, 3] = self.vector(a[0], (0, 0, 0))
        if r["class_name"] == "IFCAXIS2PLACEMENT2D":
            x = self.vector(a[1], (1, 0, 0))
            x = x / np.linalg.norm(x)
            out[:3, 0], out[:3, 1] = x, (-x[1], x[0], 0)
            return out
        z = self.vector(a[1], (0, 0, 1))
        z = z / np.linalg.norm(z)
        x = self.vector(a[2] if len(a) > 2 else "$", (1, 0, 0))
        x = x - z * (x @ z)
        x = x / np.linalg.norm(x) if np.linalg.norm(x) > 1e-12 else np.cross(z, (0, 1, 0) if abs(z[1]) < 0.9 else (1, 0, 0))
        out[:3, 0], out[:3, 1], out[:3, 2] = x, np.cross(z, x), z
        return out

    def placement(self, ref: str) -> np.ndarray:
        """A local placement within those that it is relative to."""
        out, seen = np.eye(4), set()
        r = self.get(ref)
        while r is not None and r["class_name"] == "IFCLOCALPLACEMENT" and r["id"] not in seen:
            seen.add(r["id"])
            out = self.axes(r["arguments"][1]) @ out
            r = self.get(r["arguments"][0])
        return out

    def curve(self, ref: int | str) -> np.ndarray:
        """Points of a polyline or ring, the first not repeated at the end."""
        r = self.get(ref)
        if r is None:
            return np.zeros((0, 3))
        a = r["arguments"]
        if r["class_name"] in ("IFCPOLYLINE", "IFCPOLYLOOP"):
            p = np.array([self.vector(f"#{k}", (0, 0, 0)) for k in _refs(a[0])])
        elif r["class_name"] == "IFCINDEXEDPOLYCURVE":
            p = np.array([(_numbers(x) + [0.0])[:3] for x in _items((self.get(a[0]) or {"arguments": ["()"]})["arguments"][0])])
        elif r["class_name"] == "IFCCIRCLE":
            turn = np.arange(AROUND) * 2 * math.pi / AROUND
            p = np.stack([np.cos(turn), np.sin(turn), 0 * turn, 1 / float(a[1]) + 0 * turn], 1)[:, :4] * float(a[1])
            return (self.axes(a[0]) @ p.T).T[:, :3]
        else:
            return np.zeros((0, 3))
        return p[:-1] if len(p) > 1 and np.allclose(p[0], p[-1]) else p

    def profile(self, ref: str) -> np.ndarray:
        """The outline of a profile in its plane."""
        r = self.get(ref)
        if r is None:
            return np.zeros((0, 3))
        a, kind = r["arguments"], r["class_name"]
        if kind in ("IFCARBITRARYCLOSEDPROFILEDEF", "IFCARBITRARYPROFILEDEFWITHVOIDS"):
            return self.curve(a[2])
        sizes = [float(x) if re.fullmatch(r"[-+.\dEe]+", x) else 0.0 for x in a[3:]]
        if kind in ("IFCRECTANGLEPROFILEDEF", "IFCROUNDEDRECTANGLEPROFILEDEF", "IFCRECTANGLEHOLLOWPROFILEDEF"):
            x, y = sizes[0] / 2, sizes[1] / 2
            p = [(-x, -y), (x, -y), (x, y), (-x, y)]
        elif kind in ("IFCCIRCLEPROFILEDEF", "IFCCIRCLEHOLLOWPROFILEDEF", "IFCELLIPSEPROFILEDEF"):
            rx, ry = sizes[0], sizes[1] if kind == "IFCELLIPSEPROFILEDEF" else sizes[0]
            p = [(rx * math.cos(t), ry * math.sin(t)) for t in (2 * math.pi * k / AROUND for k in range(AROUND))]
        elif kind == "IFCISHAPEPROFILEDEF":
            x, y, web, flange = sizes[0] / 2, sizes[1] / 2, sizes[2] / 2, sizes[3]
            right = [(x, -y), (x, flange - y), (web, flange - y), (web, y - flange), (x, y - flange), (x, y)]
            p = right + [(-u, v) for u, v in reversed(right)]
        else:
            return np.zeros((0, 3))
        return (self.axes(a[2]) @ np.array([(u, v, 0, 1) for u, v in p]).T).T[:, :3]

    def shape(self, ref: int | str, seen: frozenset[int] = frozenset()) -> Mesh:
        """Corners and triangles of a representation's item; nothing for kinds that aren't read."""
        r = self.get(ref)
        if r is None or r["id"] in seen:
            return np.zeros((0, 3)), []
        seen, a, kind = seen | {r["id"]}, r["arguments"], r["class_name"]
        if kind == "IFCEXTRUDEDAREASOLID":
            flat = self.profile(a[0])
            if len(flat) < 3:
                return np.zeros((0, 3)), []
            way = self.vector(a[2], (0, 0, 1))
            n, lift = len(flat), way / np.linalg.norm(way) * float(a[3])
            cap = triangulated(flat[:, :2])
            area = sum(flat[k][0] * flat[(k + 1) % n][1] - flat[(k + 1) % n][0] * flat[k][1] for k in range(n))
            sides = [t for k in range(n) for j in [(k + 1) % n] for t in ((k, j, j + n), (k, j + n, k + n))]
            if (area < 0) != (lift[2] < 0):
                sides = [(i, k, j) for i, j, k in sides]
            low, high = [(i, k, j) for i, j, k in cap], [(i + n, j + n, k + n) for i, j, k in cap]
            if lift[2] < 0:
                low, high = [(i, k, j) for i, j, k in low], [(i, k, j) for i, j, k in high]
            return _moved(self.axes(a[1]), np.concatenate([flat, flat + lift])), low + high + sides
        if kind in ("IFCFACETEDBREP", "IFCFACETEDBREPWITHVOIDS", "IFCSHELLBASEDSURFACEMODEL", "IFCFACEBASEDSURFACEMODEL"):
            return _joined([self.shape(k, seen) for k in _refs(a[0])])
        if kind in ("IFCCLOSEDSHELL", "IFCOPENSHELL", "IFCCONNECTEDFACESET"):
            parts = []
            for face in _refs(a[0]):
                for bound in _refs(self.by[face]["arguments"][0])[:1]:
                    p = self.curve(self.by[bound]["arguments"][0])
                    if len(p) >= 3:
                        if self.by[bound]["arguments"][1] == ".F.":
                            p = p[::-1]
                        parts.append((p, _planar(p)))
            return _joined(parts)
        if kind == "IFCTRIANGULATEDFACESET":
            p = np.array([_numbers(x) for x in _items(self.get(a[0])["arguments"][0])])
            at = next(x for x in a[2:] if x.startswith("(("))
            return p, [tuple(int(v) - 1 for v in _numbers(x)) for x in _items(at)]
        if kind == "IFCPOLYGONALFACESET":
            p = np.array([_numbers(x) for x in _items(self.get(a[0])["arguments"][0])])
            out = []
            for face in _refs(a[2]):
                at = [int(v) - 1 for v in _numbers(self.by[face]["arguments"][0])]
                out += [tuple(at[k] for k in t) for t in _planar(p[at])]
            return p, out
        if kind == "IFCMAPPEDITEM":
            source, target = self.get(a[0]), self.get(a[1])
            if source is None or target is None:
                return np.zeros((0, 3)), []
            t, m = target["arguments"], np.eye(4)
            x, y = self.vector(t[0], (1, 0, 0)), self.vector(t[1], (0, 1, 0))
            z = self.vector(t[4], tuple(np.cross(x, y))) if len(t) > 4 else np.cross(x, y)
            scale = float(t[3]) if t[3] not in ("$", "*") else 1.0
            m[:3, 0], m[:3, 1], m[:3, 2], m[:3, 3] = x * scale, y * scale, z * scale, self.vector(t[2], (0, 0, 0))
            p, faces = self.shape(source["arguments"][1], seen)
            return _moved(m @ self.axes(source["arguments"][0]), p), faces
        if kind in ("IFCBOOLEANCLIPPINGRESULT", "IFCBOOLEANRESULT"):
            return self.shape(a[1], seen)
        if kind in ("IFCSHAPEREPRESENTATION", "IFCPRODUCTDEFINITIONSHAPE"):
            wanted = _refs(a[3] if kind == "IFCSHAPEREPRESENTATION" else a[2])
            if kind == "IFCSHAPEREPRESENTATION" and a[1].strip("'") not in ("Body", "Facetation", "", "$"):
                return np.zeros((0, 3)), []
            return _joined([self.shape(k, seen) for k in wanted])
        return np.zeros((0, 3)), []

    def meshes(self, classes: tuple[str, ...] = ELEMENTS, ids: tuple[str, ...] | None = None) -> Iterator[tuple[dict, Mesh]]:
        """Elements of the classes, and of the global ids if given, with their triangles in place; those with one triangle or none are left out."""
        for r in self.records:
            if r["class_name"] in classes and r["global_id"] and (ids is None or r["global_id"] in ids) and len(r["arguments"]) > 6:
                p, faces = self.shape(r["arguments"][6])
                if len(faces) > 1:
                    yield r, (_moved(self.placement(r["arguments"][5]), p) * self.unit, faces)

    def materials(self) -> Iterator[tuple[int, str]]:
        """(element's id, name of a material) by the ways in which elements and materials are tied: alone, in lists, in layers."""

        def names(ref: int, seen: frozenset[int] = frozenset()) -> list[str]:
            r = self.by.get(ref)
            if r is None or ref in seen:
                return []
            if r["class_name"] == "IFCMATERIAL":
                return [r["arguments"][0].strip("'").replace("''", "'")]
            inner = {"IFCMATERIALLIST": 0, "IFCMATERIALLAYERSETUSAGE": 0, "IFCMATERIALLAYERSET": 0, "IFCMATERIALLAYER": 0, "IFCMATERIALCONSTITUENTSET": 2, "IFCMATERIALCONSTITUENT": 2, "IFCMATERIALPROFILESETUSAGE": 0, "IFCMATERIALPROFILESET": 2, "IFCMATERIALPROFILE": 2}.get(r["class_name"])
            return [x for k in _refs(r["arguments"][inner]) for x in names(k, seen | {ref})] if inner is not None and inner < len(r["arguments"]) else []

        for r in self.records:
            if r["class_name"] == "IFCRELASSOCIATESMATERIAL":
                found = [x for k in _refs(r["arguments"][5]) for x in names(k)]
                for element in _refs(r["arguments"][4]):
                    for x in found:
                        yield element, x


def _moved(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:3, :3].T + m[:3, 3] if len(p) else p


def _joined(parts: list[Mesh]) -> Mesh:
    points, faces, n = [], [], 0
    for p, f in parts:
        points.append(np.asarray(p, float).reshape(-1, 3))
        faces += [(a + n, b + n, c + n) for a, b, c in f]
        n += len(p)
    return (np.concatenate(points) if points else np.zeros((0, 3))), faces


def _planar(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a flat polygon in space, with its own direction."""
    normal = sum(np.cross(p[k], p[(k + 1) % len(p)]) for k in range(len(p)))
    drop = int(np.abs(normal).argmax())
    keep = [k for k in range(3) if k != drop]
    out = triangulated(p[:, keep])
    flat = p[:, keep]
    area = sum(flat[k][0] * flat[(k + 1) % len(flat)][1] - flat[(k + 1) % len(flat)][0] * flat[k][1] for k in range(len(flat)))
    return [(a, c, b) for a, b, c in out] if area < 0 else out


def element_triangles(spark: SparkSession, path: str, classes: tuple[str, ...] = ELEMENTS, ids: tuple[str, ...] | None = None) -> DataFrame:
    """Triangles of building elements: subject (the global id), file, class_name, name, fid, ax .. cz, in metres.

    A file's records refer to one another, so a file is read in one task; many files go to many. Curved and swept kinds that aren't read give no triangles.
    """
    schema = "subject string, file string, class_name string, name string, fid long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        for r, (p, faces) in Model(content).meshes(classes, ids):
            t = p[np.array(faces)].reshape(-1, 9)
            for k in range(0, len(t), BATCH):
                part = pd.DataFrame(t[k : k + BATCH], columns=[f"{v}{c}" for v in "abc" for c in "xyz"])
                yield part.assign(subject=r["global_id"], file=path, class_name=r["class_name"], name=r["name"], fid=np.arange(k, k + len(part)))

    return read_each(spark, path, parse, schema, ("ifc",))


def element_materials(spark: SparkSession, path: str) -> DataFrame:
    """Names of the materials of building elements: file, id, global_id, material, each once."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        m = Model(content)
        rows = [(path, k, (m.by.get(k) or {}).get("global_id"), x) for k, x in dict.fromkeys(m.materials())]
        if rows:
            yield pd.DataFrame(rows, columns=["file", "id", "global_id", "material"])

    return read_each(spark, path, parse, "file string, id long, global_id string, material string", ("ifc",))


def subtypes(class_name: Column, of: tuple[str, ...] = ELEMENTS) -> Column:
    """Whether a class is one of those below, in either case."""
    return F.upper(class_name).isin(*of)
