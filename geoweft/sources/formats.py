"""Bytes of point clouds, meshes, drawings and sidecar files to rows, and back. Plain Python on one file's bytes; files.py spreads files over tasks."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

import numpy as np

POINT = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "intensity")
#: Names of number types in PLY headers, and sizes and kinds of fields in PCD headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
PCD_TYPES = {"F4": "f4", "F8": "f8", "I1": "i1", "I2": "i2", "I4": "i4", "I8": "i8", "U1": "u1", "U2": "u2", "U4": "u4", "U8": "u8"}
COLOR_NAMES = {"red": "r", "green": "g", "blue": "b", "scalar_Intensity": "intensity"}


def _points(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns by our names; colours as shares of 1."""
    out = {COLOR_NAMES.get(k, k): np.asarray(v, np.float64) for k, v in columns.items()}
    out = {k: v for k, v in out.items() if k in POINT}
    if "r" in out and len(out["r"]) and max(out[c].max() for c in "rgb") > 1:
        out |= {c: out[c] / 255 for c in "rgb"}
    return out


def read_ply(data: bytes) -> tuple[dict[str, np.ndarray], list[tuple[int, ...]], list[tuple[int, int]]]:
    """Vertex columns, faces as tuples of vertex numbers, edges; text or binary of either byte order."""
    head, _, body = data.partition(b"end_header\n")
    if not head.startswith(b"ply"):
        raise ValueError("no PLY header")
    kind, elements = "ascii", []
    for line in head.decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    tokens = body.split() if kind == "ascii" else []
    at = 0
    columns, faces, edges = {}, [], []
    for name, n, properties in elements:
        if all(p[0] != "list" for p in properties):
            names = [p[1] for p in properties]
            if kind == "ascii":
                table = np.array(tokens[at : at + n * len(names)], np.float64).reshape(n, len(names))
                at += table.size
                own = {c: table[:, k] for k, c in enumerate(names)}
            else:
                rows = np.frombuffer(body, np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties]), n, at)
                at += rows.nbytes
                own = {c: rows[c] for c in names}
            if name == "vertex":
                columns = own
            elif name == "edge":
                edges = list(zip(own["vertex1"].astype(int).tolist(), own["vertex2"].astype(int).tolist(), strict=True))
        else:
            for _ in range(n):
                for p in properties:
                    if p[0] != "list":
                        at += 1 if kind == "ascii" else np.dtype(PLY_TYPES[p[0]]).itemsize
                        continue
                    if kind == "ascii":
                        k = int(tokens[at])
                        items = tuple(int(x) for x in tokens[at + 1 : at + 1 + k])
                        at += 1 + k
                    else:
                        size = np.dtype(order + PLY_TYPES[p[1]])
                        k = int(np.frombuffer(body, size, 1, at)[0])
                        item = np.dtype(order + PLY_TYPES[p[2]])
                        items = tuple(np.frombuffer(body, item, k, at + size.itemsize).astype(int).tolist())
                        at += size.itemsize + k * item.itemsize
                    if name == "face" and p[3] in ("vertex_indices", "vertex_index"):
                        faces.append(items)
    return _points(columns), faces, edges


def write_ply(points: dict[str, np.ndarray], faces: list[tuple[int, ...]] = (), binary: bool = True, edges: list[tuple[int, int]] = ()) -> bytes:
    """Positions and normals as doubles, colours as bytes, faces as lists, edges as pairs."""
    names = [c for c in POINT if c in points]
    n = len(points["x"])
    types = {c: "uchar" if c in "rgb" else "double" for c in names}
    back = {v: k for k, v in COLOR_NAMES.items()}
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {n}", *(f"property {types[c]} {back.get(c, c)}" for c in names)]
    if faces:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    if edges:
        head += [f"element edge {len(edges)}", "property int vertex1", "property int vertex2"]
    values = {c: np.rint(np.asarray(points[c]) * 255).astype(np.uint8) if c in "rgb" else np.asarray(points[c], np.float64) for c in names}
    if binary:
        rows = np.zeros(n, np.dtype([(c, "<" + PLY_TYPES[types[c]]) for c in names]))
        for c in names:
            rows[c] = values[c]
        body = rows.tobytes() + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in faces) + b"".join(struct.pack("<2i", *e) for e in edges)
    else:
        body = "".join([*(" ".join(repr(values[c][k].item()) for c in names) + "\n" for k in range(n)), *(" ".join(map(str, (len(f), *f))) + "\n" for f in faces), *(" ".join(map(str, e)) + "\n" for e in edges)]).encode()
    return "\n".join([*head, "end_header", ""]).encode() + body


def read_obj(data: bytes) -> tuple[dict[str, np.ndarray], list[tuple[int, ...]], list[tuple[int, int]]]:
    """Vertices, faces and line elements; vertex numbers count from 0 here, negative ones from the end."""
    v, faces, edges = [], [], []

    def index(token: str) -> int:
        k = int(token.split("/")[0])
        return k - 1 if k > 0 else len(v) + k

    for line in data.decode("utf-8", "replace").splitlines():
        words = line.split()
        if words[:1] == ["v"]:
            v.append([float(x) for x in words[1:4]])
        elif words[:1] == ["f"]:
            faces.append(tuple(map(index, words[1:])))
        elif words[:1] == ["l"]:
            at = list(map(index, words[1:]))
            edges += list(zip(at, at[1:], strict=False))
    a = np.array(v, np.float64).reshape(-1, 3)
    return {c: a[:, k] for k, c in enumerate("xyz")}, faces, edges


def write_obj(points: dict[str, np.ndarray], faces: list[tuple[int, ...]] = ()) -> bytes:
    lines = [f"v {x!r} {y!r} {z!r}" for x, y, z in zip(*(np.asarray(points[c], float).tolist() for c in "xyz"), strict=True)]
    return "\n".join([*lines, *("f " + " ".join(str(k + 1) for k in f) for f in faces), ""]).encode()


def read_pcd(data: bytes) -> dict[str, np.ndarray]:
    """Text or plain binary PCD; a packed rgb field becomes three colours."""
    head, n = {}, 0
    while True:
        end = data.index(b"\n", n)
        line = data[n:end].decode("ascii", "replace").split("#")[0].split()
        n = end + 1
        if line:
            head[line[0]] = line[1:]
            if line[0] == "DATA":
                break
    names, counts = head["FIELDS"], [int(x) for x in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    kinds = [PCD_TYPES[t + s] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    rows = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    if head["DATA"][0] == "ascii":
        table = np.array(data[n:].split(), dtype=object).reshape(rows, sum(counts))
        starts = np.cumsum([0, *counts])
        columns = {c: table[:, s].astype(k) for c, k, s in zip(names, kinds, starts, strict=False)}
    elif head["DATA"][0] == "binary":
        table = np.frombuffer(data, np.dtype([(c, "<" + k, (m,)) if m > 1 else (c, "<" + k) for c, k, m in zip(names, kinds, counts, strict=True)]), rows, n)
        columns = {c: table[c] for c in names}
    else:
        raise ValueError(f"PCD data {head['DATA'][0]}")
    for c in ("rgb", "rgba"):
        if c in columns:
            # one number holds three bytes, whether it is called a float or not
            packed = np.ascontiguousarray(columns.pop(c)).view(np.uint32)
            columns |= {k: (packed >> s & 255) / 255 for k, s in zip("rgb", (16, 8, 0), strict=True)}
    names = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
    return _points({names.get(k, k): v for k, v in columns.items()})


def write_pcd(points: dict[str, np.ndarray]) -> bytes:
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz", "intensity") if c in points]
    back = {"nx": "normal_x", "ny": "normal_y", "nz": "normal_z"}
    kinds, fields = ["<f8"] * len(names), [back.get(c, c) for c in names]
    n = len(points["x"])
    values = [np.asarray(points[c], np.float64) for c in names]
    if "r" in points:
        packed = sum(np.rint(np.asarray(points[c]) * 255).astype(np.uint32) << s for c, s in zip("rgb", (16, 8, 0), strict=True))
        kinds.append("<u4")
        fields.append("rgb")
        values.append(packed)
    rows = np.zeros(n, np.dtype(list(zip(fields, kinds, strict=True))))
    for c, v in zip(fields, values, strict=True):
        rows[c] = v
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(fields), "SIZE " + " ".join(k[2] for k in kinds), "TYPE " + " ".join(k[1].upper() for k in kinds), "COUNT " + " ".join("1" for _ in kinds), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA binary"]
    return ("\n".join(head) + "\n").encode() + rows.tobytes()


#: Byte offsets of red in the LAS point formats that have colours.
LAS_COLOR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


#: numpy's names of the types of extra dimensions, by their number.
LAS_EXTRA = {1: "<u1", 2: "<i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
#: Bytes of the standard fields of each point format.
LAS_STANDARD = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
LAS_NORMALS = {"normalx": "nx", "normaly": "ny", "normalz": "nz", "nx": "nx", "ny": "ny", "nz": "nz"}


def las_extra(data: bytes) -> list[tuple[str, str]]:
    """(name, numpy type) of the extra dimensions that a LAS header lists, in the order of their bytes."""
    at, out = struct.unpack_from("<H", data, 94)[0], []
    for _ in range(struct.unpack_from("<I", data, 100)[0]):
        user, record, n = data[at + 2 : at + 18].split(b"\0")[0], *struct.unpack_from("<HH", data, at + 18)
        if user == b"LASF_Spec" and record == 4:
            for k in range(at + 54, at + 54 + n - 191, 192):
                kind, size = data[k + 2], data[k + 3]
                out.append((data[k + 4 : k + 36].split(b"\0")[0].decode("latin-1"), LAS_EXTRA.get(kind, f"V{size}")))
        at += 54 + n
    return out


def read_las(data: bytes, extra: bool = False) -> dict[str, np.ndarray]:
    """Scaled positions, intensity and, where the point format has them, colours of 16 bits as shares of 1; extra dimensions that are normals, and with extra all others by name."""
    if data[:4] != b"LASF":
        raise ValueError("no LAS header")
    offset, kind, length, n = struct.unpack_from("<I", data, 96)[0], data[104] & 63, *struct.unpack_from("<HI", data, 105)
    if data[25] >= 4 and not n:
        (n,) = struct.unpack_from("<Q", data, 247)
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    names, formats, offsets = ["p", "intensity"], ["<3i4", "<u2"], [0, 12]
    if kind in LAS_COLOR:
        names, formats, offsets = [*names, "c"], [*formats, "<3u2"], [*offsets, LAS_COLOR[kind]]
    place = LAS_STANDARD.get(kind, length)
    own = []
    for name, form in las_extra(data):
        known = LAS_NORMALS.get(name.lower().replace("_", "").replace(" ", ""))
        if place + np.dtype(form).itemsize <= length and form[0] != "V" and (known or extra):
            own.append(known or name)
            names, formats, offsets = [*names, f"+{own[-1]}"], [*formats, form], [*offsets, place]
        place += np.dtype(form).itemsize
    rows = np.frombuffer(data, np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": length}), n, offset)
    out = {c: rows["p"][:, k] * scale[k] + shift[k] for k, c in enumerate("xyz")} | {"intensity": rows["intensity"].astype(float)}
    if "c" in names:
        out |= {c: (rows["c"][:, k] >> 8) / 255 for k, c in enumerate("rgb")}
    return out | {c: rows[f"+{c}"].astype(float) for c in own}


def write_las(points: dict[str, np.ndarray], scale: float = 0.001, extra: tuple[str, ...] = ()) -> bytes:
    """LAS 1.2, point format 2; extra columns, and normals if there are such, as extra dimensions of doubles."""
    extra = (*(c for c in ("nx", "ny", "nz") if c in points), *extra)
    n = len(points["x"])
    p = np.stack([np.asarray(points[c], float) for c in "xyz"], 1)
    low, high = (p.min(0), p.max(0)) if n else (np.zeros(3), np.zeros(3))
    length, listed = 26 + 8 * len(extra), b""
    names = ["p", "intensity", "returns", "c", *(f"+{c}" for c in extra)]
    rows = np.zeros(n, np.dtype({"names": names, "formats": ["<3i4", "<u2", "u1", "<3u2", *["<f8"] * len(extra)], "offsets": [0, 12, 14, 20, *range(26, length, 8)], "itemsize": length}))
    for c in extra:
        rows[f"+{c}"] = np.asarray(points[c], float)
        listed += struct.pack("<2xBB32s4x", 10, 0, c.encode()[:31]).ljust(192, b"\0")
    if extra:
        listed = struct.pack("<2x16sHH32s", b"LASF_Spec", 4, len(listed), b"extra dimensions") + listed
    rows["p"] = np.rint((p - low) / scale)
    rows["returns"] = 9
    if "intensity" in points:
        rows["intensity"] = np.asarray(points["intensity"])
    if "r" in points:
        rows["c"] = np.stack([np.rint(np.asarray(points[c]) * 255).astype(np.uint16) << 8 for c in "rgb"], 1)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = b"\x01\x02"
    struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(listed), bool(listed), 2, length, n)
    struct.pack_into("<I", head, 111, n)
    struct.pack_into("<12d", head, 131, scale, scale, scale, *low, *(v for k in range(3) for v in (high[k], low[k])))
    return bytes(head) + listed + rows.tobytes()


ENTITIES = ("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "ELLIPSE", "POINT", "SPLINE", "INSERT", "TEXT", "MTEXT", "3DFACE", "SOLID")
#: Group codes of a point's x, and those of scales (of an ellipse: its first and last parameter).
POINT_CODES, SCALE_CODES = (10, 11, 12, 13), {41: 0, 42: 1, 43: 2}


def _entity(seq: int, dtype: str, owner: str | None) -> dict:
    return {"seq": seq, "dtype": dtype, "owner": owner, "layer": None, "handle": None, "color": None, "text": None, "block": None, "radius": None, "start": None, "end": None, "closed": False, "points": [], "elevation": None, "scale": [None, None, None], "extrusion": [0.0, 0.0, 1.0]}


def read_dxf(data: bytes) -> list[dict]:
    """Entities of a text DXF in order: seq, dtype, layer, handle, color, text, radius, start and end angle, closed, points, scale, extrusion, block (that an insert names), and owner.

    owner is null in model space; else the entity is part of the block of that name, whose own row has dtype BLOCK and its base point. Layers' rows have dtype LAYER, their colour and name.
    """
    lines = data.decode("utf-8", "replace").splitlines()
    pairs = [(int(a), b.strip()) for a, b in zip(lines[::2], lines[1::2], strict=False) if a.strip().lstrip("-").isdigit()]
    out: list[dict] = []
    section, owner, now, parent = "", None, None, None
    for k, (code, value) in enumerate(pairs):
        if code == 0:
            now = None
            if value == "SECTION":
                section = pairs[k + 1][1] if k + 1 < len(pairs) else ""
            elif value in ("ENDSEC", "ENDBLK"):
                section, owner = section if value == "ENDBLK" else "", None
            elif section == "BLOCKS" and value == "BLOCK" or section == "TABLES" and value == "LAYER":
                now = parent = _entity(len(out), value, None)
                out.append(now)
            elif section in ("ENTITIES", "BLOCKS") and value in ENTITIES:
                now = parent = _entity(len(out), value, owner if section == "BLOCKS" else None)
                out.append(now)
            elif section in ("ENTITIES", "BLOCKS") and value in ("VERTEX", "ATTRIB") and parent is not None:
                now = {"points": parent["points"]} if value == "VERTEX" else {"points": [], "into": parent}
            continue
        if now is None:
            continue
        if code == 8:
            now.setdefault("layer", None)
            now["layer"] = now["layer"] or value
        elif code == 5:
            now["handle"] = value
        elif code == 62:
            now["color"] = int(value)
        elif code == 1:
            (now.get("into") or now)["text"] = value
        elif code == 2 and "block" in now and now["block"] is None:
            now["block"] = value
            if now["dtype"] == "BLOCK":
                owner = value
        elif code in POINT_CODES and "into" not in now:
            now["points"].append([float(value), 0.0, now.get("elevation") or 0.0])
        elif code - 10 in POINT_CODES and now["points"] and "into" not in now:
            now["points"][-1][1] = float(value)
        elif code - 20 in POINT_CODES and now["points"] and "into" not in now:
            now["points"][-1][2] = float(value)
        elif code == 38 and "elevation" in now:
            now["elevation"] = float(value)
        elif code == 40 and "radius" in now:
            now["radius"] = now["radius"] if now["radius"] is not None else float(value)
        elif code in SCALE_CODES and "scale" in now and now["dtype"] in ("INSERT", "ELLIPSE"):
            now["scale"][SCALE_CODES[code]] = float(value)
        elif code in (50, 51) and "start" in now:
            now["start" if code == 50 else "end"] = float(value)
        elif code in (210, 220, 230) and "extrusion" in now:
            now["extrusion"][code // 10 - 21] = float(value)
        elif code == 70 and "closed" in now:
            now["closed"] = bool(int(value) & 1)
    return out


def read_tfw(data: bytes) -> list[float]:
    """The six numbers of a world file: A, D, B, E, C, F."""
    values = [float(x) for x in data.split()]
    if len(values) != 6:
        raise ValueError("a world file has six numbers")
    return values


def tfw_centre(values: list[float], width: int, height: int) -> tuple[float, float, float]:
    """Ground size of a pixel, and x and y of the image's centre."""
    a, d, b, e, c, f = values
    u, v = width / 2 - 0.5, height / 2 - 0.5
    return (a * a + d * d) ** 0.5, a * u + b * v + c, d * u + e * v + f


def read_xmp(data: bytes) -> dict:
    """Camera attributes of a sidecar file; the rotation is turned to rows."""
    root = ET.fromstring(data)
    out: dict = {}
    for node in root.iter():
        for k, v in node.attrib.items():
            out[k.rpartition("}")[2]] = v
        name = node.tag.rpartition("}")[2]
        if name in ("Rotation", "Position", "DistortionCoeficients") and node.text:
            numbers = [float(x) for x in node.text.split()]
            out[name] = [numbers[3 * (k % 3) + k // 3] for k in range(9)] if name == "Rotation" else numbers
    return out


def read_e57_xml(data: bytes) -> list[dict]:
    """Scans of an E57 description: name, number of points, rotation (x, y, z, w), translation, bounds."""
    out = []
    for scan in ET.fromstring(re.sub(rb'\sxmlns(:\w+)?="[^"]*"', b"", data)).iter("vectorChild"):
        if scan.find("points") is None and scan.find("pose") is None:
            continue

        def number(path: str, default: float = 0.0, scan=scan) -> float:
            node = scan.find(path)
            return float(node.text) if node is not None and node.text and node.text.strip() else default

        points = scan.find("points")
        bounds = [number(f"cartesianBounds/{c}{m}", float("nan")) for c in "xyz" for m in ("Minimum", "Maximum")]
        out.append({"name": scan.findtext("name"), "count": int(points.get("recordCount", 0)) if points is not None else 0, "rotation": [number(f"pose/rotation/{c}", float(c == "w")) for c in "xyzw"], "translation": [number(f"pose/translation/{c}") for c in "xyz"], "bounds": bounds})
    return out


STEP = re.compile(r"#(\d+)\s*=\s*([A-Z0-9_]+)\s*\((.*?)\)\s*;", re.S)


def _arguments(text: str) -> list[str]:
    """Top-level arguments of a STEP record, quotes and parentheses kept together."""
    out, now, depth, quoted = [], "", 0, False
    for ch in text:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not depth and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def read_step(data: bytes) -> list[dict]:
    """Records of a building model in STEP text: id, class, arguments, and the global id, name and object type of those that have one."""
    out = []
    for m in STEP.finditer(data.decode("latin-1").partition("DATA;")[2]):
        a = _arguments(m[3])
        text = lambda k, a=a: a[k][1:-1].replace("''", "'") if len(a) > k and a[k][:1] == "'" else None
        rooted = len(a) > 2 and len(text(0) or "") == 22
        out.append({"id": int(m[1]), "class_name": m[2], "arguments": a, "global_id": text(0) if rooted else None, "name": text(2) if rooted else None, "object_type": text(4) if rooted else None})
    return out
