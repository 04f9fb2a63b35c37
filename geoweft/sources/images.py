"""Image files: headers with EXIF of JPEG, PNG and TIFF, pixels of PNG and PNM, and what images tell about their nodes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.functions import literals as X
from geoweft.sources.files import BATCH, read_each

# Fixed values of the formats: tag numbers, bytes of field types, frame markers of JPEG, channels of PNG's colour types.
TAGS = {256: "ImageWidth", 257: "ImageLength", 271: "Make", 272: "Model", 274: "Orientation", 277: "SamplesPerPixel", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 306: "DateTime", 33434: "ExposureTime", 33437: "FNumber", 34665: "Exif", 34853: "GPSInfo", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 37386: "FocalLength", 40962: "ExifImageWidth", 40963: "ExifImageHeight", 41989: "FocalLengthIn35mmFilm"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff")


def read_directory(data: bytes, order: str, at: int, names: dict[int, str]) -> dict:
    """Values of a TIFF directory by name: text, a number or a list; directories below it are dictionaries."""
    out: dict = {}
    if at + 2 > len(data):
        return out
    for k in range(struct.unpack_from(f"{order}H", data, at)[0]):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            break
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, place)
        if tag not in names or kind not in FIELDS:
            continue
        size = struct.calcsize(f"{order}{FIELDS[kind]}")
        where = place + 8 if n * size <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
        if where + n * size > len(data):
            continue
        if kind in (2, 7):
            out[names[tag]] = data[where : where + n].split(b"\0")[0].decode("latin-1").strip()
            continue
        flat = struct.unpack_from(f"{order}{FIELDS[kind] * n}", data, where)
        values = [a / b if b else None for a, b in zip(flat[::2], flat[1::2], strict=True)] if kind in (5, 10) else list(flat)
        out[names[tag]] = values[0] if len(values) == 1 else values
    for name, below in (("Exif", TAGS), ("GPSInfo", GPS_TAGS)):
        if isinstance(out.get(name), int):
            out[name] = read_directory(data, order, out[name], below)
    return out


def read_exif(data: bytes) -> dict:
    """Values of a TIFF header and its first directory, those of the camera's directory among them."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return {}
    out = read_directory(data, order, struct.unpack_from(f"{order}I", data, 4)[0], TAGS)
    return out | (out.pop("Exif") if isinstance(out.get("Exif"), dict) else {})


def read_header(data: bytes) -> dict | None:
    """format, width, height, channels and exif of an image file; none for other files."""
    if data[:2] == b"\xff\xd8":
        at, out = 2, {"format": "jpeg", "width": None, "height": None, "channels": None, "exif": {}}
        while at + 4 <= len(data) and data[at] == 0xFF:
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                out["exif"] = read_exif(data[at + 10 : at + 2 + n])
            if mark in FRAMES:
                out["height"], out["width"], out["channels"] = struct.unpack_from(">HHB", data, at + 5)
            if mark == 0xDA:
                break
            at += 2 + n
        return out
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, _, kind = struct.unpack_from(">IIBB", data, 16)
        exif = next((read_exif(x) for name, x in chunks(data) if name == b"eXIf"), {})
        return {"format": "png", "width": w, "height": h, "channels": 3 if kind == 3 else CHANNELS.get(kind), "exif": exif}
    exif = read_exif(data)
    if exif:
        return {"format": "tiff", "width": exif.get("ImageWidth"), "height": exif.get("ImageLength"), "channels": exif.get("SamplesPerPixel", 1), "exif": exif}
    return None


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and contents of a PNG file's chunks."""
    at = 8
    while at + 8 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Lines of a PNG image without their filters: each line's first byte names its own."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1), np.uint8)
    for k, line in enumerate(rows):
        kind, x, up = line[0], line[1:], out[k]
        if kind == 0:
            out[k + 1] = x
        elif kind == 1:
            pad = np.zeros(-len(x) % step, np.uint8)
            out[k + 1] = np.cumsum(np.append(x, pad).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(x)]
        elif kind == 2:
            out[k + 1] = x + up
        else:
            now, above, line = bytearray(len(x)), up.tolist(), x.tolist()
            for i, v in enumerate(line):
                a, b, c = (now[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[i] = (v + guess) & 255
            out[k + 1] = np.frombuffer(now, np.uint8)
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """Samples by row, column and channel; palettes are resolved. Interlaced files are not read."""
    w, h, bits, kind, _, _, laced = struct.unpack_from(">IIBBBBB", data, 16)
    if data[:8] != b"\x89PNG\r\n\x1a\n" or laced:
        raise ValueError("no PNG file, or an interlaced one")
    n = CHANNELS[kind]
    line = -(-w * n * bits // 8)
    raw = zlib.decompressobj().decompress(b"".join(x for name, x in chunks(data) if name == b"IDAT"), h * (line + 1))
    if len(raw) < h * (line + 1):
        raise ValueError("a PNG file that ends early")
    plain = _unfiltered(np.frombuffer(raw, np.uint8).reshape(h, line + 1), max(1, n * bits // 8))
    if bits == 16:
        return plain.reshape(h, line // 2, 2).view(">u2").astype(np.uint16).reshape(h, w, n)
    if bits < 8:
        each = np.unpackbits(plain, axis=1)[:, : w * bits].reshape(h, w, bits)
        plain = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        if kind == 0:
            plain = plain * (255 // (2**bits - 1))
    if kind == 3:
        colors = np.frombuffer(next(x for name, x in chunks(data) if name == b"PLTE"), np.uint8).reshape(-1, 3)
        return colors[plain].reshape(h, w, 3)
    return plain.reshape(h, w, n)


def write_png(image: np.ndarray) -> bytes:
    """A PNG file of samples of 8 or 16 bits by row, column and 1 to 4 channels."""
    a = np.asarray(image)
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, n = a.shape
    bits = 16 if a.dtype == np.uint16 else 8
    lines = np.ascontiguousarray(a.astype(">u2" if bits == 16 else np.uint8)).view(np.uint8).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes()

    def chunk(name: bytes, x: bytes) -> bytes:
        return struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))

    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def read_pnm(data: bytes) -> np.ndarray:
    """Samples of a binary or text PGM or PPM file."""
    words, at = [], 0
    while len(words) < 4:
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        word = data[at:end]
        if word.startswith(b"#"):
            end = data.index(b"\n", at)
        elif word:
            words.append(word)
        at = end + 1
        if at > len(data):
            raise ValueError("a PNM file without a header")
    kind, w, h, top = words[0], *map(int, words[1:])
    n = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        return np.array(data[at:].split()[: w * h * n], np.int64).astype(np.uint8 if top < 256 else np.uint16).reshape(h, w, n)
    return np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * n, at).reshape(h, w, n)


PIXELS = {"png": read_png, "ppm": read_pnm, "pgm": read_pnm}


def _text(value) -> str:
    return ",".join(map(_text, value)) if isinstance(value, (list, tuple)) else repr(value) if isinstance(value, float) else str(value)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image file: subject, format, width, height, channels, exif and gps (maps of text), modified.

    Files of these endings that aren't images give a row of nulls.
    """
    schema = "subject string, format string, width int, height int, channels int, exif map<string,string>, gps map<string,string>"

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        found = read_header(content) or {}
        exif = dict(found.get("exif") or {})
        gps = exif.pop("GPSInfo", None)
        row = {c: found.get(c) for c in ("format", "width", "height", "channels")}
        row |= {"subject": path, "exif": {k: _text(v) for k, v in exif.items()}, "gps": {k: _text(v) for k, v in gps.items()} if isinstance(gps, dict) else {}}
        yield pd.DataFrame([row], dtype=object)

    return read_each(spark, path, parse, schema, IMAGES)


def exif_facts(images: DataFrame) -> DataFrame:
    """What EXIF tells of images (columns of headers): timestamp, image_width, image_height, focal35, focal_x, focal_y, cu, cv, latitude, longitude, altitude, coordinate_system.

    Angles are three numbers or one, with the way's letter; fields that the file has not are null.
    """
    number = lambda name: F.try_element_at("exif", F.lit(name)).try_cast("double")
    w, h = F.coalesce(number("ExifImageWidth"), F.col("width").cast("double")), F.coalesce(number("ExifImageHeight"), F.col("height").cast("double"))
    focal, focal35 = number("FocalLength"), number("FocalLengthIn35mmFilm")

    def angle(name: str) -> Column:
        parts = F.transform(F.split(F.try_element_at("gps", F.lit(name)), ","), lambda x: x.try_cast("double"))
        way = F.upper(F.try_element_at("gps", F.lit(f"{name}Ref")))
        one = F.when(way.isin("S", "W"), -F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(0)))
        return F.when(F.size(parts) == 3, X.dms_to_dd(*(F.get(parts, F.lit(k)) for k in range(3)), way)).when(F.size(parts) == 1, one)

    below = F.try_element_at("gps", F.lit("GPSAltitudeRef")) == "1"
    height = F.try_element_at("gps", F.lit("GPSAltitude")).try_cast("double")
    facts = images.withColumns({"latitude": angle("GPSLatitude"), "longitude": angle("GPSLongitude")}).select(
        "subject",
        F.try_to_timestamp(F.try_element_at("exif", F.lit("DateTime")), F.lit("yyyy:MM:dd HH:mm:ss")).alias("timestamp"),
        w.cast("int").alias("image_width"),
        h.cast("int").alias("image_height"),
        focal35.alias("focal35"),
        # the sensor is 36 by 24 mm over the crop factor
        F.when(focal > 0, focal35 / 36 * w).alias("focal_x"),
        F.when(focal > 0, focal35 / 24 * h).alias("focal_y"),
        (w / 2).alias("cu"),
        (h / 2).alias("cv"),
        "latitude",
        "longitude",
        F.when(below, -height).otherwise(height).alias("altitude"),
    )
    return facts.withColumn("coordinate_system", F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "geospatial-wgs84"))


def filled(nodes: DataFrame, facts: DataFrame, key: str = "subject") -> DataFrame:
    """Nodes whose null attributes come from the facts of the same key; attributes that nodes haven't are added."""
    known = [c for c in facts.columns if c != key]
    both = nodes.join(facts.select(key, *(F.col(c).alias(f"_{c}") for c in known)), key, "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in nodes.columns else F.col(f"_{c}") for c in known}).drop(*(f"_{c}" for c in known))


def panorama_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files beside panoramas: subject, name (the file's), timestamp, position, quaternion (x, y, z, w) and pose t from their footprint."""
    schema = "timestamp double, footprint struct<position:array<double>,quaternion:array<double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("subject", F.col("_metadata.file_path"))
    at, turn = F.col("footprint.position"), F.col("footprint.quaternion")
    pose = F.when((F.size(at) == 3) & (F.size(turn) == 4), L.mat4_from_quat(turn, at))
    return rows.select("subject", F.regexp_extract("subject", r"([^/]+)\.[^./]+$", 1).alias("name"), F.timestamp_seconds("timestamp").alias("timestamp"), at.alias("position"), turn.alias("quaternion"), pose.alias("t"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of pixels of PNG and PNM images: subject, row, width, channels, values (by column, then channel)."""

    def parse(path: str, content: bytes) -> Iterator[pd.DataFrame]:
        a = PIXELS[path.rpartition(".")[2].lower()](content)
        step = max(1, BATCH // max(1, a.shape[1] * a.shape[2]))
        for k in range(0, len(a), step):
            part = a[k : k + step]
            yield pd.DataFrame({"subject": path, "row": np.arange(k, k + len(part)), "width": a.shape[1], "channels": a.shape[2], "values": list(part.reshape(len(part), -1).astype(np.int32))})

    return read_each(spark, path, parse, "subject string, row int, width int, channels int, values array<int>", tuple(PIXELS))


def pixels(rows: DataFrame) -> DataFrame:
    """Pixels of lines: subject, row, col, values (one for each channel)."""
    n = F.col("channels")
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).select("subject", "row", "col", F.slice("values", F.col("col") * n + 1, n).alias("values"))


def depths(pixels: DataFrame, unit: float = 1000.0) -> DataFrame:
    """Depths of pixels whose four bytes hold them, the first the lowest; unit is how many make a metre."""
    v = [F.get(F.col("values"), F.lit(k)) for k in range(4)]
    return pixels.select("subject", "row", "col", (G.depth_from_rgba(*v) * 1000 / unit).alias("depth"))


def encoded_images(pixels: DataFrame) -> DataFrame:
    """A PNG file of each image's pixels (subject, row, col, values from 0 to 255): subject, content. Pixels that aren't there are 0. A file is made in one task, as it must."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1, len(pdf["values"].iloc[0])), np.uint8)
        a[pdf["row"], pdf["col"]] = np.stack(pdf["values"].to_numpy())
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "content": [write_png(a)]})

    return pixels.select("subject", "row", "col", "values").groupBy("subject").applyInPandas(build, "subject string, content binary")
