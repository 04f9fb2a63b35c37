"""Literals, names and times of linked data, coordinates in text, and colours, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweft.functions.linalg import let, vec


def none_to_null(x: Column) -> Column:
    """Text that contains None is no value."""
    return F.when(~F.contains(x, F.lit("None")), x)


def to_double(x: Column) -> Column:
    return none_to_null(x).try_cast("double")


def to_long(x: Column) -> Column:
    return none_to_null(x).try_cast("long")


def to_number(x: Column) -> Column:
    """Struct i, d, s: the literal as a whole number, else as a decimal number if it has a point, else as text."""
    i = F.when(~F.contains(x, F.lit(".")), x.try_cast("long"))
    d = F.when(F.contains(x, F.lit(".")), x.try_cast("double"))
    return F.when(none_to_null(x).isNotNull(), F.struct(i.alias("i"), d.alias("d"), F.when(i.isNull() & d.isNull(), x).alias("s")))


NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def to_list(x: Column) -> Column:
    """Tokens of a bracketed list."""
    return F.filter(F.split(F.regexp_replace(none_to_null(x), r"[\[\](){}'\"]", " "), r"[\s,;]+"), lambda t: t != "")


def to_matrix(x: Column) -> Column:
    """Struct values array<double>, ncols: the numbers of a bracketed text by rows; null for none or for ragged rows."""
    rows = F.filter(F.split(x, r"\]"), lambda r: r.rlike(NUMBER))
    numbers = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(f"({NUMBER})")), lambda t: t.cast("double")))
    sizes = F.array_distinct(F.transform(numbers, F.size))
    return F.when(~F.lower(x).contains("none") & (F.size(sizes) == 1), F.struct(F.flatten(numbers).alias("values"), F.get(sizes, F.lit(0)).alias("ncols")))


def to_datetime(x: Column) -> Column:
    """Timestamp of EXIF, ISO or plain text, or of UNIX seconds."""
    iso = F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss")))
    return F.coalesce(iso, F.timestamp_seconds(x.try_cast("double")))


def datetime_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")


def validate_string(x: Column, replacement: str = "_") -> Column:
    """Characters that file names and subjects can't hold are replaced; a leading file:/// or http:// stays."""
    prefix = F.regexp_extract(x, r"^(file:///|https?://)", 1)
    rest = F.substring(x, F.length(prefix) + 1, F.length(x))
    return F.concat(prefix, F.regexp_replace(rest, r"[^A-Za-z0-9_./\\-]", replacement))


def replace_at(x: Column, index: int, replacement: str = "_") -> Column:
    """The character at an index (negative: from the end) replaced; null out of range."""
    at = F.lit(index) if index >= 0 else F.length(x) + index
    return F.when((at >= 0) & (at < F.length(x)), F.overlay(x, F.lit(replacement), at + 1, F.lit(1)))


def subject_name(x: Column) -> Column:
    """What follows the last / or #."""
    return F.regexp_extract(x, r"([^/#]*)$", 1)


def after_hash(x: Column) -> Column:
    return F.substring_index(x, "#", -1)


def xsd_type(x: Column) -> Column:
    """The datatype that a text value looks like."""
    return F.when(x.isNull(), None).when(F.lower(x).isin("true", "false"), "boolean").when(x.rlike(r"^[-+]?\d+$"), "integer").when(x.rlike(r"^[-+]?\d*\.\d+([eE][-+]?\d+)?$"), "float").when(x.rlike(r"^\d{4}-\d\d-\d\d(T.*)?$"), "dateTime").otherwise("string")


def dms_to_dd(degrees: Column, minutes: Column, seconds: Column, direction: Column) -> Column:
    dd = degrees + minutes / 60 + seconds / 3600
    return F.when(direction.isin("W", "S"), -dd).otherwise(dd)


def dd_to_dms(deg: Column) -> Column:
    """(degrees, minutes, seconds), the first two cut to whole numbers."""
    d = F.when(deg < 0, F.ceil(deg)).otherwise(F.floor(deg)).cast("double")
    md = F.abs(deg - d) * 60
    m = F.floor(md).cast("double")
    return vec(d, m, (md - m) * 60)


def parse_dms(x: Column) -> Column:
    """Decimal degrees of text such as [[6 , 30 , 0, N ]]; null for what can't be read."""
    t = F.split(F.regexp_replace(x, r"[\[\]()\s'\"]", ""), ",")
    n = [F.get(t, F.lit(k)).try_cast("double") for k in range(3)]
    return F.when(F.size(t) == 4, dms_to_dd(*n, F.upper(F.get(t, F.lit(3)))))


def signed_coordinate(x: Column) -> Column:
    """51.2N and the like: south and west are negative."""
    n = F.regexp_extract(x, f"({NUMBER})", 1).try_cast("double")
    return F.when(x.rlike("[SsWw]"), -n).otherwise(n)


def ratio(x: Column) -> Column:
    """10000/1600 as a number."""
    t = F.split(x, "/")
    return F.get(t, F.lit(0)).try_cast("double") / F.nullif(F.get(t, F.lit(1)).try_cast("double"), F.lit(0.0))


# The Belgian Lambert 72 projection (EPSG 31370) on the International 1924 ellipsoid, and its shift to WGS84.
A, FLATTENING = 6378388.0, 1 / 297.0
N, G_F, R0_X, R0_Y = 0.7716421928, 1.81329763, 150000.013, 5400088.438
MERIDIAN = 0.07622702237028546
SHIFT = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)  # metres, arc seconds, parts per million
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563


def _geocentric(lat: Column, lon: Column, a: float, f: float) -> list[Column]:
    e2 = 2 * f - f * f
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)]


def _geodetic(x: Column, y: Column, z: Column, a: float, f: float) -> tuple[Column, Column]:
    e2 = 2 * f - f * f
    b = a * (1 - f)
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    return lat, F.atan2(y, x)


def _shift(p: list[Column], sign: int) -> list[Column]:
    """Position-vector rotation; the way back turns all signs, exact to millimetres."""
    tx, ty, tz, rx, ry, rz, s = (sign * v for v in SHIFT)
    rx, ry, rz = (v / 3600 * math.pi / 180 for v in (rx, ry, rz))
    k = 1 + s * 1e-6
    x, y, z = p
    return [tx + k * (x - rz * y + ry * z), ty + k * (rz * x + y - rx * z), tz + k * (-ry * x + rx * y + z)]


def _conformal_to_geodetic(x: Column) -> Column:
    """The series of the geodetic latitude in multiples of the conformal one, to the eighth power of the eccentricity."""
    e2 = 2 * FLATTENING - FLATTENING**2
    a2 = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    a4 = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    a6 = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    return x + a2 * F.sin(2 * x) + a4 * F.sin(4 * x) + a6 * F.sin(6 * x)


def _datum(lat: Column, lon: Column, sign: int) -> Column:
    """(latitude, longitude) in radians on the other ellipsoid."""
    (a, f), (b, g) = ((A, FLATTENING), (WGS_A, WGS_F))[::sign]
    return let(vec(*_shift(_geocentric(lat, lon, a, f), sign)), lambda p: vec(*_geodetic(p[0], p[1], p[2], b, g)))


def l72_to_wgs84(x: Column, y: Column) -> Column:
    """(latitude, longitude) in degrees of Belgian Lambert 72 metres."""

    def conic(p: Column) -> Column:
        r = F.sqrt(p[0] * p[0] + p[1] * p[1])
        return vec(math.pi / 2 - 2 * F.atan(F.pow(r / (A * G_F), F.lit(1 / N))), F.atan2(p[0], p[1]) / N + MERIDIAN)

    return let(let(vec(x - R0_X, R0_Y - y), conic), lambda q: let(_datum(_conformal_to_geodetic(q[0]), q[1], 1), lambda w: vec(F.degrees(w[0]), F.degrees(w[1]))))


def wgs84_to_l72(lat: Column, lon: Column) -> Column:
    """Belgian Lambert 72 metres of degrees."""
    e = (2 * FLATTENING - FLATTENING**2) ** 0.5

    def conic(q: Column) -> Column:
        t = F.tan(math.pi / 4 - q[0] / 2) / F.pow((1 - e * F.sin(q[0])) / (1 + e * F.sin(q[0])), F.lit(e / 2))
        return vec(A * G_F * F.pow(t, F.lit(N)), N * (q[1] - MERIDIAN))

    return let(let(_datum(F.radians(lat), F.radians(lon), -1), conic), lambda p: vec(R0_X + p[0] * F.sin(p[1]), R0_Y - p[0] * F.cos(p[1])))


# colours


def loa_label(r30: Column, r20: Column, r10: Column, least: float = 0.95) -> Column:
    return F.when(r30 > least, "LOA30").when(r20 > least, "LOA20").when(r10 > least, "LOA10").otherwise("NO_LOA")


def color_by_loa(d: Column, t00: float = 0.15, t10: float = 0.1, t20: float = 0.05, t30: float = 0.015) -> Column:
    """The colour of the tightest threshold that a distance meets, grey beyond all."""
    return F.when(d <= t30, vec(0, 1, 0)).when(d <= t20, vec(1, 1, 0)).when(d <= t10, vec(1, 0.76, 0)).when(d <= t00, vec(1, 0, 0)).otherwise(vec(0.5, 0.5, 0.5))


def color_by_completion(c: Column) -> Column:
    return F.when(c >= 0.95, "green").when(c <= 0.25, "red").when(c <= 0.5, "amber").when(c < 0.95, "yellow")


def bucket_color(bucket: Column, buckets: int) -> Column:
    """From green for bucket 0 to red for the last."""
    t = bucket / max(1, buckets - 1)
    return vec(t, 1 - t, 0)

# Fixed values of the drawing colour index: colours 0 to 9 and 250 to 255, and for the ten last digits of the others the five levels of a channel, from none to full.
ACI_FIRST = ((0, 0, 0), (255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 255, 255), (65, 65, 65), (128, 128, 128))
ACI_GREY = (51, 80, 105, 130, 190, 255)
ACI_LEVELS = (
    (0, 63, 127, 191, 255),
    (170, 191, 212, 234, 255),
    (0, 46, 94, 141, 189),
    (126, 141, 157, 173, 189),
    (0, 31, 64, 96, 129),
    (86, 96, 107, 118, 129),
    (0, 25, 52, 78, 104),
    (69, 78, 86, 95, 104),
    (0, 19, 39, 59, 79),
    (53, 59, 66, 73, 79),
)


def aci_rgb(index: Column) -> Column:
    """(r, g, b) from 0 to 255 of a colour index: 24 hues of 15 degrees by the tens, brightness and paleness by the last digit. Null beyond 0 to 255."""
    step = F.floor(index / 10).cast("int") - 1
    levels = F.array(*(vec(*row) for row in ACI_LEVELS))

    def channel(turn: int) -> Column:
        # full near its own third of the circle, none on the far side, in quarters between
        away = F.abs((step + turn) % 24 - 12)
        quarter = F.greatest(F.lit(0), F.least(F.lit(4), away - 4)).cast("int")
        return F.get(F.get(levels, (index % 10).cast("int")), quarter)

    hue = F.array(channel(0), channel(16), channel(8))
    table = lambda rows, at: F.get(F.array(*(vec(*r) for r in rows)), at.cast("int"))
    return F.when(index < 0, None).when(index < 10, table(ACI_FIRST, index)).when(index < 250, hue).when(index <= 255, table([(g, g, g) for g in ACI_GREY], index - 250))


def random_rgb(key: Column, seed: int = 0, most: int = 1) -> Column:
    """A colour for a key, the same each time: three numbers from 0 to 1, or whole ones up to most."""
    part = [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) for k in range(3)]
    return vec(*(x if most == 1 else F.floor(x * (most + 1)) for x in part))


# paths and values


def relative_path(path: Column, folder: Column) -> Column:
    """A path as seen from a folder: .. for every step up to what both share, then the way down; paths of another root stay."""
    a = F.filter(F.split(F.regexp_replace(path, r"\\\\", "/"), "/"), lambda x: ~x.isin("", "."))
    b = F.filter(F.split(F.regexp_replace(folder, r"\\\\", "/"), "/"), lambda x: ~x.isin("", "."))
    apart = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)) | F.get(a, k).isNull())
    shared = F.get(apart, F.lit(0))
    way = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0))))
    same_root = F.startswith(path, F.lit("/")) == F.startswith(folder, F.lit("/"))
    return F.when(same_root & (F.size(F.array_intersect(F.slice(a, 1, 1), F.slice(b, 1, 1))) + F.startswith(path, F.lit("/")).cast("int") > 0), F.when(F.size(way) == 0, ".").otherwise(F.array_join(way, "/"))).otherwise(path)


def xml_number(text: Column) -> Column:
    """The number that an element holds; null for none."""
    return F.trim(text).try_cast("double")


def as_list(x: Column, kind: str) -> Column:
    """A value as an array: scalars alone, nested arrays flat; null is an empty array."""
    if kind.startswith("array<array<"):
        return F.coalesce(F.flatten(x), F.array().cast(kind.removeprefix("array<").removesuffix(">")))
    if kind.startswith("array<"):
        return F.coalesce(x, F.array().cast(kind))
    return F.when(x.isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(x))


def in_any(subject: Column, uris: Column) -> Column:
    """Whether a subject stands in one of an array of URIs."""
    return F.exists(uris, lambda u: F.contains(u, subject))
