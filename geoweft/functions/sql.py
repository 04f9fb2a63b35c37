"""Names for SQL: temporary SQL functions, which the optimizer sees as plain expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.functions import literals as X

V3, M4 = "ARRAY<DOUBLE>", "ARRAY<DOUBLE>"


def _matrix_product() -> str:
    return "array(" + ", ".join(" + ".join(f"a[{4 * r + k}] * b[{4 * k + c}]" for k in range(4)) for r in range(4) for c in range(4)) + ")"


FUNCTIONS = {
    "cr_dist3(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))",
    "cr_voxel_id(x DOUBLE, size DOUBLE) RETURNS BIGINT": "floor(x / size)",
    "cr_mat4_mul(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": _matrix_product(),
    "cr_mat4_apply(m ARRAY<DOUBLE>, p ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(" + ", ".join(f"m[{4 * r}] * p[0] + m[{4 * r + 1}] * p[1] + m[{4 * r + 2}] * p[2] + m[{4 * r + 3}]" for r in range(3)) + ")",
    "cr_mat4_inv_rigid(m ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(" + ", ".join(f"m[{r}], m[{4 + r}], m[{8 + r}], -(m[{r}] * m[3] + m[{4 + r}] * m[7] + m[{8 + r}] * m[11])" for r in range(3)) + ", 0D, 0D, 0D, 1D)",
    "cr_aabb_overlaps(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS BOOLEAN": " AND ".join(f"a[{k}] <= b[{k + 1}] AND b[{k}] <= a[{k + 1}]" for k in (0, 2, 4)),
    "cr_hull_contains(planes ARRAY<ARRAY<DOUBLE>>, p ARRAY<DOUBLE>) RETURNS BOOLEAN": "forall(planes, q -> q[0] * p[0] + q[1] * p[1] + q[2] * p[2] <= q[3])",
    "cr_quat_mul(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "array(a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1], a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0], a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3], a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2])",
    "cr_dms_to_dd(d DOUBLE, m DOUBLE, s DOUBLE, way STRING) RETURNS DOUBLE": "(d + m / 60 + s / 3600) * CASE WHEN way IN ('W', 'S') THEN -1 ELSE 1 END",
    "cr_loa_label(r30 DOUBLE, r20 DOUBLE, r10 DOUBLE) RETURNS STRING": "CASE WHEN r30 > 0.95 THEN 'LOA30' WHEN r20 > 0.95 THEN 'LOA20' WHEN r10 > 0.95 THEN 'LOA10' ELSE 'NO_LOA' END",
    "cr_subject_name(s STRING) RETURNS STRING": "regexp_extract(s, '([^/#]*)$', 1)",
    "cr_equirect_dir(u DOUBLE, v DOUBLE, w DOUBLE, h DOUBLE) RETURNS ARRAY<DOUBLE>": "array(cos(v / (h - 1) * pi() - pi() / 2) * sin(u / (w - 1) * 2 * pi() - pi()), -sin(v / (h - 1) * pi() - pi() / 2), cos(v / (h - 1) * pi() - pi() / 2) * cos(u / (w - 1) * 2 * pi() - pi()))",
}


#: Functions whose body is the column of the same meaning: name, arguments with their types, type of the result, column.
ARRAY, TABLE = "ARRAY<DOUBLE>", "ARRAY<ARRAY<DOUBLE>>"
COLUMNS = (
    ("cr_mat4_from_quat", {"q": ARRAY, "t": ARRAY}, ARRAY, lambda q, t: L.mat4_from_quat(q, t)),
    ("cr_mat4_from_euler", {"angles": ARRAY, "t": ARRAY}, ARRAY, lambda angles, t: L.mat4_from_euler(angles, t)),
    ("cr_euler_from_mat", {"m": ARRAY}, ARRAY, L.euler_from_mat),
    ("cr_obb_contains", {"box": ARRAY, "p": ARRAY}, "BOOLEAN", lambda box, p: G.obb_contains(box, p)),
    ("cr_obb_corners", {"box": ARRAY}, TABLE, G.obb_corners),
    ("cr_obb_intersects", {"a": ARRAY, "b": ARRAY}, "BOOLEAN", lambda a, b: G.obb_intersects(a, b, F.array(*G.box_rotation(a)), F.array(*G.box_rotation(b)))),
    ("cr_ray_tri_t", {"o": ARRAY, "d": ARRAY, "a": ARRAY, "b": ARRAY, "c": ARRAY}, "DOUBLE", G.ray_triangle),
    ("cr_pinhole_project", {"pose": ARRAY, "f": "DOUBLE", "cu": "DOUBLE", "cv": "DOUBLE", "p": ARRAY}, ARRAY, lambda pose, f, cu, cv, p: G.pinhole_project(pose, (f, cu, cv), p)),
    ("cr_pinhole_unproject", {"pose": ARRAY, "f": "DOUBLE", "cu": "DOUBLE", "cv": "DOUBLE", "u": "DOUBLE", "v": "DOUBLE", "depth": "DOUBLE"}, ARRAY, lambda pose, f, cu, cv, u, v, depth: G.pinhole_unproject(pose, (f, cu, cv), u, v, depth)),
    ("cr_ortho_project", {"pose": ARRAY, "p": ARRAY, "gsd": "DOUBLE", "w": "DOUBLE", "h": "DOUBLE"}, ARRAY, G.ortho_project),
    ("cr_dd_to_dms", {"deg": "DOUBLE"}, ARRAY, X.dd_to_dms),
    ("cr_l72_to_wgs84", {"x": "DOUBLE", "y": "DOUBLE"}, ARRAY, X.l72_to_wgs84),
    ("cr_wgs84_to_l72", {"lat": "DOUBLE", "lon": "DOUBLE"}, ARRAY, X.wgs84_to_l72),
    ("cr_parse_matrix", {"s": "STRING"}, ARRAY, lambda s: X.to_matrix(s)["values"]),
    ("cr_parse_literal", {"s": "STRING"}, "DOUBLE", X.to_double),
    ("cr_aci_rgb", {"i": "INT"}, ARRAY, X.aci_rgb),
)
#: Functions of SQL alone, and functions that return rows.
FUNCTIONS["cr_morton(i BIGINT, j BIGINT, k BIGINT, depth INT) RETURNS BIGINT"] = "aggregate(sequence(0, depth - 1), 0L, (s, b) -> s + shiftleft(shiftright(i, b) & 1L, 3 * b) + shiftleft(shiftright(j, b) & 1L, 3 * b + 1) + shiftleft(shiftright(k, b) & 1L, 3 * b + 2))"
STEPS = "transform(sequence(0L, greatest(CAST(ceil(round(({hi} - {lo}) / {step}, 9)) AS BIGINT) - 1L, 0L)), n -> {lo} + n * {step})"
BOUNDS = "xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE, zmin DOUBLE, zmax DOUBLE"


def _steps(c: str) -> str:
    return STEPS.format(lo=f"{c}min", hi=f"{c}max", step="resolution")


def _nested(x: str, y: str, item: str) -> str:
    return f"flatten(transform({x}, x -> transform({y}, y -> {item})))"


LENGTH = "sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))"
TILE = "named_struct('tile_row', x, 'tile_col', y, 'x0', y * width, 'y0', x * height, 'x1', least((y + 1) * width, CAST(w AS BIGINT)), 'y1', least((x + 1) * height, CAST(h AS BIGINT)))"
#: Functions of rows: name, arguments, fields, and the array of structs that they make. As name_list they are scalar, for the rows of a table (made in a subquery, then LATERAL VIEW inline); as name they are tables of constant arguments.
ROWS = (
    ("cr_xyz_grid", f"{BOUNDS}, resolution DOUBLE", "x DOUBLE, y DOUBLE, z DOUBLE", f"flatten(transform({_steps('x')}, x -> flatten(transform({_steps('y')}, y -> transform({_steps('z')}, z -> named_struct('x', x, 'y', y, 'z', z))))))"),
    ("cr_xy_rays", f"{BOUNDS}, resolution DOUBLE, start DOUBLE", "ox DOUBLE, oy DOUBLE, oz DOUBLE, dz DOUBLE", _nested(_steps("x"), _steps("y"), "named_struct('ox', x, 'oy', y, 'oz', zmax + start, 'dz', -1D)")),
    ("cr_sample_line", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, step DOUBLE", "s BIGINT, x DOUBLE, y DOUBLE, z DOUBLE", f"transform(filter(sequence(0L, CAST(floor({LENGTH} / step) AS BIGINT)), s -> floor({LENGTH} / step) >= 1), s -> named_struct('s', s, " + ", ".join(f"'{c}', a[{k}] + (b[{k}] - a[{k}]) * (s / floor({LENGTH} / step))" for k, c in enumerate("xyz")) + "))"),
    ("cr_tiles", "w INT, h INT, width INT, height INT", "tile_row BIGINT, tile_col BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT", _nested("sequence(0L, CAST(ceil(h / height) AS BIGINT) - 1L)", "sequence(0L, CAST(ceil(w / width) AS BIGINT) - 1L)", TILE)),
)
OPERATOR = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])([-+*/%<>=!&|^]+|and|or|not)(?=\()")


def text_of(column: Column) -> str:
    """A column as SQL: the plan's own text, whose operators stand before their operands, as names in back quotes."""
    return OPERATOR.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], column._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names; afterwards FUNCTIONS holds the text of those that stand for columns and rows too."""
    heads = FUNCTIONS
    for name, arguments, kind, build in COLUMNS:
        heads[f"{name}({', '.join(f'{a} {t}' for a, t in arguments.items())}) RETURNS {kind}"] = text_of(build(*map(F.col, arguments)).cast(kind))
    for name, arguments, fields, body in ROWS:
        names = ", ".join(x.split()[0] for x in arguments.split(", "))
        kinds = ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in fields.split(", "))
        heads[f"{name}_list({arguments}) RETURNS ARRAY<STRUCT<{kinds}>>"] = body
        heads[f"{name}({arguments}) RETURNS TABLE({fields})"] = f"SELECT inline(l) FROM (SELECT {name}_list({names}) AS l)"
    for head, body in heads.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in heads]
