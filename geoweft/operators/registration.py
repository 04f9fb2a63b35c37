"""Poses from matches: rigid motions, relative and absolute camera poses, means of estimates, whole sessions, clouds by their features, cameras by boards.

Matching, counting and weighing are joins and aggregates; what is left for numpy is one pair of images or clouds, whose matches are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geometry as G
from geoweft.functions import linalg as L
from geoweft.operators.joins import within_distance

#: Fixed value: with fewer links than this a pose from points and pixels isn't tried.
LEAST_LINKS = 10


def matrix(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, np.ravel(t)
    return out


def rigid(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The 4x4 of the rotation and translation that brings points p nearest to q, by weight."""
    w = np.ones(len(p)) if w is None else w
    a, b = (w @ p) / w.sum(), (w @ q) / w.sum()
    u, _, vt = np.linalg.svd(((p - a) * w[:, None]).T @ (q - b))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    return matrix(r, b - r @ a)


def _normalized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = x.mean(0)
    s = math.sqrt(2) / max(1e-12, np.linalg.norm(x - centre, axis=1).mean())
    t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
    return np.c_[x, np.ones(len(x))] @ t.T, t


def essential(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The essential matrix of 8 or more pairs of points on the plane at distance 1."""
    a, ta = _normalized(x1)
    b, tb = _normalized(x2)
    e = np.linalg.svd((b[:, :, None] * a[:, None, :]).reshape(-1, 9))[2][-1].reshape(3, 3)
    u, s, vt = np.linalg.svd(tb.T @ e @ ta)
    return u @ np.diag([1, 1, 0]) * (s[0] + s[1]) / 2 @ vt


def _sampson(e: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    a, b = np.c_[x1, np.ones(len(x1))], np.c_[x2, np.ones(len(x2))]
    f, g = a @ e.T, b @ e
    return (b * f).sum(1) ** 2 / np.maximum(1e-18, f[:, 0] ** 2 + f[:, 1] ** 2 + g[:, 0] ** 2 + g[:, 1] ** 2)


def _depths(r: np.ndarray, t: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Depths of triangulated points in both cameras."""
    a, b = np.c_[x1, np.ones(len(x1))] @ r.T, np.c_[x2, np.ones(len(x2))]
    # b * z2 = a * z1 + t
    out = np.zeros((len(a), 2))
    for k in range(len(a)):
        out[k] = np.linalg.lstsq(np.stack([a[k], -b[k]], 1), -t, rcond=None)[0]
    return out


def relative_pose(x1: np.ndarray, x2: np.ndarray, tolerance: float = 1e-3, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, translation of length 1, inliers): what brings points of the first camera's frame to the second's, from pairs of points on the plane at distance 1, by random samples of 8."""
    rng, best = np.random.default_rng(seed), np.zeros(len(x1), bool)
    for _ in range(rounds):
        pick = rng.choice(len(x1), 8, replace=False)
        near = _sampson(essential(x1[pick], x2[pick]), x1, x2) < tolerance * tolerance
        if near.sum() > best.sum():
            best = near
    if best.sum() < 8:
        best = np.ones(len(x1), bool)
    u, _, vt = np.linalg.svd(essential(x1[best], x2[best]))
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    chosen = max(((u @ m @ vt, s * u[:, 2]) for m in (w, w.T) for s in (1, -1)), key=lambda rt: int((_depths(*rt, x1[best], x2[best]) > 0).all(1).sum()))
    return (*chosen, best)


def absolute_pose(points: np.ndarray, x: np.ndarray, tolerance: float = 8.0, focal: float = 1.0, rounds: int = 300, seed: int = 0) -> np.ndarray | None:
    """The camera's 4x4, from camera to world, by points and where they are seen on the plane at distance 1: random samples of 6, then all that lie within tolerance pixels. None where nothing agrees."""

    def solve(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre, s = p.mean(0), max(1e-12, np.linalg.norm(p - p.mean(0), axis=1).mean())
        h = np.c_[(p - centre) / s, np.ones(len(p))]
        z = np.zeros_like(h)
        rows = np.concatenate([np.c_[h, z, -v[:, :1] * h], np.c_[z, h, -v[:, 1:] * h]])
        m = np.linalg.svd(rows)[2][-1].reshape(3, 4)
        m = m @ np.block([[np.eye(3) / s, (-centre / s)[:, None]], [np.zeros((1, 3)), np.ones((1, 1))]])
        u, d, vt = np.linalg.svd(m[:, :3])
        sign = np.sign(np.linalg.det(u @ vt))
        return sign * u @ vt, sign * m[:, 3] / d.mean()

    def errors(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        q = points @ r.T + t
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(q[:, 2] > 0, np.linalg.norm(q[:, :2] / q[:, 2:] - x, axis=1) * focal, np.inf)

    rng, best = np.random.default_rng(seed), np.zeros(len(points), bool)
    for _ in range(rounds):
        pick = rng.choice(len(points), 6, replace=False)
        near = errors(*solve(points[pick], x[pick])) <= tolerance
        if near.sum() > best.sum():
            best = near
    if best.sum() < 6:
        return None
    r, t = solve(points[best], x[best])
    for _ in range(10):
        # steps of least squares on a small turn and shift
        q = points[best] @ r.T + t
        z = q[:, 2]
        j = np.zeros((len(q), 2, 6))
        for c in range(2):
            j[:, c, 3 + c], j[:, c, 5] = 1 / z, -q[:, c] / z**2
            d = np.zeros((len(q), 3))
            d[:, c], d[:, 2] = 1 / z, -q[:, c] / z**2
            j[:, c, :3] = np.cross(q, d)
        e = (x[best] - q[:, :2] / q[:, 2:]).ravel()
        step = np.linalg.lstsq(j.reshape(-1, 6), e, rcond=None)[0]
        turn = rodrigues(step[:3])
        r, t = turn @ r, turn @ t + step[3:]
    return matrix(r.T, -r.T @ t)


def rodrigues(v: np.ndarray) -> np.ndarray:
    """The rotation about a vector by its length."""
    a = np.linalg.norm(v)
    if a < 1e-15:
        return np.eye(3)
    k = v / a
    c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(a) * c + (1 - math.cos(a)) * c @ c


def rotation_between(a, b) -> Column:
    """The 3x3 that turns vector a to b, as an array of 9, by the shortest way; for opposite vectors half a turn about an axis across them."""

    def turn(x: Column) -> Column:
        k, c = x[0], x[1][0]
        f = 1 / F.nullif(1 + c, F.lit(0.0))
        straight = F.array(*(k[i] * k[j] * f + (c if i == j else ((-k[2], k[1]), (k[2], -k[0]), (-k[1], k[0]))[i][j - (j > i)]) for i in range(3) for j in range(3)))
        return straight

    u, v = L.normalize(a), L.normalize(b)
    across = L.let(u, lambda w: L.normalize(L.cross(w, F.when(F.abs(w[0]) < 0.9, L.vec(1, 0, 0)).otherwise(L.vec(0, 1, 0)))))
    half = L.let(across, lambda n: F.array(*(2 * n[i] * n[j] - (1.0 if i == j else 0.0) for i in range(3) for j in range(3))))
    return L.let(F.array(L.cross(u, v), L.vec(L.dot(u, v), 0, 0)), lambda x: F.when(x[1][0] < -1 + 1e-12, half).otherwise(turn(x)))


def pair_poses(matches: DataFrame, by: list[str]) -> DataFrame:
    """The pose of the second image in the first one's frame for each pair (columns by, u1, v1, u2, v2 and the images' f1, cu1, cv1, f2, cu2, cv2): t (with a translation of length 1), inliers, n. Pairs of fewer than 8 matches have none."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {c: pdf[c].iloc[0] for c in by}
        if len(pdf) < 8:
            return pd.DataFrame([row | {"t": None, "inliers": 0, "n": len(pdf)}])
        x1, x2 = (np.stack([(pdf[f"u{k}"] - pdf[f"cu{k}"]) / pdf[f"f{k}"], (pdf[f"v{k}"] - pdf[f"cv{k}"]) / pdf[f"f{k}"]], 1) for k in (1, 2))
        r, t, near = relative_pose(x1, x2)
        return pd.DataFrame([row | {"t": matrix(r.T, -r.T @ t).ravel().tolist(), "inliers": int(near.sum()), "n": len(pdf)}])

    kinds = dict(matches.dtypes)
    return matches.groupBy(*by).applyInPandas(build, ", ".join(f"{c} {kinds[c]}" for c in by) + ", t array<double>, inliers int, n int")


def point_links(known: DataFrame, matches: DataFrame) -> DataFrame:
    """Points of the world with their pixels in a new image: known (image, u, v, x, y, z), matches (image, u1, v1, other, u2, v2) that begin in the known image; equal rounded pixels join, one link for each point."""
    at = lambda c: F.round(c).cast("long")
    a = known.select("image", at("u").alias("i"), at("v").alias("j"), "x", "y", "z")
    b = matches.groupBy("image", "other", at("u1").alias("i"), at("v1").alias("j")).agg(F.min(F.struct(at("u2").alias("u"), at("v2").alias("v"))).alias("p"))
    return a.join(b, ["image", "i", "j"]).select("other", "x", "y", "z", F.col("p.u").alias("u"), F.col("p.v").alias("v"))


def linked_poses(links: DataFrame, cameras: DataFrame, least: int = LEAST_LINKS) -> DataFrame:
    """The pose of each new image (other) from its links (x, y, z, u, v) and camera (other, focal, cu, cv): t, n; null with fewer links than least."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        if len(pdf) >= least:
            f, cu, cv = (float(pdf[c].iloc[0]) for c in ("focal", "cu", "cv"))
            found = absolute_pose(pdf[["x", "y", "z"]].to_numpy(float), np.stack([(pdf["u"] - cu) / f, (pdf["v"] - cv) / f], 1), focal=f)
            out = None if found is None else found.ravel().tolist()
        return pd.DataFrame([{"other": pdf["other"].iloc[0], "t": out, "n": len(pdf)}])

    kind = dict(links.dtypes)["other"]
    return links.join(cameras, "other").groupBy("other").applyInPandas(build, f"other {kind}, t array<double>, n int")


def scaled_translation(t: Column, length: Column) -> Column:
    """A pose with its translation stretched to the length; a translation of 0 stays."""
    n = L.norm(L.translation_of(t))
    k = F.when(n == 0, F.lit(1.0)).otherwise(length / n)
    return L.mat4_of(L.rotation_of(t), [t[4 * r + 3] * k for r in range(3)])


def reference_scale(t1: Column, t2: Column) -> Column:
    """The distance between two poses, which gives a relative pose its length."""
    return L.distance(L.translation_of(t1), L.translation_of(t2))


def meeting_point(o1, d1, o2, d2) -> Column:
    """(x, y, z, gap): the middle of the shortest segment between two lines, and its length; parallel lines meet between their origins."""

    def solve(x: Column) -> Column:
        o1, d1, o2, d2 = (x[k] for k in range(4))
        w, a, b, c = L.sub(o1, o2), L.dot(d1, d1), L.dot(d1, d2), L.dot(d2, d2)
        d, e = L.dot(d1, w), L.dot(d2, w)
        det = F.nullif(F.when(F.abs(a * c - b * b) < 1e-12, 0.0).otherwise(a * c - b * b), F.lit(0.0))
        s, t = F.coalesce((b * e - c * d) / det, F.lit(0.0)), F.coalesce((a * e - b * d) / det, F.lit(0.0))
        return L.let(F.array(L.add(o1, L.scale(d1, s)), L.add(o2, L.scale(d2, t))), lambda p: L.vec(*((p[0][k] + p[1][k]) / 2 for k in range(3)), L.distance(p[0], p[1])))

    return L.let(F.array(*(v if isinstance(v, Column) else L.vec(*v) for v in (o1, d1, o2, d2))), solve)


def cross_referenced(best: DataFrame) -> DataFrame:
    """Poses of images from their two best references (test, rank 1 and 2, the reference's pose t and the relative pose rel): in the middle of where both directions meet, turned as the first says: test, t, gap."""
    place = L.mat4_mul(F.col("t"), F.col("rel"))
    rows = best.where("rank <= 2").withColumn("_m", place)
    both = rows.groupBy("test").agg(*(F.max(F.when(F.col("rank") == k, F.struct("t", "_m"))).alias(f"r{k}") for k in (1, 2))).where("r1 IS NOT NULL AND r2 IS NOT NULL")
    line = lambda r: (L.translation_of(F.col(f"{r}.t")), L.sub(L.translation_of(F.col(f"{r}._m")), L.translation_of(F.col(f"{r}.t"))))
    rows = both.withColumn("_p", meeting_point(*line("r1"), *line("r2")))
    return rows.select("test", L.mat4_of(L.rotation_of(F.col("r1._m")), [F.col("_p")[k] for k in range(3)]).alias("t"), F.col("_p")[3].alias("gap"))


# means and sessions


def weighted_poses(estimates: DataFrame, by: list[str], weight: str = "confidence") -> DataFrame:
    """The mean pose of each group of estimates (t as 16 numbers, weight): the weighted mean of places, and the rotation nearest to all by weight. Sums of products are aggregates; each group's one 4x4 is solved in batches."""
    quat = estimates.withColumn("_q", quaternion(L.rotation_of(F.col("t"))))
    w = F.col(weight)
    products = [F.sum(w * F.col("_q")[i] * F.col("_q")[j]).alias(f"q{i}{j}") for i in range(4) for j in range(i, 4)]
    sums = quat.groupBy(*by).agg(F.sum(w).alias("_w"), *(F.sum(w * F.col("t")[4 * k + 3]).alias(f"p{k}") for k in range(3)), *products).where("_w > 0")
    kinds = dict(estimates.dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                m = np.array([[row[f"q{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                q = np.linalg.eigh(m)[1][:, -1]
                q = q * np.sign(q[np.argmax(np.abs(q))])
                out.append(q.tolist() + [row[f"p{k}"] / row["_w"] for k in range(3)])
            yield b[by].assign(_qp=out)

    solved = sums.mapInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", _qp array<double>")
    return solved.select(*by, L.mat4_from_quat([F.col("_qp")[k] for k in range(4)], [F.col("_qp")[4 + k] for k in range(3)]).alias("t"))


def quaternion(r: list[Column]) -> Column:
    """(x, y, z, w) of a 3x3 rotation, by its largest part."""

    def solve(m: Column) -> Column:
        a = [m[k] for k in range(9)]
        trace = a[0] + a[4] + a[8]
        root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0))) * 2
        by_w = L.let(root(1 + trace), lambda s: L.vec((a[7] - a[5]) / s, (a[2] - a[6]) / s, (a[3] - a[1]) / s, s / 4))
        by_x = L.let(root(1 + a[0] - a[4] - a[8]), lambda s: L.vec(s / 4, (a[1] + a[3]) / s, (a[2] + a[6]) / s, (a[7] - a[5]) / s))
        by_y = L.let(root(1 + a[4] - a[0] - a[8]), lambda s: L.vec((a[1] + a[3]) / s, s / 4, (a[5] + a[7]) / s, (a[2] - a[6]) / s))
        by_z = L.let(root(1 + a[8] - a[0] - a[4]), lambda s: L.vec((a[2] + a[6]) / s, (a[5] + a[7]) / s, s / 4, (a[3] - a[1]) / s))
        return F.when(trace > 0, by_w).when((a[0] >= a[4]) & (a[0] >= a[8]), by_x).when(a[4] >= a[8], by_y).otherwise(by_z)

    return L.let(F.array(*r), solve)


def close_sessions(sessions: DataFrame, bounds: list[float]) -> DataFrame:
    """Sessions whose bounds (xmin .. zmax) touch or overlap the given ones."""
    own = [F.col(f"{c}{s}") for c in "xyz" for s in ("min", "max")]
    return sessions.where(G.aabb_overlaps(own, [float(b) for b in bounds]))


#: What a test resource of a kind needs in a reference session (least numbers of its images and meshes) for each method.
METHODS = (("ImageNode", "crossref", 2, 0), ("ImageNode", "incremental", 2, 0), ("ImageNode", "raycast", 1, 1), ("MeshNode", "fgr", 0, 1), ("MeshNode", "super4pcs", 0, 1))


def session_plan(tests: DataFrame, references: DataFrame) -> DataFrame:
    """Which methods can place each test resource (test, kind) by each reference session (session, kind of each of its resources): test, session, method."""
    counts = references.groupBy("session").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("ImageNode", "images"), ("MeshNode", "meshes"))))
    plan = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("method"), F.lit(i).alias("images"), F.lit(n).alias("meshes")) for k, m, i, n in METHODS))
    # sessions are few beside the tests: a row with all of them is looked through
    sessions = counts.agg(F.collect_list(F.struct("session", "images", "meshes")).alias("_s"))
    rows = tests.select("test", "kind", F.explode(F.filter(plan, lambda p: p["kind"] == F.col("kind"))).alias("p")).join(F.broadcast(sessions)).withColumn("s", F.explode("_s"))
    return rows.where((F.col("s.images") >= F.col("p.images")) & (F.col("s.meshes") >= F.col("p.meshes"))).select("test", "s.session", "p.method")


def session_positions(estimates: DataFrame) -> DataFrame:
    """The place of each session (column session) by all estimates of it (t, confidence)."""
    return weighted_poses(estimates, ["session"])


# clouds


def fpfh(points: DataFrame, radius: float, key: str = "id", bins: int = 11) -> DataFrame:
    """Fast point feature histograms of points with normals: key, feature (3 * bins numbers). Pairs in reach give three angles, counted in bins by aggregates; a point's own counts are
    shares of 100, and those of its neighbours are added by one over their distance."""
    wide = [key, "x", "y", "z", "nx", "ny", "nz"]
    p = points.select(*wide)
    pairs = within_distance(p, p, radius).where("d > 0")
    n1, n2 = ([F.col(f"{s}.n{c}") for c in "xyz"] for s in "qr")
    way = [(F.col(f"r.{c}") - F.col(f"q.{c}")) / F.col("d") for c in "xyz"]

    def angles(x: Column) -> Column:
        u, d, m = x[0], x[1], x[2]
        return L.let(L.normalize(L.cross(u, d)), lambda v: L.let(L.cross(u, v), lambda w: L.vec(F.atan2(L.dot(w, m), L.dot(u, m)), L.dot(v, m), L.dot(u, d))))

    found = L.let(F.array(L.vec(*n1), L.vec(*way), L.vec(*n2)), angles)
    spans = ((-math.pi, math.pi), (-1.0, 1.0), (-1.0, 1.0))
    slot = lambda k: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("_a")[k] - spans[k][0]) / (spans[k][1] - spans[k][0]) * bins).cast("int"))) + k * bins
    counted = pairs.withColumn("_a", found).select(F.col(f"q.{key}").alias("u"), F.col(f"r.{key}").alias("v"), "d", F.array(*(slot(k) for k in range(3))).alias("s"))
    counts = counted.groupBy("u").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.array_contains("s", k).cast("int")).alias(f"h{k}") for k in range(3 * bins)))
    simple = counts.select("u", F.array(*(F.col(f"h{k}") * 100.0 / F.col("n") for k in range(3 * bins))).alias("h"))
    around = counted.select("u", "v", "d").join(simple.select(F.col("u").alias("v"), "h"), "v").groupBy("u").agg(F.count(F.lit(1)).alias("k"), F.array(*(F.sum(F.col("h")[b] / F.col("d")) for b in range(3 * bins))).alias("g"))
    return simple.join(around, "u").select(F.col("u").alias(key), F.zip_with("h", F.transform("g", lambda g: g / F.col("k")), lambda a, b: a + b).alias("feature"))


def feature_pairs(a: np.ndarray, b: np.ndarray, mutual: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows of a and b whose features are nearest to each other."""
    def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        for k in range(0, len(p), 512):
            out[k : k + 512] = ((p[k : k + 512] ** 2).sum(1)[:, None] - 2 * p[k : k + 512] @ q.T + (q**2).sum(1)).argmin(1)
        return out

    forth = nearest(a, b)
    keep = nearest(b, a)[forth] == np.arange(len(a)) if mutual else np.ones(len(a), bool)
    return np.flatnonzero(keep), forth[keep]


def sampled_registration(p: np.ndarray, q: np.ndarray, distance: float, rounds: int = 100_000, confidence: float = 0.999, edges: float = 0.9, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """(4x4, share of pairs in reach, their root mean square distance) from pairs of points of which some are wrong: random triples whose sides agree by the share edges, then all pairs in reach."""
    rng, best, most, k = np.random.default_rng(seed), np.eye(4), -1, 0
    while k < rounds and len(p) >= 3:
        k += 1
        i = rng.choice(len(p), 3, replace=False)
        s, t = (np.linalg.norm(x[i] - x[np.roll(i, 1)], axis=1) for x in (p, q))
        if (s < edges * t).any() or (t < edges * s).any():
            continue
        m = rigid(p[i], q[i])
        near = int((np.linalg.norm(p @ m[:3, :3].T + m[:3, 3] - q, axis=1) <= distance).sum())
        if near > most:
            best, most = m, near
            share = (near / len(p)) ** 3
            rounds = min(rounds, k + math.ceil(math.log(1 - confidence) / math.log(max(1e-12, 1 - share)))) if share < 1 else k
    near = np.linalg.norm(p @ best[:3, :3].T + best[:3, 3] - q, axis=1) <= distance
    if near.sum() >= 3:
        best = rigid(p[near], q[near])
    d = np.linalg.norm(p @ best[:3, :3].T + best[:3, 3] - q, axis=1)
    near = d <= distance
    return best, float(near.mean()) if len(p) else 0.0, float(np.sqrt((d[near] ** 2).mean())) if near.any() else 0.0


def graduated_registration(p: np.ndarray, q: np.ndarray, distance: float, rounds: int = 64) -> tuple[np.ndarray, float, float]:
    """The same without samples: pairs are weighed by how well they fit, at first gently, then ever more sharply."""
    m, mu = np.eye(4), max(1e-12, float(((p - p.mean(0)) ** 2).sum(1).max())) if len(p) else 1.0
    for k in range(rounds if len(p) >= 3 else 0):
        d2 = ((p @ m[:3, :3].T + m[:3, 3] - q) ** 2).sum(1) if k else np.zeros(len(p))
        m = rigid(p, q, (mu / (mu + d2)) ** 2)
        mu = max(distance * distance, mu / 1.4)
    d = np.linalg.norm(p @ m[:3, :3].T + m[:3, 3] - q, axis=1) if len(p) else np.zeros(0)
    near = d <= distance
    return m, float(near.mean()) if len(p) else 0.0, float(np.sqrt((d[near] ** 2).mean())) if near.any() else 0.0


def registered(sources: DataFrame, targets: DataFrame, distance: float, fast: bool = False, by: str = "pair") -> DataFrame:
    """For each pair of clouds (column by; x, y, z, feature; thinned to a voxel each before, so one task holds both) what moves the source onto the target: t, fitness, rmse.

    Pairs of points are those whose features are nearest to each other. distance is in reach; 1.5 times the voxel is usual.
    """

    def build(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({by: [], "t": [], "fitness": [], "rmse": []})
        i, j = feature_pairs(np.stack(a["feature"].to_numpy()), np.stack(b["feature"].to_numpy()))
        p, q = a[["x", "y", "z"]].to_numpy(float)[i], b[["x", "y", "z"]].to_numpy(float)[j]
        m, fitness, rmse = (graduated_registration if fast else sampled_registration)(p, q, distance)
        return pd.DataFrame([{by: a[by].iloc[0], "t": m.ravel().tolist(), "fitness": fitness, "rmse": rmse}])

    kind = dict(sources.dtypes)[by]
    columns = [by, "x", "y", "z", "feature"]
    return sources.select(*columns).groupBy(by).cogroup(targets.select(*columns).groupBy(by)).applyInPandas(build, f"{by} {kind}, t array<double>, fitness double, rmse double")


# calibration


def homography(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The 3x3 that maps points of one plane to another's."""
    a, ta = _normalized(p)
    b, tb = _normalized(q)
    z = np.zeros_like(a)
    rows = np.concatenate([np.c_[a, z, -b[:, :1] * a], np.c_[z, a, -b[:, 1:2] * a]])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2]


def calibrated(boards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(intrinsic 3x3, pose of the camera for each view) of three or more views of a flat board: (corners on the board, their pixels) each."""
    hs = [homography(p, q) for p, q in boards]

    def row(h: np.ndarray, i: int, j: int) -> list[float]:
        a, b = h[:, i], h[:, j]
        return [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]]

    v = np.array([r for h in hs for r in (row(h, 0, 1), np.subtract(row(h, 0, 0), row(h, 1, 1)))])
    scale = np.abs(v).max(0)
    b11, b12, b22, b13, b23, b33 = np.linalg.svd(v / scale)[2][-1] / scale
    cv = (b12 * b13 - b11 * b23) / (b11 * b22 - b12 * b12)
    lam = b33 - (b13 * b13 + cv * (b12 * b13 - b11 * b23)) / b11
    fx, fy = math.sqrt(lam / b11), math.sqrt(lam * b11 / (b11 * b22 - b12 * b12))
    skew = -b12 * fx * fx * fy / lam
    k = np.array([[fx, skew, skew * cv / fy - b13 * fx * fx / lam], [0, fy, cv], [0, 0, 1]])
    poses = []
    for h in hs:
        m = np.linalg.inv(k) @ h
        m = m / np.linalg.norm(m[:, 0]) * (np.sign(m[2, 2]) or 1.0)
        u, _, vt = np.linalg.svd(np.stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])], 1))
        r = u @ vt
        poses.append(matrix(r.T, -r.T @ m[:, 2]))
    return k, poses


def calibrated_cameras(corners: DataFrame) -> DataFrame:
    """Focal lengths and principal point of each camera by the corners of a flat board in its views (camera, view, x, y on the board, u, v in the image): camera, fx, fy, cu, cv, views; null for fewer than three views. Corners are found elsewhere."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        boards = [(g[["x", "y"]].to_numpy(float), g[["u", "v"]].to_numpy(float)) for _, g in pdf.groupby("view") if len(g) >= 4]
        row = {"camera": pdf["camera"].iloc[0], "fx": None, "fy": None, "cu": None, "cv": None, "views": len(boards)}
        if len(boards) >= 3:
            k, _ = calibrated(boards)
            row |= {"fx": k[0, 0], "fy": k[1, 1], "cu": k[0, 2], "cv": k[1, 2]}
        return pd.DataFrame([row])

    return corners.groupBy("camera").applyInPandas(build, f"camera {dict(corners.dtypes)['camera']}, fx double, fy double, cu double, cv double, views int")


