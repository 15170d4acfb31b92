"""Ground planes, sweeps put together, and boxes from stereo points."""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cluster import rectangle
from .groups import Columns, solved


# ---- planes ----
def plane_sums(points: DataFrame, keys: list[str]) -> DataFrame:
    """The least-squares plane z = a x + b y + c of each group, from sums of products alone; null where it is undefined."""
    x, y, z = (F.col(c) for c in "xyz")
    mean = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    whole = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    safe = F.when((F.col("n") >= 3) & (F.abs(whole) > 1e-12), whole)
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / safe
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / safe
    return mean.select(*keys, "n", a.alias("a"), b.alias("b"), "mx", "my", "mz").withColumn("c", F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).drop("mx", "my", "mz")


def spread_ratio(points: DataFrame, keys: list[str]) -> DataFrame:
    """The larger over the smaller eigenvalue of the points' covariance in the plane; null if the smaller is 0."""
    x, y = F.col("x"), F.col("y")
    sums = points.groupBy(*keys).agg(F.covar_samp(x, x).alias("xx"), F.covar_samp(x, y).alias("xy"), F.covar_samp(y, y).alias("yy"))
    half, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    return sums.select(*keys, F.when(half - gap > 1e-9, (half + gap) / F.when(half - gap > 1e-9, half - gap)).alias("ratio"))


class Plane(NamedTuple):
    """n.p + d = 0 with a unit normal that points up."""

    a: float
    b: float
    c: float
    d: float

    def away(self, p: np.ndarray) -> np.ndarray:
        return p @ np.array(self[:3]) + self.d

    def height(self, x: float, y: float) -> float:
        return -(self.a * x + self.b * y + self.d) / self.c

    @property
    def tilt(self) -> float:
        return math.degrees(math.acos(min(1.0, abs(self.c))))


FLAT = Plane(0.0, 0.0, 1.0, 0.0)


def _plane(normal: np.ndarray, point: np.ndarray) -> Plane | None:
    n = np.linalg.norm(normal)
    if n < 1e-9:
        return None
    normal = normal / n * (1 if normal[2] >= 0 else -1)
    return Plane(*normal.tolist(), float(-normal @ point))


def least_squares(p: np.ndarray) -> Plane | None:
    """The plane z = ax + by + c nearest to the points in z, by normal equations."""
    mean = p.mean(axis=0)
    x, y, z = (p - mean).T
    m = np.array([[x @ x, x @ y], [x @ y, y @ y]])
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    a, b = np.linalg.solve(m, [x @ z, y @ z])
    return _plane(np.array([-a, -b, 1.0]), mean)


def seed_of(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def ransac(p: np.ndarray, seed: int, draws: int = 200, within: float = 0.10) -> tuple[Plane, float] | None:
    """The plane through three drawn points that most points lie near, polished on those, and their share.

    Triples are drawn without replacement by a seeded generator; of equal counts the first drawn stays. All
    draws are judged as one matrix, in blocks of points.
    """
    if len(p) < 3:
        return None
    rng = np.random.default_rng(seed)
    picks = p[np.array([rng.choice(len(p), 3, replace=False) for _ in range(draws)])]
    normal = np.cross(picks[:, 1] - picks[:, 0], picks[:, 2] - picks[:, 0])
    size = np.linalg.norm(normal, axis=1)
    unit = normal / np.maximum(size, 1e-12)[:, None]
    offset = -(unit * picks[:, 0]).sum(axis=1)
    count = np.zeros(draws, int)
    for i in range(0, len(p), 4096):
        count += (np.abs(p[i : i + 4096] @ unit.T + offset) <= within).sum(axis=0)
    count[size < 1e-9] = -1
    k = int(count.argmax())
    if count[k] < 3:
        return None
    inside = np.abs(p @ unit[k] + offset[k]) <= within
    found = least_squares(p[inside]) or _plane(unit[k], picks[k, 0])
    return found, float(inside.mean())


def sector_planes(g: Columns, token: str, seed: int = 0, sectors: int = 8, least: int = 50, most_tilt: float = 15.0, most_apart: float = 0.25) -> Columns:
    """The plane of every azimuth sector of a keyframe's candidate points (x, y, z), and why it is what it is.

    A sector of too few points, or whose plane tilts too much or lies too far from the keyframe's reference
    plane at three probes, takes the reference; the tilt told is that of the plane that was fitted.
    """
    p = np.column_stack([g[c].astype(float) for c in "xyz"])
    whole = ransac(p, seed_of(seed, token, sectors))
    reference = whole[0] if whole else FLAT
    sector = np.minimum(np.floor((np.arctan2(p[:, 1], p[:, 0]) + math.pi) / (2 * math.pi / sectors)), sectors - 1).astype(int)
    out: dict[str, list] = {n: [] for n in ("sector", "n", "a", "b", "c", "d", "tilt", "status")}
    for k in range(sectors):
        mine = p[sector == k]
        plane, status, tilt = reference, "fitted", None
        if len(mine) < least:
            status = "too_few_points"
        elif (found := ransac(mine, seed_of(seed, token, k))) is None:
            status = "no_plane"
        else:
            tilt = found[0].tilt
            reach = np.hypot(mine[:, 0], mine[:, 1])
            probes = [mine.mean(axis=0), *(mine[np.abs(reach - np.percentile(reach, q)).argmin()] for q in (5, 95))]
            if tilt > most_tilt:
                status = "implausible_tilt"
            elif max(abs(found[0].height(x, y) - reference.height(x, y)) for x, y, _ in probes) > most_apart:
                status = "off_reference"
            else:
                plane = found[0]
        for n, v in zip(out, (k, len(mine), *plane, plane.tilt if tilt is None else tilt, status)):
            out[n].append(v)
    return {n: np.array(v, object) for n, v in out.items()}


def ground_planes(points: DataFrame, keyframe: str, seed: int = 0, sectors: int = 8, least: int = 50) -> DataFrame:
    """keyframe, sector, n, the plane (a, b, c, d), tilt and status, a row a sector."""
    schema = f"`{keyframe}` {dict(points.dtypes)[keyframe]}, sector int, n bigint, a double, b double, c double, d double, tilt double, status string"

    def solve(g: Columns) -> Columns:
        out = sector_planes(g, str(g[keyframe][0]), seed, sectors, least)
        return {keyframe: np.repeat(g[keyframe][:1], sectors), **out}

    return solved(points.select(keyframe, "x", "y", "z"), [keyframe], ["x", "y", "z"], solve, schema)


def without_ground(points: DataFrame, planes: DataFrame, keyframe: str, sectors: int = 8, within: float = 0.30) -> DataFrame:
    """Points at least so far from their sector's plane, on either side."""
    rows = points.withColumn("sector", G.sector(F.col("x"), F.col("y"), sectors))
    near = rows.join(planes.select(keyframe, "sector", "a", "b", "c", "d"), [keyframe, "sector"])
    away = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    return near.where(away >= within).drop("a", "b", "c", "d")


def near_road(points: DataFrame, masks: list[str], radius: float, apart: float) -> DataFrame:
    """Adds ``on_plane``: whether a point's height is near the median height of anchor points about the sensor."""
    anchor = points.where((F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) <= radius) & F.col("anchor")).groupBy(*masks).agg(F.median("z").alias("road_z"))
    out = points.join(anchor, masks, "left")
    return out.withColumn("on_plane", F.coalesce(F.abs(F.col("z") - F.col("road_z")) <= apart, F.lit(False)))


# ---- sweeps ----
def accumulated(points: DataFrame, poses: DataFrame, scene: str, window_ns: int) -> DataFrame:
    """Points of every sweep up to ``window_ns`` before a keyframe, moved into the keyframe's own frame.

    ``points`` have scene, sweep and point (vector); ``poses`` scene, sweep, t_ns, is_keyframe and pose. The
    relative pose is computed once a pair of sweep and keyframe, before the points are joined to it.
    """
    anchor = poses.where("is_keyframe").select(scene, F.col("sweep").alias("keyframe"), F.col("t_ns").alias("anchor_ns"), F.col("pose").alias("anchor_pose"))
    pairs = poses.join(anchor, scene).where((F.col("t_ns") <= F.col("anchor_ns")) & (F.col("t_ns") >= F.col("anchor_ns") - window_ns))
    turned = pairs.withColumn("qa", G.conjugate(G.unit(F.col("anchor_pose.q"))).struct).withColumn("qs", G.unit(F.col("pose.q")).struct)
    moved = turned.withColumn("q", G.quat_product(F.col("qa"), F.col("qs")).struct).withColumn("t", G.rotate(F.col("qa"), G.subtract(F.col("pose.t"), F.col("anchor_pose.t"))).struct)
    moved = moved.select(scene, "sweep", "keyframe", "q", "t", ((F.col("anchor_ns") - F.col("t_ns")) / 1e9).alias("age_s"))
    out = points.join(moved, [scene, "sweep"])
    return out.withColumn("point", G.add(G.rotate(F.col("q"), F.col("point")), F.col("t")).struct).drop("q", "t")


def motion_deltas(rows: DataFrame, scene: str) -> DataFrame:
    """Whether a scene's ego motion is degraded: no camera's pose ever differs from that of the scan."""
    a, b = F.col("camera_pose"), F.col("scan_pose")
    parts = [F.abs(a[f"{v}"][c] - b[f"{v}"][c]) for v, cs in (("t", "xyz"), ("q", "wxyz")) for c in cs]
    out = rows.groupBy(scene).agg(F.max(F.greatest(*parts)).alias("largest_delta"))
    return out.withColumn("degraded", F.col("largest_delta") == 0.0)


# ---- stereo boxes ----
STATUSES = ("out_of_region", "channel_disabled", "no_prior", "no_points", "no_ground_plane")


def stereo_status(in_region: Column, enabled: Column, prior: Column, n_points: Column, plane: Column) -> Column:
    """The first reason not to fit a box, or null."""
    tests = (~in_region, ~enabled, prior.isNull(), n_points == 0, plane.isNull())
    out = F.when(tests[0], STATUSES[0])
    for test, name in zip(tests[1:], STATUSES[1:]):
        out = out.when(test, name)
    return out


class Prior(NamedTuple):
    """Mean and deviation of width, length and height."""

    w: tuple[float, float]
    l: tuple[float, float]  # noqa: E741
    h: tuple[float, float]


def within_prior(value: float, prior: tuple[float, float]) -> float:
    """A measured side, or the mean where it is far too small, or the most a class allows where it is too large."""
    mu, sigma = prior
    return mu if value < mu - 2 * sigma else min(value, mu + 2 * sigma)


def stereo_box(points: np.ndarray, stereo: np.ndarray, prior: Prior, plane: Plane, f: float = 953.16, truncated: bool = False, far: float = 25.0, least: int = 20, near_share: float = 20.0, round_ratio: float = 1.5) -> dict:
    """The box behind a mask's points, seen from the origin along x: x ahead, y left, z up.

    ``stereo`` tells stereo points from LiDAR points. Stereo depths are trimmed about their median; the near
    face lies at their 20th percentile, or at the median of LiDAR points near it. Width and height come from
    the points' extents at that depth, kept near the class prior; the length is the prior's. The yaw is that
    of the fitted rectangle, or the line of sight where the footprint is round; it is an axis, in [0, pi). The
    centre lies behind the near face by the box's half extent along the line of sight, the bottom on the plane.
    """
    depth = points[:, 0]
    s = depth[stereo & (depth > 0.1)]
    if len(s) < least:
        return {"status": "too_few_stereo"}
    middle = np.median(s)
    mad = max(float(np.median(np.abs(s - middle))), 0.10)
    kept = stereo & (depth > 0.1) & (np.abs(depth - middle) <= 3 * mad)
    if kept.sum() < least:
        return {"status": "too_few_stereo"}
    near = float(np.percentile(depth[kept], near_share))
    beams = depth[~stereo & (np.abs(depth - near) <= 2 * mad)]
    refined = len(beams) >= 5
    near = float(np.median(beams)) if refined else near
    mine = points[kept]
    u, v = f * mine[:, 1] / mine[:, 0], f * mine[:, 2] / mine[:, 0]
    (u0, u1), (v0, v1) = np.percentile(u, [1, 99]), np.percentile(v, [1, 99])
    w = within_prior((u1 - u0) * near / f, prior.w)
    h = within_prior((v1 - v0) * near / f, prior.h)
    length = prior.l[0]
    face = near / f * np.array([f, (u0 + u1) / 2, (v0 + v1) / 2])  # the middle of the near face
    if math.hypot(face[0], face[1]) > far:
        return {"status": "beyond_stereo_cap"}
    bearing = math.atan2(face[1], face[0])
    flat = mine[:, :2]
    spread = np.linalg.eigvalsh(np.cov(flat.T))
    if spread[1] < round_ratio * max(spread[0], 1e-12):
        yaw, basis = bearing, "bearing"
    else:
        fit = rectangle(flat)
        sides = (fit.u[1] - fit.u[0], fit.v[1] - fit.v[0])
        major, minor = max(sides), min(sides)
        along = fit.theta + (0.0 if sides[0] >= sides[1] else math.pi / 2)
        yaw, basis = along, "rectangle"
        if minor < 0.5 * min(prior.w[0], prior.l[0]):  # one face only: which one?
            if truncated:
                yaw, basis = 0.0, "truncated"
            elif max(prior.w[0], prior.l[0]) / min(prior.w[0], prior.l[0]) < 1.15:
                basis = "square_prior"
            elif abs(math.log(major / prior.w[0])) <= abs(math.log(major / prior.l[0])):
                yaw, basis = along + math.pi / 2, "width_face"  # the length lies across the face
            else:
                basis = "length_face"
    yaw %= math.pi
    if w > length:
        w, length, yaw = length, w, yaw + math.pi / 2
    off = yaw - bearing
    push = length / 2 * abs(math.cos(off)) + w / 2 * abs(math.sin(off))
    x, y, _ = (face * (1 + push / np.linalg.norm(face))).tolist()
    low = plane.height(x, y)
    turned = (points[:, 0] - x) * math.cos(yaw) + (points[:, 1] - y) * math.sin(yaw), (points[:, 1] - y) * math.cos(yaw) - (points[:, 0] - x) * math.sin(yaw)
    inside = (np.abs(turned[0]) <= length / 2) & (np.abs(turned[1]) <= w / 2) & (np.abs(points[:, 2] - low - h / 2) <= h / 2)
    return {"status": "fit", "x": x, "y": y, "z": low + h / 2, "w": w, "l": length, "h": h, "yaw": yaw % math.pi, "yaw_basis": basis, "n_inside": int(inside.sum()), "near": near, "lidar_refined": refined}


def stereo_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_points, status and the box of every mask that can be fitted.

    Points have x, y, z, stereo and, constant in a mask, truncated, the prior (mu_w, sigma_w, ..., sigma_h)
    and the ground plane (a, b, c, d).
    """
    kinds = dict(points.dtypes)
    numbers = ["x", "y", "z", "w", "l", "h", "yaw", "near"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_points int, status string, " + ", ".join(f"{n} double" for n in numbers) + ", yaw_basis string, n_inside int, lidar_refined boolean"
    prior, plane = [f"{s}_{c}" for c in "wlh" for s in ("mu", "sigma")], ["a", "b", "c", "d"]

    def solve(g: Columns) -> Columns:
        p = np.column_stack([g[c].astype(float) for c in "xyz"])
        pr = [float(g[c][0]) for c in prior]
        found = stereo_box(p, g["stereo"].astype(bool), Prior(*((pr[i], pr[i + 1]) for i in (0, 2, 4))), Plane(*(float(g[c][0]) for c in plane)), truncated=bool(g["truncated"][0]))
        fields = {n: np.array([found.get(n)], object) for n in ("status", *numbers, "yaw_basis", "n_inside", "lidar_refined")}
        return {**{k: g[k][:1] for k in keys}, "n_points": np.array([len(p)]), **fields}

    return solved(points.select(*keys, "x", "y", "z", "stereo", "truncated", *prior, *plane), keys, ["x", "y", "z"], solve, schema)
