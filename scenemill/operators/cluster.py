"""Clusters of an instance's points, the rectangle fitted to one, and the box it gives."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import Columns, solved

NOISE = -1


def canonical(points: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The order in which points are clustered: by x, y, z, then by their own number."""
    return np.lexsort((index, points[:, 2], points[:, 1], points[:, 0]))


#: Candidate pairs that are measured at once.
PAIRS = 1 << 20


def near_pairs(xy: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ordered pairs, each point with itself too, at most eps apart, in portions of bounded size.

    Points are sorted by rows of a grid of side eps and by x within a row; a point meets those of three rows
    whose x lies within eps, so the work follows the number of near points and not that of all.
    """
    x, row = xy[:, 0], np.floor((xy[:, 1] - xy[:, 1].min()) / eps).astype(np.int64)
    order = np.lexsort((x, row))
    x, row, at = x[order], row[order], xy[order]
    rows, first = np.unique(row, return_index=True)
    ends = np.append(first[1:], len(row))
    # one number a point that sorts as (row, x) does, so bounds are found for all points at once
    width = np.ptp(x) + 4 * eps
    place = np.repeat(np.arange(len(rows)), ends - first) * width + (x - x.min())
    slack = eps * (1 + 1e-9) + 1e-12 * width * len(rows)
    for step in (-1, 0, 1):
        other = np.searchsorted(rows, row + step)
        there = np.flatnonzero((other < len(rows)) & (rows[np.minimum(other, len(rows) - 1)] == row + step))
        centre = other[there] * width + (x[there] - x.min())
        lo, hi = np.searchsorted(place, centre - slack, "left"), np.searchsorted(place, centre + slack, "right")
        upto = np.cumsum(hi - lo)
        begin = 0
        while begin < len(there):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
            n = hi[begin:end] - lo[begin:end]
            i = np.repeat(there[begin:end], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)
            near = ((at[i] - at[j]) ** 2).sum(axis=1) <= eps * eps
            yield order[i[near]], order[j[near]]
            begin = end


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every node the least one that pairs connect it to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def dbscan(xy: np.ndarray, eps: float, least: int = 3) -> np.ndarray:
    """Labels from 0 by the first point of each cluster, NOISE for the rest.

    A point with ``least`` neighbours, itself one of them, is a core; cores within eps are of one cluster,
    and another point within eps of cores belongs to the first cluster among theirs.
    """
    n = len(xy)
    if not n:
        return np.empty(0, int)
    core = sum(np.bincount(a, minlength=n) for a, _ in near_pairs(xy, eps)) >= least
    root = np.arange(n)
    for a, b in near_pairs(xy, eps):
        both = core[a] & core[b] & (a < b)
        root = least_connected(n, np.concatenate([a[both], np.arange(n)]), np.concatenate([b[both], root]))
    firsts = np.unique(root[core])
    label = np.full(n, len(firsts))
    label[core] = np.searchsorted(firsts, root[core])
    for a, b in near_pairs(xy, eps):
        edge = core[b] & ~core[a]
        np.minimum.at(label, a[edge], label[b[edge]])
    label[label == len(firsts)] = NOISE
    return label


def chosen_cluster(points: np.ndarray, label: np.ndarray) -> int:
    """The label with most points, then of the least mean range, then with the first point; NOISE if there is none."""
    best = None
    for k in np.unique(label[label >= 0]):
        mine = np.flatnonzero(label == k)
        rank = (-len(mine), np.hypot(points[mine, 0], points[mine, 1]).mean(), mine[0], int(k))
        best = rank if best is None or rank < best else best
    return NOISE if best is None else best[3]


class Rectangle(NamedTuple):
    theta: float
    u: tuple[float, float]
    v: tuple[float, float]
    score: float

    @property
    def area(self) -> float:
        return (self.u[1] - self.u[0]) * (self.v[1] - self.v[0])


def _turned(xy: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, s = np.cos(theta)[:, None], np.sin(theta)[:, None]
    return xy[:, 0] * c + xy[:, 1] * s, xy[:, 1] * c - xy[:, 0] * s


def rectangle(xy: np.ndarray, step: float = math.pi / 180, passes: int = 3, factor: float = 10.0, floor: float = 0.01, criterion: str = "closeness") -> Rectangle:
    """The rectangle whose edges the points lie nearest to, over a quarter turn.

    All angles of a pass are scored as one matrix; the best goes by score, then by the smaller area, then by
    the smaller angle, and the next pass looks a step to either side of it in steps smaller by ``factor``.
    """
    lo, hi, best = 0.0, math.pi / 2, None
    for _ in range(passes + 1):
        theta = lo + np.arange(max(1, round((hi - lo) / step)) + 1) * step
        theta = theta[theta <= hi + 1e-12]
        u, v = _turned(xy, theta)
        u0, u1, v0, v1 = u.min(axis=1), u.max(axis=1), v.min(axis=1), v.max(axis=1)
        area = (u1 - u0) * (v1 - v0)
        if criterion == "area":
            score = -area
        else:
            away = np.minimum(np.minimum(u - u0[:, None], u1[:, None] - u), np.minimum(v - v0[:, None], v1[:, None] - v))
            score = (1 / np.maximum(away, floor)).sum(axis=1)
        k = np.lexsort((theta, area, -score))[0]
        found = (-score[k], area[k], theta[k])
        if best is None or found < best[0]:
            best = found, Rectangle(float(theta[k]), (float(u0[k]), float(u1[k])), (float(v0[k]), float(v1[k])), float(score[k]))
        lo, hi, step = best[1].theta - step, best[1].theta + step, step / factor
    return best[1]


class Box(NamedTuple):
    x: float
    y: float
    z: float
    w: float
    l: float  # noqa: E741
    h: float
    yaw: float
    yaw_ambiguous: bool
    clamped: str


def wrapped(a: float) -> float:
    """The angle in (-pi, pi]."""
    turned = math.remainder(a, 2 * math.pi)
    return math.pi if turned == -math.pi else turned


def box_of(points: np.ndarray, fit: Rectangle, least_extent: float = 0.05, square: float = 0.8, least_points: int = 10) -> Box:
    """The upright box over a fitted rectangle: the longer side is its length and gives the yaw.

    Extents are at least ``least_extent``. The yaw is ambiguous for a nearly square footprint, few points or
    a clamped extent.
    """
    (u0, u1), (v0, v1) = fit.u, fit.v
    long_u = u1 - u0 >= v1 - v0
    length, width = (u1 - u0, v1 - v0) if long_u else (v1 - v0, u1 - u0)
    c, s, mu, mv = math.cos(fit.theta), math.sin(fit.theta), (u0 + u1) / 2, (v0 + v1) / 2
    low, high = points[:, 2].min(), points[:, 2].max()
    raw = {"w": width, "l": length, "h": high - low}
    clamped = ",".join(k for k, value in raw.items() if value < least_extent)
    w, l, h = (max(value, least_extent) for value in raw.values())  # noqa: E741
    unsure = w / l >= square or len(points) < least_points or bool(clamped)
    return Box(mu * c - mv * s, mu * s + mv * c, (low + high) / 2, w, l, h, wrapped(fit.theta + (0.0 if long_u else math.pi / 2)), unsure, clamped)


def too_large(box: Box, prior_w: float, prior_l: float, factor: float = 2.0) -> bool:
    """Whether a footprint exceeds so many times its prior, side by sorted side."""
    sides, prior = sorted((box.w, box.l)), sorted((prior_w, prior_l))
    return any(a > factor * b for a, b in zip(sides, prior))


def fitted(points: np.ndarray, eps: float, least: int) -> tuple[str, np.ndarray, Box | None]:
    """Status, which points are of the chosen cluster, and its box."""
    if len(points) < least:
        return "too_few_points", np.zeros(len(points), bool), None
    label = dbscan(points[:, :2], eps, least)
    k = chosen_cluster(points, label)
    if k == NOISE:
        return "all_noise", np.zeros(len(points), bool), None
    member = label == k
    return "fit", member, box_of(points[member], rectangle(points[member, :2]))


def boxed_instance(points: np.ndarray, index: np.ndarray, depth: np.ndarray, eps: float, prior: tuple[float, float] | None, least: int = 3, reach: float = 5.0) -> dict:
    """The box of an instance's points; one too large for its prior is tried again on the nearest points.

    The second try keeps points up to ``reach`` behind the nearest and counts only if enough points remain,
    they cluster, and the footprint doesn't grow; else ``rejected`` says why the first box stays.
    """
    order = canonical(points, index)
    points, depth = points[order], depth[order]
    status, member, box = fitted(points, eps, least)
    out = {"status": status, "n_kept": int(member.sum()), "retried": False, "rejected": None, "box": box}
    if box is None or prior is None or not too_large(box, *prior):
        return out
    near = depth <= depth.min() + reach
    out["retried"] = True
    again, member2, box2 = fitted(points[near], eps, least)
    if near.sum() < least:
        out["rejected"] = "below_min_samples_after_cut"
    elif box2 is None:
        out["rejected"] = "all_noise_after_cut"
    elif box2.w * box2.l > box.w * box.l:
        out["rejected"] = "footprint_would_grow"
    else:
        out |= {"n_kept": int(member2.sum()), "box": box2}
    return out


BOX_FIELDS = "x double, y double, z double, w double, l double, h double, yaw double, yaw_ambiguous boolean, clamped string"


def cluster_labels(points: DataFrame, keys: list[str], eps: float, least: int = 3) -> DataFrame:
    """keys, point_index and label of every point (x, y, z, point_index), by group."""
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", point_index {kinds['point_index']}, label int"

    def solve(g: Columns) -> Columns:
        p = np.column_stack([g[c].astype(float) for c in "xyz"])
        order = canonical(p, g["point_index"])
        return {**{k: g[k][order] for k in keys}, "point_index": g["point_index"][order], "label": dbscan(p[order][:, :2], eps, least).astype(np.int32)}

    return solved(points.select(*keys, "x", "y", "z", "point_index"), keys, ["point_index"], solve, schema)


def instance_boxes(points: DataFrame, keys: list[str], least: int = 3, reach: float = 5.0) -> DataFrame:
    """keys, status, n_points, n_kept, retried, rejected and the box of every instance.

    Points have x, y, z, depth, point_index, and the instance's eps, prior_w and prior_l (null: no prior).
    """
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", status string, n_points int, n_kept int, retried boolean, rejected string, " + BOX_FIELDS

    def solve(g: Columns) -> Columns:
        p = np.column_stack([g[c].astype(float) for c in "xyz"])
        w, l = float(g["prior_w"][0]), float(g["prior_l"][0])  # noqa: E741
        found = boxed_instance(p, g["point_index"], g["depth"].astype(float), float(g["eps"][0]), None if math.isnan(w) or math.isnan(l) else (w, l), least, reach)
        box = found["box"]
        fields = {n: np.array([None if box is None else getattr(box, n)], object) for n in Box._fields}
        rest = {n: np.array([found[n]], object) for n in ("status", "n_kept", "retried", "rejected")}
        return {**{k: g[k][:1] for k in keys}, "n_points": np.array([len(p)]), **rest, **fields}

    return solved(points.select(*keys, "x", "y", "z", "depth", "point_index", "eps", F.col("prior_w").cast("double").alias("prior_w"), F.col("prior_l").cast("double").alias("prior_l")), keys, ["point_index"], solve, schema)


def best_clusters(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The chosen cluster of each group, of points with label, x, y and a rank in canonical order: plain aggregates."""
    sizes = labelled.where("label >= 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("mean_range"), F.min("rank").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "mean_range", "first")
    return sizes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def class_eps(priors: DataFrame, share: float = 0.6, fallback: float = 0.75) -> DataFrame:
    """eps by class: a share of the mean footprint's diagonal, or a fixed one."""
    return priors.withColumn("eps", F.coalesce(F.lit(share) * F.sqrt(F.col("mu_w") * F.col("mu_w") + F.col("mu_l") * F.col("mu_l")), F.lit(fallback)))


def instance_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, depths and counts of every instance of painted points (x, y, z, depth, in_region)."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        *(F.avg(c).alias(f"mean_{c}") for c in "xyz"),
        F.min("depth").alias("min_depth"),
        F.avg("depth").alias("mean_depth"),
        F.max("depth").alias("max_depth"),
        F.sum(F.when(F.col("in_region"), 1).otherwise(0)).alias("n_in_region"),
    )
