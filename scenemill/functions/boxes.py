"""Axis-aligned boxes of images as Column algebra, and oriented boxes of the plane as Arrow functions.

Image boxes are structs (x1, y1, x2, y2), or (x, y, w, h) where said.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def area(b: Column) -> Column:
    """Width times height, each at least 0: a box that is turned inside out has no area."""
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(0.0)


def containment(inner: Column, outer: Column) -> Column:
    """The share of the inner box that the outer one covers; 0 for an empty inner box."""
    own = area(inner)
    return F.when(own > 0, intersection(inner, outer) / F.when(own > 0, own)).otherwise(0.0)


def iou_xywh(a: Column, b: Column, least_union: float = 1e-9) -> Column:
    """IoU of boxes given by corner, width and height, over a union of at least so much."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return common / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - common, F.lit(least_union))


def aligned_size_iou(a: Column, b: Column) -> Column:
    """IoU of two sizes (w, l, h) laid over each other."""
    common = F.least(a["w"], b["w"]) * F.least(a["l"], b["l"]) * F.least(a["h"], b["h"])
    union = a["w"] * a["l"] * a["h"] + b["w"] * b["l"] * b["h"] - common
    return F.when(union > 0, common / F.when(union > 0, union)).otherwise(0.0)


def clipped(b: Column, width: Column | float, height: Column | float) -> Column:
    put = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), most if isinstance(most, Column) else F.lit(float(most)))
    return box(put(b["x1"], width), put(b["y1"], height), put(b["x2"], width), put(b["y2"], height))


def shorter_side(b: Column) -> Column:
    return F.least(b["x2"] - b["x1"], b["y2"] - b["y1"])


def crop(b: Column, width: Column, height: Column, margin: float = 1.15) -> Column:
    """The box grown about its centre and clipped to whole pixels of the image."""
    cx, cy, w, h = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, (b["x2"] - b["x1"]) * margin, (b["y2"] - b["y1"]) * margin
    put = lambda c, most: F.greatest(F.lit(0), F.least(F.rint(c).cast("int"), most))
    return box(put(cx - w / 2, width), put(cy - h / 2, height), put(cx + w / 2, width), put(cy + h / 2, height))


def untruncated(b: Column, width: Column, height: Column, edge: float = 1.0) -> Column:
    return (b["x1"] > edge) & (b["y1"] > edge) & (b["x2"] < width - edge) & (b["y2"] < height - edge)


def oversize(b: Column, last: Column, frame_area: Column, frame_share: float = 0.25, growth: float = 2.5) -> Column:
    """Whether a recovered box takes too much of the frame, or has grown too much since it was last seen."""
    return (area(b) > frame_area * frame_share) | (area(b) > area(last) * growth)


def angular_overlap(a: Column, b: Column) -> Column:
    """The share of footprint a (az1, az2, el1, el2) within b, which is tried a turn either way."""

    def shifted(turn: float) -> Column:
        w = F.least(a["az2"], b["az2"] + turn) - F.greatest(a["az1"], b["az1"] + turn)
        h = F.least(a["el2"], b["el2"]) - F.greatest(a["el1"], b["el1"])
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    own = (a["az2"] - a["az1"]) * (a["el2"] - a["el1"])
    common = F.greatest(shifted(0.0), shifted(2 * math.pi), shifted(-2 * math.pi))
    return F.when(own > 0, common / F.when(own > 0, own)).otherwise(0.0)


def angular_footprint(rays: Column) -> Column:
    """The footprint (az1, az2, el1, el2) of rays (x, y, z), azimuths unwrapped about the first."""
    az = F.transform(rays, lambda r: F.atan2(r["y"], r["x"]))
    first = F.element_at(az, 1)
    az = F.transform(az, lambda a: first + (a - first) - F.lit(2 * math.pi) * F.rint((a - first) / F.lit(2 * math.pi)))
    el = F.transform(rays, lambda r: F.atan2(r["z"], F.sqrt(r["x"] * r["x"] + r["y"] * r["y"])))
    return F.struct(F.array_min(az).alias("az1"), F.array_max(az).alias("az2"), F.array_min(el).alias("el1"), F.array_max(el).alias("el2"))


# ---- oriented boxes ----
def ground_corners(x: np.ndarray, y: np.ndarray, w: np.ndarray, l: np.ndarray, yaw: np.ndarray) -> np.ndarray:  # noqa: E741
    """n x 4 x 2 corners, counter-clockwise."""
    along, across = np.stack([np.cos(yaw), np.sin(yaw)], -1), np.stack([-np.sin(yaw), np.cos(yaw)], -1)
    signs = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]]) / 2
    return np.stack([x, y], -1)[:, None] + signs[None, :, :1] * (along * l[:, None])[:, None] + signs[None, :, 1:] * (across * w[:, None])[:, None]


def overlap_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of the intersections of pairs of convex counter-clockwise quadrilaterals (n x 4 x 2), all pairs at once.

    The corners of an intersection are the corners of either within the other and the crossings of their
    edges; put in order around their mean they give the area.
    """
    tiny = 1e-12
    edge = lambda p: np.roll(p, -1, axis=1) - p
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]

    def within(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (cross(edge(q)[:, None], p[:, :, None] - q[:, None]) >= -tiny).all(axis=2)

    da, db = edge(a)[:, :, None], edge(b)[:, None]
    gap = b[:, None] - a[:, :, None]
    turn = cross(da, db)
    flat = np.abs(turn) < tiny
    safe = np.where(flat, 1.0, turn)
    t, u = cross(gap, db) / safe, cross(gap, da) / safe
    meets = ~flat & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossings = a[:, :, None] + t[..., None] * da
    points = np.concatenate([a, b, crossings.reshape(len(a), 16, 2)], axis=1)
    real = np.concatenate([within(a, b), within(b, a), meets.reshape(len(a), 16)], axis=1)
    n = real.sum(axis=1)
    mean = np.where(real[..., None], points, 0).sum(axis=1) / np.maximum(n, 1)[:, None]
    away = np.where(real[..., None], points - mean[:, None], 0)
    angle = np.where(real, np.arctan2(away[..., 1], away[..., 0]), np.inf)
    away = np.take_along_axis(away, np.argsort(angle, axis=1)[..., None], axis=1)
    # what isn't a corner lies at the mean, and triangles from there have no area; the last corner closes with the first
    total = cross(away[:, :-1], away[:, 1:]).sum(axis=1)
    last = np.take_along_axis(away, np.maximum(n - 1, 0)[:, None, None].repeat(2, axis=2), axis=1)[:, 0]
    return np.where(n >= 3, np.maximum(total + cross(last, away[:, 0]), 0) / 2, 0.0)


def ground_iou(a: np.ndarray, b: np.ndarray, block: int = 20_000) -> np.ndarray:
    """IoU of footprints by pair; rows (x, y, w, l, yaw). Pairs whose circles don't meet are left at 0."""
    out = np.zeros(len(a))
    near = np.flatnonzero(np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]) <= (np.hypot(a[:, 2], a[:, 3]) + np.hypot(b[:, 2], b[:, 3])) / 2)
    for i in range(0, len(near), block):
        k = near[i : i + block]
        # about the first box's centre, so large coordinates take no digits from small overlaps
        p, q = a[k].copy(), b[k].copy()
        q[:, :2] -= p[:, :2]
        p[:, :2] = 0
        common = overlap_areas(ground_corners(*p.T), ground_corners(*q.T))
        union = p[:, 2] * p[:, 3] + q[:, 2] * q[:, 3] - common
        out[k] = np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)
    return out


def solid_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of upright boxes by pair; rows (x, y, z, w, l, h, yaw)."""
    flat = [0, 1, 3, 4, 6]
    ground = ground_iou(a[:, flat], b[:, flat])
    own, other = a[:, 3] * a[:, 4], b[:, 3] * b[:, 4]
    common = ground * (own + other) / (1 + ground)
    tall = np.minimum(a[:, 2] + a[:, 5] / 2, b[:, 2] + b[:, 5] / 2) - np.maximum(a[:, 2] - a[:, 5] / 2, b[:, 2] - b[:, 5] / 2)
    common = common * np.maximum(tall, 0)
    union = own * a[:, 5] + other * b[:, 5] - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def _pair_iou(columns: list[pd.Series], rows) -> pd.Series:
    half = len(columns) // 2
    a, b = (np.column_stack([c.to_numpy(float) for c in part]) for part in (columns[:half], columns[half:]))
    return pd.Series(rows(a, b))


@F.pandas_udf(T.DoubleType())
def oriented_iou(ax: pd.Series, ay: pd.Series, aw: pd.Series, al: pd.Series, ayaw: pd.Series, bx: pd.Series, by: pd.Series, bw: pd.Series, bl: pd.Series, byaw: pd.Series) -> pd.Series:
    """IoU of two footprints, by Arrow batch of pairs."""
    return _pair_iou([ax, ay, aw, al, ayaw, bx, by, bw, bl, byaw], ground_iou)
