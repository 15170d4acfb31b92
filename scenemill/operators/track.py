"""Tracking: assignment of detections to tracks, a constant-velocity filter, point registration, life cycles.

A scene is a group; its keyframes are gone through in order of time, and scenes run in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from .assign import iou_matrix, matched
from .cluster import wrapped
from .groups import Columns, solved

STATE = ("x", "y", "z", "vx", "vy", "vz", "yaw")


@dataclass(frozen=True)
class Settings:
    """Gates and noise of the 3D tracker; noise is given as standard deviations, process noise a second."""

    iou_gate: float = 0.05
    most_misses: int = 2
    stable_hits: int = 3
    class_gate: bool = True
    process: tuple[float, float, float] = (0.5, 2.0, math.radians(5))
    measured: tuple[float, float] = (0.3, math.radians(10))
    velocity: float = 1.0
    initial: tuple[float, float, float] = (1.0, 5.0, math.radians(30))
    icp_points: int = 15


class Filter:
    """A Kalman filter over STATE: positions move with their velocities, the yaw stays."""

    def __init__(self, x: float, y: float, z: float, yaw: float, s: Settings):
        self.s, self.x = s, np.array([x, y, z, 0.0, 0.0, 0.0, yaw])
        self.p = np.diag(np.repeat(np.square(s.initial), (3, 3, 1)))

    def predict(self, dt: float) -> None:
        move = np.eye(7)
        move[[0, 1, 2], [3, 4, 5]] = dt
        self.x = move @ self.x
        self.x[6] = wrapped(self.x[6])
        self.p = move @ self.p @ move.T + np.diag(np.repeat(np.square(np.array(self.s.process) * max(dt, 1e-6)), (3, 3, 1)))

    def _see(self, which: list[int], value: np.ndarray, noise: np.ndarray) -> None:
        off = value - self.x[which]
        if 6 in which:
            off[which.index(6)] = wrapped(off[which.index(6)])
        gain = np.linalg.solve(self.p[np.ix_(which, which)] + np.diag(noise**2), self.p[which]).T
        self.x = self.x + gain @ off
        self.x[6] = wrapped(self.x[6])
        self.p = self.p - gain @ self.p[which]

    def update(self, x: float, y: float, z: float, yaw: float) -> None:
        self._see([0, 1, 2, 6], np.array([x, y, z, yaw]), np.repeat(self.s.measured, (3, 1)))

    def update_velocity(self, v: np.ndarray) -> None:
        self._see([3, 4, 5], np.asarray(v, float), np.repeat(self.s.velocity, 3))


def nearest(source: np.ndarray, target: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest target point of every source point, and the distances; blocks bound the memory."""
    order = np.argsort(target[:, 0], kind="stable")
    t = target[order]
    at, away = np.empty(len(source), int), np.empty(len(source))
    for a in range(0, len(source), block):
        s = source[a : a + block]
        # a first guess bounds the distance, and with it the strip of x to look in
        guess = t[np.clip(np.searchsorted(t[:, 0], s[:, 0]), 0, len(t) - 1)]
        reach = np.sqrt(((s - guess) ** 2).sum(axis=1)).max() * (1 + 1e-9)
        lo, hi = np.searchsorted(t[:, 0], [s[:, 0].min() - reach, s[:, 0].max() + reach])
        lo, hi = max(0, lo - 1), min(len(t), hi + 1)
        best = np.full(len(s), np.inf)
        where = np.zeros(len(s), int)
        for b in range(lo, hi, 4096):
            d = ((s[:, None] - t[None, b : min(hi, b + 4096)]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)
            low = d[np.arange(len(s)), k]
            nearer = low < best
            best[nearer], where[nearer] = low[nearer], b + k[nearer]
        at[a : a + block], away[a : a + block] = order[where], np.sqrt(best)
    return at, away


@dataclass
class Registration:
    rotation: np.ndarray
    translation: np.ndarray
    rounds: int
    converged: bool
    residual: float


def register(source: np.ndarray, target: np.ndarray, most_rounds: int = 25, settled: float = 1e-4) -> Registration | None:
    """The rigid motion of ``source`` onto ``target``, point to point, from aligned centroids on; None for under 3 points."""
    if min(len(source), len(target)) < 3:
        return None
    shift = target.mean(axis=0) - source.mean(axis=0)
    moved, turn, before, rounds, done = source + shift, np.eye(3), math.inf, 0, False
    while rounds < most_rounds and not done:
        rounds += 1
        at, away = nearest(moved, target)
        a, b = moved.mean(axis=0), target[at].mean(axis=0)
        left, _, right = np.linalg.svd((moved - a).T @ (target[at] - b))
        mirror = np.diag([1.0, 1.0, np.linalg.det(right.T @ left.T) or 1.0])
        step = right.T @ mirror @ left.T
        moved = (moved - a) @ step.T + b
        turn, shift = step @ turn, step @ (shift - a) + b
        done, before = abs(before - away.mean()) < settled, float(away.mean())
    return Registration(turn, shift, rounds, done, before)


def registered_velocity(r: Registration, centroid: np.ndarray, dt: float) -> np.ndarray:
    """Velocity of a cluster whose centroid the motion carries along."""
    return (r.translation + r.rotation @ centroid - centroid) / dt


def footprint_scores(tracks: np.ndarray, detections: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """IoU of footprints (x, y, w, l, yaw) of the allowed pairs, 0 elsewhere."""
    out = np.zeros(allowed.shape)
    i, j = np.nonzero(allowed)
    if len(i):
        out[i, j] = B.ground_iou(tracks[i], detections[j])
    return out


def solid_assignment(tracks: np.ndarray, detections: np.ndarray, track_class: np.ndarray, class_: np.ndarray, cosine: np.ndarray | None = None, gate: float = 0.05, class_gate: bool = True) -> list[tuple[int, int, float]]:
    """Pairs of most total IoU, weighed by max(0, cosine) where one is known (NaN: not), among those over the gate."""
    if not len(tracks) or not len(detections):
        return []
    allowed = track_class[:, None] == class_[None] if class_gate else np.ones((len(tracks), len(detections)), bool)
    iou = footprint_scores(tracks, detections, allowed)
    ok = allowed & (iou >= gate)
    score = iou if cosine is None else np.where(np.isnan(cosine), iou, iou * np.maximum(np.nan_to_num(cosine), 0))
    return [(i, j, float(iou[i, j])) for i, j in matched(score, ok)]


def flat_assignment(a: np.ndarray, b: np.ndarray, name_a: np.ndarray, name_b: np.ndarray, floor: float = 0.30) -> list[tuple[int, int, float]]:
    """Pairs of most total IoU of image boxes of one class, each at or over the floor."""
    if not len(a) or not len(b):
        return []
    iou = iou_matrix(a, b)
    ok = (name_a[:, None] == name_b[None]) & (iou >= floor)
    # a pair that isn't admissible costs 1, which is more than any admissible one
    return [(i, j, float(iou[i, j])) for i, j in matched(iou, ok, refused=1.0)]


@dataclass
class Track:
    number: int
    filter: Filter
    name: object
    size: tuple[float, float, float]
    t: float
    seen: float
    embedding: np.ndarray | None = None
    cluster: np.ndarray | None = None
    keyframe: int = 0
    hits: int = 1
    misses: int = 0
    dead: bool = False


def track_scene(g: Columns, s: Settings = Settings()) -> Columns:
    """What becomes of a scene's detections, given in order of keyframe and index, in the global frame.

    Columns: keyframe, t_ns, index, name, x, y, z, w, l, h, yaw; embedding and points (arrays) may be there.
    Results: track, event (birth or match), hits, velocity, speed and the filter's yaw of every detection.
    """
    out, tracks, _ = track_on(g, s, [], 0)
    stable = {t.number for t in tracks if t.hits >= s.stable_hits}
    out["stable"] = np.array([k in stable for k in out["track"]], bool)
    return out


def track_on(g: Columns, s: Settings, tracks: list[Track], number: int) -> tuple[Columns, list[Track], int]:
    """track_scene() for the next keyframes of a scene that has these tracks, the next of which gets the number; stable is left out."""
    n = len(g["keyframe"])
    out = {"track": np.zeros(n, np.int64), "event": np.empty(n, object), "hits": np.zeros(n, np.int64), "iou": np.full(n, np.nan), **{c: np.zeros(n) for c in ("vx", "vy", "vz", "filter_yaw")}}
    flat = np.column_stack([g[c].astype(float) for c in ("x", "y", "w", "l", "yaw")])
    embedding, clouds = g.get("embedding"), g.get("points")
    for key in np.unique(g["keyframe"]):
        rows = np.flatnonzero(g["keyframe"] == key)
        now = float(g["t_ns"][rows[0]]) / 1e9
        alive = [t for t in tracks if not t.dead]
        for t in alive:
            t.filter.predict(now - t.t)
            t.t = now
        boxes = np.array([[t.filter.x[0], t.filter.x[1], t.size[0], t.size[1], t.filter.x[6]] for t in alive]).reshape(-1, 5)
        cosine = None
        if embedding is not None and alive:
            cosine = np.array([[np.nan if t.embedding is None or embedding[r] is None else float(np.dot(t.embedding, embedding[r])) for r in rows] for t in alive])
        pairs = solid_assignment(boxes, flat[rows], np.array([t.name for t in alive], object), g["name"][rows].astype(object), cosine, s.iou_gate, s.class_gate)
        met, seen = set(), set()
        for i, j, iou in pairs:
            t, r = alive[i], rows[j]
            yaw = float(g["yaw"][r])
            if abs(wrapped(yaw - t.filter.x[6])) > math.pi / 2:  # the box's axis has no front of its own
                yaw = wrapped(yaw + math.pi)
            t.filter.update(float(g["x"][r]), float(g["y"][r]), float(g["z"][r]), yaw)
            points = None if clouds is None or clouds[r] is None else np.asarray(clouds[r], float).reshape(-1, 3)
            if points is not None and t.cluster is not None and t.keyframe == key - 1 and min(len(points), len(t.cluster)) >= s.icp_points:
                if now > t.seen and (found := register(t.cluster, points)) is not None:
                    t.filter.update_velocity(registered_velocity(found, t.cluster.mean(axis=0), now - t.seen))
            t.hits, t.misses, t.size = t.hits + 1, 0, tuple(float(g[c][r]) for c in "wlh")
            t.cluster, t.keyframe, t.seen = points, key, now
            if embedding is not None and embedding[r] is not None:
                t.embedding = np.asarray(embedding[r], float)
            met.add(i)
            seen.add(j)
            out["event"][r], out["iou"][r] = "match", iou
            _write(out, r, t)
        for j, r in enumerate(rows):
            if j in seen:
                continue
            t = Track(number, Filter(*(float(g[c][r]) for c in ("x", "y", "z", "yaw")), s), g["name"][r], tuple(float(g[c][r]) for c in "wlh"), now, now, keyframe=key)
            t.embedding = None if embedding is None or embedding[r] is None else np.asarray(embedding[r], float)
            t.cluster = None if clouds is None or clouds[r] is None else np.asarray(clouds[r], float).reshape(-1, 3)
            number += 1
            tracks.append(t)
            out["event"][r] = "birth"
            _write(out, r, t)
        for i, t in enumerate(alive):
            if i not in met:
                t.misses += 1
                t.dead = t.misses > s.most_misses
    return out, tracks, number


def _write(out: Columns, r: int, t: Track) -> None:
    out["track"][r], out["hits"][r] = t.number, t.hits
    for c, k in (("vx", 3), ("vy", 4), ("vz", 5), ("filter_yaw", 6)):
        out[c][r] = t.filter.x[k]


TRACK_FIELDS = "track bigint, event string, hits bigint, iou double, vx double, vy double, vz double, filter_yaw double, stable boolean"


def tracking_columns(detections: DataFrame, scene: list[str]) -> tuple[list[str], list[str], str]:
    """The columns that name a detection, those a tracker reads, and the schema of its results."""
    kinds = dict(detections.dtypes)
    keep = [*scene, "keyframe", "index"]
    used = [*keep, "t_ns", "name", "x", "y", "z", "w", "l", "h", "yaw", *(c for c in ("embedding", "points") if c in kinds)]
    return keep, used, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", " + TRACK_FIELDS


def tracked(detections: DataFrame, scene: list[str], settings: Settings = Settings()) -> DataFrame:
    """scene, keyframe, index and TRACK_FIELDS of every detection; see track_scene()."""
    keep, used, schema = tracking_columns(detections, scene)
    return solved(detections.select(*used), scene, ["keyframe", "index"], lambda g: {**{k: g[k] for k in keep}, **track_scene(g, settings)}, schema)


def assigned(rows: DataFrame, keys: list[str], side: str, solid: bool, threshold: float) -> DataFrame:
    """Pairs (a, b: index, iou) of each group's rows with ``side`` true and false, assigned for most total IoU."""
    kinds = dict(rows.dtypes)
    columns = ["x", "y", "w", "l", "yaw"] if solid else ["x1", "y1", "x2", "y2"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", a {kinds['index']}, b {kinds['index']}, iou double"

    def solve(g: Columns) -> Columns:
        m, names, left = np.column_stack([g[c].astype(float) for c in columns]), g["name"].astype(object), g[side].astype(bool)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        found = solid_assignment(m[a], m[b], names[a], names[b], gate=threshold) if solid else flat_assignment(m[a], m[b], names[a], names[b], threshold)
        i, j = np.array([p[0] for p in found], int), np.array([p[1] for p in found], int)
        return {**{k: np.repeat(g[k][:1], len(found)) for k in keys}, "a": g["index"][a][i], "b": g["index"][b][j], "iou": np.array([p[2] for p in found])}

    return solved(rows.select(*keys, "index", "name", side, *columns), keys, ["index"], solve, schema)


def within_capacity(rows: DataFrame, keys: list[str], score: str, number: str, most: int = 64) -> DataFrame:
    """The rows of each group with the highest scores, the least numbers among equals."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(number).asc())
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


@dataclass(frozen=True)
class ImageSettings:
    """Gates of the tracker of image boxes."""

    floor: float = 0.30
    other_class: float = 0.90
    most_misses: int = 2
    least_hits: int = 2
    decay: float = 0.7
    frame_share: float = 0.25
    growth: float = 2.5
    same_class: float = 0.65
    most_rows: int = 300
    capacity: int = 64


def track_images(g: Columns, s: ImageSettings = ImageSettings()) -> Columns:
    """Boxes of a camera's frames followed from frame to frame; lost ones are recovered for a while.

    Columns, in order of frame and index: frame, index, name, score, x1..y2, frame_area. Results: detected
    rows with their track, and recovered rows (source "recovered") with the last box, a decayed score and hops.
    """
    return track_images_on(g, s, [], 0)[0]


def track_images_on(g: Columns, s: ImageSettings, live: list[dict], number: int) -> tuple[Columns, list[dict], int]:
    """track_images() for the next frames of a camera that has these tracks, the next of which gets the number."""
    box = np.column_stack([g[c].astype(float) for c in ("x1", "y1", "x2", "y2")])
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    rows: list[tuple] = []
    for frame in np.unique(g["frame"]):
        here = np.flatnonzero(g["frame"] == frame)
        names = g["name"][here].astype(object)
        ends = np.array([t["box"] for t in live]).reshape(-1, 4)
        pairs = flat_assignment(ends, box[here], np.array([t["name"] for t in live], object), names, s.floor)
        met = {i for i, _, _ in pairs}
        of = {j: i for i, j, _ in pairs}
        after: list[dict] = []
        for j, r in enumerate(here):
            if j in of:
                t = live[of[j]]
            else:
                t = {"number": number, "hits": 0}
                number += 1
            t |= {"box": box[r], "name": names[j], "score": float(g["score"][r]), "misses": 0, "hops": 0, "hits": t["hits"] + 1}
            after.append(t)
            rows.append((frame, int(g["index"][r]), t["number"], "detected", 0, t["score"], *box[r], t["name"]))
        found: list[dict] = []
        over = iou_matrix(ends, box[here]) if len(here) and len(live) else np.zeros((len(live), len(here)))
        for i, t in enumerate(live):
            if i in met:
                continue
            t["hops"], t["misses"] = t["hops"] + 1, t["misses"] + 1
            same = over[i][names == t["name"]]
            other = over[i][names != t["name"]]
            gone = size(t["box"]) > s.frame_share * float(g["frame_area"][0]) or t["hits"] < s.least_hits or t["misses"] > s.most_misses
            if gone or (len(same) and same.max() >= s.floor) or (len(other) and other.max() >= s.other_class):
                continue
            found.append(t)
        # recovered boxes contest each other by decayed score, and take what room the frame leaves
        found.sort(key=lambda t: (-round(t["score"] * s.decay ** t["hops"], 5), t["number"]))
        kept: list[dict] = []
        for t in found:
            rivals = [k["box"] for k in kept if k["name"] == t["name"]]
            if len(kept) < s.most_rows - len(here) and (not rivals or iou_matrix(np.array([t["box"]]), np.array(rivals)).max() <= s.same_class):
                kept.append(t)
        for t in sorted(kept, key=lambda t: t["number"]):
            rows.append((frame, -1, t["number"], "recovered", t["hops"], round(t["score"] * s.decay ** t["hops"], 5), *t["box"], t["name"]))
        live = sorted(after + kept, key=lambda t: (-t["score"], t["number"]))[: s.capacity]
        live.sort(key=lambda t: t["number"])
    names_ = ("frame", "index", "track", "source", "hops", "score", "x1", "y1", "x2", "y2", "name")
    return {n: np.array([r[k] for r in rows], object) for k, n in enumerate(names_)}, live, number


def image_columns(boxes: DataFrame, keys: list[str]) -> tuple[list[str], str]:
    """The columns that the tracker of image boxes reads, and the schema of its results."""
    kinds = dict(boxes.dtypes)
    used = [*keys, "frame", "index", "name", "score", "x1", "y1", "x2", "y2", "frame_area"]
    return used, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", frame {kinds['frame']}, index int, track int, source string, hops int, score double, x1 double, y1 double, x2 double, y2 double, name string"


def tracked_images(boxes: DataFrame, keys: list[str], settings: ImageSettings = ImageSettings()) -> DataFrame:
    used, schema = image_columns(boxes, keys)

    def solve(g: Columns) -> Columns:
        out = track_images(g, settings)
        return {**{k: np.repeat(g[k][:1], len(out["frame"])) for k in keys}, **out}

    return solved(boxes.select(*used), keys, ["frame", "index"], solve, schema)
