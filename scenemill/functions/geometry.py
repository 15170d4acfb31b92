"""Rigid-body and camera geometry as Column algebra.

Columns of vectors are structs (x, y, z), of quaternions (w, x, y, z), sizes (w, l, h), poses (t: vector, q:
quaternion) and intrinsics (fx, fy, cx, cy). Functions take such columns or their components (Vec, Quat,
Pose) and give components, whose ``struct`` is a column again. Everything stays in generated code; there
are no UDFs. Results of one step that others use more than once are best made columns of their own.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth at or below which a point counts as behind the camera.
MIN_DEPTH = 1e-3
#: Nanoseconds of the only other time base that is accepted.
NS_PER_US = 1000
#: A unix time in nanoseconds is at least this large.
LEAST_UNIX_NS = 10**18


def unix_ns(ts: Column, base: Column) -> Column:
    """Nanoseconds since the epoch from microseconds ('unix_us') or nanoseconds ('unix_ns'); other bases raise."""
    ns = F.when(base == "unix_us", ts * NS_PER_US).when(base == "unix_ns", ts)
    return F.when(base.isin("unix_us", "unix_ns"), ns).otherwise(F.raise_error(F.concat(F.lit("unknown time base "), base)).cast("long"))


class Vec(NamedTuple):
    """Components of a vector. Kept apart until ``struct``: a field of a struct expression would repeat the whole struct."""

    x: Column
    y: Column
    z: Column

    @property
    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip("xyz", self)))


class Quat(NamedTuple):
    """Components of a quaternion."""

    w: Column
    x: Column
    y: Column
    z: Column

    @property
    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip("wxyz", self)))


class Pose(NamedTuple):
    t: Vec
    q: Quat

    @property
    def struct(self) -> Column:
        return F.struct(self.t.struct.alias("t"), self.q.struct.alias("q"))


def vec(a: Column | Vec) -> Vec:
    """The components of a struct column (x, y, z)."""
    return a if isinstance(a, Vec) else Vec(*(a[c] for c in "xyz"))


def quat(q: Column | Quat) -> Quat:
    return q if isinstance(q, Quat) else Quat(*(q[c] for c in "wxyz"))


def pose(p: Column | Pose) -> Pose:
    return p if isinstance(p, Pose) else Pose(vec(p["t"]), quat(p["q"]))


def add(a: Column | Vec, b: Column | Vec) -> Vec:
    return Vec(*(x + y for x, y in zip(vec(a), vec(b))))


def subtract(a: Column | Vec, b: Column | Vec) -> Vec:
    return Vec(*(x - y for x, y in zip(vec(a), vec(b))))


def scale(a: Column | Vec, k: Column | float) -> Vec:
    return Vec(*(x * k for x in vec(a)))


def cross(a: Column | Vec, b: Column | Vec) -> Vec:
    a, b = vec(a), vec(b)
    return Vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def dot(a: Column | Vec, b: Column | Vec) -> Column:
    a, b = vec(a), vec(b)
    return a.x * b.x + a.y * b.y + a.z * b.z


def length(a: Column | Vec) -> Column:
    return F.sqrt(dot(a, a))


def quat_norm(q: Column | Quat) -> Column:
    q = quat(q)
    return F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)


def unit(q: Column | Quat, least: float = 1e-6) -> Quat:
    """The quaternion over its norm; one that is nearly zero raises."""
    n = quat_norm(q)
    n = F.when(n < least, F.raise_error(F.lit("a quaternion has no direction")).cast("double")).otherwise(n)
    return Quat(*(c / n for c in quat(q)))


def conjugate(q: Column | Quat) -> Quat:
    q = quat(q)
    return Quat(q.w, -q.x, -q.y, -q.z)


def quat_product(a: Column | Quat, b: Column | Quat) -> Quat:
    a, b = quat(a), quat(b)
    return Quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def canonical(q: Column | Quat) -> Quat:
    """Of the two quaternions of a rotation, the one with w >= 0."""
    q = quat(q)
    sign = F.when(q.w < 0, -1.0).otherwise(1.0)
    return Quat(*(c * sign for c in q))


def rotation_matrix(q: Column | Quat) -> Column:
    """Rows of the rotation, as a struct r00 to r22."""
    w, x, y, z = unit(q)
    entries = (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )
    return F.struct(*(e.alias(f"r{i}{j}") for i, row in enumerate(entries) for j, e in enumerate(row)))


def rotate(q: Column | Quat, v: Column | Vec) -> Vec:
    """v turned by the (unit) quaternion: v + 2w(u x v) + 2u x (u x v)."""
    q = quat(q)
    u = Vec(q.x, q.y, q.z)
    t = scale(cross(u, v), 2.0)
    return add(add(v, scale(t, q.w)), cross(u, t))


def wrap(angle: Column) -> Column:
    """The angle in (-pi, pi]: the IEEE remainder by a full turn, with -pi taken to pi."""
    turned = angle - F.lit(2 * math.pi) * F.rint(angle / F.lit(2 * math.pi))
    return F.when(turned == F.lit(-math.pi), F.lit(math.pi)).otherwise(turned)


def yaw_of(q: Column | Quat) -> Column:
    u = unit(q)
    return wrap(F.atan2(2 * (u.w * u.z + u.x * u.y), 1 - 2 * (u.y * u.y + u.z * u.z)))


def quat_of_yaw(yaw: Column) -> Quat:
    return Quat(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def transform(p: Column | Pose, v: Column | Vec) -> Vec:
    """From the pose's own frame to the frame it is given in."""
    p = pose(p)
    return add(rotate(unit(p.q), v), p.t)


def inverse_transform(p: Column | Pose, v: Column | Vec) -> Vec:
    p = pose(p)
    return rotate(conjugate(unit(p.q)), subtract(v, p.t))


def compose(outer: Column | Pose, inner: Column | Pose) -> Pose:
    """The pose that applies inner, then outer."""
    outer, inner = pose(outer), pose(inner)
    return Pose(transform(outer, inner.t), quat_product(unit(outer.q), unit(inner.q)))


def box_to_global(box: Column, ego: Column | Pose) -> Column:
    """A box (t, q, size) of the ego frame in the global frame."""
    q = canonical(quat_product(unit(pose(ego).q), unit(box["q"])))
    return F.struct(transform(ego, box["t"]).struct.alias("t"), q.struct.alias("q"), box["size"].alias("size"))


def box_to_ego(box: Column, ego: Column | Pose) -> Column:
    q = canonical(quat_product(conjugate(unit(pose(ego).q)), unit(box["q"])))
    return F.struct(inverse_transform(ego, box["t"]).struct.alias("t"), q.struct.alias("q"), box["size"].alias("size"))


def rotation_of_yaw(yaw: Column) -> Column:
    """Rows of the rotation about z, as a struct r00 to r22: the angle's own cosine and sine, not those of its half."""
    zero, one = F.lit(0.0), F.lit(1.0)
    entries = ((F.cos(yaw), -F.sin(yaw), zero), (F.sin(yaw), F.cos(yaw), zero), (zero, zero, one))
    return F.struct(*(e.alias(f"r{i}{j}") for i, row in enumerate(entries) for j, e in enumerate(row)))


def with_camera_matrix(frames: DataFrame, ego_at_scan: str, ego_at_image: str, camera: str, out: str = "matrix") -> DataFrame:
    """Adds the motion from the ego frame at scan time into the camera frame at image time: a struct of the rotation
    m00 to m22, the ego's way e0 to e2 and the camera's place c0 to c2, both along the axes of the scan.

    ``frames`` has a row for each scan and camera, and is joined to the points afterwards: the four hops (ego,
    global, ego, camera) are composed once a row of it, and a point costs two sums and three dot products. A point
    is moved before it is turned: a turned translation would bring its rounding to every point. ``camera`` has a
    rotation ``q`` (quaternion) or ``r`` (its matrix, r00 to r22).
    """
    q = lambda c: F.col(f"{c}.q")
    own = F.col(f"{camera}.r") if "r" in frames.schema[camera].dataType.names else rotation_matrix(q(camera))
    rows = frames.withColumn("__s", unit(q(ego_at_scan)).struct).withColumn("__i", conjugate(unit(q(ego_at_image))).struct).withColumn("__c", own)
    rows = rows.withColumn("__q", quat_product(F.col("__i"), F.col("__s")).struct).withColumn("__e", rotate(conjugate(F.col("__s")), subtract(F.col(f"{ego_at_scan}.t"), F.col(f"{ego_at_image}.t"))).struct)
    r = rows.withColumn("__r", rotation_matrix(F.col("__q"))).withColumn("__t", rotate(conjugate(F.col("__q")), F.col(f"{camera}.t")).struct)
    turned = lambda i, j: F.col(f"__c.r0{i}") * F.col(f"__r.r0{j}") + F.col(f"__c.r1{i}") * F.col(f"__r.r1{j}") + F.col(f"__c.r2{i}") * F.col(f"__r.r2{j}")
    entries = [turned(i, j).alias(f"m{i}{j}") for i in range(3) for j in range(3)] + [F.col(f"__{n}.{c}").alias(f"{m}{i}") for n, m in (("e", "e"), ("t", "c")) for i, c in enumerate("xyz")]
    return r.withColumn(out, F.struct(*entries)).drop("__s", "__i", "__c", "__q", "__e", "__t", "__r")


def moved(matrix: Column, p: Column | Vec) -> Vec:
    """A point under a motion of ``with_camera_matrix``."""
    x, y, z = (a + matrix[f"e{i}"] - matrix[f"c{i}"] for i, a in enumerate(vec(p)))
    return Vec(*(matrix[f"m{i}0"] * x + matrix[f"m{i}1"] * y + matrix[f"m{i}2"] * z for i in range(3)))


def pixel(p: Column, k: Column, width: Column, height: Column, min_depth: float = MIN_DEPTH) -> Column:
    """u, v, depth and in_image of a point of the camera frame.

    A point that isn't in front has null pixels: nothing is divided by its depth, whatever order the
    optimiser evaluates in.
    """
    z = F.when(p["z"] > min_depth, p["z"])
    u, v = k["fx"] * p["x"] / z + k["cx"], k["fy"] * p["y"] / z + k["cy"]
    # on the pixels themselves: a test multiplied out rounds otherwise, and takes points on an edge that they say are outside
    inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
    inside = F.coalesce(inside, F.lit(False))  # one test: as several, the optimiser would infer ever more from them
    return F.struct(u.alias("u"), v.alias("v"), p["z"].alias("depth"), inside.alias("in_image"))


def axis_cosine(p: Column) -> Column:
    """Cosine of the angle to the optical axis, in [-1, 1]."""
    n = length(p)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["z"] / F.when(n > 0, n))))


def slerp(a: Column | Quat, b: Column | Quat, t: Column, straight_above: float = 1 - 1e-9) -> Quat:
    """Between unit quaternions along the shorter arc; nearly equal ones are interpolated straight."""
    a, b = quat(a), quat(b)
    d = a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    d = F.abs(d)
    straight = d > straight_above
    angle = F.acos(F.least(d, F.lit(1.0)))
    sine = F.when(straight, F.lit(1.0)).otherwise(F.sin(angle))
    wa = F.when(straight, 1 - t).otherwise(F.sin((1 - t) * angle) / sine)
    wb = F.when(straight, t).otherwise(F.sin(t * angle) / sine) * sign
    mixed = Quat(*(x * wa + y * wb for x, y in zip(a, b)))
    n = quat_norm(mixed)
    return Quat(*(c / n for c in mixed))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def corners(center: Column, size: Column, q: Column) -> Column:
    """The eight corners of a box, as an array of vectors."""
    at = [Vec(size["l"] / 2 * i, size["w"] / 2 * j, size["h"] / 2 * k).struct for i in (1, -1) for j in (1, -1) for k in (1, -1)]
    return F.transform(F.array(*at), lambda c: add(center, rotate(q, c)).struct)


def local_point(p: Column | Vec, center: Column | Vec, q: Column | Quat) -> Vec:
    """A point in a box's own frame."""
    return rotate(conjugate(q), subtract(p, center))


def in_box(p: Column | Vec, center: Column | Vec, size: Column, q: Column | Quat, inclusive: bool) -> Column:
    """Whether a point lies in a box; points on the faces count if ``inclusive``."""
    sides = zip(local_point(p, center, q), (size["l"], size["w"], size["h"]))
    tests = [F.abs(a) <= s / 2 if inclusive else F.abs(a) < s / 2 for a, s in sides]
    return tests[0] & tests[1] & tests[2]


def footprint_contains(x: Column, y: Column, center: Column, size: Column, yaw: Column, margin: float = 0.0) -> Column:
    """Whether a point of the plane lies in a box's footprint."""
    dx, dy = x - center["x"], y - center["y"]
    along, across = dx * F.cos(yaw) + dy * F.sin(yaw), dy * F.cos(yaw) - dx * F.sin(yaw)
    return (F.abs(along) <= size["l"] / 2 + margin) & (F.abs(across) <= size["w"] / 2 + margin)


def image_box(points: Column, k: Column, width: Column, height: Column, min_depth: float = MIN_DEPTH) -> Column:
    """The box around the pixels of camera-frame points in front, clipped to the image; null if none is or nothing is left."""
    front = F.filter(points, lambda p: p["z"] > min_depth)
    u = F.transform(front, lambda p: k["fx"] * p["x"] / F.when(p["z"] > min_depth, p["z"]) + k["cx"])
    v = F.transform(front, lambda p: k["fy"] * p["y"] / F.when(p["z"] > min_depth, p["z"]) + k["cy"])
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(c, most))
    x1, x2, y1, y2 = clip(F.array_min(u), width), clip(F.array_max(u), width), clip(F.array_min(v), height), clip(F.array_max(v), height)
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((F.size(front) > 0) & (x2 > x1) & (y2 > y1), box)


def plane_height(plane: Column, x: Column, y: Column) -> Column:
    """Height over (x, y) of the plane n.p + d = 0, given as (a, b, c, d)."""
    return -(plane["a"] * x + plane["b"] * y + plane["d"]) / plane["c"]


def plane_distance(plane: Column, p: Column) -> Column:
    """Signed distance of a point to a plane with unit normal."""
    return plane["a"] * p["x"] + plane["b"] * p["y"] + plane["c"] * p["z"] + plane["d"]


def plane_tilt_deg(plane: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(plane["c"]))))


def pitched(p: Column | Vec, pitch: Column, dz: Column | float = 0.0) -> Vec:
    """A point turned in the x-z plane and lifted."""
    p = vec(p)
    return Vec(p.x * F.cos(pitch) + p.z * F.sin(pitch), p.y, p.z * F.cos(pitch) - p.x * F.sin(pitch) + dz)


def sector(x: Column, y: Column, n: int) -> Column:
    """The index of the azimuth sector, from -pi on."""
    return F.least(F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi / n)), F.lit(n - 1)).cast("int")


def settled_yaw(yaw: Column, velocity_x: Column, velocity_y: Column, previous: Column, least_speed: float = 1.0) -> Column:
    """Of a yaw and its opposite, the one nearer to the direction of motion, or else to the previous yaw."""
    speed = F.sqrt(velocity_x * velocity_x + velocity_y * velocity_y)
    heading = F.when(speed >= least_speed, F.atan2(velocity_y, velocity_x)).otherwise(previous)
    away = F.abs(wrap(yaw - heading))
    return F.when(heading.isNull() | (away <= math.pi / 2), wrap(yaw)).otherwise(wrap(yaw + math.pi))


def optical(q: Column | Quat) -> Quat:
    """A camera's body-frame rotation (x ahead, y left, z up) as one of its optical frame (z ahead, x right)."""
    return canonical(quat_product(q, Quat(F.lit(0.5), F.lit(-0.5), F.lit(0.5), F.lit(-0.5))))


def is_optical(q: Column | Quat) -> Column:
    """Whether the frame's z axis lies nearer to the horizontal than to the vertical."""
    return F.abs(rotate(unit(q), Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))).z) < 0.5


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
