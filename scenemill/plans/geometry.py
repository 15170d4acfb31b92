"""Queries on poses, boxes and pixels: each expression over the test tables, with SQL that spells it out for itself."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions import boxes as B
from ..functions import geometry as G
from ..operators import filters, pairs, release
from ..sources.tables import table
from . import inputs
from .registry import query

_N = "round({0}, 6) + 0.0::DOUBLE"


def _numbers(**columns) -> list:
    """Rounded columns; adding 0 makes -0 a 0."""
    return [(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in columns.items()]


def _poses(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as rotations that aren't of unit length, with a vector."""
    c = F.col
    q = G.Quat(1.0 + c("l_tax") * 10.0, c("l_discount") * 7.0 - 0.3, c("l_quantity") / 40.0 - 0.5, c("l_linenumber") / 5.0 - 0.6)
    v = G.Vec(c("l_extendedprice") % 17.0, c("l_quantity") - 20.0, c("l_tax") * 30.0)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.struct.alias("q"), v.struct.alias("v"), G.Vec(c("l_tax") * 9.0, c("l_discount") * 5.0, c("l_quantity") / 7.0).struct.alias("t"))


_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_POSES = f"""
raw AS (SELECT {_KEY}, 1.0::DOUBLE + l_tax * 10.0::DOUBLE AS a, l_discount * 7.0::DOUBLE - 0.3::DOUBLE AS b, l_quantity / 40.0::DOUBLE - 0.5::DOUBLE AS c, l_linenumber / 5.0::DOUBLE - 0.6::DOUBLE AS d,
               l_extendedprice % 17.0::DOUBLE AS vx, l_quantity - 20.0::DOUBLE AS vy, l_tax * 30.0::DOUBLE AS vz, l_tax * 9.0::DOUBLE AS tx, l_discount * 5.0::DOUBLE AS ty, l_quantity / 7.0::DOUBLE AS tz FROM lineitem),
poses AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n, a / n AS w, b / n AS x, c / n AS y, d / n AS z FROM raw),
turned AS (SELECT *, 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - w * z) AS r01, 2 * (x * z + w * y) AS r02, 2 * (x * y + w * z) AS r10, 1 - 2 * (x * x + z * z) AS r11, 2 * (y * z - w * x) AS r12,
                  2 * (x * z - w * y) AS r20, 2 * (y * z + w * x) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM poses)"""


@query(f"""WITH {_POSES}
SELECT {_KEY}, {', '.join(f'{_N.format(f"r{i}{j}")} AS r{i}{j}' for i in range(3) for j in range(3))},
       {_N.format('atan2(r10, r00)')} AS yaw FROM turned""")
def rotation_matrices(spark: SparkSession, folder: str) -> DataFrame:
    rows = _poses(spark, folder).withColumn("m", G.rotation_matrix(F.col("q")))
    entries = {f"r{i}{j}": F.col(f"m.r{i}{j}") for i in range(3) for j in range(3)}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_numbers(**entries, yaw=G.yaw_of(F.col("q"))))


@query(f"""WITH {_POSES}
SELECT {_KEY}, {_N.format('r00 * vx + r01 * vy + r02 * vz + tx')} AS ox, {_N.format('r10 * vx + r11 * vy + r12 * vz + ty')} AS oy, {_N.format('r20 * vx + r21 * vy + r22 * vz + tz')} AS oz,
       {_N.format('r00 * (vx - tx) + r10 * (vy - ty) + r20 * (vz - tz)')} AS ix, {_N.format('r01 * (vx - tx) + r11 * (vy - ty) + r21 * (vz - tz)')} AS iy, {_N.format('r02 * (vx - tx) + r12 * (vy - ty) + r22 * (vz - tz)')} AS iz
FROM turned""")
def rigid_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors out of a pose's frame and into it."""
    p = F.struct("t", "q").alias("p")
    rows = _poses(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v", p)
    out, into = G.transform(F.col("p"), F.col("v")), G.inverse_transform(F.col("p"), F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_numbers(ox=out.x, oy=out.y, oz=out.z, ix=into.x, iy=into.y, iz=into.z))


_YAWS = "o AS (SELECT o_orderkey, o_totalprice % 7.0::DOUBLE - 3.5::DOUBLE AS a, o_custkey % 6 - 2.5::DOUBLE AS b, o_totalprice % 50.0::DOUBLE AS x, o_totalprice % 31.0::DOUBLE AS y, o_custkey % 3 + 1.0::DOUBLE AS l FROM orders)"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "orders").select("o_orderkey", (c("o_totalprice") % 7.0 - 3.5).alias("a"), (c("o_custkey") % 6 - 2.5).alias("b"), (c("o_totalprice") % 50.0).alias("x"), (c("o_totalprice") % 31.0).alias("y"), (c("o_custkey") % 3 + 1.0).alias("l"))


@query(f"""WITH {_YAWS}
SELECT o_orderkey, {_N.format('x * cos(b) - y * sin(b) + 3.0::DOUBLE')} AS gx, {_N.format('x * sin(b) + y * cos(b) - 2.0::DOUBLE')} AS gy, {_N.format('atan2(sin(a + b), cos(a + b))')} AS yaw, {_N.format('x')} AS back_x, {_N.format('y')} AS back_y FROM o""")
def boxes_to_global(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the ego frame in the global one, and back."""
    zero = F.lit(0.0)
    rows = _turns(spark, folder).select("o_orderkey", F.struct(G.Vec(F.col("x"), F.col("y"), zero).struct.alias("t"), G.quat_of_yaw(F.col("a")).struct.alias("q"), F.col("l").alias("size")).alias("box"), G.Pose(G.Vec(F.lit(3.0), F.lit(-2.0), zero), G.quat_of_yaw(F.col("b"))).struct.alias("ego"))
    rows = rows.withColumn("g", G.box_to_global(F.col("box"), F.col("ego")))
    rows = rows.withColumn("back", G.box_to_ego(F.col("g"), F.col("ego")))
    return rows.select("o_orderkey", *_numbers(gx=F.col("g.t.x"), gy=F.col("g.t.y"), yaw=G.yaw_of(F.col("g.q")), back_x=F.col("back.t.x"), back_y=F.col("back.t.y")))


@query(f"""WITH {_YAWS},
s AS (SELECT *, CASE WHEN abs(a - b) > 2 * pi() THEN 0.0::DOUBLE ELSE (a - b) / 2 END AS half, cos(half) AS d FROM o)
SELECT o_orderkey, {_N.format("atan2(sin(b + CASE WHEN d < 0 THEN (half - sign(half) * pi()) ELSE half END * 2 * 0.25::DOUBLE), cos(b + CASE WHEN d < 0 THEN (half - sign(half) * pi()) ELSE half END * 2 * 0.25::DOUBLE))")} AS yaw FROM s WHERE abs(a - b) <= 2 * pi() AND abs(d) > 0.01""")
def slerped_yaws(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the way from one heading to another along the shorter arc; opposite headings have none."""
    rows = _turns(spark, folder).where((F.abs(F.col("a") - F.col("b")) <= 2 * math.pi) & (F.abs(F.cos((F.col("a") - F.col("b")) / 2)) > 0.01))
    rows = rows.withColumn("q", G.slerp(G.quat_of_yaw(F.col("b")), G.quat_of_yaw(F.col("a")), F.lit(0.25)).struct)
    return rows.select("o_orderkey", *_numbers(yaw=G.yaw_of(F.col("q"))))


@query(f"""WITH {_YAWS}, t AS (SELECT *, atan2(sin(a), cos(a)) AS yaw, sqrt(x * x + y * y) AS speed FROM o),
h AS (SELECT *, CASE WHEN speed >= 20 THEN atan2(y, x) WHEN l > 1.5 THEN b END AS heading FROM t), d AS (SELECT *, abs(atan2(sin(a - heading), cos(a - heading))) AS away FROM h)
SELECT o_orderkey, {_N.format("CASE WHEN heading IS NULL OR away <= pi() / 2 THEN yaw ELSE atan2(sin(a + pi()), cos(a + pi())) END")} AS yaw,
       least(floor((atan2(b, a) + pi()) / (2 * pi() / 8)), 7)::INTEGER AS sector FROM d""")
def settled_yaws(spark: SparkSession, folder: str) -> DataFrame:
    previous = F.when(F.col("l") > 1.5, F.col("b"))
    yaw = G.settled_yaw(F.col("a"), F.col("x"), F.col("y"), previous, least_speed=20.0)
    return _turns(spark, folder).select("o_orderkey", *_numbers(yaw=yaw), G.sector(F.col("a"), F.col("b"), 8).alias("sector"))


@query(f"""WITH {inputs.SOLID_BOXES}
SELECT image, index, {_N.format('min(cx)')} AS x1, {_N.format('max(cx)')} AS x2, {_N.format('min(cy)')} AS y1, {_N.format('max(cy)')} AS y2, {_N.format('min(cz)')} AS z1, {_N.format('max(cz)')} AS z2, count(*) AS n
FROM (SELECT *, x + i * l / 2 * cos(yaw) - j * w / 2 * sin(yaw) AS cx, y + i * l / 2 * sin(yaw) + j * w / 2 * cos(yaw) AS cy, z + k * h / 2 AS cz
      FROM solids, (VALUES (1), (-1)) a(i), (VALUES (1), (-1)) b(j), (VALUES (1), (-1)) c(k)) GROUP BY image, index""")
def box_corners(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.solid_boxes(spark, folder)
    c = G.corners(F.struct("x", "y", "z"), F.struct("w", "l", "h"), G.quat_of_yaw(F.col("yaw")).struct)
    rows = rows.select("image", "index", c.alias("c"))
    along = lambda a: F.transform("c", lambda p: p[a])
    ends = {f"{a}{n}": (F.array_min if n == 1 else F.array_max)(along(a)) for a in "xyz" for n in (1, 2)}
    return rows.select("image", "index", *_numbers(**ends), F.size("c").cast("long").alias("n"))


@query(f"""WITH {inputs.SOLID_BOXES}
SELECT image, index, abs((3 - x) * cos(yaw) + (2 - y) * sin(yaw)) <= l / 2 + 5 AND abs((2 - y) * cos(yaw) - (3 - x) * sin(yaw)) <= w / 2 + 5 AS holds,
       {_N.format('-(0.1::DOUBLE * x - 0.2::DOUBLE * y + 0.5::DOUBLE) / 0.9::DOUBLE')} AS height, {_N.format('0.1::DOUBLE * x - 0.2::DOUBLE * y + 0.9::DOUBLE * z + 0.5::DOUBLE')} AS away,
       {_N.format('x * cos(0.02::DOUBLE) + z * sin(0.02::DOUBLE)')} AS px, {_N.format('z * cos(0.02::DOUBLE) - x * sin(0.02::DOUBLE) + 0.4::DOUBLE')} AS pz, {_N.format('0.299::DOUBLE * w + 0.587::DOUBLE * l + 0.114::DOUBLE * h')} AS luma,
       {_N.format('degrees(acos(least(1.0::DOUBLE, abs(confidence))))')} AS tilt FROM solids""")
def planes_and_footprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.solid_boxes(spark, folder)
    c = F.col
    plane = F.struct(F.lit(0.1).alias("a"), F.lit(-0.2).alias("b"), F.lit(0.9).alias("c"), F.lit(0.5).alias("d"))
    up = G.pitched(G.Vec(c("x"), c("y"), c("z")), F.lit(0.02), 0.4)
    holds = G.footprint_contains(F.lit(3), F.lit(2), F.struct("x", "y"), F.struct("w", "l"), c("yaw"), 5.0)
    values = _numbers(height=G.plane_height(plane, c("x"), c("y")), away=G.plane_distance(plane, F.struct("x", "y", "z")), px=up.x, pz=up.z, luma=G.luma(c("w"), c("l"), c("h")), tilt=G.plane_tilt_deg(F.struct(c("confidence").alias("c"))))
    return rows.select("image", "index", holds.alias("holds"), *values)


@query(f"""WITH {inputs.SOLID_BOXES},
p AS (SELECT image, index, 40.0::DOUBLE * px / pz + 50.0::DOUBLE AS u, 42.0::DOUBLE * py / pz + 30.0::DOUBLE AS v FROM
      (SELECT image, index, x + i * l AS px, y + j * w AS py, h + n_points / 4.0::DOUBLE - 4.0::DOUBLE AS pz FROM solids, (VALUES (1), (-1)) a(i), (VALUES (1), (-1)) b(j)) WHERE pz > 0.001),
e AS (SELECT image, index, greatest(0.0::DOUBLE, least(min(u), 100)) AS x1, greatest(0.0::DOUBLE, least(max(u), 100)) AS x2, greatest(0.0::DOUBLE, least(min(v), 60)) AS y1, greatest(0.0::DOUBLE, least(max(v), 60)) AS y2 FROM p GROUP BY image, index)
SELECT image, index, {', '.join(f'{_N.format(c)} AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM e WHERE x2 > x1 AND y2 > y1""")
def camera_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The image box around a solid box's four corners, where any is in front of the camera."""
    c = F.col
    z = c("h") + c("n_points") / 4.0 - 4.0
    points = F.array(*(G.Vec(c("x") + c("l") * i, c("y") + c("w") * j, z).struct for i in (1, -1) for j in (1, -1)))
    k = F.struct(F.lit(40.0).alias("fx"), F.lit(42.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(30.0).alias("cy"))
    rows = inputs.solid_boxes(spark, folder).select("image", "index", G.image_box(points, k, F.lit(100.0), F.lit(60.0)).alias("b")).where("b IS NOT NULL")
    return rows.select("image", "index", *_numbers(**{n: F.col(f"b.{n}") for n in ("x1", "y1", "x2", "y2")}))


@query(f"""WITH {_POSES}, q AS (SELECT {_KEY}, (w + x - y + z) / 2 AS qw, (-w + x - y - z) / 2 AS qx, (w + x + y - z) / 2 AS qy, (-w + x + y + z) / 2 AS qz, abs(r22) < 0.5 AS is_optical FROM turned)
SELECT {_KEY}, {', '.join(f'{_N.format(f"q{c} * CASE WHEN qw < 0 THEN -1 ELSE 1 END")} AS q{c}' for c in 'wxyz')}, is_optical FROM q""")
def optical_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Rotations of camera bodies as those of their optical frames, and which are of one already."""
    q = G.unit(F.col("q"))
    rows = _poses(spark, folder).withColumn("u", q.struct)
    rows = rows.withColumn("o", G.optical(F.col("u")).struct)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_numbers(**{f"q{c}": F.col(f"o.{c}") for c in "wxyz"}), G.is_optical(F.col("u")).alias("is_optical"))


@query(f"""WITH {inputs.IMAGE_BOXES},
s AS (SELECT *, round(score, 6) AS s6, x2 - x1 AS w, y2 - y1 AS h FROM boxes),
p AS (SELECT a.image, a.index, b.index AS b_index, {inputs.COMMON} AS common, a.w * a.h + b.w * b.h AS sizes FROM s a JOIN s b ON a.image = b.image AND a.index < b.index)
SELECT image, index, b_index, {_N.format('common / greatest(sizes - common, 1e-9::DOUBLE)')} AS iou FROM p WHERE common > 0""")
def corner_size_iou(spark: SparkSession, folder: str) -> DataFrame:
    """IoU of boxes given by corner and size."""
    b = inputs.image_boxes(spark, folder)
    b = b.select("image", "index", F.struct(F.col("box.x1").alias("x"), F.col("box.y1").alias("y"), (F.col("box.x2") - F.col("box.x1")).alias("w"), (F.col("box.y2") - F.col("box.y1")).alias("h")).alias("box"))
    other = pairs.prefixed(b, "b_")
    out = b.join(other, (F.col("image") == F.col("b_image")) & (F.col("index") < F.col("b_index"))).withColumn("iou", B.iou_xywh(F.col("box"), F.col("b_box")))
    return out.where("iou > 0").select("image", "index", "b_index", *_numbers(iou=F.col("iou")))


def _grown(c: str, d: str, most: str, sign: str) -> str:
    return f"greatest(0, least(round_even(({c}1 + {c}2) / 2 {sign} ({d}) * 1.15::DOUBLE / 2, 0)::INTEGER, {most}))"


@query(f"""WITH {inputs.IMAGE_BOXES}
SELECT image, index, {_N.format('least(greatest(x1, 0), 100)')} AS cx1, {_N.format('least(greatest(x2, 0), 100)')} AS cx2, {_N.format('least(x2 - x1, y2 - y1)')} AS side,
       {_grown('x', 'x2 - x1', '100', '-')} AS gx1, {_grown('x', 'x2 - x1', '100', '+')} AS gx2, {_grown('y', 'y2 - y1', '80', '-')} AS gy1, {_grown('y', 'y2 - y1', '80', '+')} AS gy2,
       x1 > 1 AND y1 > 1 AND x2 < 99 AND y2 < 79 AS whole, (x2 - x1) * (y2 - y1) > 8000 * 0.25::DOUBLE OR (x2 - x1) * (y2 - y1) > 1200 * 2.5::DOUBLE AS oversize FROM boxes""")
def cropped_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes clipped to the image and grown to crops, and which are cut off or too large."""
    b = F.col("box")
    last = B.box(F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(30.0))
    clip, crop = B.clipped(b, 100.0, 80.0), B.crop(b, F.lit(100), F.lit(80))
    rows = inputs.image_boxes(spark, folder).select("image", "index", "box", clip.alias("c"), crop.alias("g"))
    return rows.select("image", "index", *_numbers(cx1=F.col("c.x1"), cx2=F.col("c.x2"), side=B.shorter_side(b)), *(F.col(f"g.{n}").alias(f"g{n}") for n in ("x1", "x2", "y1", "y2")), B.untruncated(b, F.lit(100), F.lit(80)).alias("whole"), B.oversize(b, last, F.lit(8000.0)).alias("oversize"))


_FOOT = """f AS (SELECT o_orderkey, o_custkey AS frame, o_totalprice % 6.0::DOUBLE - 3.0::DOUBLE AS az1, az1 + 0.2::DOUBLE + o_custkey % 5 / 4.0::DOUBLE AS az2, o_totalprice % 1.0::DOUBLE - 0.5::DOUBLE AS el1, el1 + 0.6::DOUBLE AS el2 FROM orders)"""


@query(f"""WITH {_FOOT},
p AS (SELECT a.o_orderkey, b.o_orderkey AS b_orderkey, (a.az2 - a.az1) * (a.el2 - a.el1) AS own, greatest(least(a.el2, b.el2) - greatest(a.el1, b.el1), 0) AS h,
             greatest(least(a.az2, b.az2) - greatest(a.az1, b.az1), least(a.az2, b.az2 + 2 * pi()) - greatest(a.az1, b.az1 + 2 * pi()), least(a.az2, b.az2 - 2 * pi()) - greatest(a.az1, b.az1 - 2 * pi()), 0) AS w
      FROM f a JOIN f b ON a.frame = b.frame AND a.o_orderkey <> b.o_orderkey)
SELECT o_orderkey, b_orderkey, {_N.format('w * h / own')} AS inside FROM p WHERE w * h / own > 0.5""")
def angular_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Footprints on the sphere of directions that lie more than half within another's, over the seam too."""
    c = F.col
    az, el = c("o_totalprice") % 6.0 - 3.0, c("o_totalprice") % 1.0 - 0.5
    foot = F.struct(az.alias("az1"), (az + 0.2 + c("o_custkey") % 5 / 4.0).alias("az2"), el.alias("el1"), (el + 0.6).alias("el2"))
    rows = table(spark, folder, "orders").select("o_orderkey", c("o_custkey").alias("frame"), foot.alias("foot"))
    other = pairs.prefixed(rows, "b_")
    out = rows.join(other, (c("frame") == c("b_frame")) & (c("o_orderkey") != c("b_o_orderkey"))).withColumn("inside", B.angular_overlap(c("foot"), c("b_foot")))
    return out.where("inside > 0.5").select("o_orderkey", c("b_o_orderkey").alias("b_orderkey"), *_numbers(inside=c("inside")))


@query(f"""WITH p AS (SELECT event_id, value % 9.0::DOUBLE - 4.0::DOUBLE AS x, (user_id % 7) - 3.0::DOUBLE AS y, 2.0::DOUBLE + value % 13.0::DOUBLE AS z FROM events),
r AS (SELECT event_id, atan2(y, x) AS first, atan2(y + k, x) AS az, atan2(z, sqrt(x * x + (y + k) * (y + k))) AS el FROM p, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (-0.5::DOUBLE)) a(k)),
u AS (SELECT event_id, first + (az - first) - 2 * pi() * round_even((az - first) / (2 * pi()), 0) AS az, el FROM r)
SELECT event_id, {_N.format('min(az)')} AS az1, {_N.format('max(az)')} AS az2, {_N.format('min(el)')} AS el1, {_N.format('max(el)')} AS el2 FROM u GROUP BY event_id""")
def angular_footprints(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    x, y, z = c("value") % 9.0 - 4.0, (c("user_id") % 7) - 3.0, 2.0 + c("value") % 13.0
    rays = F.array(*(G.Vec(x, y + k, z).struct for k in (0.0, 0.5, -0.5)))
    rows = table(spark, folder, "events").select("event_id", B.angular_footprint(rays).alias("f"))
    return rows.select("event_id", *_numbers(**{n: F.col(f"f.{n}") for n in ("az1", "az2", "el1", "el2")}))


@query("""SELECT o_orderkey, (epoch_us(o_orderdate) * 1000)::BIGINT AS ns, CASE WHEN f < 0.4 THEN '1' WHEN f < 0.6 THEN '2' WHEN f < 0.8 THEN '3' ELSE '4' END AS visibility
FROM (SELECT *, (o_custkey % 11) / 10.0::DOUBLE AS f FROM orders)""")
def times_and_visibility(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    us = inputs.micros(c("o_orderdate"))
    base = F.when(c("o_orderkey") % 2 == 0, "unix_us").otherwise("unix_ns")
    ns = G.unix_ns(F.when(base == "unix_us", us).otherwise(us * 1000), base)
    return table(spark, folder, "orders").select("o_orderkey", ns.cast("long").alias("ns"), release.visibility_of((c("o_custkey") % 11) / 10.0).alias("visibility"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS nth FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM n WHERE nth % 5 = 3""")
def strided_rows(spark: SparkSession, folder: str) -> DataFrame:
    out = filters.strided(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"], 5, 3, ["l_suppkey"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"""WITH {inputs.IMAGE_BOXES}
SELECT image, name, min(index) AS index FROM boxes GROUP BY image, name""")
def first_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Of boxes of one image and name the first."""
    rows = inputs.image_boxes(spark, folder).select("image", "name", "index")
    return pairs.first_copies(rows, ["image", "name"], ["index"])


@query("""WITH p AS (SELECT event_id, user_id AS image, event_id % 8 AS r, event_id % 30 AS c FROM events),
m AS (SELECT c_custkey AS mask, c_custkey % 100 AS image, c_nationkey % 8 AS r, c_nationkey AS lo, c_nationkey + 9 AS hi, c_custkey % 7 + 3 AS n_mask_px, round(c_acctbal, 2) AS score FROM customer)
SELECT event_id, arg_min(mask, (n_mask_px, -score, mask)) AS mask, count(*) AS n_masks FROM p JOIN m ON p.image = m.image AND p.r = m.r AND p.c BETWEEN m.lo AND m.hi GROUP BY event_id""")
def mask_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Points joined to the mask runs that hold them; the smallest mask claims each."""
    c = F.col
    points = table(spark, folder, "events").select("event_id", c("user_id").alias("image"), (c("event_id") % 8).alias("row"), (c("event_id") % 30).alias("col"))
    runs = table(spark, folder, "customer").select(c("c_custkey").alias("mask"), (c("c_custkey") % 100).alias("image"), (c("c_nationkey") % 8).alias("row"), c("c_nationkey").alias("col_lo"), (c("c_nationkey") + 9).alias("col_hi"), (c("c_custkey") % 7 + 3).alias("n_mask_px"), F.round("c_acctbal", 2).alias("score"))
    held = pairs.masked_points(points, runs, ["image"])
    held = held.select("event_id", *(F.col(f"b_{n}").alias(n) for n in ("mask", "n_mask_px", "score")))
    n = held.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_masks"))
    return pairs.first_claims(held.withColumn("proposal_index", c("mask")), ["event_id"]).select("event_id", "mask").join(n, "event_id")


@query("""SELECT event_id, CASE WHEN event_type LIKE '%view%' THEN 'view' WHEN event_type LIKE '%click%' THEN 'click' ELSE 'unknown' END AS place,
       CASE WHEN event_id % 3 = 0 THEN '***' ELSE event_type END AS shown, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_id::VARCHAR END AS BIGINT), -1) AS number FROM events""")
def text_helpers(spark: SparkSession, folder: str) -> DataFrame:
    """Places named in texts, hidden settings, and names that sort as numbers."""
    c = F.col
    shown = text.masked(F.when(c("event_id") % 3 == 0, "API_TOKEN").otherwise("PORT"), c("event_type"))
    key = text.natural_key(F.when(c("event_id") % 4 == 0, c("event_type")).otherwise(c("event_id").cast("string")))
    return table(spark, folder, "events").select("event_id", text.location_of(c("event_type"), ["view", "click"]).alias("place"), shown.alias("shown"), F.coalesce(key["number"], F.lit(-1)).alias("number"))


@query("""WITH s AS (SELECT image, list(score ORDER BY index) AS scores FROM (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS index, l_discount * 9.0::DOUBLE + l_quantity / 500.0::DOUBLE AS score FROM lineitem) GROUP BY image)
SELECT image, round(scores[1], 6) AS first, round(list_max(scores[1:3]), 6) AS most FROM s""")
def phrase_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.image_boxes(spark, folder).select("image", F.col("index").alias("proposal_index"), "score")
    rows = arrays.together(rows, ["image"], ["score"])
    span = lambda a, b: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")))
    return rows.select("image", F.round(arrays.phrase_scores(F.col("score"), span(0, 1))[0], 6).alias("first"), F.round(arrays.phrase_scores(F.col("score"), span(0, 3), "max")[0], 6).alias("most"))
