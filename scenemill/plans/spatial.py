"""Queries of clustering, box fitting, tracking and ground planes. SQL gives no rows for these; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster, ground, track
from ..sources.tables import table
from . import inputs
from .registry import query


def painted_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as painted points: a user is an instance, whose points lie along two faces and in some noise."""
    c = F.col
    along, side = (c("event_id") % 40) * 0.1, c("event_id") % 3
    x = F.when(side == 0, along).otherwise(c("value") % 0.2) + c("user_id") % 13 + F.when(c("event_id") % 17 == 0, c("value") % 9.0).otherwise(0.0)
    y = F.when(side == 0, c("value") % 0.15).otherwise(along / 2) + c("user_id") % 7
    return table(spark, folder, "events").select(c("user_id").alias("instance"), c("event_id").alias("point_index"), x.alias("x"), y.alias("y"), (c("value") % 1.5).alias("z"), F.sqrt(x * x + y * y).alias("depth"), F.lit(0.6).alias("eps"), F.when(c("user_id") % 4 > 0, 0.4).alias("prior_w"), F.when(c("user_id") % 4 > 0, 1.0).alias("prior_l"))


@query()
def dbscan_labels(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.cluster_labels(painted_points(spark, folder), ["instance"], 0.35)


@query()
def fitted_boxes(spark: SparkSession, folder: str) -> DataFrame:
    out = cluster.instance_boxes(painted_points(spark, folder), ["instance"])
    return out.select("instance", "status", "n_points", "n_kept", "retried", "rejected", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "w", "l", "h", "yaw")), "yaw_ambiguous", "clamped")


@query("""
WITH p AS (SELECT user_id AS instance, value % 30.0::DOUBLE AS x, (event_id % 11)::DOUBLE AS y, value % 4.0::DOUBLE AS z, value % 5.0::DOUBLE < 2 AS in_region FROM events)
SELECT instance, count(*) AS n_points, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, min(x) AS min_depth, round(avg(x), 6) AS mean_depth, max(x) AS max_depth, count(*) FILTER (in_region) AS n_in_region FROM p GROUP BY instance
""")
def instance_summaries(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    points = table(spark, folder, "events").select(c("user_id").alias("instance"), (c("value") % 30.0).alias("x"), (c("event_id") % 11).cast("double").alias("y"), (c("value") % 4.0).alias("z"), (c("value") % 30.0).alias("depth"), (c("value") % 5.0 < 2).alias("in_region"))
    out = cluster.instance_summary(points, ["instance"])
    return out.withColumns({n: F.round(n, 6) for n in ("mean_x", "mean_y", "mean_z", "mean_depth")})


@query("""
WITH p AS (SELECT user_id AS scene, event_id % 4 - 1 AS label, value % 30.0::DOUBLE AS x, (event_id % 11)::DOUBLE AS y, event_id AS rank FROM events),
s AS (SELECT scene, label, count(*) AS n, avg(sqrt(x * x + y * y)) AS mean_range, min(rank) AS first FROM p WHERE label >= 0 GROUP BY scene, label)
SELECT scene, label, n, round(mean_range, 6) AS mean_range, first FROM s QUALIFY row_number() OVER (PARTITION BY scene ORDER BY n DESC, mean_range, first) = 1
""")
def chosen_clusters(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    points = table(spark, folder, "events").select(c("user_id").alias("scene"), (c("event_id") % 4 - 1).alias("label"), (c("value") % 30.0).alias("x"), (c("event_id") % 11).cast("double").alias("y"), c("event_id").alias("rank"))
    return cluster.best_clusters(points, ["scene"]).withColumn("mean_range", F.round("mean_range", 6))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as detections: a supplier is a scene, of 40 keyframes half a second apart; half the boxes drift with time."""
    c = F.col
    b = inputs.solid_boxes(spark, folder)
    rows = b.join(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("image"), "l_suppkey").groupBy("image").agg(F.min("l_suppkey").alias("scene")), "image")
    rows = rows.withColumn("keyframe", (c("image") % 40).cast("int"))
    at = F.row_number().over(Window.partitionBy("scene", "keyframe").orderBy("image", "index")) - 1
    lane = (c("index") % 3) * 8.0
    return rows.select("scene", "keyframe", at.alias("index"), (c("keyframe").cast("long") * 500_000_000).alias("t_ns"), (c("index") % 2).cast("string").alias("name"), (c("x") * 0.02 + c("keyframe") * 0.5).alias("x"), (lane + c("y") * 0.02).alias("y"), "z", "w", "l", "h", (c("yaw") * 0.05).alias("yaw"))


@query()
def tracked_boxes(spark: SparkSession, folder: str) -> DataFrame:
    out = track.tracked(detections(spark, folder), ["scene"])
    return out.withColumns({n: F.round(n, 6) for n in ("iou", "vx", "vy", "vz", "filter_yaw")})


@query()
def tracked_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image boxes of a supplier's lines, followed over 30 frames."""
    c = F.col
    rows = inputs.image_boxes(spark, folder).join(table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.min("l_suppkey").alias("scene")), "image")
    rows = rows.withColumn("frame", (c("image") % 30).cast("int"))
    at = F.row_number().over(Window.partitionBy("scene", "frame").orderBy("image", "index")) - 1
    rows = rows.select("scene", "frame", at.alias("index"), "name", F.round("score", 6).alias("score"), *(c(f"box.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")), F.lit(30_000.0).alias("frame_area"))
    return track.tracked_images(rows, ["scene"]).withColumns({n: F.round(n, 6) for n in ("x1", "y1", "x2", "y2")})


@query()
def hungarian_2d(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.image_boxes(spark, folder).select("image", "index", "name", (F.col("odd") == 1).alias("left"), *(F.col("box")[c].alias(c) for c in ("x1", "y1", "x2", "y2")))
    return track.assigned(rows.withColumn("name", F.lit("any")), ["image"], "left", False, 0.30).withColumn("iou", F.round("iou", 6))


@query()
def hungarian_3d(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.solid_boxes(spark, folder)
    rows = rows.select("image", "index", F.lit("any").alias("name"), (F.col("index") % 2 == 1).alias("left"), (F.col("x") * 0.1).alias("x"), (F.col("y") * 0.1).alias("y"), "w", "l", "yaw")
    return track.assigned(rows, ["image"], "left", True, 0.05).withColumn("iou", F.round("iou", 6))


def ground_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as points of a slightly tilted road with clutter above; an event type is a keyframe."""
    c = F.col
    turn, reach = (c("event_id") % 360) * 0.0174532925199433, 3.0 + c("value") % 9.0
    x, y = reach * F.cos(turn), reach * F.sin(turn)
    z = 0.02 * x - 0.01 * y - 1.5 + F.when(c("event_id") % 5 == 0, c("value") % 1.3).otherwise((c("event_id") % 7) * 0.01)
    return table(spark, folder, "events").select(c("event_type").alias("keyframe"), "event_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query()
def ground_planes(spark: SparkSession, folder: str) -> DataFrame:
    out = ground.ground_planes(ground_points(spark, folder), "keyframe")
    return out.withColumns({n: F.round(n, 6) for n in ("a", "b", "c", "d", "tilt")})


@query()
def off_ground_points(spark: SparkSession, folder: str) -> DataFrame:
    points = ground_points(spark, folder)
    return ground.without_ground(points, ground.ground_planes(points, "keyframe"), "keyframe").select("keyframe", "event_id")


def stereo_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a mask's points: a user is a mask on a box's near face, with a wall behind it."""
    c = F.col
    near = 4.0 + c("user_id") % 30
    x = near + F.when(c("event_id") % 9 == 0, 12.0).otherwise(c("value") % 0.3)
    y = (c("event_id") % 21 - 10) * 0.09 + (c("user_id") % 5 - 2) * 0.5
    return table(spark, folder, "events").select(
        c("user_id").alias("mask"), x.alias("x"), y.alias("y"), ((c("event_id") % 13) * 0.12 - 1.0).alias("z"), (c("event_id") % 4 > 0).alias("stereo"), (c("user_id") % 6 == 0).alias("truncated"),
        *(F.lit(v).alias(n) for n, v in (("mu_w", 1.8), ("sigma_w", 0.15), ("mu_l", 4.5), ("sigma_l", 0.4), ("mu_h", 1.6), ("sigma_h", 0.2), ("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 1.2))),
    )


@query()
def stereo_boxes(spark: SparkSession, folder: str) -> DataFrame:
    out = ground.stereo_boxes(stereo_points(spark, folder), ["mask"])
    return out.withColumns({n: F.round(n, 6) for n in ("x", "y", "z", "w", "l", "h", "yaw", "near")})
