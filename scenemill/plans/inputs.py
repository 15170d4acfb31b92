"""The engine's inputs, drawn from the test tables: boxes, poses, points and chains; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..sources.tables import table

#: A line of an order has no key of its own: all columns together are one.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def rounded(x: Column, digits: int) -> Column:
    """Rounded as the SQL does it, from the product with a power of ten; ``F.round`` goes by the shortest decimal, and differs next to halves."""
    k = F.lit(10.0**digits)
    return F.round(x * k) / k


def image_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """An order is an image and its lines are boxes: image, index, name, score, box."""
    rows = table(spark, folder, "lineitem")
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    x, y = F.col("l_extendedprice") % 97.0, F.col("l_extendedprice") % 61.0
    box = B.box(x, y, x + 30.0 + F.col("l_quantity"), y + 30.0 + F.col("l_tax") * 500.0)
    names = ["car", "truck", "bus", "motorcycle", "bicycle", "pedestrian", "cone"]
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 7 + 1).cast("int"))
    return rows.select(F.col("l_orderkey").alias("image"), index.alias("index"), name.alias("name"), (F.col("l_discount") * 9.0 + F.col("l_quantity") / 500.0).alias("score"), box.alias("box"), (F.col("l_linenumber") % 2).alias("odd"))


IMAGE_BOXES = """boxes AS (
  SELECT l_orderkey AS image,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1)::INTEGER AS index,
         ['car', 'truck', 'bus', 'motorcycle', 'bicycle', 'pedestrian', 'cone'][l_partkey % 7 + 1] AS name,
         l_discount * 9.0::DOUBLE + l_quantity / 500.0::DOUBLE AS score, l_linenumber % 2 AS odd,
         l_extendedprice % 97.0::DOUBLE AS x1, l_extendedprice % 61.0::DOUBLE AS y1,
         x1 + 30.0::DOUBLE + l_quantity AS x2, y1 + 30.0::DOUBLE + l_tax * 500.0::DOUBLE AS y2
  FROM lineitem)"""

#: IoU and containment of boxes a and b.
COMMON = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0::DOUBLE) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0::DOUBLE)"
AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
IOU = f"({COMMON}) / ({AREA.format('a')} + {AREA.format('b')} - ({COMMON}))"
INSIDE = f"({COMMON}) / ({AREA.format('a')})"


def solid_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as boxes in space: image, index, category, x, y, z, yaw, w, l, h, n_points, confidence."""
    rows = table(spark, folder, "lineitem")
    index = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    c = F.col
    return rows.select(
        c("l_orderkey").alias("image"),
        index.alias("index"),
        (c("l_partkey") % 11).cast("string").alias("category"),
        (c("l_extendedprice") % 83.0 - 40.0).alias("x"),
        (c("l_extendedprice") % 59.0 - 30.0).alias("y"),
        (c("l_tax") * 10.0).alias("z"),
        (c("l_discount") * 30.0 - 1.5).alias("yaw"),
        (1.0 + c("l_quantity") / 25.0).alias("w"),
        (2.0 + c("l_extendedprice") % 7.0).alias("l"),
        (1.0 + c("l_tax") * 20.0).alias("h"),
        c("l_quantity").cast("int").alias("n_points"),
        (c("l_discount") * 10.0).alias("confidence"),
    )


SOLID_BOXES = """solids AS (
  SELECT l_orderkey AS image,
         (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1)::INTEGER AS index,
         (l_partkey % 11)::VARCHAR AS category,
         l_extendedprice % 83.0::DOUBLE - 40.0::DOUBLE AS x, l_extendedprice % 59.0::DOUBLE - 30.0::DOUBLE AS y, l_tax * 10.0::DOUBLE AS z,
         l_discount * 30.0::DOUBLE - 1.5::DOUBLE AS yaw, 1.0::DOUBLE + l_quantity / 25.0::DOUBLE AS w, 2.0::DOUBLE + l_extendedprice % 7.0::DOUBLE AS l,
         1.0::DOUBLE + l_tax * 20.0::DOUBLE AS h, l_quantity::INTEGER AS n_points, l_discount * 10.0::DOUBLE AS confidence
  FROM lineitem)"""
