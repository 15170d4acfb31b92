"""Queries of order-dependent assignment. SQL gives no rows for these; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assign, evaluate, pairs
from . import inputs
from .registry import query


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.image_boxes(spark, folder).select("image", "index", "name", "score", "odd", *(F.col("box")[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


def _candidates(spark: SparkSession, folder: str, above: float) -> DataFrame:
    """Pairs of an odd line (prediction) and an even one (truth) of an order that overlap."""
    from ..functions import boxes as B

    rows = inputs.image_boxes(spark, folder)
    truths = pairs.prefixed(rows.where("odd = 0"), "b_")
    out = rows.where("odd = 1").join(truths, F.col("image") == F.col("b_image"))
    out = out.select("image", F.col("index").alias("pred"), F.col("b_index").alias("gt"), "score", B.iou(F.col("box"), F.col("b_box")).alias("iou"))
    return out.where(F.col("iou") > above)


@query()
def nms_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return assign.nms(_flat(spark, folder), ["image"], ["index"]).select("image", "index", "kept", "fate", "rank")


@query()
def greedy_match(spark: SparkSession, folder: str) -> DataFrame:
    out = assign.greedy_matches(_candidates(spark, folder, 0.1), ["image"], "pred", "gt", "score", "iou", 0.3)
    return out.withColumn("iou", F.round("iou", 6)).select("image", "pred", "gt", "iou")


@query()
def iou_sweep(spark: SparkSession, folder: str) -> DataFrame:
    boxes = inputs.image_boxes(spark, folder)
    return evaluate.iou_sweep(_candidates(spark, folder, 0.1), boxes.where("odd = 1"), boxes.where("odd = 0"), ["image"], "pred", "gt", "score")


@query()
def consumed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    out = assign.consumed_pairs(_candidates(spark, folder, 0.1), ["image"], "pred", "gt", "iou")
    return out.select("image", "pred", "gt", F.round("iou", 6).alias("iou"))
