"""Joins of boxes within an image: overlap, containment, and the arbitration between two arms of detectors.

Every join carries the image's key as an equality; no pair crosses images.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k] == b[f"b_{k}"] for k in keys])


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(prefix + c) for c in rows.columns))


def overlapping(rows: DataFrame, keys: list[str], order: list[str], box: str = "box", above: float = 0.0) -> DataFrame:
    """Pairs (a, then b with the prefix b_, in the order) of one image whose IoU is over a threshold, with the IoU."""
    other = prefixed(rows, "b_")
    earlier = F.struct(*order) < F.struct(*(f"b_{c}" for c in order))
    out = rows.join(other, _same(rows, other, keys) & earlier).withColumn("iou", B.iou(F.col(box), F.col(f"b_{box}")))
    return out.where(F.col("iou") > above)


def grid_pairs(left: DataFrame, right: DataFrame, x: str, y: str, reach: float, keys: list[str]) -> DataFrame:
    """Pairs of points within ``reach``: each left point looks into the 3 x 3 cells about its own, so the join is by equality."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = left.withColumn("__at", around).withColumn("__i", cell(x) + F.col("__at.i")).withColumn("__j", cell(y) + F.col("__at.j")).drop("__at")
    b = prefixed(right, "b_").withColumn("b___i", cell(f"b_{x}")).withColumn("b___j", cell(f"b_{y}"))
    on = _same(a, b, [*keys, "__i", "__j"])
    dx, dy = F.col(x) - F.col(f"b_{x}"), F.col(y) - F.col(f"b_{y}")
    return a.join(b, on).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= reach).drop("__i", "__j", "b___i", "b___j")


#: Fixed values of the two-arm contest: what becomes of an arm-A box of a class that overlaps an arm-B box.
ARBITRATION = {
    "car": "suppressed",
    "truck": "suppressed",
    "bus": "suppressed",
    "motorcycle": "suppressed",
    "bicycle": "suppressed",
    "pedestrian": "both_kept",
}
#: Share of an A box of a class within a B box from which it is a part of it.
PART_FLOORS = {"bicycle": 0.6, "motorcycle": 0.6}


def arbitrated(
    arm_a: DataFrame,
    arm_b: DataFrame,
    keys: list[str],
    threshold: float = 0.5,
    table: dict[str, str] = ARBITRATION,
    part_floors: dict[str, float] = PART_FLOORS,
    protected: dict[str, float] | None = None,
) -> DataFrame:
    """The merged rows of both arms and what became of each: keys, arm, index, name, box, outcome, partner, overlap.

    ``arm_a`` and ``arm_b`` have index (within the image), name, score and box. A boxes of a ``protected``
    class that score at least its floor veto B boxes that overlap them. Every other A box meets the live B box it overlaps most (the least index among
    equals); over the threshold the table decides. A boxes of part classes not yet suppressed are absorbed
    by the B box that contains most of them. Outcomes: kept, vetoed, suppressed, absorbed, both_kept (a
    kept pair the table allows) and untabled (kept, for want of an entry). Nothing depends on the order
    of boxes but ties, so each step is a join and a best-of aggregate.
    """
    guard = F.lit(False)
    for name, floor in (protected or {}).items():
        guard = guard | ((F.col("name") == name) & (F.col("score") >= floor))
    a = arm_a.select(*keys, "index", "name", "box", guard.alias("guarded"))
    b = prefixed(arm_b.select(*keys, "index", "name", "box"), "b_")

    def best(pairs: DataFrame, by: list[str], score: str, other: str) -> DataFrame:
        return pairs.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(other)).alias("first"))).alias("m")).select(*by, (-F.col("m.first")).cast("int").alias("partner"), F.col(f"m.{score}").alias("overlap"))

    pairs = a.join(b, _same(a, b, keys)).withColumn("iou", B.iou(F.col("box"), F.col("b_box"))).withColumn("inside", B.containment(F.col("box"), F.col("b_box")))
    b_keys = [f"b_{k}" for k in keys]
    if protected:
        veto = best(pairs.where(F.col("guarded") & (F.col("iou") > threshold)), [*b_keys, "b_index"], "iou", "index")
    else:
        veto = b.limit(0).select(*b_keys, "b_index", F.lit(None).cast("int").alias("partner"), F.lit(None).cast("double").alias("overlap"))
    live = pairs.join(veto.select(*b_keys, "b_index"), [*b_keys, "b_index"], "left_anti") if protected else pairs
    open_a = live.where(~F.col("guarded"))
    met = best(open_a, [*keys, "index", "name"], "iou", "b_index").where(F.col("overlap") > threshold)
    outcome = F.lit("untabled")
    for name, what in table.items():
        outcome = F.when(F.col("name") == name, what).otherwise(outcome)
    met = met.withColumn("outcome", outcome).drop("name")
    floor = F.coalesce(*(F.when(F.col("name") == n, F.lit(f)) for n, f in part_floors.items()))
    parts = best(open_a.where(floor.isNotNull()), [*keys, "index", "name"], "inside", "b_index")
    parts = parts.where(F.col("overlap") >= floor).select(*keys, "index", F.col("partner").alias("whole"), F.col("overlap").alias("covered"))
    out_a = a.join(met, [*keys, "index"], "left").join(parts, [*keys, "index"], "left")
    absorbed = F.col("whole").isNotNull() & (F.coalesce(F.col("outcome"), F.lit("")) != "suppressed")
    out_a = out_a.select(
        *keys,
        F.lit("a").alias("arm"),
        "index",
        "name",
        "box",
        F.when(absorbed, "absorbed").otherwise(F.coalesce("outcome", F.lit("kept"))).alias("outcome"),
        F.when(absorbed, F.col("whole")).otherwise(F.col("partner")).alias("partner"),
        F.when(absorbed, F.col("covered")).otherwise(F.col("overlap")).alias("overlap"),
    )
    out_b = b.join(veto, [*b_keys, "b_index"], "left")
    out_b = out_b.select(
        *(F.col(f"b_{k}").alias(k) for k in keys),
        F.lit("b").alias("arm"),
        F.col("b_index").alias("index"),
        F.col("b_name").alias("name"),
        F.col("b_box").alias("box"),
        F.when(F.col("partner").isNotNull(), "vetoed").otherwise("kept").alias("outcome"),
        "partner",
        "overlap",
    )
    return out_a.unionByName(out_b)


def renumbered(merged: DataFrame, keys: list[str]) -> DataFrame:
    """What arbitration keeps, A before B, with the index in the merged image."""
    kept = merged.where(~F.col("outcome").isin("suppressed", "absorbed", "vetoed"))
    order = Window.partitionBy(*keys).orderBy("arm", "index")
    return kept.withColumn("merged_index", F.row_number().over(order) - 1)


def best_by_point(rows: DataFrame, point: list[str], score: str, priority: str) -> DataFrame:
    """Each point's row of the highest score; among equals that of the least priority number.

    A best-of aggregate, so each task hands on one row a point.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(score), -F.col(priority)))
    return rows.groupBy(*point).agg(best.alias("__best")).select("__best.*")


def first_claims(rows: DataFrame, pixel: list[str], rule: str = "smallest_mask") -> DataFrame:
    """Of the masks that hold a pixel's point, the first by size (or by score), then score, then index."""
    order = {"smallest_mask": [F.col("n_mask_px").asc(), F.col("score").desc()], "highest_score": [F.col("score").desc(), F.col("n_mask_px").asc()]}[rule]
    w = Window.partitionBy(*pixel).orderBy(*order, F.col("proposal_index").asc())
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def masked_points(points: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Points (row, col) joined to the masks, given as runs (row, col_lo, col_hi) of an image, that hold them."""
    r = prefixed(runs, "b_")
    on = _same(points, r, keys) & (points["row"] == r["b_row"]) & points["col"].between(r["b_col_lo"], r["b_col_hi"])
    return points.join(r, on).drop(*(f"b_{k}" for k in [*keys, "row", "col_lo", "col_hi"]))


def first_copies(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
