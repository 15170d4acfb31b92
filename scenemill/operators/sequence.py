"""Windows over ordered rows: links, velocities, gap filling, as-of interpolation and sweep windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def linked(rows: DataFrame, chain: list[str], order: list[str], token: str = "token") -> DataFrame:
    """Adds prev and next tokens, and the chain's first and last token and length."""
    w = Window.partitionBy(*chain).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = F.col(token)
    return rows.select(
        "*", F.lag(t).over(w).alias("prev"), F.lead(t).over(w).alias("next"), F.first(t).over(whole).alias("first_token"), F.last(t).over(whole).alias("last_token"), F.count(F.lit(1)).over(whole).alias("n_in_chain")
    )


def chain_velocity(rows: DataFrame, chain: list[str], t_seconds: str, positions: list[str], longest: float = 1.5, order: list[str] | None = None) -> DataFrame:
    """Adds v_<position>: the slope between a row's neighbours, of itself and one neighbour at the ends.

    Null for chains of one row, for neighbours at one time, and where the neighbours are more than
    ``longest`` seconds apart (twice that for two).
    """
    w = Window.partitionBy(*chain).orderBy(*(order or [t_seconds]))
    ahead, behind = F.lead(t_seconds).over(w), F.lag(t_seconds).over(w)
    dt = F.coalesce(ahead, F.col(t_seconds)) - F.coalesce(behind, F.col(t_seconds))
    most = F.when(ahead.isNotNull() & behind.isNotNull(), 2 * longest).otherwise(longest)
    out = rows.withColumn("__dt", dt).withColumn("__ok", (dt > 0) & (dt <= most))
    for p in positions:
        step = F.coalesce(F.lead(p).over(w), F.col(p)) - F.coalesce(F.lag(p).over(w), F.col(p))
        out = out.withColumn(f"v_{p}", F.when(F.col("__ok"), step / F.when(F.col("__ok"), F.col("__dt"))))
    return out.drop("__dt", "__ok")


# States of motion by kind of category, and the only attribute names there are.
ATTRIBUTE_STATES = {"vehicle": ("vehicle.moving", "vehicle.stopped"), "pedestrian": ("pedestrian.moving", "pedestrian.standing")}
WITH_RIDER = "cycle.with_rider"
ATTRIBUTES = (
    "vehicle.moving", "vehicle.stopped", "vehicle.parked", "cycle.with_rider", "cycle.without_rider", "pedestrian.moving", "pedestrian.standing", "pedestrian.sitting_lying_down",
)


def attribute_of(kind: Column, speed: Column, human: Column | None = None, least: float = 0.5) -> Column:
    """The attribute of a row: a human's if there is one (it must be known), else by speed; cycles have riders."""
    by_speed = F.when(kind == "cycle", WITH_RIDER)
    for name, (moving, still) in ATTRIBUTE_STATES.items():
        by_speed = by_speed.when(kind == name, F.when(speed > least, moving).when(speed <= least, still))
    if human is None:
        return by_speed
    unknown = F.raise_error(F.concat(F.lit("unknown attribute "), human)).cast("string")
    return F.when(human.isNull(), by_speed).when(human.isin(*ATTRIBUTES), human).otherwise(unknown)


def gap_filled(rows: DataFrame, chain: list[str], step: str, values: list[str], most_missing: int, order: list[str] | None = None) -> DataFrame:
    """Adds a row, linear between its neighbours, for every step that a chain skips, up to so many in a row.

    The result has the chain, step, values and ``interpolated``.
    """
    w = Window.partitionBy(*chain).orderBy(*(order or [step]))
    ahead = rows.select(*chain, step, *values, F.lead(step).over(w).alias("__to"), *(F.lead(v).over(w).alias(f"__{v}") for v in values))
    gap = ahead.where((F.col("__to") - F.col(step) > 1) & (F.col("__to") - F.col(step) <= most_missing + 1))
    filled = gap.withColumn("__at", F.explode(F.sequence(F.col(step) + 1, F.col("__to") - 1)))
    share = (F.col("__at") - F.col(step)) / (F.col("__to") - F.col(step))
    filled = filled.select(*chain, F.col("__at").alias(step), *((F.col(v) + (F.col(f"__{v}") - F.col(v)) * share).alias(v) for v in values), F.lit(True).alias("interpolated"))
    return rows.select(*chain, step, *values, F.lit(False).alias("interpolated")).unionByName(filled)


def as_of_segments(queries: DataFrame, poses: DataFrame, keys: list[str], t: str, payload: list[str]) -> DataFrame:
    """Each query row with its key's segment around its time: t0, t1, payload_0, payload_1.

    One pass over the union of both in order of time: the segment is the last pose at or before the row
    and the first one after it, carried along by windows, so no pair of a query and another pose is made.
    Before the first pose and after the last, the outermost segment serves, and interpolation extrapolates.
    """
    pose = F.struct(F.col(t), *payload)
    both = poses.select(*keys, t, F.lit(0).alias("__kind"), pose.alias("__pose"), F.lit(None).cast(queries.select(F.struct("*")).schema[0].dataType).alias("__row"))
    asks = queries.select(*keys, t, F.lit(1).alias("__kind"), F.lit(None).cast(poses.select(pose).schema[0].dataType).alias("__pose"), F.struct("*").alias("__row"))
    w = Window.partitionBy(*keys).orderBy(t, "__kind")
    # every pose knows its neighbours on both sides
    only = Window.partitionBy(*keys, "__kind").orderBy(t)
    every = both.unionByName(asks)
    every = every.withColumn("__next", F.when(F.col("__kind") == 0, F.lead("__pose").over(only))).withColumn("__prev", F.when(F.col("__kind") == 0, F.lag("__pose").over(only)))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.struct("__prev", "__pose", "__next")
    every = every.withColumn("__last", F.last(F.when(F.col("__kind") == 0, here), ignorenulls=True).over(back)).withColumn("__first", F.first(F.when(F.col("__kind") == 0, here), ignorenulls=True).over(on))
    found = every.where("__kind = 1")
    a = F.when(F.col("__last").isNull(), F.col("__first.__pose")).when(F.col("__last.__next").isNull(), F.col("__last.__prev")).otherwise(F.col("__last.__pose"))
    b = F.when(F.col("__last").isNull(), F.col("__first.__next")).when(F.col("__last.__next").isNull(), F.col("__last.__pose")).otherwise(F.col("__last.__next"))
    found = found.withColumn("__a", a).withColumn("__b", b)
    return found.select("__row.*", F.col("__a")[t].alias("t0"), F.col("__b")[t].alias("t1"), *(F.col("__a")[p].alias(f"{p}_0") for p in payload), *(F.col("__b")[p].alias(f"{p}_1") for p in payload))


def interpolated_pose(t: Column, t0: Column, t1: Column, pose0: Column, pose1: Column, straight_above: float = 0.9995) -> Column:
    """The pose (t, q) at a time on a segment."""
    share = (t - t0) / (t1 - t0)
    moved = G.Vec(*(G.lerp(pose0["t"][c], pose1["t"][c], share) for c in "xyz"))
    return G.Pose(moved, G.slerp(pose0["q"], pose1["q"], share, straight_above)).struct


def swept(rows: DataFrame, keys: list[str], t: str, window: int) -> DataFrame:
    """Adds n_window, the rows of the key within ``window`` units back, and gap, the time since the row before."""
    over = Window.partitionBy(*keys).orderBy(t)
    return rows.withColumn("n_window", F.count(F.lit(1)).over(over.rangeBetween(-window, 0))).withColumn("gap", F.col(t) - F.lag(t).over(over))


def chain_faults(rows: DataFrame, chain: list[str], order: str, token: str = "token", prev: str = "prev", nxt: str = "next") -> DataFrame:
    """One row a chain: heads, tails, links that the neighbour in time doesn't answer, and times that don't increase."""
    w = Window.partitionBy(*chain).orderBy(order, token)
    out = rows.withColumn("__p", F.lag(token).over(w)).withColumn("__n", F.lead(token).over(w)).withColumn("__t", F.lag(order).over(w))
    return out.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(prev).isNull()).alias("heads"),
        F.count_if(F.col(nxt).isNull()).alias("tails"),
        F.count_if(~F.col(prev).eqNullSafe(F.col("__p")) | ~F.col(nxt).eqNullSafe(F.col("__n"))).alias("broken_links"),
        F.count_if(F.col(order) <= F.col("__t")).alias("not_increasing"),
    )


def keyframe_windows(frames: DataFrame, scene: list[str], order: str, is_key: str, most: int = 16) -> DataFrame:
    """The frames between neighbouring keyframes, both included, thinned to ``most`` with the ends kept.

    Adds window (number of the keyframe it starts at), place (its frame's place in the window) and slot. A
    keyframe ends one window and starts the next. The k-th of m frames kept of n is number (k(n-1)/(m-1)), halves up.
    """
    w = Window.partitionBy(*scene).orderBy(order)
    n = F.sum(F.col(is_key).cast("int")).over(w)
    out = frames.withColumn("window", n - 1)
    ends = out.where(F.col(is_key)).withColumn("window", F.col("window") - 1).where("window >= 0")
    out = out.where("window >= 0").unionByName(ends)
    each = Window.partitionBy(*scene, "window")
    out = out.withColumn("place", F.row_number().over(each.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(each)).withColumn("__keys", F.count_if(F.col(is_key)).over(each))
    out = out.where("__keys = 2")
    slots = F.least(F.col("__n"), F.lit(most))
    wanted = F.transform(F.sequence(F.lit(0), slots - 1), lambda k: F.floor(k * (F.col("__n") - 1) / F.greatest(slots - 1, F.lit(1)) + 0.5))
    out = out.withColumn("slot", F.array_position(wanted, F.col("place").cast("long")) - 1)
    return out.where("slot >= 0").drop("__n", "__keys")


def late_corrected(rows: DataFrame, t: str, true_t: str, tolerance: int) -> DataFrame:
    """Times further than the tolerance from the true one are replaced by it, and marked ``corrected``."""
    off = F.abs(F.col(t) - F.col(true_t)) > tolerance
    return rows.withColumn("corrected", F.coalesce(off, F.lit(False))).withColumn(t, F.when(F.col("corrected"), F.col(true_t)).otherwise(F.col(t)))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate with a partial step, so a hot key costs a row a task."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return out.select(*keys, "__last.*")
