"""Inflation of sparse boxes towards class priors, as Column algebra.

A box of few returns shows only part of its object. Each axis grows towards the prior by a share that
falls with the number of returns, within clamps, about the face nearest to the sensor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import small


@dataclass(frozen=True)
class Policy:
    full_points: int = 15
    one_sided: bool = True
    clamp_sigma: float = 0.0
    most_ratio: float = 3.0
    most_growth: float = 3.0
    centred: float = 0.05


def share_missing(n_points: Column, policy: Policy = Policy()) -> Column:
    """1 without returns, 0 from full_points on."""
    return F.greatest(F.lit(0.0), 1 - n_points / F.lit(float(policy.full_points)))


def target(measured: Column, mu: Column, sigma: Column, alpha: Column, policy: Policy, ceiling: Column | None = None) -> Column:
    """An axis's new extent: towards mu, then at most mu plus deviations, a ratio, a length, and the ceiling; never less than measured."""
    goal = measured + (mu - measured) * alpha
    goal = F.when(measured >= mu, measured).otherwise(goal) if policy.one_sided else goal
    goal = F.least(goal, F.greatest(mu + sigma * policy.clamp_sigma, measured))
    goal = F.least(goal, measured * policy.most_ratio)
    goal = F.least(goal, measured + policy.most_growth)
    goal = F.least(goal, ceiling) if ceiling is not None else goal
    return F.greatest(goal, measured)


def inflated(boxes: DataFrame, priors: DataFrame, category: str = "category", policy: Policy = Policy()) -> DataFrame:
    """Adds new_w, new_l, new_h, new_x, new_y, new_z, outcome and fraction (the share of the new volume that was grown).

    Boxes have x, y, z, yaw, w, l, h, n_points and the sensor's sensor_x, sensor_y in the same frame; priors a
    row (category, mu_w, mu_l, mu_h, sigma_w, sigma_l, sigma_h) for each class, bounded by a taxonomy and
    broadcast if their count says so. Outcomes: enough_points, no_prior, sensor_inside, would_enclose_sensor, unchanged, inflated;
    a box that isn't inflated keeps its values.
    """
    p = priors.select(F.col(category).alias("__class"), "mu_w", "mu_l", "mu_h", "sigma_w", "sigma_l", "sigma_h")
    out = boxes.join(small(p), F.col(category) == F.col("__class"), "left")
    c = F.col
    # the prior's axes are its short and its long one
    swapped = c("mu_w") > c("mu_l")
    short, long = F.least("mu_w", "mu_l"), F.greatest("mu_w", "mu_l")
    short_sigma, long_sigma = F.when(swapped, c("sigma_l")).otherwise(c("sigma_w")), F.when(swapped, c("sigma_w")).otherwise(c("sigma_l"))
    alpha = share_missing(c("n_points"), policy)
    new_l = target(c("l"), long, long_sigma, alpha, policy)
    out = out.withColumn("__l", new_l)
    out = out.withColumn("__w", target(c("w"), short, short_sigma, alpha, policy, ceiling=c("__l"))).withColumn("__h", target(c("h"), c("mu_h"), c("sigma_h"), alpha, policy))
    # the sensor in the box's frame
    dx, dy = c("sensor_x") - c("x"), c("sensor_y") - c("y")
    out = out.withColumn("__along", dx * F.cos("yaw") + dy * F.sin("yaw")).withColumn("__across", dy * F.cos("yaw") - dx * F.sin("yaw"))
    near = lambda off: F.when(F.abs(off) <= policy.centred, 0.0).when(off > 0, 1.0).otherwise(-1.0)
    # the near face stays, so the centre moves away from the sensor by half the growth
    out = out.withColumn("__da", -near(c("__along")) * (c("__l") - c("l")) / 2).withColumn("__dc", -near(c("__across")) * (c("__w") - c("w")) / 2)
    holds = lambda a, l, b, w: (F.abs(a) <= l / 2) & (F.abs(b) <= w / 2)
    inside = holds(c("__along"), c("l"), c("__across"), c("w"))
    encloses = holds(c("__along") - c("__da"), c("__l"), c("__across") - c("__dc"), c("__w"))
    changed = (c("__l") > c("l")) | (c("__w") > c("w")) | (c("__h") > c("h"))
    outcome = (
        F.when(c("n_points") >= policy.full_points, "enough_points")
        .when(c("__class").isNull(), "no_prior")
        .when(inside, "sensor_inside")
        .when(encloses, "would_enclose_sensor")
        .when(changed, "inflated")
        .otherwise("unchanged")
    )
    out = out.withColumn("outcome", outcome)
    grown = c("outcome") == "inflated"
    pick = lambda new, old: F.when(grown, new).otherwise(old)
    out = out.withColumn("new_w", pick(c("__w"), c("w"))).withColumn("new_l", pick(c("__l"), c("l"))).withColumn("new_h", pick(c("__h"), c("h")))
    out = out.withColumn("new_x", pick(c("x") + c("__da") * F.cos("yaw") - c("__dc") * F.sin("yaw"), c("x")))
    out = out.withColumn("new_y", pick(c("y") + c("__da") * F.sin("yaw") + c("__dc") * F.cos("yaw"), c("y")))
    # the top stays: growth in height goes down
    out = out.withColumn("new_z", pick(c("z") - (c("__h") - c("h")) / 2, c("z")))
    volume = c("new_w") * c("new_l") * c("new_h")
    out = out.withColumn("fraction", F.when(volume > 0, 1 - c("w") * c("l") * c("h") / F.when(volume > 0, volume)).otherwise(0.0))
    keep = [*boxes.columns, "new_w", "new_l", "new_h", "new_x", "new_y", "new_z", "outcome", "fraction"]
    return out.select(*keep)
