"""The quality gate: returns, prior footprint and confidence decide a detection's tier; and class priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .joins import small
from .quantiles import matched

LEAST_POINTS = 5
FOOTPRINT_FACTOR = 2.0
LEAST_CONFIDENCE = 0.5


def returns_gate(n_points: Column, basis: Column | None = None, expected_basis: str | None = None, least: int = LEAST_POINTS) -> Column:
    """Whether a box holds enough returns; counts of another basis raise."""
    ok = n_points >= least
    if basis is None:
        return ok
    wrong = F.raise_error(F.concat(F.lit("returns counted on another basis: "), basis)).cast("boolean")
    return F.when(basis == expected_basis, ok).otherwise(wrong)


def spatial_gate(w: Column, l: Column, prior_w: Column, prior_l: Column, factor: float = FOOTPRINT_FACTOR) -> Column:  # noqa: E741
    """Whether the footprint, long and short side each, stays within a multiple of the prior's; null without a prior."""
    fits = (F.least(w, l) <= F.least(prior_w, prior_l) * factor) & (F.greatest(w, l) <= F.greatest(prior_w, prior_l) * factor)
    return F.when(prior_w.isNotNull() & prior_l.isNotNull(), fits)


def tier_of(returns_ok: Column, spatial_ok: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """rejected, flagged or auto_accept; an unknown footprint flags."""
    return F.when(~returns_ok | ~F.coalesce(spatial_ok, F.lit(True)), "rejected").when((confidence < least) | spatial_ok.isNull(), "flagged").otherwise("auto_accept")


def gated(rows: DataFrame, priors: DataFrame, category: str = "category") -> DataFrame:
    """Adds returns_ok, spatial_ok and tier to rows with n_points, w, l and confidence.

    ``priors`` has a row (category, mu_w, mu_l) for each class, which a taxonomy bounds; it is broadcast if its count says so.
    """
    known = priors.select(F.col(category).alias("__class"), "mu_w", "mu_l")
    out = rows.join(small(known), F.col(category) == F.col("__class"), "left")
    out = out.withColumn("returns_ok", returns_gate(F.col("n_points"))).withColumn("spatial_ok", spatial_gate(F.col("w"), F.col("l"), F.col("mu_w"), F.col("mu_l")))
    return out.withColumn("tier", tier_of(F.col("returns_ok"), F.col("spatial_ok"), F.col("confidence"))).drop("__class", "mu_w", "mu_l")


def class_priors(rows: DataFrame, category: str, value: str, percentiles: tuple[float, ...] = (0.05, 0.5, 0.95), least: int = 2) -> DataFrame:
    """n, mean, sample deviation, exact percentiles and maximum by class; classes of too few rows are left out."""
    names = [f"p{round(p * 100):02d}" for p in percentiles]
    out = rows.groupBy(category).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"), F.max(value).alias("most"))
    out = matched(out.where(F.col("n") >= least), quantiles.percentiles(rows, [category], value, percentiles), [category], "left")
    return out.select(category, "n", "mu", "sigma", *(F.col("percentiles")[i].alias(n) for i, n in enumerate(names)), "most")


def prior_gaps(priors: DataFrame, wanted: DataFrame, category: str) -> DataFrame:
    """The wanted classes that have no prior."""
    return wanted.select(category).distinct().join(priors.select(category), category, "left_anti")
