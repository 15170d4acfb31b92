"""Point filters with row accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small
from .staging import kept


def cumulative_masks(points: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds for each test, in order, a column that holds where it and all before it do; nothing is dropped."""
    out, so_far = points, F.lit(True)
    for name, test in tests.items():
        out = out.withColumn(name, so_far & F.coalesce(test, F.lit(False)))
        so_far = F.col(name)
    return out


def filter_ledger(points: DataFrame, keys: list[str], sector: str, stages: list[str]) -> DataFrame:
    """Rows counted by stage for every key, by sector and (sector null) in total, and how many each stage removed.

    One pass: the grouping sets share the partial aggregates, which are a row a key and sector.
    """
    counts = [F.count(F.lit(1)).alias("n_in"), *(F.count_if(F.col(s)).alias(f"n_{s}") for s in stages)]
    out = points.groupingSets([[*keys, sector], [*keys]], *keys, sector).agg(F.grouping(sector).alias("is_total"), *counts)
    names = ["n_in", *(f"n_{s}" for s in stages)]
    removed = [(F.col(a) - F.col(b)).alias(f"removed_{s}") for a, b, s in zip(names, names[1:], stages)]
    return out.select(*keys, F.when(F.col("is_total") == 0, F.col(sector)).alias(sector), *names, *removed)


def ground_tests(distance: Column, in_range: Column, z: Column, clearance: float = 0.30, highest: float = 4.0) -> dict[str, Column]:
    """Off the ground plane on either side, within range, and not too high."""
    return {"off_ground": F.abs(distance) >= clearance, "in_range": in_range, "in_height": z <= highest}


def thinned(points: DataFrame, keys: list[str], ring: str, order: list[str], stride: int, thinned_rings: Column | None = None) -> DataFrame:
    """Every stride-th point of each ring in file order; rings that ``thinned_rings`` doesn't hold for are kept whole."""
    nth = F.row_number().over(Window.partitionBy(*keys, ring).orderBy(*order))
    keep = (nth - 1) % stride == 0
    if thinned_rings is not None:
        keep = keep | ~thinned_rings
    return points.withColumn("__keep", keep).where("__keep").drop("__keep")


def strided(rows: DataFrame, order: list[str], stride: int, offset: int, keys: list[str] | None = None) -> DataFrame:
    """One in ``stride`` rows from an offset on, in a canonical order, within keys if there are any."""
    if keys:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        numbered = rows.withColumn("__nth", nth)
    else:
        numbered = in_order(rows, order, "__nth")
    return numbered.where((F.col("__nth") - offset) % stride == 0).drop("__nth")


def in_order(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds each row's place, from 0, in the order of all rows: places in ranges of it, and the sizes of the ranges before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = kept(dealt.withColumn("__range", F.shiftright("__id", 33)).withColumn(out, F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"))
    # a row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(small(starts), "__range").withColumn(out, F.col(out) + F.col("__start")).drop("__range", "__start")


def seeded_offset(seed: int, stride: int) -> int:
    """The offset that a seed gives."""
    import numpy as np

    return int(np.random.default_rng(seed).integers(stride))
