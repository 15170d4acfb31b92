"""Regions of the plane: sets of azimuth intervals out to a radius.

Interval algebra is done once on the driver; membership is a boolean Column of literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Intervals = tuple[tuple[float, float], ...]


def normalised(intervals: list[tuple[float, float]]) -> Intervals:
    """Disjoint sorted intervals within [-pi, pi]; one across the seam is cut in two."""
    cut = []
    for lo, hi in intervals:
        if hi - lo >= 2 * math.pi:
            return ((-math.pi, math.pi),)
        lo, hi = (math.remainder(a, 2 * math.pi) for a in (lo, hi))
        cut += [(lo, hi)] if lo <= hi else [(lo, math.pi), (-math.pi, hi)]
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(cut):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return tuple(out)


def without(intervals: Intervals, removed: Intervals) -> Intervals:
    """What is left of the intervals once others are taken out."""
    for a, b in removed:
        left = []
        for lo, hi in intervals:
            left += [(lo, min(hi, a))] if lo < a else []
            left += [(max(lo, b), hi)] if hi > b else []
        intervals = tuple((lo, hi) for lo, hi in left if hi > lo)
    return intervals


@dataclass(frozen=True)
class Region:
    """Points at a radius over 0 and up to ``radius`` whose azimuth lies in one of the intervals."""

    intervals: Intervals
    radius: float

    def contains(self, x: Column, y: Column) -> Column:
        r, azimuth = F.sqrt(x * x + y * y), F.atan2(y, x)
        known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        inside = reduce(lambda a, b: a | b, [azimuth.between(lo, hi) for lo, hi in self.intervals], F.lit(False))
        return known & (r > 0) & (r <= self.radius) & inside

    @property
    def area(self) -> float:
        return sum(hi - lo for lo, hi in self.intervals) / 2 * self.radius**2

    def density(self, x: Column, y: Column, weight: Column | float = 1.0) -> Column:
        """An aggregate: weight of the agents in the region over its area."""
        weight = weight if isinstance(weight, Column) else F.lit(weight)
        return F.coalesce(F.sum(F.when(self.contains(x, y), weight)), F.lit(0.0)) / F.lit(self.area)
