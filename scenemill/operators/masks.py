"""Masks as runs of pixels: growing, outlines, and how well a projected box covers one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import Columns, solved


def grown(runs: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Runs (row, col_lo, col_hi) of masks grown by a square of so many pixels to every side, merged row by row."""
    rows = runs.select(*keys, F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("row"), F.greatest(F.col("col_lo") - radius, F.lit(0)).alias("col_lo"), F.least(F.col("col_hi") + radius, F.lit(width - 1)).alias("col_hi"))
    rows = rows.where(F.col("row").between(0, height - 1))
    order = Window.partitionBy(*keys, "row").orderBy("col_lo", "col_hi")
    before = F.max("col_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.withColumn("new", F.when(before.isNull() | (F.col("col_lo") > before + 1), 1).otherwise(0))
    numbered = starts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "part").agg(F.min("col_lo").alias("col_lo"), F.max("col_hi").alias("col_hi")).drop("part")


def carved(runs: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs without the pixels of other runs of the same keys: what is left of each run, by the gaps between the holes in it."""
    h = holes.select(*(F.col(k).alias(f"h_{k}") for k in keys), F.col("row").alias("h_row"), F.col("col_lo").alias("h_lo"), F.col("col_hi").alias("h_hi"))
    on = (runs["row"] == h["h_row"]) & (h["h_lo"] <= runs["col_hi"]) & (h["h_hi"] >= runs["col_lo"])
    for k in keys:
        on = on & (runs[k] == h[f"h_{k}"])
    met = runs.join(h, on, "left").groupBy(*keys, "row", "col_lo", "col_hi").agg(F.sort_array(F.collect_list(F.when(F.col("h_lo").isNotNull(), F.struct("h_lo", "h_hi")))).alias("cut"))
    # from the end of each hole, or the run's start, to the next hole
    starts = F.concat(F.array("col_lo"), F.transform("cut", lambda c: c["h_hi"] + 1))
    ends = F.concat(F.transform("cut", lambda c: c["h_lo"] - 1), F.array("col_hi"))
    gaps = F.filter(F.arrays_zip(starts.alias("lo"), ends.alias("hi")), lambda g: g["lo"] <= g["hi"])
    return met.select(*keys, "row", F.explode(gaps).alias("g")).select(*keys, "row", F.col("g.lo").alias("col_lo"), F.col("g.hi").alias("col_hi"))


def outlines(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """The closed outlines of a mask along the edges of its pixels, outer ones clockwise on the screen, corners only."""
    pixels = {(int(r), c) for r, a, b in zip(row, lo, hi) for c in range(int(a), int(b) + 1)}
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in sorted(pixels):
        for off, a, b in (((-1, 0), (c, r), (c + 1, r)), ((0, 1), (c + 1, r), (c + 1, r + 1)), ((1, 0), (c + 1, r + 1), (c, r + 1)), ((0, -1), (c, r + 1), (c, r))):
            if (r + off[0], c + off[1]) not in pixels:
                ahead.setdefault(a, []).append(b)
    found = []
    while ahead:
        at = start = min(ahead)
        path, way = [], None
        while True:
            nexts = ahead[at]
            # where two pixels touch at a corner, the sharper turn stays with its own pixel
            if len(nexts) > 1 and way is not None:
                nexts.sort(key=lambda n: way[0] * (n[1] - at[1]) - way[1] * (n[0] - at[0]))
            to = nexts.pop()
            if not nexts:
                del ahead[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != way:
                path.append(at)
            at, way = to, step
            if at == start:
                break
        if len(path) > 1 and (path[1][0] - path[0][0] == 0) == (way[0] == 0):
            path = path[1:]  # the start lies on a straight edge
        found.append(np.array(path, float))
    return found


def polygon_area(p: np.ndarray) -> float:
    """Signed area; positive for an outer outline."""
    x, y = p.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline without corners that lie within a tolerance of the lines between those that stay.

    Douglas and Peucker's method on the two halves between the first corner and the one farthest from it.
    """
    if tolerance <= 0 or len(p) < 4:
        return p
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    closed = np.concatenate([p, p[:1]])
    stays = np.zeros(len(closed), bool)
    stays[[0, far, -1]] = True
    spans = [(0, far), (far, len(p))]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        base, between = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        share = np.clip(between @ base / max(base @ base, 1e-300), 0, 1)
        away = np.sqrt(((between - share[:, None] * base) ** 2).sum(axis=1))
        k = int(away.argmax())
        if away[k] > tolerance:
            stays[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[stays[:-1]]


def polygons(runs: DataFrame, keys: list[str], least_area: float = 20.0, tolerance: float = 0.0) -> DataFrame:
    """keys, polygon (x1, y1, x2, ...) and area of the outer outlines of every mask that are large enough.

    Outlines follow the edges of pixels; with a tolerance they are simplified() after their area is taken, and left out
    where fewer than three corners stay.
    """
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", polygon array<double>, area double"

    def solve(g: Columns) -> Columns:
        large = [(p, a) for p in outlines(g["row"], g["col_lo"], g["col_hi"]) if (a := polygon_area(p)) >= least_area]
        kept = [(q, a) for p, a in large if len(q := simplified(p, tolerance)) > 2]
        return {**{k: np.repeat(g[k][:1], len(kept)) for k in keys}, "polygon": np.array([*(p.ravel() for p, _ in kept), None], object)[:-1], "area": np.array([a for _, a in kept])}

    return solved(runs.select(*keys, "row", "col_lo", "col_hi"), keys, ["row", "col_lo"], solve, schema)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hull_rows(corners: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the pixels whose centres lie in the hull of whole-pixel corners, edges included."""
    h = hull(np.round(corners))
    if len(h) < 3:
        return (np.empty(0, int),) * 3
    rows = np.arange(max(0, int(h[:, 1].min())), min(height - 1, int(h[:, 1].max())) + 1)
    lo, hi = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    for (x0, y0), (x1, y1) in zip(h, np.roll(h, -1, axis=0)):
        on = (rows >= min(y0, y1)) & (rows <= max(y0, y1))
        x = np.array([x0, x1]) if y0 == y1 else x0 + (rows[on] - y0) * (x1 - x0) / (y1 - y0)
        lo[on] = np.minimum(lo[on], x.min() if y0 == y1 else x)
        hi[on] = np.maximum(hi[on], x.max() if y0 == y1 else x)
    lo, hi = np.maximum(np.ceil(lo - 1e-9), 0).astype(int), np.minimum(np.floor(hi + 1e-9), width - 1).astype(int)
    ok = lo <= hi
    return rows[ok], lo[ok], hi[ok]


def hull_iou(corners: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, height: int) -> tuple[float | None, float | None]:
    """IoU of the corners' hull with a mask's runs, and how far the mask's lowest row lies below the lowest corner.

    None of fewer than three corners: then there is no hull to compare.
    """
    if len(corners) < 3:
        return None, None
    hr, hl, hh = hull_rows(corners, width, height)
    size, mask = int((hh - hl + 1).sum()), int((hi - lo + 1).sum())
    at = {int(r): k for k, r in enumerate(hr)}
    common = 0
    for r, a, b in zip(row, lo, hi):
        k = at.get(int(r))
        if k is not None:
            common += max(0, min(int(b), int(hh[k])) - max(int(a), int(hl[k])) + 1)
    union = size + mask - common
    return (common / union if union else 0.0), (float(row.max() - corners[:, 1].max()) if len(row) else None)


def without_higher(runs: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Runs of pixels of several masks of one image, each pixel left to the mask of the least priority."""
    w = Window.partitionBy(*keys, "row", "col").orderBy("priority", "mask")
    pixels = runs.withColumn("priority", priority).withColumn("col", F.explode(F.sequence("col_lo", "col_hi")))
    return pixels.withColumn("place", F.row_number().over(w)).where("place = 1").select(*keys, "mask", "row", "col")
