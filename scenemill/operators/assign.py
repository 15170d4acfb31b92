"""Order-dependent assignment and suppression: folds over one group's array, or numpy where a matrix is needed.

A group is an image, a keyframe or a scene, so it has a bound of its own; groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import least_connected
from .groups import Columns, solved


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment of least total cost, by shortest augmenting paths."""
    n, m = cost.shape
    if not n or not m:
        return np.empty(0, int), np.empty(0, int)
    if n > m:
        columns, rows = assignment(cost.T)
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order]
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        far, best, before, done = np.full(m, np.inf), -1, np.full(m, -1), np.zeros(m, bool)
        at, lowest = i, 0.0
        visited = []
        while True:
            reach = lowest + cost[at] - u[at] - v
            nearer = ~done & (reach < far)
            far[nearer] = reach[nearer]
            before[nearer] = best
            open_far = np.where(done, np.inf, far)
            best = int(open_far.argmin())
            lowest = open_far[best]
            done[best] = True
            visited.append(best)
            if row_of[best] < 0:
                break
            at = row_of[best]
        u[i] += lowest
        for j in visited[:-1]:
            u[row_of[j]] += lowest - far[j]
            v[j] -= lowest - far[j]
        j = best
        while j >= 0:
            k = before[j]
            row_of[j] = i if k < 0 else row_of[k]
            j = k
    columns = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[columns], kind="stable")
    return row_of[columns][order], columns[order]


def chosen_pairs(left: np.ndarray, right: np.ndarray, cost: np.ndarray, refused: float) -> np.ndarray:
    """Positions of the candidate pairs that the cheapest assignment takes; a pair that is no candidate costs ``refused``.

    Candidates fall into tangles that share no end. Each is assigned apart, and a candidate alone is taken, so
    a matrix is as large as one tangle.
    """
    if not len(left):
        return np.empty(0, int)
    lefts, i = np.unique(left, return_inverse=True)
    j = np.unique(right, return_inverse=True)[1]
    tangle, size = np.unique(least_connected(len(lefts) + j.max() + 1, i, len(lefts) + j)[i], return_inverse=True, return_counts=True)[1:]
    order = np.argsort(tangle, kind="stable")
    taken = [order[size[tangle[order]] == 1]]
    order = order[size[tangle[order]] > 1]
    for mine in np.split(order, np.flatnonzero(np.diff(tangle[order])) + 1):
        rows, a = np.unique(i[mine], return_inverse=True)
        columns, b = np.unique(j[mine], return_inverse=True)
        matrix, number = np.full((len(rows), len(columns)), refused), np.full((len(rows), len(columns)), -1)
        matrix[a, b], number[a, b] = cost[mine], mine
        found = number[assignment(matrix)]
        taken.append(found[found >= 0])
    return np.sort(np.concatenate(taken))


def matched(score: np.ndarray, allowed: np.ndarray, refused: float = 1e6) -> list[tuple[int, int]]:
    """Pairs of the assignment of most total score among the allowed ones."""
    i, j = np.nonzero(allowed)
    k = chosen_pairs(i, j, -score[i, j], refused)
    return [(int(a), int(b)) for a, b in zip(i[k], j[k])]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes (x1, y1, x2, y2), all against all; 0 where the union is empty."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    common = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None] - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def suppressed(boxes: np.ndarray, scores: np.ndarray, names: np.ndarray, same: float = 0.65, cross: float = 0.90) -> tuple[np.ndarray, np.ndarray]:
    """Order of the boxes and, by box, the one that suppresses it (-1: kept).

    In order of score, then of box and name, a kept box suppresses every later one that overlaps it by more
    than ``same`` if the names are equal, by more than ``cross`` if not.
    """
    order = np.lexsort((names.astype(str), boxes[:, 3], boxes[:, 2], boxes[:, 1], boxes[:, 0], -scores)) if len(boxes) else np.empty(0, int)
    by, overlap = np.full(len(boxes), -1), iou_matrix(boxes, boxes) if len(boxes) else np.empty((0, 0))
    limit = np.where(names[:, None] == names[None], same, cross)
    for k, i in enumerate(order):
        if by[i] < 0:
            rest = order[k + 1 :]
            hit = rest[(by[rest] < 0) & (overlap[i, rest] > limit[i, rest])]
            by[hit] = i
    return order, by


def grouped(rows: DataFrame, keys: list[str], columns: dict[str, T.DataType], solve: Callable[[pd.DataFrame], dict[str, np.ndarray]], order: list[str]) -> DataFrame:
    """Adds columns that ``solve`` gives for the rows of each group, which come in the order."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in columns.items())])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**solve(pdf))[schema.names]

    return rows.groupBy(*keys).applyInPandas(apply, schema)


def nms(rows: DataFrame, keys: list[str], order: list[str], same: float = 0.65, cross: float = 0.90, most: int = 300) -> DataFrame:
    """Adds ``fate`` (kept, same_class, cross_class or over_cap), ``rank`` and ``kept`` to rows with x1..y2, score, name.

    A group's boxes come by falling score, then by box, name and ``order``; a box falls to the first kept one
    that overlaps it by more than ``same`` (equal names) or ``cross``. Groups are images: one matrix each.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("fate", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("kept", T.BooleanType())])

    def solve(g: Columns) -> Columns:
        boxes, name = np.column_stack([g[c].astype(float) for c in ("x1", "y1", "x2", "y2")]), g["name"].astype(object)
        turn, by = suppressed(boxes, g["score"].astype(float), name, same, cross)
        by, name = by[turn], name[turn]
        kept = by < 0
        fate = np.where(kept, "kept", np.where(name == g["name"].astype(object)[by], "same_class", "cross_class")).astype(object)
        fate[kept & (np.cumsum(kept) > most)] = "over_cap"
        return {**{n: g[n][turn] for n in names}, "fate": fate, "rank": np.arange(len(turn), dtype=np.int32), "kept": fate == "kept"}

    return solved(rows, keys, order, solve, schema)


def swept_matches(pairs: DataFrame, image: list[str], pred: str, gt: str, score: str, overlap: str, thresholds: tuple[float, ...]) -> DataFrame:
    """image, pred, gt, threshold: the pairs that greedy matching takes at each threshold, in one pass over an image's pairs."""
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*image, pred, gt]) + ", threshold double"

    def solve(g: Columns) -> Columns:
        turn = np.lexsort((g[gt], -g[overlap], g[pred], -g[score]))
        out: list[tuple[int, float]] = []
        for t in thresholds:
            left, right = set(), set()
            for k in turn[g[overlap][turn] >= t]:
                a, b = g[pred][k], g[gt][k]
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    out.append((k, t))
        at = np.array([k for k, _ in out], int)
        return {**{c: g[c][at] for c in [*image, pred, gt]}, "threshold": np.array([t for _, t in out], float)}

    return solved(pairs.select(*image, pred, gt, score, overlap), image, [pred, gt], solve, schema)


def angular_nms(rows: DataFrame, keys: list[str], order: list[str], threshold: float = 0.5, same_class: bool = True, least_px: int = 16) -> DataFrame:
    """Adds ``kept``: between cameras of a keyframe, a mask whose footprint lies within a better one's goes.

    Rows have az1, az2, el1, el2, score, camera_priority, channel, name, n_px, index. Masks of too few pixels are no candidates.
    """
    turn = 2 * np.pi

    def solve(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a = pdf[["az1", "az2", "el1", "el2"]].to_numpy(float)
        order_ = np.lexsort((pdf["index"], pdf["channel"].astype(str), pdf["camera_priority"], -pdf["score"].to_numpy(float)))
        kept, channel, name = (pdf["n_px"] >= least_px).to_numpy(), pdf["channel"].to_numpy(object), pdf["name"].to_numpy(object)
        own = (a[:, 1] - a[:, 0]) * (a[:, 3] - a[:, 2])
        for k, i in enumerate(order_):
            if not kept[i]:
                continue
            rest = order_[k + 1 :]
            rest = rest[kept[rest] & (channel[rest] != channel[i])]
            rest = rest[name[rest] == name[i]] if same_class else rest
            h = np.maximum(np.minimum(a[rest, 3], a[i, 3]) - np.maximum(a[rest, 2], a[i, 2]), 0)
            w = np.max([np.maximum(np.minimum(a[rest, 1], a[i, 1] + s) - np.maximum(a[rest, 0], a[i, 0] + s), 0) for s in (0, turn, -turn)], axis=0) if len(rest) else h
            inside = np.where(own[rest] > 0, w * h / np.where(own[rest] > 0, own[rest], 1), 0)
            kept[rest[inside > threshold]] = False
        return {"kept": kept}

    return grouped(rows, keys, {"kept": T.BooleanType()}, solve, order)


def greedy(score: np.ndarray, overlap: np.ndarray, threshold: float) -> np.ndarray:
    """The ground truth (-1: none) that each prediction takes: by falling score, the best still free at or over the threshold."""
    taken, match = np.zeros(overlap.shape[1], bool), np.full(len(score), -1)
    for i in np.argsort(-score, kind="stable"):
        free = np.where(taken, -np.inf, overlap[i]) if overlap.shape[1] else np.empty(0)
        if len(free) and free.max() >= threshold:
            match[i] = int(free.argmax())
            taken[match[i]] = True
    return match


def consumed(pairs: DataFrame, image: list[str], left: str, right: str, rank: list[Column]) -> DataFrame:
    """Of an image's pairs in order of ``rank``, those whose two ends are both still free when their turn comes.

    A fold over the image's pairs; the result has the pairs' columns.
    """
    ranked = pairs.withColumn("__turn", F.struct(*(c.alias(f"__{i}") for i, c in enumerate(rank)))).withColumn("__row", F.struct(*pairs.columns))
    packed = ranked.groupBy(*image).agg(F.sort_array(F.collect_list(F.struct("__turn", "__row"))).alias("__pairs"))
    none = F.array().cast(f"array<{dict(ranked.dtypes)['__row']}>")

    def step(taken: Column, pair: Column) -> Column:
        mine = pair["__row"]
        clash = F.exists(taken, lambda t: (t[left] == mine[left]) | (t[right] == mine[right]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(mine)))

    return packed.select(F.explode(F.aggregate("__pairs", none, step)).alias("__row")).select("__row.*")


def greedy_matches(pairs: DataFrame, image: list[str], pred: str, gt: str, score: str, overlap: str, threshold: float, nearest: bool = False) -> DataFrame:
    """The pairs that greedy one-to-one matching takes, of candidate pairs with predictions' scores and overlaps.

    Predictions come by falling score, then number; each takes the free ground truth of most overlap (of
    least distance if ``nearest``) within the threshold, the least number among equals.
    """
    near = F.col(overlap) if nearest else -F.col(overlap)
    ok = pairs.where(F.col(overlap) <= threshold if nearest else F.col(overlap) >= threshold)
    return consumed(ok, image, pred, gt, [-F.col(score), F.col(pred), near, F.col(gt)])


def consumed_pairs(pairs: DataFrame, image: list[str], left: str, right: str, overlap: str) -> DataFrame:
    """Pairs sorted by falling overlap, then numbers, each consuming both its ends."""
    return consumed(pairs, image, left, right, [-F.col(overlap), F.col(left), F.col(right)])
