"""Stitching against the cheapest assignment found by trying all."""

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from scenemill.operators import release


def cheapest(pairs):
    """(number of joins, cost, joins): most joins first, then the least cost, as one more join always pays."""
    best = (0, 0.0, [])
    for k, (b, a, c) in enumerate(pairs):
        n, cost, joins = cheapest([p for p in pairs[k + 1 :] if p[0] != b and p[1] != a])
        if (-(n + 1), cost + c) < (-best[0], best[1]):
            best = (n + 1, cost + c, [(b, a), *joins])
    return best


@pytest.mark.parametrize("seed", range(3))
def test_joins_are_the_cheapest_of_each_gap(spark, seed):
    rng, rows = random.Random(seed), []
    for scene in range(4):
        for track in range(12):
            start, at = rng.choice((0, 4, 5)), (rng.choice((0.0, 30.0)) + rng.random() * 2, rng.random() * 2)
            rows += [(scene, track, start + k, float(start + k), at[0], at[1], "car", 2.0, 4.0) for k in range(1, 4 if start else rng.choice((3, 4)))]
    schema = "scene int, track int, step int, t double, x double, y double, category string, w double, l double"
    pieces = release.fragments(spark.createDataFrame(rows, schema), ["scene"], "track", "step", ["x", "y"], "t")
    candidates = [(g, r) for g in (1, 2, 3) for r in release.stitch_pairs(pieces, ["scene"], "track", g).collect()]
    got = {(r["scene"], r["gap"], r["before"], r["after"]) for r in release.stitched(pieces, ["scene"], "track").collect()}
    assert got
    for scene in range(4):
        befores, afters = set(), set()
        for gap in (1, 2, 3):
            open_pairs = [(r["before"], r["after"], r["cost"]) for g, r in candidates if g == gap and r["scene"] == scene and r["before"] not in befores and r["after"] not in afters]
            n, cost, _ = cheapest(open_pairs)
            mine = {(b, a) for s, g, b, a in got if (s, g) == (scene, gap)}
            assert len(mine) == n and abs(sum(c for b, a, c in open_pairs if (b, a) in mine) - cost) < 1e-9
            befores |= {b for b, _ in mine}
            afters |= {a for _, a in mine}


PIECES = "scene int, track int, first int, last int, first_t double, last_t double, first_at array<double>, last_at array<double>, first_v array<double>, last_v array<double>, category string, area double"


def plain_cost(a, b, gate):
    """Distance over gate of a predecessor and a successor: the nearer of both directions, or of the ends where there is neither."""

    def far(p, v, q, dt):
        moved = [None if None in (x, y, dt) else x + y * dt for x, y in zip(p, v or [])] if v is not None else [None]
        return None if None in moved else math.dist(moved, q)

    dt = None if None in (a["last_t"], b["first_t"]) else b["first_t"] - a["last_t"]
    found = [d for d in (far(a["last_at"], a["last_v"], b["first_at"], dt), far(b["first_at"], b["first_v"], a["last_at"], dt and -dt)) if d is not None]
    return (min(found) if found else math.dist(a["last_at"], b["first_at"])) / gate


@pytest.mark.parametrize("axes", [1, 2, 3])
def test_pairs_are_those_of_all_pairs(spark, axes):
    rng, rows = random.Random(axes), []
    place = lambda: [rng.choice((0.0, 2.0, -4.0, 1e7)) + rng.choice((0.0, rng.uniform(-6, 6))) for _ in range(axes)]
    speed = lambda: rng.choice((None, [None] * axes, [rng.uniform(-9, 9) for _ in range(axes)]))
    # of steps with times of their own, those of the third run lie so far apart that whole steps are compared
    time = lambda step: rng.choice((None, step * 0.5, step * 0.5, step * 0.5 + 0.1, step * 0.5 + rng.random() * (100 if axes == 3 else 0.1)))
    for track in range(400):
        first = rng.randrange(6)
        last = first + rng.randrange(3)
        rows.append((track % 2, track, first, last, time(first), time(last), place(), place(), speed(), speed(), rng.choice("ab"), rng.choice((1.0, 2.0, 3.0))))
    pieces = spark.createDataFrame(rows, PIECES)
    plain, want = pieces.collect(), {}
    for a in plain:
        for b in plain:
            gap = b["first"] - a["last"]
            if (a["scene"], a["category"]) == (b["scene"], b["category"]) and gap in (1, 2, 3) and 0.5 <= b["area"] / a["area"] <= 2:
                cost = plain_cost(a, b, 2.0 + (gap - 1))
                if cost <= 1:
                    want[a["scene"], a["track"], b["track"], gap] = cost
    got = release.stitch_pairs(pieces, ["scene"], "track", [1, 2, 3]).collect()
    assert len(got) == len(want) > 50
    assert all(abs(want[r["scene"], r["before"], r["after"], r["gap"]] - r["cost"]) < 1e-9 for r in got)
    assert release.stitch_pairs(pieces, ["scene"], "track", 2).count() == sum(k[3] == 2 for k in want)


def test_far_fragments_of_one_step_are_not_compared(spark):
    """40,000 tracks of one scene, each with times of its own, all cut at one step: 1.6 billion pairs of it, of which 40,000 are near."""
    n = 40_000
    at, late = F.array((F.col("id") % n) * 10.0, F.lit(0.0)), (F.col("id") % n) * 1e-6
    piece = [F.lit(0).alias("scene"), F.col("id").alias("track"), *(F.when(F.col("id") < n, lo).otherwise(hi).alias(c) for c, lo, hi in (("first", 0, 2), ("last", 1, 3)))]
    piece += [(F.when(F.col("id") < n, lo).otherwise(hi) + late).alias(c) for c, lo, hi in (("first_t", 0.0, 2.0), ("last_t", 1.0, 3.0))]
    piece += [at.alias("first_at"), at.alias("last_at"), *(F.array(F.lit(0.0), F.lit(0.3)).alias(c) for c in ("first_v", "last_v")), F.lit("car").alias("category"), F.lit(8.0).alias("area")]
    context = spark.sparkContext
    limit = threading.Timer(60, context.cancelAllJobs)
    limit.start()
    try:
        joins = release.stitched(spark.range(2 * n).select(*piece), ["scene"], "track").collect()
    finally:
        limit.cancel()
    assert sorted((r["before"], r["after"], r["gap"]) for r in joins) == [(k, k + n, 1) for k in range(n)]
