"""From gated rows to a release: human coverage, tiers, strata, the second annotation's sample, and its checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bin_of
from ..functions.geometry import luma
from ..functions.text import token
from .assign import chosen_pairs
from .quantiles import matched, percentiles
from .staging import kept


#: Rows that a seeded generator draws from on the driver, at most.
DRAWN = 1_000_000


def human_merged(pipeline: DataFrame, human: DataFrame, coverage: DataFrame, sample: str = "sample_token") -> DataFrame:
    """Human rows and pipeline rows together, with ``superseded_by`` telling which rows give way.

    ``coverage`` has (sample, annotator_pass); ``human`` rows have annotator_pass null (review), 'A' or 'B'.
    Pipeline rows on a covered sample give way, to double_A before review. A human review row gives way
    where pass A covers the sample; rows of pass B stand beside and are never superseded.
    """
    passes = coverage.groupBy(sample).agg(F.bool_or(F.coalesce(F.col("annotator_pass") == "A", F.lit(False))).alias("__a"), F.bool_or(F.col("annotator_pass").isNull()).alias("__review"))
    both = pipeline.withColumn("is_human", F.lit(False)).unionByName(human.withColumn("is_human", F.lit(True)), allowMissingColumns=True)
    out = both.join(passes, sample, "left")
    by = F.when(~F.col("is_human"), F.when(F.col("__a"), "double_A").when(F.col("__review"), "review"))
    by = by.when(F.col("annotator_pass").isNull() & F.col("__a"), "double_A")
    return out.withColumn("superseded_by", by).drop("__a", "__review")


def half_imported(coverage: DataFrame, sample: str = "sample_token") -> DataFrame:
    """Samples that pass B covers and pass A doesn't."""
    of = lambda p: coverage.where(F.col("annotator_pass") == p).select(sample).distinct()
    return of("B").join(of("A"), sample, "left_anti")


def partitioned(rows: DataFrame, accepted: tuple[str, ...] = ("auto_accept",), point_floor: int = 5) -> DataFrame:
    """Adds ``reason``: null for rows of the release, or else why they are left out.

    In this order: a superseded row, whoever made it, then a pipeline row of another tier, then an
    interpolated auto_accept row of too few points. Every row has exactly one outcome.
    """
    human = F.coalesce(F.col("is_human"), F.lit(False))
    sparse = F.coalesce(F.col("interpolated"), F.lit(False)) & (F.col("tier") == "auto_accept") & (F.col("n_points") < point_floor)
    reason = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit("superseded_by_"), F.col("superseded_by")))
    reason = reason.when(~human & ~F.col("tier").isin(*accepted), F.concat(F.lit("tier_"), F.col("tier"))).when(~human & sparse, "interpolated_below_floor")
    return rows.withColumn("reason", reason)


def density_by_frame(frames: DataFrame, boxes: DataFrame, key: str, radius: float = 30.0) -> DataFrame:
    """Boxes within a radius of the origin over its area, for every frame, 0 for those without."""
    near = boxes.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) <= radius).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return frames.join(near, key, "left").withColumn("density", F.coalesce("__n", F.lit(0)) / F.lit(math.pi * radius**2)).drop("__n")


def illumination(frames: DataFrame, pixels: DataFrame, key: str, brightest: float) -> DataFrame:
    """The mean luma of every frame's pixels (r, g, b) that aren't brighter than a limit; null where there are none."""
    light = luma(F.col("r"), F.col("g"), F.col("b"))
    means = pixels.groupBy(key).agg(F.avg(F.when(light <= brightest, light)).alias("illumination"))
    return frames.join(means, key, "left")


def stratified(rows: DataFrame, value: str, quantiles: tuple[float, ...], names: tuple[str, ...], out: str = "stratum") -> DataFrame:
    """Adds the stratum of a value among the (linear) quantiles of all rows; the edges are one row, broadcast."""
    edges = percentiles(rows, [], value, quantiles).withColumnRenamed("percentiles", "__edges")
    bins = matched(rows, edges, [], "left")
    return bins.withColumn(out, F.element_at(F.array(*map(F.lit, names)), bin_of(F.col(value), F.col("__edges")) + 1)).drop("__edges")


def allocated(cells: DataFrame, keys: list[str], fraction: float, count: str = "n") -> DataFrame:
    """Adds ``selected`` to cells with counts: a proportional sample with one of each at least.

    The target is the fraction of all, rounded up, at least a row a cell. Each cell gets its share rounded
    down, at least 1; what is left goes one by one to the largest remainders, cells in order among equals,
    round after round while cells have rows left. Cells are few: strata, not rows.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, number = F.sum(count).over(everything), F.count(F.lit(1)).over(everything)
    out = cells.withColumn("__target", F.least(F.greatest(F.ceil(total * fraction), number), total))
    exact = F.col(count) * F.col("__target") / total
    out = out.withColumn("__base", F.least(F.greatest(F.floor(exact), F.lit(1)), F.col(count))).withColumn("__part", exact - F.floor(exact))
    out = out.withColumn("__room", F.col(count) - F.col("__base")).withColumn("__left", F.greatest(F.col("__target") - F.sum("__base").over(everything), F.lit(0)))
    # the k-th unit of a cell comes in round k; units are handed out by round, then remainder
    unit = out.where("__left > 0 and __room > 0").withColumn("__round", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__room", "__left"))))
    turn = F.row_number().over(Window.orderBy("__round", F.col("__part").desc(), *keys))
    more = unit.withColumn("__turn", turn).where("__turn <= __left").groupBy(*keys).agg(F.count(F.lit(1)).alias("__more"))
    out = out.join(more, keys, "left")
    return out.withColumn("selected", (F.col("__base") + F.coalesce("__more", F.lit(0))).cast("long")).drop("__target", "__base", "__part", "__room", "__left", "__more")


def chosen(rows: DataFrame, cells: DataFrame, keys: list[str], id_col: str, seed: int = 20260812) -> DataFrame:
    """Of each cell as many rows as allocated: those whose seeded hash comes first, the same on every run."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), id_col))
    out = matched(rows.withColumn("__rank", rank), cells.select(*keys, "selected"), keys)
    return out.where(F.col("__rank") <= F.col("selected")).drop("__rank", "selected")


def chosen_by_generator(rows: DataFrame, cells: DataFrame, keys: list[str], id_col: str, seed: int = 20260812) -> list:
    """The ids a seeded generator draws without replacement, cell after cell, on the driver: more than ``DRAWN`` rows raise, chosen() takes any."""
    rng, out = np.random.default_rng(seed), []
    if rows.limit(DRAWN + 1).count() > DRAWN:
        raise ValueError(f"more than {DRAWN} rows to draw from on the driver; use chosen()")
    ids = rows.select(*keys, id_col).orderBy(*keys, id_col).toPandas()
    wanted = {tuple(r[k] for k in keys): r["selected"] for r in cells.collect()}
    for key, part in ids.groupby(keys, sort=True):
        key = key if isinstance(key, tuple) else (key,)
        out += sorted(part[id_col].to_numpy()[rng.choice(len(part), wanted.get(key, 0), replace=False)].tolist())
    return out


# ---- stitching of track fragments ----
def fragments(rows: DataFrame, scene: list[str], track: str, step: str, position: list[str], t_seconds: str) -> DataFrame:
    """One row a fragment: first and last step, position and velocity (of two rows) at both ends, category, size."""
    w = Window.partitionBy(*scene, track).orderBy(step)
    ahead, behind = {}, {}
    for p in [t_seconds, *position]:
        ahead[p], behind[p] = F.lead(p).over(w), F.lag(p).over(w)
    velocity = lambda near, sign: F.array(*(F.try_divide((near[p] - F.col(p)) * sign, (near[t_seconds] - F.col(t_seconds)) * sign) for p in position))
    out = rows.withColumn("__v0", F.when(ahead[t_seconds].isNotNull(), velocity(ahead, 1))).withColumn("__v1", F.when(behind[t_seconds].isNotNull(), velocity(behind, -1)))
    out = out.withColumn("__p", F.array(*position))
    end = lambda by, c: getattr(F, by)(F.col(c), F.col(step))
    return out.groupBy(*scene, track).agg(
        F.min(step).alias("first"),
        F.max(step).alias("last"),
        end("min_by", t_seconds).alias("first_t"),
        end("max_by", t_seconds).alias("last_t"),
        end("min_by", "__p").alias("first_at"),
        end("max_by", "__p").alias("last_at"),
        end("min_by", "__v0").alias("first_v"),
        end("max_by", "__v1").alias("last_v"),
        F.min("category").alias("category"),
        F.count_distinct("category").alias("n_categories"),
        F.avg(F.col("w") * F.col("l")).alias("area"),
        F.count(F.lit(1)).alias("n_rows"),
    )


#: Cells that a fragment looks at, at most; one whose places lie further apart meets all of its step.
LOOKS = 64


def _cell(x: Column, side: float) -> Column:
    """The number of a grid's cell along one axis; what lies too far out for whole numbers is in the outermost ones."""
    return F.floor(F.greatest(F.least(x / side, F.lit(1e12)), F.lit(-1e12)))


def _axes(place: Column) -> dict[str, Column]:
    """The first two coordinates of a place, which may have one or more than two."""
    return {"i": F.get(place, F.lit(0)).cast("double"), "j": F.coalesce(F.get(place, F.lit(1)).cast("double"), F.lit(0.0))}


def stitch_pairs(pieces: DataFrame, scene: list[str], track: str, gap: int | list[int], base_gate: float = 2.0, slack: float = 1.0, size_ratio: float = 2.0) -> DataFrame:
    """Predecessor and successor fragments that a gap of so many steps may join, with the cost of distance over gate.

    The successor starts exactly ``gap`` steps after the end; of several gaps each has a gate of its own. All joins are
    equi-joins on scene, category and step, and on a grid's cells: a predecessor looks for starts about the place where
    it would be by then, a successor for ends about the place where it would have been, one without velocity about its
    own end. So the work follows the number of near fragments, not that of all pairs of a step. Where the others of a
    step have many times, all the cells between the first and the last place are looked at; a fragment that would have
    to look at more than ``LOOKS`` is compared with all of the step.
    """
    gates = {g: base_gate + slack * (g - 1) for g in ([gap] if isinstance(gap, int) else gap)}
    side = 2 * max(gates.values())
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("gap"), F.lit(gate).alias("gate")) for g, gate in gates.items())))
    a = pieces.select(*scene, "category", F.col(track).alias("before"), "last", "last_t", "last_at", "last_v", F.col("area").alias("area_a"), each.alias("__g"))
    a = a.withColumn("start", F.col("last") + F.col("__g.gap")).select("*", "__g.*").drop("last", "__g")
    b = pieces.select(*scene, "category", F.col(track).alias("after"), F.col("first").alias("start"), "first_t", "first_at", "first_v", F.col("area").alias("area_b"))
    step, grid = [*scene, "category", "start"], ["__wide", "__i", "__j"]
    dt = F.col("first_t") - F.col("last_t")

    def coasted(p: str, v: str, by: Column) -> Column:
        return F.zip_with(p, v, lambda x, y: x + y * by)

    def distance(p: Column, q: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    def placed(rows: DataFrame, at: str) -> DataFrame:
        cell = [_cell(x, side).alias(f"__{n}") for n, x in _axes(F.col(at)).items()]
        whole = [F.lit(0).cast("long").alias(c) for c in ("__i", "__j")]
        both = F.array(F.struct(F.lit(False).alias("__wide"), *cell), F.struct(F.lit(True).alias("__wide"), *whole))
        return rows.withColumn("__at", F.explode(both)).select("*", "__at.*").drop("__at")

    def looking(rows: DataFrame, times: DataFrame, t: str, p: str, v: str, by: Callable[[Column], Column]) -> DataFrame:
        """The rows in every cell that the gate reaches about their places at the others' times."""
        others = times.groupBy(*(c for c in times.columns if c != t)).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.bool_or(F.col(t).isNull()).alias("__untimed"))
        out = rows.join(others, step).withColumn("__p0", coasted(p, v, by(F.col("__t0")))).withColumn("__p1", coasted(p, v, by(F.col("__t1"))))
        out = out.withColumn("__moves", F.coalesce(~F.exists("__p0", F.isnull), F.lit(False)))
        reach = F.col("gate") * 1.001  # so that rounding loses no pair
        for n in "ij":
            x = [F.when(F.col("__moves"), _axes(F.col(c))[n]) for c in ("__p0", "__p1")] + [F.when(~F.col("__moves") | F.col("__untimed"), _axes(F.col(p))[n])]
            out = out.withColumn(f"__{n}0", _cell(F.least(*x) - reach, side)).withColumn(f"__{n}1", _cell(F.greatest(*x) + reach, side))
        out = out.withColumn("__wide", reduce(Column.__mul__, [(F.col(f"__{n}1") - F.col(f"__{n}0") + 1).cast("double") for n in "ij"]) > LOOKS)
        for n in "ij":
            ends = [F.when(F.col("__wide"), F.lit(0).cast("long")).otherwise(F.col(f"__{n}{k}")) for k in (0, 1)]
            out = out.withColumn(f"__{n}", F.explode(F.sequence(*ends)))
        return out.select(*rows.columns, *(c for c in others.columns if c in ("gap", "gate")), *grid)

    ahead = looking(a, b.select(*step, "first_t"), "first_t", "last_at", "last_v", lambda t: t - F.col("last_t")).join(placed(b, "first_at"), [*step, *grid])
    back = looking(b, a.select(*step, "gap", "gate", "last_t"), "last_t", "first_at", "first_v", lambda t: -(F.col("first_t") - t)).join(placed(a.drop("gate"), "last_at"), [*step, "gap", *grid])
    forward = F.when(F.col("last_v").isNotNull(), distance(coasted("last_at", "last_v", dt), F.col("first_at")))
    backward = F.when(F.col("first_v").isNotNull(), distance(coasted("first_at", "first_v", -dt), F.col("last_at")))
    still = distance(F.col("last_at"), F.col("first_at"))
    cost = F.coalesce(F.least(forward, backward), still) / F.col("gate")
    found_ahead = F.coalesce(F.coalesce(forward, still) / F.col("gate") <= 1, F.lit(False))
    ratio = F.col("area_b") / F.col("area_a")

    def near(found: DataFrame, mine: Column) -> DataFrame:
        return found.where(ratio.between(1 / size_ratio, size_ratio)).where(mine).withColumn("cost", cost).where("cost <= 1").select(*scene, "before", "after", "gap", "cost")

    return near(ahead, found_ahead).unionByName(near(back, ~found_ahead))


def stitched(pieces: DataFrame, scene: list[str], track: str, most_gap: int = 3, **gates: float) -> DataFrame:
    """before, after, gap, cost of the joins: the cheapest assignment of each gap, shorter gaps first.

    Candidate pairs of all gaps are joined in Spark; only they reach the scene's assignment, which runs
    gap by gap, an end once used being taken. Ends that no candidates connect are assigned apart, so a matrix
    is as large as one tangle of candidates, not as a scene.
    """

    pairs = stitch_pairs(kept(pieces), scene, track, list(range(1, most_gap + 1)), **gates)
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*scene, "before", "after", "gap", "cost"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        taken_before, taken_after, found = set(), set(), []
        for _, part in sorted(pdf.groupby("gap")):
            part = part[~part["before"].isin(taken_before) & ~part["after"].isin(taken_after)]
            k = chosen_pairs(part["before"].to_numpy(), part["after"].to_numpy(), part["cost"].to_numpy(), 10.0)
            found += list(zip(part["before"].to_numpy()[k], part["after"].to_numpy()[k]))
            taken_before, taken_after = {a for a, _ in found}, {b for _, b in found}
        kept = pd.DataFrame(found, columns=["before", "after"])
        return pdf.merge(kept, on=["before", "after"])[[*scene, "before", "after", "gap", "cost"]]

    return pairs.groupBy(*scene).applyInPandas(solve, schema)


def chains_of(pieces: DataFrame, joins: DataFrame, scene: list[str], track: str) -> DataFrame:
    """scene, track and chain, the first fragment that joins lead back to. Joins form paths, halved in each round."""
    links = pieces.select(*scene, track).join(joins.select(*scene, F.col("after").alias(track), "before"), [*scene, track], "left")
    links = kept(links.select(*scene, track, F.coalesce("before", track).alias("chain")))
    while True:
        up = links.select(*scene, F.col(track).alias("chain"), F.col("chain").alias("__up"))
        longer = links.join(up, [*scene, "chain"]).select(*scene, track, F.col("__up").alias("chain"), (F.col("__up") != F.col("chain")).alias("__moved"))
        longer = kept(longer)
        links = longer.drop("__moved")
        if longer.where("__moved").isEmpty():
            return links


def instance_tokens(rows: DataFrame, scene: str, chain: str) -> DataFrame:
    return rows.withColumn("instance_token", token("instance", F.col(scene), F.col(chain)))


def visibility_of(share: Column) -> Column:
    """The bucket '1' to '4' of a share of visible corners."""
    return F.when(share < 0.4, "1").when(share < 0.6, "2").when(share < 0.8, "3").otherwise("4")


# ---- checks ----
def violations(annotations: DataFrame, instances: DataFrame, samples: DataFrame, categories: DataFrame, accepted: tuple[str, ...] = ("auto_accept",), point_floor: int = 5) -> DataFrame:
    """kind, severity and token of everything that is wrong with a release; the checks are a union of queries."""
    a = annotations
    say = lambda rows, kind, severity="error", key="token": rows.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("token"))
    norm = F.sqrt(F.aggregate("rotation", F.lit(0.0), lambda s, x: s + x * x))
    size = F.col("size")
    pipeline = ~F.coalesce(F.col("is_human"), F.lit(False))
    nbr = a.groupBy("instance_token").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("prev").isNull()).alias("__heads"), F.count_if(F.col("next").isNull()).alias("__tails"))
    chains = instances.join(nbr, F.col("token") == F.col("instance_token"), "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    twin = a.select(F.col("token").alias("next"), F.col("prev").alias("__back"))
    missing = lambda key, other: a.join(other.select(F.col("token").alias(key)), key, "left_anti")
    found = [
        say(a.where(F.exists(size, lambda s: s <= 0)), "size_not_positive"),
        say(a.where(F.abs(norm - 1) > 1e-3), "quaternion_norm"),
        say(missing("instance_token", instances), "dangling_instance"),
        say(missing("sample_token", samples), "dangling_sample"),
        say(instances.join(categories.select(F.col("token").alias("category_token")), "category_token", "left_anti"), "dangling_category"),
        say(a.where("next is not null").join(twin, "next", "left").where(~F.col("token").eqNullSafe(F.col("__back"))), "links_not_symmetric"),
        say(a.where(F.col("is_human") & F.col("verified_by").isNull()), "human_unverified"),
        say(a.where(pipeline & ~F.col("tier").isin(*accepted)), "wrong_tier"),
        say(a.where(pipeline & F.col("interpolated") & (F.col("n_points") < point_floor)), "below_point_floor"),
        say(chains.where(F.col("nbr_annotations") != F.col("__n")), "annotation_count"),
        say(chains.where((F.col("__n") > 0) & ((F.col("__heads") != 1) | (F.col("__tails") != 1))), "chain_ends"),
        say(chains.where("__n = 0"), "instance_without_annotations", "warning"),
        say(a.where(size[0] > size[1]), "wider_than_long", "warning"),
    ]
    return reduce(DataFrame.unionByName, found)
