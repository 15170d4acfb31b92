"""Exact percentiles of groups of any size, without a group's values in one buffer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small
from .staging import kept

#: Values of one group that a single aggregation buffer or sort may hold.
MOST = 1_000_000
#: Parts into which a round divides the values that may hold a percentile.
PARTS = 256
#: Accuracy of the sketch that gives the parts' edges; its error is far below the width of a part.
ACCURACY = 10_000


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, null keys matching; without keys ``right`` is one row for all."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same: Column = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(small(other), same, how).drop(*(f"__right_{k}" for k in keys))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], most: int = MOST) -> DataFrame:
    """by and ``percentiles``, an array of the value at each share with linear interpolation, for groups that have values.

    Groups of at most ``most`` values are aggregated at once. For larger ones a sketch brackets each rank, one
    pass counts the values below the bracket and by value inside, and brackets that still hold too many distinct
    values are divided again. Sketches only choose brackets: ranks come from counts, so results are exact.
    Zeros of both signs are one value, 0.0; NaN is the largest value.
    """
    v = rows.select(*by, (F.col(value).cast("double") + 0.0).alias("__v")).where("__v is not null")
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest = n.agg(F.max("n")).first()[0] or 0
    if largest <= most:
        found = v.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, shares))).alias("percentiles"))
        return found.where(F.col("percentiles").isNotNull())
    return by_counts(v, by, shares, most)


def edges(inside: str) -> Column:
    return F.percentile_approx(inside, [k / PARTS for k in range(PARTS + 1)], ACCURACY).alias("__edges")


def bracket(rank: Column) -> tuple[Column, Column]:
    """The edges between which values of a rank (a share of the values inside) lie, a part's width to spare on either side."""
    part = F.floor(rank * PARTS).cast("int")
    at = lambda k: F.element_at("__edges", F.least(F.greatest(k, F.lit(0)), F.lit(PARTS)) + 1)
    return F.when(part > 1, at(part - 1)), F.when(part < PARTS - 2, at(part + 2))


def by_counts(v: DataFrame, by: list[str], shares: tuple[float, ...], most: int) -> DataFrame:
    """percentiles() of values __v for groups that no single buffer should hold."""
    whole = v.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), edges("__v"))
    tall = whole.select(*by, "__n", "__edges", F.posexplode(F.array(*map(F.lit, shares))).alias("__k", "__share"))
    low, high = bracket(F.col("__share"))
    at = (F.col("__n") - 1) * F.col("__share")
    # no bound is a null; last tells that the bracket isn't divided again
    todo = kept(tall.select(*by, "__k", at.alias("__at"), low.alias("__lo"), high.alias("__hi"), F.lit(False).alias("__last")))
    done: list[DataFrame] = []
    while True:
        counts = kept(bracketed(v, todo, by).groupBy(*by, "__k", "__at", "__last", "__lo", "__hi", "__below", "__x").agg(F.count(F.lit(1)).alias("__c")))
        ours = ["__k", "__at", "__last", "__lo", "__hi"]
        sums = counts.groupBy(*by, *ours).agg(
            F.sum(F.when(F.col("__below"), F.col("__c")).otherwise(0)).alias("__under"),
            F.sum(F.when(~F.col("__below"), F.col("__c")).otherwise(0)).alias("__inside"),
            F.count_if(~F.col("__below")).alias("__distinct"),
        )
        missed = (F.col("__under") > F.floor("__at")) | (F.col("__under") + F.col("__inside") <= F.ceil("__at"))
        sums = kept(sums.withColumn("__missed", missed).withColumn("__again", missed | ((F.col("__distinct") > most) & ~F.col("__last"))))
        ready = sums.where("not __again").select(*by, "__k", "__under")
        done.append(interpolated(matched(counts.where("not __below"), ready, [*by, "__k"]), by))
        if sums.where("__again").isEmpty():
            break
        todo = kept(divided(v, sums.where("__again"), by))
    found = reduce(DataFrame.unionByName, done)
    values = F.array_sort(F.collect_list(F.struct("__k", "__value")))
    return found.groupBy(*by).agg(F.transform(values, lambda s: s["__value"]).alias("percentiles"))


def bracketed(v: DataFrame, todo: DataFrame, by: list[str]) -> DataFrame:
    """Values below or inside the brackets of their group, a row a bracket; those below carry no value, so they fold into one count."""
    out = matched(v, todo, by)
    below = F.col("__v") < F.col("__lo")
    out = out.withColumn("__below", F.coalesce(below, F.lit(False))).where(F.col("__below") | F.coalesce(F.col("__v") <= F.col("__hi"), F.lit(True)))
    return out.withColumn("__x", F.when(~F.col("__below"), F.col("__v")))


def divided(v: DataFrame, again: DataFrame, by: list[str]) -> DataFrame:
    """Narrower brackets; one that missed its rank opens to all values, and one that a part doesn't narrow is sorted as it is."""
    wide = again.withColumn("__lo", F.when(~F.col("__missed"), F.col("__lo"))).withColumn("__hi", F.when(~F.col("__missed"), F.col("__hi")))
    inside = bracketed(v, wide, by).where("not __below")
    parts = inside.groupBy(*by, "__k", "__at", "__lo", "__hi", "__missed", "__under", "__inside").agg(edges("__x"))
    low, high = bracket((F.col("__at") - F.col("__under")) / F.greatest(F.col("__inside") - 1, F.lit(1)))
    lo, hi = F.coalesce(low, F.col("__lo")), F.coalesce(high, F.col("__hi"))
    lo, hi = F.when(~F.col("__missed"), lo), F.when(~F.col("__missed"), hi)
    stuck = F.col("__missed") | (lo.eqNullSafe(F.col("__lo")) & hi.eqNullSafe(F.col("__hi")))
    return parts.select(*by, "__k", "__at", lo.alias("__new_lo"), hi.alias("__new_hi"), stuck.alias("__last")).withColumnsRenamed({"__new_lo": "__lo", "__new_hi": "__hi"})


def interpolated(counts: DataFrame, by: list[str]) -> DataFrame:
    """The value at each position from counts by value and the number of values under them."""
    order = Window.partitionBy(*by, "__k").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("__upto", F.col("__under") + F.sum("__c").over(order))
    value = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__x")))
    at = F.col("__at")
    out = upto.groupBy(*by, "__k", "__at").agg(value(F.floor(at)).alias("__a"), value(F.ceil(at)).alias("__b"))
    mixed = (F.ceil(at) - at) * F.col("__a") + (at - F.floor(at)) * F.col("__b")
    return out.select(*by, "__k", F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(mixed).alias("__value"))
