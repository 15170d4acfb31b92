"""Referential and structural checks of token-linked tables, and their repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, blank_ok: bool = True) -> DataFrame:
    """Rows whose key has no target; null and empty keys pass if ``blank_ok``."""
    known = target.select(F.col(target_key).alias("__known")).distinct()
    out = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")) if blank_ok else rows
    return out.join(known, out[key] == known["__known"], "left_anti")


def closure_report(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """name and n_dangling of each link (name, rows, key, target, target key)."""
    one = lambda name, *link: dangling(*link).agg(F.count(F.lit(1)).alias("n_dangling")).select(F.lit(name).alias("link"), "n_dangling")
    return reduce(DataFrame.unionByName, [one(*link) for link in links])


def scoped(rows: DataFrame, key: str, kept: DataFrame, kept_key: str) -> DataFrame:
    """Rows whose key is among the kept ones: one step of a cascade of semi-joins."""
    k = kept.select(F.col(kept_key).alias("__kept"))
    return rows.join(k, rows[key] == k["__kept"], "left_semi")


def scoped_substrate(tables: dict[str, DataFrame], scenes: list[str]) -> dict[str, DataFrame]:
    """The token-linked tables of some scenes, links out of them blanked.

    Scenes are filtered first and the rest follows by semi-joins down the tree, so each step is small.
    """
    t = dict(tables)
    out = {"scene": t["scene"].where(F.col("name").isin(scenes))}
    out["sample"] = scoped(t["sample"], "scene_token", out["scene"], "token")
    out["sample_data"] = scoped(t["sample_data"], "sample_token", out["sample"], "token")
    out["ego_pose"] = scoped(t["ego_pose"], "token", out["sample_data"], "ego_pose_token")
    out["calibrated_sensor"] = scoped(t["calibrated_sensor"], "token", out["sample_data"], "calibrated_sensor_token")
    out["sensor"] = scoped(t["sensor"], "token", out["calibrated_sensor"], "sensor_token")
    out["log"] = scoped(t["log"], "token", out["scene"], "log_token")
    for name in ("sample", "sample_data"):
        out[name] = blanked(out[name], ["prev", "next"])
    return out | {n: d for n, d in t.items() if n not in out}


def blanked(rows: DataFrame, links: list[str], token: str = "token") -> DataFrame:
    """Links whose token isn't among the rows become empty."""
    known = rows.select(F.col(token).alias("__t"))
    for link in links:
        rows = rows.join(known.withColumn("__has", F.lit(True)), rows[link] == F.col("__t"), "left").withColumn(link, F.when(F.col("__has"), F.col(link)).otherwise(F.lit("")))
        rows = rows.drop("__t", "__has")
    return rows


def missing_values(rows: DataFrame, group: list[str], value: str, required: list[str]) -> DataFrame:
    """Adds to each group the required values it lacks."""
    have = rows.groupBy(*group).agg(F.collect_set(F.when(F.col(value).isin(*required), F.col(value))).alias("__have"))
    return have.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("__have")))).drop("__have")


def complete_only(rows: DataFrame, group: list[str], value: str, required: list[str]) -> DataFrame:
    """The rows of groups that have every required value."""
    whole = missing_values(rows, group, value, required).where(F.size("missing") == 0).select(*group)
    return rows.join(whole, group, "left_semi")


def relinked(rows: DataFrame, chain: list[str], order: list[str], token: str = "token") -> DataFrame:
    """prev and next recomputed from the order of what is left of each chain; the ends are empty."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return rows.withColumn("prev", F.coalesce(F.lag(token).over(w), F.lit(""))).withColumn("next", F.coalesce(F.lead(token).over(w), F.lit("")))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with the count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inconstant(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups with more than one value, with the number and the least and largest one."""
    out = rows.groupBy(*group).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return out.where("n_values > 1")


def partition_report(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: keys in no part, in more than one, and in a part but not in the whole."""
    named = reduce(DataFrame.unionByName, [d.select(key).distinct().withColumn("__part", F.lit(n)) for n, d in parts.items()])
    counts = named.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    both = whole.select(key).distinct().withColumn("__in", F.lit(True)).join(counts, key, "full")
    return both.agg(F.count_if(F.col("__n").isNull()).alias("n_uncovered"), F.count_if(F.col("__n") > 1).alias("n_overlapping"), F.count_if(F.col("__in").isNull()).alias("n_unknown"))


def rule_errors(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, as an array; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))


def split_leaks(rows: DataFrame, split: str, content: str) -> DataFrame:
    """Contents that more than one split holds, and duplicates within one: content, splits, n."""
    out = rows.groupBy(content).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 1").withColumn("leaks", F.size("splits") > 1)


def verdicts(checks: dict[str, DataFrame], scenes: DataFrame, scene: str = "scene_token") -> DataFrame:
    """scene, predicate, n_offenders, passed: each check gives the offending rows with their scene."""
    one = lambda name, rows: scenes.select(scene).join(rows.groupBy(scene).agg(F.count(F.lit(1)).alias("__n")), scene, "left").select(scene, F.lit(name).alias("predicate"), F.coalesce("__n", F.lit(0)).alias("n_offenders"))
    out = reduce(DataFrame.unionByName, [one(n, r) for n, r in checks.items()])
    return out.withColumn("passed", F.col("n_offenders") == 0)


def exact_matches(kept: DataFrame, whole: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Each kept row's first equal row of the whole, by all keys bit for bit, and how many there are."""
    first = whole.groupBy(*keys).agg(F.min(index).alias("match"), F.count(F.lit(1)).alias("n_matches"))
    return kept.join(first, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def folded(rows: DataFrame, object_label: str, road_label: str, background: int = 0) -> Column:
    """The label of a point: the road's only where no object has one."""
    mine = F.coalesce(F.col(object_label), F.lit(background))
    return F.when(mine != background, mine).otherwise(F.coalesce(F.col(road_label), F.lit(background)))


def representatives(rows: DataFrame, group: list[str], rank: list[Column]) -> DataFrame:
    """The first row of each group by a rank of several keys."""
    w = Window.partitionBy(*group).orderBy(*rank)
    return rows.withColumn("rank", F.row_number().over(w))


def propagated(rows: DataFrame, ranked: DataFrame, group: list[str], answer: str, unsettled: tuple[str, ...] = ("unclear", "error")) -> DataFrame:
    """Every member with its group's answer: of those asked, in rank order, the first that settles it.

    If none does, the last answer that isn't an error, or an error if all are. ``ranked`` has rank and answer.
    """
    settled = F.min(F.when(~F.col(answer).isin(*unsettled), F.struct("rank", answer)))
    unclear = F.max(F.when(F.col(answer) == unsettled[0], F.struct("rank", answer)))
    some = F.max(F.struct("rank", answer))
    got = ranked.where(F.col(answer).isNotNull()).groupBy(*group).agg(F.coalesce(settled, unclear, some)[answer].alias("verdict"))
    return rows.join(got, group, "left").withColumn("verdict", F.coalesce("verdict", F.lit("skipped_small")))
