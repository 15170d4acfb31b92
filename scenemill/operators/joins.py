"""Joins with their contracts: pairing of arms, lookups, rounded keys, enrichment, and broadcasts of checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond it both sides are dealt out by their keys.
BROADCAST_ROWS = 100_000


def small(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, marked for broadcast if a count of at most ``limit`` + 1 of its rows says that it is small."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def failed(message: str, *shown: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in shown)))


def paired(a: DataFrame, b: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Rows of two arms one to one, b's columns with the prefix b_; a row that lacks its other, repeats or differs in identity raises."""
    once = lambda x: x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*x.columns)).alias("__row"))
    left, right = once(a), once(b).withColumnsRenamed({**{k: f"b_{k}" for k in keys}, "__n": "b___n", "__row": "b___row"})
    both = left.join(right, reduce(lambda p, q: p & q, [left[k].eqNullSafe(right[f"b_{k}"]) for k in keys]), "full")
    same = reduce(lambda p, q: p & q, [F.col(f"__row.{c}").eqNullSafe(F.col(f"b___row.{c}")) for c in identity], F.lit(True))
    fault = (
        F.when(F.col("__row").isNull() | F.col("b___row").isNull(), "a row has no counterpart")
        .when((F.col("__n") > 1) | (F.col("b___n") > 1), "a key is repeated")
        .when(~same, "rows of one key differ in identity")
    )
    checked = both.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    return checked.select("__row.*", *(F.col(f"b___row.{c}").alias(f"b_{c}") for c in b.columns))


def looked_up(rows: DataFrame, table: DataFrame, key: str, required: bool = True) -> DataFrame:
    """Every row with its one row of the table; a key that the table lacks raises if ``required``."""
    hit = table.withColumn("__hit", F.lit(True))
    out = rows.join(small(hit), key, "left")
    if required:
        out = out.where(F.when(F.col("__hit"), True).otherwise(failed("no row for key ", key).cast("boolean")))
    return out.drop("__hit")


def rounded_lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], places: int = 2) -> DataFrame:
    """Left join by keys and by values rounded to so many places; the table's first row (by its other columns) of a key counts."""
    rest = [c for c in table.columns if c not in keys + values]
    key = lambda x: F.array(*(F.round(F.col(c), places) for c in values))
    firsts = table.withColumn("__at", key(table)).groupBy(*keys, "__at").agg(F.min(F.struct(*rest)).alias("__found"))
    out = rows.withColumn("__at", key(rows)).join(firsts, [*keys, "__at"], "left")
    return out.select(*rows.columns, *(F.col(f"__found.{c}").alias(c) for c in rest))


def enriched(rows: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Rows with what each table says of their key, as a struct column of the table's name (null: nothing)."""
    for name, table in tables.items():
        said = table.select(key, F.struct(*(c for c in table.columns if c != key)).alias(name))
        rows = rows.join(said, key, "left")
    return rows
