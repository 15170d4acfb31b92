"""Rows of parallel arrays: checked, taken apart into rows, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equally_long(*names: str) -> Column:
    """True where all arrays that are there have one length."""
    sizes = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.size(n)) for n in names)))
    return F.size(F.array_distinct(sizes)) <= 1


def apart(rows: DataFrame, names: list[str], index: str = "proposal_index") -> DataFrame:
    """One row per element, with its index from 0; arrays of unequal length raise."""
    zipped = F.when(equally_long(*names), F.arrays_zip(*names)).otherwise(F.raise_error(F.lit("parallel arrays differ in length")))
    others = [c for c in rows.columns if c not in names]
    out = rows.select(*others, F.posexplode(zipped).alias(index, "__element"))
    return out.select(*others, index, *(F.col("__element")[n].alias(n) for n in names))


def together(rows: DataFrame, key: list[str], names: list[str], index: str = "proposal_index") -> DataFrame:
    """The opposite of apart(): arrays in the order of the index. A key's rows are one image's, so few."""
    packed = F.sort_array(F.collect_list(F.struct(index, *names)))
    out = rows.groupBy(*key).agg(packed.alias("__rows"))
    return out.select(*key, *(F.col("__rows")[n].alias(n) for n in names))


def phrase_scores(token_scores: Column, spans: Column, how: str = "mean") -> Column:
    """Scores of phrases from those of tokens: the mean or maximum over each span (start, stop) of tokens."""

    def score(span: Column) -> Column:
        part = F.slice(token_scores, span["start"] + 1, span["stop"] - span["start"])
        total = F.aggregate(part, F.lit(0.0), lambda a, b: a + b) / F.size(part)
        return F.when(F.size(part) > 0, F.array_max(part) if how == "max" else total)

    return F.transform(spans, score)


def cosine(a: Column, b: Column, least_norm: float = 1e-12) -> Column:
    """Cosine of two vectors, folded in element order, so the same on every engine."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(least_norm))
    return product / (norm(a) * norm(b))


def bin_of(value: Column, edges: Column) -> Column:
    """How many edges lie at or below the value."""
    return F.size(F.filter(edges, lambda e: e <= value))
