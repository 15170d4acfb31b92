"""Connected components by alternating stars, and their counterpart in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, staged


def dealt(df: DataFrame) -> DataFrame:
    """The rows without a partitioning by key, as the next join is to make its own."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for every node of the edges (a, b: long) the smallest node it is connected to.

    Alternates large stars (a node's larger neighbours go to the least) and small stars (a node and
    its smaller neighbours go to the least), Kiveris et al. 2014. No neighbourhood is gathered: the
    least neighbour is an aggregate that is joined back, and the edges never grow in number. The
    aggregate is dealt out anew before the join, which so has an exchange on either side, and the
    partition of a hub with very many neighbours can be split. The rounds grow with the logarithm of
    the number of nodes; ``most_rounds`` only ends a run whose edges change for another reason.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = dealt(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt(least), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, e = e, staged(small.distinct(), "small-star")
        discarded(before, large)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes is connected to."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return label
