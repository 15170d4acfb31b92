"""Embeddings: nearest partners within a class, and outliers by the distance to neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from .quantiles import matched, percentiles
from .staging import kept

#: Vectors that are compared at once: a block of queries against a block of all.
BLOCK = 2048
#: Vectors of a reference that is broadcast, at most.
REFERENCE = 100_000


def nearest_in_class(vectors: DataFrame, id_col: str, vector: str, label: str, k: int = 3, digits: int = 5) -> DataFrame:
    """id, label, other, cosine, rank: each vector's k most similar others of its class, the least id among equals.

    Cosines are rounded before they are ranked. The classes are dealt out in pairs of blocks, so a class
    of any size is spread; each pair of blocks gives its k best a vector, and those are merged.
    """
    blocks = vectors.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    v = v.join(blocks.withColumnRenamed(label, "__label"), F.col("label") == F.col("__label")).drop("__label")
    side = F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")
    asks = v.withColumn("a", side).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).withColumn("ask", F.lit(True))
    gives = v.withColumn("b", side).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).withColumn("ask", F.lit(False))
    both = asks.unionByName(gives).drop("__blocks")
    kinds = dict(v.dtypes)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, give = pdf[pdf["ask"]].sort_values("id"), pdf[~pdf["ask"]].sort_values("id")
        if not len(ask) or not len(give):
            return pd.DataFrame({"id": [], "label": [], "other": [], "cosine": []})
        # sums in the order of the elements, as a fold gives them
        x, y = np.stack(ask["v"].to_numpy()), np.stack(give["v"].to_numpy())
        dot, nx, ny = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
        for i in range(x.shape[1]):
            dot += x[:, i, None] * y[None, :, i]
            nx += x[:, i] * x[:, i]
            ny += y[:, i] * y[:, i]
        c = np.round(dot / (np.maximum(np.sqrt(nx), 1e-12)[:, None] * np.maximum(np.sqrt(ny), 1e-12)[None]), digits)
        ids, others = ask["id"].to_numpy(), give["id"].to_numpy()
        c[ids[:, None] == others[None]] = -np.inf
        top = np.argsort(-c, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(ids)), top.shape[1])
        out = pd.DataFrame({"id": ids[rows], "label": ask["label"].to_numpy()[rows], "other": others[top.ravel()], "cosine": c[rows, top.ravel()]})
        return out[np.isfinite(out["cosine"])]

    found = both.groupBy("label", "a", "b").applyInPandas(best, f"id {kinds['id']}, label {kinds['label']}, other {kinds['id']}, cosine double")
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("other").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_matrix_pairs(a: DataFrame, b: DataFrame, keys: list[str], va: str, vb: str) -> DataFrame:
    """All pairs of a key, a keyframe for example, with their cosine."""
    return a.join(b, keys).withColumn("cosine", cosine(F.col(va), F.col(vb)))


def neighbour_distances(vectors: DataFrame, reference: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """id and distance to the k-th nearest reference vector other than itself.

    The reference is a sample of at most ``REFERENCE`` rows, more raise; it is collected and broadcast, and every
    row is compared to it in blocks.
    """
    if reference.limit(REFERENCE + 1).count() > REFERENCE:
        raise ValueError(f"a reference of more than {REFERENCE} rows")
    ref = reference.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).toPandas().sort_values("id")
    ids, y = ref["id"].to_numpy(), np.stack(ref["v"].to_numpy()) if len(ref) else np.empty((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, y))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = np.stack(part.column("v").to_numpy(zero_copy_only=False))
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)) if len(y) else np.empty((len(x), 0))
                d[np.array(part.column("id").to_pylist())[:, None] == ids[None]] = np.inf
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.nan)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(kth)], ["id", "distance"])

    return rows.mapInArrow(far, f"id {dict(rows.dtypes)['id']}, distance double")


def outliers(distances: DataFrame, share: float = 0.75, digits: int = 6) -> DataFrame:
    """Adds ``score`` (1 - the median distance over its own, at least 0) and ``outlier`` (score over ``share``'s quantile of scores)."""
    d = kept(distances.withColumn("distance", F.round("distance", digits)))
    quantile = lambda c, at, out: percentiles(d, [], c, (at,)).select(F.col("percentiles")[0].alias(out))
    d = matched(d, quantile("distance", 0.5, "__m"), [], "left").withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("__m") / F.greatest("distance", F.lit(1e-12))), digits)).drop("__m")
    return matched(d, quantile("score", share, "__e"), [], "left").withColumn("outlier", F.col("score") > F.col("__e")).drop("__e")
