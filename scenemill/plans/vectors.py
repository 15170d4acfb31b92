"""Queries on embeddings: nearest others of a class, and outliers by the distance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density, filters, vectors
from ..sources.tables import table
from .registry import query

_NEAREST = """c AS (SELECT a.vec_id AS id, a.label, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
                   FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, other)::INTEGER AS rank FROM c QUALIFY rank <= 3)"""


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.nearest_in_class(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 3)


@query(f"WITH {_NEAREST} SELECT id, label, other, cosine, rank FROM n")
def reid_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder)


@query(f"""
WITH {_NEAREST},
d AS (SELECT id, round(1 - cosine, 6) AS distance FROM n WHERE rank = 3),
m AS (SELECT quantile_cont(distance, 0.5) AS m FROM d),
s AS (SELECT id, distance, round(greatest(0, 1 - m / greatest(distance, 1e-12::DOUBLE)), 6) AS score FROM d, m),
e AS (SELECT quantile_cont(score, 0.75) AS e FROM s)
SELECT id, distance, score, score > e AS outlier FROM s, e
""")
def ood_knn_outlier(spark: SparkSession, folder: str) -> DataFrame:
    """Outliers by the distance (1 - cosine) to the third nearest other vector of the class."""
    far = _nearest(spark, folder).where("rank = 3").select("id", (1 - F.col("cosine")).alias("distance"))
    return vectors.outliers(far)


@query()
def density_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and outliers by density in a sample, one in ten vectors from a seeded offset on."""
    sample = filters.strided(table(spark, folder, "embeddings"), ["vec_id"], 10, filters.seeded_offset(20260812, 10))
    return density.density_outliers(sample, [], "vec_id", "embedding").withColumn("score", F.round("score", 6))
