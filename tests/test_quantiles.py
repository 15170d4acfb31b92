"""Exact percentiles by brackets and counts against those of one buffer, and numbering without one sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scenemill.operators import filters, quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.95, 0.999, 1.0)


def rows(kind):
    rng = random.Random(kind)
    draw = {
        "heavy tails": lambda: math.exp(rng.gauss(0, 40)) * rng.choice((-1, 1)),
        "ties": lambda: float(rng.choice((1, 1, 1, 1, 2, 7))),
        "mixed": lambda: rng.choice((0.0, 0.0, -0.0, rng.random(), float("nan"), float("inf"))),
    }[kind]
    out = [(None if k % 3 == 0 else f"g{k % 3}", draw()) for k in range(6000)]
    return [*out, ("one", 4.5), ("two", 1.0), ("two", 2.0), ("nothing", None), ("g1", None)]


@pytest.mark.parametrize("kind", ["heavy tails", "ties", "mixed"])
@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_percentiles(spark, kind, most):
    data = spark.createDataFrame(rows(kind), "g string, x double").repartition(5)
    want = data.groupBy("g").agg(F.percentile(F.col("x") + 0.0, F.array(*map(F.lit, SHARES))).alias("p")).where("p is not null").collect()
    got = {r["g"]: r["percentiles"] for r in quantiles.percentiles(data, ["g"], "x", SHARES, most).collect()}
    assert {k: list(map(repr, v)) for k, v in got.items()} == {r["g"]: list(map(repr, r["p"])) for r in want}


def test_percentiles_of_all_rows_and_of_none(spark):
    data = spark.createDataFrame(rows("ties"), "g string, x double")
    want = data.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5)))).first()[0]
    assert quantiles.percentiles(data, [], "x", (0.1, 0.5), 2).first()["percentiles"] == want
    assert quantiles.percentiles(data.where("false"), ["g"], "x", (0.5,), 2).count() == 0
    assert quantiles.percentiles(data.where("false"), [], "x", (0.5,), 2).count() == 0


def test_every_stride_without_keys(spark):
    data = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("x"))
    got = sorted(r["x"] for r in filters.strided(data, ["x"], 7, 3).collect())
    assert got == list(range(3, 1000, 7))
    assert filters.strided(data.where("false"), ["x"], 7, 3).count() == 0
