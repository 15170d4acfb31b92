"""Queries of a release: human coverage, tiers, strata, the second annotation's sample, checks and stitching."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import release
from ..sources.tables import table
from . import inputs
from .registry import query

_COVERAGE = """cov AS (SELECT c_custkey AS s, 'A' AS p FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 5 = 0
         UNION ALL SELECT c_custkey, 'B' FROM customer WHERE c_custkey % 6 = 0)"""


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Samples (customers) that the annotator passes A, B and the review (null) cover."""
    key = table(spark, folder, "customer").select(F.col("c_custkey").alias("sample_token"))
    of = lambda n, p: key.where(F.col("sample_token") % n == 0).withColumn("annotator_pass", F.lit(p).cast("string"))
    return of(4, "A").unionByName(of(5, None)).unionByName(of(6, "B"))


@query(f"""
WITH {_COVERAGE},
passes AS (SELECT s, bool_or(coalesce(p = 'A', false)) AS a, bool_or(p IS NULL) AS review FROM cov GROUP BY s),
r AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS is_human, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END END AS annotator_pass,
             CASE WHEN o_orderpriority < '3' THEN 'auto_accept' WHEN o_orderpriority < '4' THEN 'flagged' ELSE 'rejected' END AS tier FROM orders),
m AS (SELECT r.*, CASE WHEN NOT is_human AND a THEN 'double_A' WHEN NOT is_human AND review THEN 'review' WHEN is_human AND annotator_pass IS NULL AND a THEN 'double_A' END AS superseded_by
      FROM r LEFT JOIN passes ON o_custkey = s)
SELECT o_orderkey, is_human, superseded_by,
       CASE WHEN superseded_by IS NOT NULL THEN 'superseded_by_' || superseded_by WHEN NOT is_human AND tier <> 'auto_accept' THEN 'tier_' || tier
            WHEN NOT is_human AND o_orderkey % 4 = 0 AND o_orderkey % 11 < 5 THEN 'interpolated_below_floor' END AS reason
FROM m
""")
def tier_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Human and pipeline rows together, and why each is left out of the release, if it is."""
    p = F.col("o_orderpriority")
    rows = table(spark, folder, "orders").withColumn("sample_token", F.col("o_custkey"))
    tier = F.when(p < "3", "auto_accept").when(p < "4", "flagged").otherwise("rejected")
    pipeline = rows.where("o_orderstatus <> 'F'").select("o_orderkey", "sample_token", tier.alias("tier"), (F.col("o_orderkey") % 4 == 0).alias("interpolated"), (F.col("o_orderkey") % 11).alias("n_points"))
    by = F.when(F.col("o_orderkey") % 3 == 1, "A").when(F.col("o_orderkey") % 3 == 2, "B")
    human = rows.where("o_orderstatus = 'F'").select("o_orderkey", "sample_token", by.alias("annotator_pass"))
    out = release.partitioned(release.human_merged(pipeline, human, _coverage(spark, folder)))
    return out.select("o_orderkey", "is_human", "superseded_by", "reason")


@query("SELECT c_custkey AS sample_token FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 4 <> 0")
def half_imported(spark: SparkSession, folder: str) -> DataFrame:
    return release.half_imported(_coverage(spark, folder))


@query(f"""
WITH {inputs.SOLID_BOXES}, n AS (SELECT image, count(*) AS n FROM solids WHERE sqrt(x * x + y * y) <= 30 GROUP BY image)
SELECT o_orderkey AS image, round(coalesce(n, 0) / {math.pi * 900!r}::DOUBLE, 9) AS density FROM orders LEFT JOIN n ON image = o_orderkey
""")
def density_by_frame(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "orders").select(F.col("o_orderkey").alias("image"))
    return release.density_by_frame(frames, inputs.solid_boxes(spark, folder), "image").withColumn("density", F.round("density", 9))


@query("""
WITH p AS (SELECT l_orderkey AS frame, (l_partkey % 256)::DOUBLE AS r, (l_suppkey % 256)::DOUBLE AS g, l_quantity::DOUBLE AS b FROM lineitem),
y AS (SELECT frame, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM p)
SELECT o_orderkey AS frame, round((SELECT avg(y) FROM y WHERE frame = o_orderkey AND y <= 60), 6) AS illumination FROM orders
""")
def illumination(spark: SparkSession, folder: str) -> DataFrame:
    """The light of every order's frame, whose pixels are its lines."""
    c = F.col
    pixels = table(spark, folder, "lineitem").select(c("l_orderkey").alias("frame"), (c("l_partkey") % 256).cast("double").alias("r"), (c("l_suppkey") % 256).cast("double").alias("g"), c("l_quantity").cast("double").alias("b"))
    out = release.illumination(table(spark, folder, "orders").select(c("o_orderkey").alias("frame")), pixels, "frame", 60.0)
    return out.withColumn("illumination", F.round("illumination", 6))


@query("""
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT quantile_cont(n, [0.25, 0.5, 0.75]) AS e FROM d)
SELECT day, n, ['Low', 'Medium', 'High', 'Extreme'][1 + (n >= e[1])::INTEGER + (n >= e[2])::INTEGER + (n >= e[3])::INTEGER] AS stratum FROM d, e
""")
def strata_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Days by which quarter of the days their number of orders falls into."""
    days = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return release.stratified(days, "n", (0.25, 0.5, 0.75), ("Low", "Medium", "High", "Extreme"))


_ALLOCATED = """c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, (sum(n) OVER ())::BIGINT AS total, least(greatest(ceil((sum(n) OVER ())::BIGINT * 0.05::DOUBLE)::BIGINT, count(*) OVER ()), (sum(n) OVER ())::BIGINT) AS target FROM c),
x AS (SELECT *, n * target / total AS exact FROM t),
b AS (SELECT *, least(greatest(floor(exact), 1), n)::BIGINT AS base, exact - floor(exact) AS part FROM x),
l AS (SELECT *, greatest(target - (sum(base) OVER ())::BIGINT, 0) AS open, row_number() OVER (ORDER BY n = base, part DESC, o_orderpriority, o_orderstatus) AS turn FROM b),
cells AS (SELECT o_orderpriority, o_orderstatus, n, base + (n > base AND turn <= open)::BIGINT AS selected FROM l)"""


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["o_orderpriority", "o_orderstatus"]
    return release.allocated(table(spark, folder, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, 0.05)


@query(f"WITH {_ALLOCATED} SELECT * FROM cells")
def double_allocation(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each cell are annotated twice: a twentieth in all, one of each cell at least."""
    return _cells(spark, folder)


@query(f"""
WITH {_ALLOCATED}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5('20260812:' || o_orderkey), o_orderkey) AS rank FROM orders)
SELECT o_orderkey FROM r JOIN cells USING (o_orderpriority, o_orderstatus) WHERE rank <= selected
""")
def double_selection(spark: SparkSession, folder: str) -> DataFrame:
    return release.chosen(table(spark, folder, "orders"), _cells(spark, folder), ["o_orderpriority", "o_orderstatus"], "o_orderkey").select("o_orderkey")


@query(f"""
WITH {inputs.SOLID_BOXES},
a AS (SELECT image || '-' || index AS token, image AS instance_token, CASE WHEN index > 0 AND image % 13 <> 0 THEN image || '-' || (index - 1) END AS prev,
             CASE WHEN index + 1 < count(*) OVER (PARTITION BY image) THEN image || '-' || (index + 1) END AS next, index, image, l, w, n_points, confidence FROM solids),
i AS (SELECT o_orderkey AS token, o_orderkey % 5 AS category, coalesce(n, 0) + (o_orderkey % 17 = 0)::INTEGER AS nbr, coalesce(n, 0) AS n, coalesce(heads, 0) AS heads
      FROM orders LEFT JOIN (SELECT image, count(*) AS n, count(*) FILTER (prev IS NULL) AS heads FROM a GROUP BY image) ON image = o_orderkey WHERE o_orderkey % 19 <> 0),
f AS (
  SELECT 'dangling_instance' AS kind, 'error' AS severity FROM a WHERE instance_token NOT IN (SELECT token FROM i)
  UNION ALL SELECT 'dangling_sample', 'error' FROM a WHERE image % 23 = 0
  UNION ALL SELECT 'dangling_category', 'error' FROM i WHERE category = 4
  UNION ALL SELECT 'quaternion_norm', 'error' FROM a WHERE image % 29 = 0
  UNION ALL SELECT 'size_not_positive', 'error' FROM a WHERE image % 31 = 0
  UNION ALL SELECT 'links_not_symmetric', 'error' FROM a WHERE next IS NOT NULL AND image % 13 = 0
  UNION ALL SELECT 'human_unverified', 'error' FROM a WHERE image % 3 = 0 AND image % 2 = 0
  UNION ALL SELECT 'wrong_tier', 'error' FROM a WHERE image % 3 <> 0 AND confidence < 0.15
  UNION ALL SELECT 'below_point_floor', 'error' FROM a WHERE image % 3 <> 0 AND index % 2 = 1 AND n_points < 5
  UNION ALL SELECT 'annotation_count', 'error' FROM i WHERE nbr <> n
  UNION ALL SELECT 'chain_ends', 'error' FROM i WHERE n > 0 AND heads <> 1
  UNION ALL SELECT 'instance_without_annotations', 'warning' FROM i WHERE n = 0
  UNION ALL SELECT 'wider_than_long', 'warning' FROM a WHERE CASE WHEN image % 31 = 0 THEN 0 ELSE w END > l)
SELECT kind, severity, count(*) AS n FROM f GROUP BY ALL
""")
def release_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of what the checks find in annotations with planted faults."""
    b, orders = inputs.solid_boxes(spark, folder), table(spark, folder, "orders")
    image, index = F.col("image"), F.col("index")
    name = lambda i: F.concat_ws("-", image, i)
    sizes = b.groupBy("image").agg(F.count(F.lit(1)).alias("n_all"))
    rows = b.join(sizes, "image").select(
        name(index).alias("token"),
        image.alias("instance_token"),
        image.alias("sample_token"),
        F.when((index > 0) & (image % 13 != 0), name(index - 1)).alias("prev"),
        F.when(index + 1 < F.col("n_all"), name(index + 1)).alias("next"),
        F.array(F.when(image % 29 == 0, 2.0).otherwise(1.0), *[F.lit(0.0)] * 3).alias("rotation"),
        F.array(F.when(image % 31 == 0, 0.0).otherwise(F.col("w")), "l", "h").alias("size"),
        (image % 3 == 0).alias("is_human"),
        F.when(image % 2 != 0, "someone").alias("verified_by"),
        F.when(F.col("confidence") < 0.15, "flagged").otherwise("auto_accept").alias("tier"),
        (index % 2 == 1).alias("interpolated"),
        "n_points",
    )
    instances = orders.where("o_orderkey % 19 <> 0").join(sizes, F.col("o_orderkey") == image, "left").select(F.col("o_orderkey").alias("token"), (F.col("o_orderkey") % 5).alias("category_token"), (F.coalesce("n_all", F.lit(0)) + (F.col("o_orderkey") % 17 == 0).cast("int")).alias("nbr_annotations"))
    samples = orders.where("o_orderkey % 23 <> 0").select(F.col("o_orderkey").alias("token"))
    found = release.violations(rows, instances, samples, spark.range(4).toDF("token"))
    return found.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def _pieces(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Fragments: a user's days, cut every fourth day; ten users are a scene."""
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    rows = table(spark, folder, "events").groupBy((F.col("user_id") % 10).alias("scene"), "user_id", day.alias("step")).agg(F.round(F.avg("value"), 6).alias("x"))
    rows = rows.select("scene", F.concat_ws("-", "user_id", F.floor(F.col("step") / 4)).alias("track"), "step", (F.col("step") * 0.4).alias("t"), (F.col("x") / 100).alias("x"), (F.col("user_id") * 1.0).alias("y"), F.lit("car").alias("category"), F.lit(1.8).alias("w"), F.lit(4.5).alias("l"))
    return release.fragments(rows, ["scene"], "track", "step", ["x", "y"], "t"), ["scene"]


@query()
def stitch_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Fragments joined across gaps of up to three steps, with the chain each belongs to; tests check the chains."""
    pieces, scene = _pieces(spark, folder)
    return release.chains_of(pieces, release.stitched(pieces, scene, "track"), scene, "track")
