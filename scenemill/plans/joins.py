"""Queries on pairings, lookups, roll-ups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assign, evaluate, ground, joins, track
from ..sources.tables import table
from . import inputs
from .grouped import _candidates
from .registry import query


@query("SELECT o_orderkey, o_custkey, o_totalprice AS price, o_totalprice * 2 AS b_price FROM orders")
def paired_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Two arms of the same orders, one to one, with equal identity columns."""
    a = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    b = a.withColumn("price", F.col("price") * 2)
    return joins.paired(a, b, ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey", "price", "b_price")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def looked_up(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.looked_up(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", required=False).select("o_orderkey", "c_mktsegment")


@query("""
WITH p AS (SELECT p_size, round(p_retailprice, 0) AS price, min(p_partkey) AS p_partkey FROM part GROUP BY ALL)
SELECT p.p_partkey AS first_part, q.p_partkey FROM part q LEFT JOIN p ON q.p_size = p.p_size AND round(q.p_retailprice + 0.0::DOUBLE, 0) = p.price
""")
def rounded_lookup(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_size", "p_retailprice", "p_partkey")
    found = parts.withColumnRenamed("p_partkey", "first_part")
    return joins.rounded_lookup(parts, found, ["p_size"], ["p_retailprice"], 0).select("first_part", "p_partkey")


@query("""
SELECT c_custkey, n_name AS nation, r_name AS region, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with what three tables say of them."""
    base = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = nation.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_nationkey", "r_name")
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    out = joins.enriched(joins.enriched(base, "c_nationkey", nation=nation.select("c_nationkey", "n_name"), region=region), "c_custkey", orders=orders)
    return out.select("c_custkey", F.col("nation.n_name").alias("nation"), F.col("region.r_name").alias("region"), F.coalesce("orders.n", F.lit(0)).alias("n_orders"))


@query("SELECT n_regionkey, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_nationkey)")
def scene_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counters by scene and run, in one pass."""
    rows = table(spark, folder, "customer").join(joins.small(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return evaluate.rolled_up(rows, ["n_regionkey", "c_nationkey"], F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(20,2)")).cast("double"), 2).alias("total"))


@query("SELECT l_returnflag AS keyframe, l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("keyframe"), F.col("l_linenumber").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT count(*) AS n_chains, sum(n)::BIGINT AS n_rows, round(avg(n), 6) AS mean_length, quantile_cont(n, 0.5) AS median_length, round(coalesce(sum(n) FILTER (n >= 10), 0) / sum(n), 6) AS share_on_long FROM c
""")
def stitch_statistics(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.chain_statistics(table(spark, folder, "orders"), ["o_custkey"], 10)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_length", "share_on_long")})


@query("""
WITH m AS (SELECT c_custkey % 20 AS image, c_nationkey AS px, c_custkey % 2 = 0 AS road FROM customer)
SELECT image, px, bool_or(road) AS road, count(*) FILTER (road) AS votes FROM m GROUP BY image, px HAVING NOT (bool_or(NOT road) AND bool_or(road) AND count(*) FILTER (road) < 2)
""")
def mask_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of masks with votes; of contested pixels those with fewer than two votes go to the side walk and are left out."""
    m = table(spark, folder, "customer").select((F.col("c_custkey") % 20).alias("image"), F.col("c_nationkey").alias("px"), (F.col("c_custkey") % 2 == 0).alias("road"))
    union = evaluate.mask_union(m, ["image", "px"], "road")
    side = union.where("votes < 2 AND n > votes AND road").select("image", "px")
    return union.join(side, ["image", "px"], "left_anti").select("image", "px", "road", "votes")


@query(f"""
WITH {inputs.IMAGE_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, index) AS place FROM boxes)
SELECT image, index, place::INTEGER AS place FROM r WHERE place <= 3
""")
def within_capacity(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.image_boxes(spark, folder).select("image", "index", "score")
    return track.within_capacity(rows, ["image"], "score", "index", 3).select("image", "index", "place")


@query("""
WITH m AS (SELECT user_id, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
                  covar_samp(x, x) AS sxx, covar_samp(x, y) AS sxy, covar_samp(y, y) AS syy
           FROM (SELECT user_id, value % 40.0::DOUBLE AS x, (event_id % 29)::DOUBLE AS y, value % 7.0::DOUBLE + event_id % 3 AS z FROM events) GROUP BY user_id),
s AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM m WHERE n >= 3)
SELECT user_id, n, round(a, 6) AS a, round(b, 6) AS b, round(mz - a * mx - b * my, 5) AS c,
       round(((sxx + syy) / 2 + sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2)) / ((sxx + syy) / 2 - sqrt(((sxx - syy) / 2) ** 2 + sxy ** 2)), 5) AS ratio FROM s
""")
def least_squares_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Planes through points, and how long their footprints are, from sums of products."""
    c = F.col
    points = table(spark, folder, "events").select("user_id", (c("value") % 40.0).alias("x"), (c("event_id") % 29).cast("double").alias("y"), (c("value") % 7.0 + c("event_id") % 3).alias("z"))
    out = ground.plane_sums(points, ["user_id"]).join(ground.spread_ratio(points, ["user_id"]), "user_id").where("n >= 3")
    return out.select("user_id", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 5).alias("c"), F.round("ratio", 5).alias("ratio"))


@query("""
SELECT user_id, max(abs(value % 3.0::DOUBLE)) AS largest_delta, max(abs(value % 3.0::DOUBLE)) = 0 AS degraded FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM events) GROUP BY user_id
""")
def motion_deltas(spark: SparkSession, folder: str) -> DataFrame:
    c, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    pose = lambda x: F.struct(F.struct(x.alias("x"), zero.alias("y"), zero.alias("z")).alias("t"), F.struct(one.alias("w"), zero.alias("x"), zero.alias("y"), zero.alias("z")).alias("q"))
    value = F.when(c("user_id") % 2 == 0, 0.0).otherwise(c("value")) % 3.0
    return ground.motion_deltas(table(spark, folder, "events").select("user_id", pose(value).alias("camera_pose"), pose(zero).alias("scan_pose")), "user_id")


_SWEEPS = """
s AS (SELECT o_custkey AS scene, o_orderkey AS sweep, epoch_us(o_orderdate) AS t, o_totalprice % 10.0::DOUBLE AS x, o_custkey * 0.1::DOUBLE AS y, o_totalprice % 3.0::DOUBLE AS a, o_orderkey % 4 = 0 AS is_key FROM orders)"""


@query(f"""WITH {_SWEEPS}
SELECT s.scene, s.sweep, k.sweep AS keyframe, round((k.t - s.t) / 1e6, 6) AS age_s,
       round((s.x + 2 * cos(s.a) - sin(s.a) - k.x) * cos(k.a) + (s.y + 2 * sin(s.a) + cos(s.a) - k.y) * sin(k.a), 6) + 0.0::DOUBLE AS x,
       round((s.y + 2 * sin(s.a) + cos(s.a) - k.y) * cos(k.a) - (s.x + 2 * cos(s.a) - sin(s.a) - k.x) * sin(k.a), 6) + 0.0::DOUBLE AS y
FROM s JOIN s k ON s.scene = k.scene AND k.is_key AND s.t <= k.t AND s.t >= k.t - 86400000000 * 60""")
def accumulated_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """A point of each sweep, moved into the frame of every keyframe that lies within 60 days behind."""
    from ..functions import geometry as G

    c, zero = F.col, F.lit(0.0)
    orders = table(spark, folder, "orders")
    pose = G.Pose(G.Vec(c("o_totalprice") % 10.0, c("o_custkey") * 0.1, zero), G.quat_of_yaw(c("o_totalprice") % 3.0)).struct
    poses = orders.select(c("o_custkey").alias("scene"), c("o_orderkey").alias("sweep"), (inputs.micros(c("o_orderdate")) * 1000).alias("t_ns"), (c("o_orderkey") % 4 == 0).alias("is_keyframe"), pose.alias("pose"))
    points = orders.select(c("o_custkey").alias("scene"), c("o_orderkey").alias("sweep"), G.Vec(F.lit(2.0), F.lit(1.0), zero).struct.alias("point"))
    out = ground.accumulated(points, poses, "scene", 86400 * 60 * 10**9)
    return out.select("scene", "sweep", "keyframe", F.round("age_s", 6).alias("age_s"), (F.round("point.x", 6) + 0.0).alias("x"), (F.round("point.y", 6) + 0.0).alias("y"))


@query()
def best_overlap_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of an image and class that take a truth: greedy by score, best overlap first."""
    pairs = _candidates(spark, folder, 0.1).withColumn("class", F.col("pred") % 2)
    hit = assign.greedy_matches(pairs, ["image", "class"], "pred", "gt", "score", "iou", 0.3).select("image", "pred", F.lit(True).alias("hit"))
    return pairs.select("image", "pred", "class", "score").distinct().join(hit, ["image", "pred"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query()
def nearest_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes in space taken one to one by distance, the best scored first."""
    from ..operators import pairs as P

    b = inputs.solid_boxes(spark, folder).select("image", "index", "x", "y", F.round("confidence", 6).alias("confidence"))
    near = P.grid_pairs(b.where("index % 2 = 1"), b.where("index % 2 = 0"), "x", "y", 15.0, ["image"])
    near = near.select("image", F.col("index").alias("pred"), F.col("b_index").alias("gt"), "confidence", "distance")
    return assign.greedy_matches(near, ["image"], "pred", "gt", "confidence", "distance", 15.0, nearest=True).select("image", "pred", "gt", F.round("distance", 6).alias("distance"))
