"""Queries of metrics: precision and recall, box errors, thresholds, summaries and comparisons of runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources.tables import table
from . import inputs
from .registry import query


@query("""
WITH p AS (SELECT l_linestatus, l_linenumber, count(*) AS n_pred, count(*) FILTER (l_discount > 0.05) AS tp FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL),
g AS (SELECT l_linestatus, l_linenumber, count(*) AS n_gt FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT l_linestatus, l_linenumber, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_gt, 0) AS n_gt,
       round(CASE WHEN n_pred > 0 THEN tp / n_pred END, 9) AS precision, round(CASE WHEN n_gt > 0 THEN coalesce(tp, 0) / n_gt END, 9) AS recall
FROM p FULL JOIN g USING (l_linestatus, l_linenumber)
""")
def precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    out = evaluate.precision_recall(rows.where("l_linenumber < 6").withColumn("matched", F.col("l_discount") > 0.05), rows.where("l_linenumber > 1"), ["l_linestatus", "l_linenumber"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


_TURN = f"{2 * math.pi!r}::DOUBLE"


@query(f"""
WITH {inputs.SOLID_BOXES},
e AS (SELECT p.category, sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS te,
             least(p.w, g.w) * least(p.l, g.l) * least(p.h, g.h) AS common, p.w * p.l * p.h + g.w * g.l * g.h - common AS whole,
             abs((p.yaw - g.yaw) - {_TURN} * round_even((p.yaw - g.yaw) / {_TURN}, 0)) AS turned, p.n_points >= 10 AS trusted
      FROM solids p JOIN solids g ON p.image = g.image AND g.index = p.index + 1)
SELECT category, count(*) AS n, round(avg(te), 6) AS ate, round(avg(1 - common / whole), 6) AS ase, round(avg(CASE WHEN trusted THEN least(turned, {math.pi!r}::DOUBLE - turned) END), 6) AS aoe FROM e GROUP BY category
""")
def ate_ase_aoe(spark: SparkSession, folder: str) -> DataFrame:
    """Each box against the next of its image, as if it were its truth."""
    b = inputs.solid_boxes(spark, folder)
    side = lambda s: [F.struct("x", "y", "z").alias(s), F.struct("w", "l", "h").alias(f"{s}_size"), F.col("yaw").alias(f"{s}_yaw")]
    p = b.select("image", "index", "category", *side("p"), (F.col("n_points") >= 10).alias("trusted"))
    g = b.select("image", (F.col("index") - 1).alias("index"), *side("g"))
    out = evaluate.box_errors(p.join(g, ["image", "index"]), ["category"])
    return out.withColumns({c: F.round(c, 6) for c in ("ate", "ase", "aoe")})


@query("""
WITH r AS (SELECT l_linestatus, l_linenumber, l_discount * 9.0::DOUBLE + l_tax AS score, l_returnflag = 'R' AS tp FROM lineitem),
a AS (SELECT l_linestatus, l_linenumber, count(*) FILTER (tp) AS n_tp, quantile_cont(score, 0.95) FILTER (NOT tp) AS p95 FROM r GROUP BY ALL),
s AS (SELECT l_linestatus, l_linenumber, t, count(*) FILTER (tp AND floor(score * 100 + 1e-9::DOUBLE) >= t) AS tp, count(*) FILTER (NOT tp AND floor(score * 100 + 1e-9::DOUBLE) >= t) AS fp
      FROM r, range(20, 96) AS grid(t) GROUP BY ALL),
f AS (SELECT s.*, n_tp, p95, CASE WHEN s.tp > 0 THEN 1.25::DOUBLE * (s.tp / (s.tp + fp)) * (s.tp / n_tp) / (0.25::DOUBLE * (s.tp / (s.tp + fp)) + s.tp / n_tp) ELSE 0 END AS f
      FROM s JOIN a USING (l_linestatus, l_linenumber)),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_linestatus, l_linenumber ORDER BY f DESC, t) = 1)
SELECT l_linestatus, l_linenumber, n_tp, round(CASE WHEN n_tp >= 5 THEN t / 100 ELSE coalesce(p95, 0.95) END, 6) AS threshold, round(CASE WHEN n_tp >= 5 THEN f END, 6) AS f_beta FROM b
""")
def f_beta_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").withColumn("score", F.col("l_discount") * 9.0 + F.col("l_tax")).withColumn("tp", F.col("l_returnflag") == "R")
    out = evaluate.tuned_thresholds(rows, ["l_linestatus", "l_linenumber"], "score", "tp")
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", "f_beta")})


@query("SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def metric_spread(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.spread(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("median", "p10", "p90")})


@query("SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type)::INTEGER AS rank FROM events GROUP BY user_id, event_type")
def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.histogram(table(spark, folder, "events"), ["user_id"], "event_type")


@query("SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def run_pivot(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.runs_compared(counts, "o_orderstatus", "o_orderpriority", "n", ["F", "O", "P"])


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT user_id, event_type AS category FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
SELECT user_id, count(DISTINCT ts::DATE) AS n_keyframes, sum(value::DECIMAL(20,6))::DOUBLE / count(value) AS mean_value, sum((value / 3)::DECIMAL(20,6))::DOUBLE / count(value) AS mean_third, sum(sqrt(value * value + value / 3 * (value / 3))::DECIMAL(20,6))::DOUBLE / count(value) AS mean_speed, category
FROM events JOIN m USING (user_id) GROUP BY user_id, category
""")
def track_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("day", F.to_date("ts")).withColumn("third", F.col("value") / 3)
    return evaluate.track_summary(rows, ["user_id"], "event_type", "day", ["value", "third"])


@query(f"""
WITH {inputs.SOLID_BOXES}
SELECT category, CASE WHEN sqrt(x * x + y * y) > 40 THEN 'out_of_range' WHEN n_points < 5 THEN 'few_points' WHEN category IN ('3', '7') THEN 'unmapped' WHEN NOT confidence > 0.25 THEN 'unreachable' END AS rejected, count(*) AS n
FROM solids GROUP BY ALL
""")
def eligible_truths(spark: SparkSession, folder: str) -> DataFrame:
    """Truths by why they don't count."""
    rows = inputs.solid_boxes(spark, folder).withColumn("phrase", F.when(~F.col("category").isin("3", "7"), F.col("category"))).withColumn("reachable", F.col("confidence") > 0.25)
    return evaluate.eligible_truths(rows).groupBy("category", "rejected").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {inputs.SOLID_BOXES},
h AS (SELECT p.image, p.index, p.n_points >= 20 AS painted, b.index AS box, b.n_points >= 5 AS counted
      FROM solids p JOIN solids b ON p.image = b.image WHERE abs(p.x - b.x) <= b.l * 2 AND abs(p.y - b.y) <= b.w * 2 AND abs(p.z - b.z) <= b.h / 2),
i AS (SELECT DISTINCT image, index FROM h),
r AS (SELECT count(*) AS n_points, count(*) FILTER (n_points >= 20) AS n_painted, count(i.image) AS n_inside, count(i.image) FILTER (n_points >= 20) AS n_painted_inside FROM solids s LEFT JOIN i ON s.image = i.image AND s.index = i.index),
c AS (SELECT count(*) AS n_covered FROM (SELECT image, box FROM h WHERE painted AND counted GROUP BY ALL HAVING count(*) >= 2)),
b AS (SELECT count(*) AS n_boxes FROM solids WHERE n_points >= 5)
SELECT n_points, n_painted, n_inside, n_painted_inside, n_covered, n_boxes, round(n_inside / n_points, 9) AS base_rate, round(n_painted_inside / n_painted, 9) AS painted_rate,
       round((n_painted_inside / n_painted) / (n_inside / n_points), 9) AS enrichment, round(n_covered / n_boxes, 9) AS coverage FROM r, c, b
""")
def paint_report(spark: SparkSession, folder: str) -> DataFrame:
    """Box centres as points, a part of them painted, against boxes four times as long and wide."""
    b = inputs.solid_boxes(spark, folder)
    points = b.select("image", "index", "x", "y", "z", (F.col("n_points") >= 20).alias("painted"))
    size = F.struct((F.col("w") * 4).alias("w"), (F.col("l") * 4).alias("l"), "h")
    still = F.struct(F.lit(1.0).alias("w"), *(F.lit(0.0).alias(c) for c in "xyz"))
    boxes = b.select("image", F.col("index").alias("box"), F.struct("x", "y", "z").alias("center"), size.alias("size"), still.alias("q"), (F.col("n_points") >= 5).alias("counted"))
    out = evaluate.paint_report(points, boxes, ["image"], 2)
    return out.withColumns({c: F.round(c, 9) for c in ("base_rate", "painted_rate", "enrichment", "coverage")})


@query("""
WITH l AS (SELECT p_size AS epoch, round(avg(p_retailprice), 4) AS map50, count(*)::DOUBLE AS recall FROM part GROUP BY p_size)
SELECT epoch, map50, recall, round(map50 * 0.1::DOUBLE + recall * 0.9::DOUBLE, 6) AS fitness FROM l ORDER BY fitness DESC, epoch LIMIT 1
""")
def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "part").groupBy(F.col("p_size").alias("epoch")).agg(F.round(F.avg("p_retailprice"), 4).alias("map50"), F.count(F.lit(1)).cast("double").alias("recall"))
    return evaluate.best_epoch(log, {"map50": 0.1, "recall": 0.9}).withColumn("fitness", F.round("fitness", 6))
