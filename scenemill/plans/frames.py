"""Queries on ordered rows: links, velocities, gap filling, interpolation between poses, windows and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import sequence
from ..sources.tables import table
from .inputs import micros
from .registry import query


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("t", micros(F.col("ts")))


@query("""
SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next,
       first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_token,
       last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_token,
       count(*) OVER (PARTITION BY user_id) AS n_in_chain
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def links_prev_next(spark: SparkSession, folder: str) -> DataFrame:
    out = sequence.linked(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_id")
    return out.select("event_id", "prev", "next", "first_token", "last_token", "n_in_chain")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
n AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(value) OVER w AS x0, lead(value) OVER w AS x1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
d AS (SELECT *, coalesce(t1, t) - coalesce(t0, t) AS dt, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 80000 ELSE 40000 END AS most FROM n),
v AS (SELECT event_id, event_type, CASE WHEN dt > 0 AND dt <= most THEN (coalesce(x1, value) - coalesce(x0, value)) / dt END AS v FROM d)
SELECT event_id, round(v, 9) AS v_value,
       CASE event_type WHEN 'purchase' THEN 'cycle.with_rider'
                       WHEN 'view' THEN CASE WHEN abs(v) * 1000 > 0.5 THEN 'vehicle.moving' WHEN abs(v) * 1000 <= 0.5 THEN 'vehicle.stopped' END
                       WHEN 'click' THEN CASE WHEN abs(v) * 1000 > 0.5 THEN 'pedestrian.moving' WHEN abs(v) * 1000 <= 0.5 THEN 'pedestrian.standing' END END AS attribute
FROM v
""")
def chain_velocity_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Slopes of the value along a user's events, and the state of motion by kind of event."""
    rows = _events(spark, folder).withColumn("t", F.col("t") / 1e6)
    out = sequence.chain_velocity(rows, ["user_id"], "t", ["value"], 40000.0, ["t", "event_id"])
    kind = F.when(F.col("event_type") == "purchase", "cycle").when(F.col("event_type") == "view", "vehicle").when(F.col("event_type") == "click", "pedestrian")
    return out.select("event_id", F.round("v_value", 9).alias("v_value"), sequence.attribute_of(kind, F.abs("v_value") * 1000).alias("attribute"))


@query("""
WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL),
n AS (SELECT *, lead(day) OVER w AS to_day, lead(value) OVER w AS to_value FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
f AS (SELECT *, unnest(range(day + 1, to_day)) AS at_day FROM n WHERE to_day - day > 1 AND to_day - day <= 4)
SELECT user_id, day, round(value, 5) AS value, false AS interpolated FROM d
UNION ALL SELECT user_id, at_day::INTEGER, round(value + (to_value - value) * ((at_day - day) / (to_day - day)), 5), true FROM f
""")
def stitch_gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Users' daily means with gaps of up to three days filled on the line between their ends."""
    days = table(spark, folder, "events").groupBy("user_id", F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    return sequence.gap_filled(days, ["user_id"], "day", ["value"], 3).withColumn("value", F.round("value", 5))


@query("""
WITH p AS (SELECT user_id, epoch_us(ts) AS t, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL),
s AS (SELECT user_id, t AS t0, value AS v0, lead(t) OVER w AS t1, lead(value) OVER w AS v1, lag(t) OVER w IS NULL AS head, lead(t, 2) OVER w IS NULL AS tail FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, CASE WHEN head THEN -1 ELSE t0 END AS lo, CASE WHEN tail THEN 9e18::BIGINT ELSE t1 END AS hi FROM s WHERE t1 IS NOT NULL)
SELECT event_id, round(v0 + (v1 - v0) * ((epoch_us(ts) - t0) / (t1 - t0)), 5) AS value
FROM events e LEFT JOIN g ON e.user_id = g.user_id AND epoch_us(ts) >= lo AND epoch_us(ts) < hi WHERE event_type = 'error'
""")
def asof_pose_interp(spark: SparkSession, folder: str) -> DataFrame:
    """Errors placed on the line between the user's other events around them, or on the outermost line."""
    rows = _events(spark, folder)
    poses = rows.where("event_type <> 'error'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    asks = rows.where("event_type = 'error'").select("event_id", "user_id", "t")
    out = sequence.as_of_segments(asks, poses, ["user_id"], "t", ["value"])
    share = (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return out.select("event_id", F.round(G.lerp(F.col("value_0"), F.col("value_1"), share), 5).alias("value"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events)
SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS n_window,
       t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e
""")
def sweep_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the user in the two days before each, and the time since the last one."""
    return sequence.swept(_events(spark, folder).select("user_id", "t"), ["user_id"], "t", 2 * 86400 * 10**6)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ledger_latest(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.latest(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + (event_id % 7 - 3) * 1000000 AS true_t FROM events)
SELECT event_id, CASE WHEN abs(t - true_t) > 2000000 THEN true_t ELSE t END AS t, abs(t - true_t) > 2000000 AS corrected FROM e
""")
def late_correction(spark: SparkSession, folder: str) -> DataFrame:
    """Times more than two seconds off the derived ones give way to them."""
    rows = _events(spark, folder).withColumn("true_t", F.col("t") + (F.col("event_id") % 7 - 3) * 1000000)
    return sequence.late_corrected(rows, "t", "true_t", 2000000).select("event_id", "t", "corrected")


@query("""
WITH s AS (SELECT event_id, user_id, event_type = 'view' AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
n AS (SELECT *, sum(k::INTEGER) OVER (PARTITION BY user_id ORDER BY seq) - 1 AS win FROM s),
u AS (SELECT event_id, user_id, k, seq, win FROM n WHERE win >= 0 UNION ALL SELECT event_id, user_id, k, seq, win - 1 FROM n WHERE k AND win >= 1),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, win ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY user_id, win) AS m,
             sum(k::INTEGER) OVER (PARTITION BY user_id, win) AS keys FROM u),
t AS (SELECT *, least(m, 4) AS slots FROM c WHERE keys = 2),
r AS (SELECT event_id, win, place, list_position([floor(j * (m - 1) / greatest(slots - 1, 1) + 0.5)::BIGINT FOR j IN range(0, slots)], place) - 1 AS slot FROM t)
SELECT event_id, win::BIGINT AS keyframe, place::BIGINT AS place, slot::BIGINT AS slot FROM r WHERE slot >= 0
""")
def keyframe_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The events between neighbouring views of a user, thinned to four with the ends kept."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, folder, "events").select("event_id", "user_id", (F.col("event_type") == "view").alias("is_key"), seq.alias("seq"))
    out = sequence.keyframe_windows(rows, ["user_id"], "seq", "is_key", 4)
    return out.select("event_id", F.col("window").cast("long").alias("keyframe"), F.col("place").cast("long").alias("place"), F.col("slot").cast("long").alias("slot"))


@query("""
WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 97 <> 0 THEN lag(event_id) OVER w END AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n, lag(t) OVER w AS before FROM l WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) AS n, count(*) FILTER (prev IS NULL) AS heads, count(*) FILTER (next IS NULL) AS tails,
       count(*) FILTER (prev IS DISTINCT FROM p OR next IS DISTINCT FROM c.n) AS broken_links, count(*) FILTER (t <= before) AS not_increasing
FROM c GROUP BY user_id
""")
def chain_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Faults by chain where some links back are lost."""
    rows = sequence.linked(_events(spark, folder), ["user_id"], ["ts", "event_id"], "event_id")
    rows = rows.withColumn("prev", F.when(F.col("event_id") % 97 != 0, F.col("prev")))
    return sequence.chain_faults(rows, ["user_id"], "t", "event_id")
