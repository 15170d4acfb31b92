"""Detection, track and lift metrics, threshold tuning, and comparison of runs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geometry as G
from .quantiles import matched, percentiles


def ratio(a: Column, b: Column) -> Column:
    """a over b, null where there is nothing to divide by."""
    return F.when(b > 0, a / F.when(b > 0, b))


def precision_recall(matches: DataFrame, truths: DataFrame, by: list[str]) -> DataFrame:
    """n_pred, n_gt, tp, precision and recall by key; matches has a row a prediction with ``matched``."""
    p = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"), F.count_if("matched").alias("tp"))
    g = truths.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt"))
    out = p.join(g, by, "full").na.fill(0, ["n_pred", "tp", "n_gt"])
    return out.withColumn("precision", ratio(F.col("tp"), F.col("n_pred"))).withColumn("recall", ratio(F.col("tp"), F.col("n_gt")))


def iou_sweep(pairs: DataFrame, preds: DataFrame, truths: DataFrame, image: list[str], pred: str, gt: str, score: str, thresholds: tuple[float, ...] = (0.3, 0.5, 0.75)) -> DataFrame:
    """threshold, tp, n_pred, n_gt, precision and recall of a greedy matching at each threshold."""
    from .assign import swept_matches

    found = swept_matches(pairs, image, pred, gt, score, "iou", thresholds).groupBy("threshold").agg(F.count(F.lit(1)).alias("tp"))
    n = preds.agg(F.count(F.lit(1)).alias("n_pred")).crossJoin(truths.agg(F.count(F.lit(1)).alias("n_gt")))  # one row each
    levels = n.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    out = levels.join(found, "threshold", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    return out.select("threshold", "tp", "n_pred", "n_gt", ratio(F.col("tp"), F.col("n_pred")).alias("precision"), ratio(F.col("tp"), F.col("n_gt")).alias("recall"))


def box_errors(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean errors of matched pairs: position (ATE), size (ASE) and, over trusted yaws, orientation (AOE).

    Rows have p (x, y, z), g (x, y, z), p_size and g_size (w, l, h), p_yaw, g_yaw and trusted.
    """
    dx, dy = F.col("p.x") - F.col("g.x"), F.col("p.y") - F.col("g.y")
    turned = F.abs(G.wrap(F.col("p_yaw") - F.col("g_yaw")))
    turned = F.least(turned, F.lit(math.pi) - turned)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.sqrt(dx * dx + dy * dy)).alias("ate"),
        F.avg(1 - B.aligned_size_iou(F.col("p_size"), F.col("g_size"))).alias("ase"),
        F.avg(F.when(F.col("trusted"), turned)).alias("aoe"),
    )


def eligible_truths(truths: DataFrame, farthest: float = 40.0, least_points: int = 5) -> DataFrame:
    """Adds ``rejected``: why a ground truth doesn't count (out_of_range, few_points, unmapped, unreachable), or null."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    why = F.when(r > farthest, "out_of_range").when(F.col("n_points") < least_points, "few_points").when(F.col("phrase").isNull(), "unmapped").when(~F.coalesce(F.col("reachable"), F.lit(False)), "unreachable")
    return truths.withColumn("rejected", why)


def paint_report(points: DataFrame, boxes: DataFrame, keys: list[str], least_painted: int = 5) -> DataFrame:
    """One row: shares of all and of painted points in any box, their ratio, and the share of boxes painted enough.

    Points have index, x, y, z, painted; boxes have box, center, size, q and counted (eligible and reachable).
    Faces count as inside.
    """
    b = boxes.select(*(F.col(k).alias(f"b_{k}") for k in keys), "box", "center", "size", "q", "counted")
    on = reduce(lambda x, y: x & y, [points[k] == b[f"b_{k}"] for k in keys])
    hits = points.join(b, on).where(G.in_box(G.Vec(F.col("x"), F.col("y"), F.col("z")), F.col("center"), F.col("size"), F.col("q"), inclusive=True))
    inside = hits.select(*keys, "index").distinct().withColumn("__in", F.lit(True))
    flags = points.join(inside, [*keys, "index"], "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    rates = flags.agg(F.count(F.lit(1)).alias("n_points"), F.count_if("painted").alias("n_painted"), F.count_if("__in").alias("n_inside"), F.count_if(F.col("painted") & F.col("__in")).alias("n_painted_inside"))
    filled = hits.where("painted and counted").groupBy(*keys, "box").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_painted)
    covered = filled.agg(F.count(F.lit(1)).alias("n_covered"))
    total = boxes.where("counted").agg(F.count(F.lit(1)).alias("n_boxes"))
    out = rates.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(total))
    out = out.withColumn("base_rate", ratio(F.col("n_inside"), F.col("n_points"))).withColumn("painted_rate", ratio(F.col("n_painted_inside"), F.col("n_painted")))
    return out.withColumn("enrichment", ratio(F.col("painted_rate"), F.col("base_rate"))).withColumn("coverage", ratio(F.col("n_covered"), F.col("n_boxes")))


def tuned_thresholds(rows: DataFrame, by: list[str], score: str, tp: str, beta: float = 0.5, first: int = 20, last: int = 95, least_tp: int = 5, total: str | None = None) -> DataFrame:
    """The score threshold of most F-beta by class, of first to last hundredths; the lowest among equals.

    Precision and recall at a threshold count rows at or over it, recall against all true positives (or
    the largest ``total``). Scores are first summed into hundredths, so the sweep runs over at most 76
    sums a class, not over rows. Classes of too few true positives take the 95th percentile of the
    scores of false positives, or the last threshold without any.
    """
    bucket = F.greatest(F.least(F.floor(F.col(score) * 100 + 1e-9), F.lit(last)), F.lit(first - 1)).cast("int")
    sums = rows.groupBy(*by, bucket.alias("__b")).agg(F.count_if(F.col(tp)).alias("__tp"), F.count_if(~F.col(tp)).alias("__fp"))
    grid = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: t)
    packed = sums.groupBy(*by).agg(F.collect_list(F.struct("__b", "__tp", "__fp")).alias("__sums"), F.sum("__tp").alias("__all"))
    high = percentiles(rows.where(~F.col(tp)), by, score, (0.95,)).select(*by, F.col("percentiles")[0].alias("__p95"))
    out = matched(packed, high, by, "left").withColumn("__t", F.explode(grid))
    if total:
        out = matched(out, rows.groupBy(*by).agg(F.max(total).alias("__total")), by)
    at = lambda c: F.aggregate(F.filter("__sums", lambda s: s["__b"] >= F.col("__t")), F.lit(0).cast("long"), lambda n, s: n + s[c])
    out = out.withColumn("__n_tp", at("__tp")).withColumn("__n_fp", at("__fp"))
    recall = F.col("__n_tp") / (F.col("__total") if total else F.col("__all"))
    precision = ratio(F.col("__n_tp"), F.col("__n_tp") + F.col("__n_fp"))
    b2 = beta * beta
    f = F.when(F.col("__n_tp") > 0, (1 + b2) * precision * recall / (b2 * precision + recall)).otherwise(0.0)
    out = out.withColumn("__f", F.when(F.col("__all") > 0, f).otherwise(0.0))
    best = out.groupBy(*by).agg(F.max_by(F.struct("__t", "__f"), F.struct(F.col("__f"), -F.col("__t"))).alias("__m"), F.first("__all").alias("n_tp"), F.first("__p95").alias("__p95"))
    enough = F.col("n_tp") >= least_tp
    return best.select(*by, "n_tp", F.when(enough, F.col("__m.__t") / 100.0).otherwise(F.coalesce("__p95", F.lit(last / 100.0))).alias("threshold"), F.when(enough, F.col("__m.__f")).alias("f_beta"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median and the 10th and 90th percentile of a value; null of nothing."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"))
    p = F.col("percentiles")
    return matched(out, percentiles(rows, by, value, (0.1, 0.5, 0.9)), by, "left").select(*by, "n", p[1].alias("median"), p[0].alias("p10"), p[2].alias("p90"))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts by value with their rank: most frequent first, then by value."""
    from pyspark.sql import Window

    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("n").desc(), F.col(value).asc_nulls_last())
    return n.withColumn("rank", F.row_number().over(order))


def runs_compared(metrics: DataFrame, run: str, metric: str, value: str, runs: list[str]) -> DataFrame:
    """A row a metric and a column a run."""
    return metrics.groupBy(metric).pivot(run, runs).agg(F.first(value))


def track_summary(rows: DataFrame, track: list[str], category: str, keyframe: str, velocity: list[str]) -> DataFrame:
    """Most frequent class (the first by name among equals), keyframes, mean velocity and speed by track.

    Values are summed as decimals of six places, so means don't depend on the order of rows.
    """
    mean = lambda c: F.sum(c.cast("decimal(20,6)")).cast("double") / F.count(c)
    speed = F.sqrt(reduce(lambda a, b: a + b, [F.col(v) * F.col(v) for v in velocity]))
    n = rows.groupBy(*track, category).agg(F.count(F.lit(1)).alias("__n"))
    top = n.groupBy(*track).agg(F.min_by(category, F.struct(-F.col("__n"), F.col(category))).alias("category"))
    sums = rows.groupBy(*track).agg(F.count_distinct(keyframe).alias("n_keyframes"), *(mean(F.col(v)).alias(f"mean_{v}") for v in velocity), mean(speed).alias("mean_speed"))
    return sums.join(top, track)


def best_epoch(log: DataFrame, weights: dict[str, float], epoch: str = "epoch") -> DataFrame:
    """The row of a training log with most fitness, a weighted sum of metrics; the earliest among equals."""
    fitness = reduce(lambda a, b: a + b, [F.col(c).cast("double") * w for c, w in weights.items()])
    out = log.withColumn("fitness", fitness)
    return out.agg(F.max_by(F.struct("*"), F.struct("fitness", -F.col(epoch).cast("long"))).alias("__r")).select("__r.*")


def rolled_up(rows: DataFrame, levels: list[str], *counters: Column) -> DataFrame:
    """Counters by each level and all above it, down to one row for everything."""
    return rows.rollup(*levels).agg(*counters)


def chain_statistics(rows: DataFrame, chain: list[str], long: int = 3) -> DataFrame:
    """How many chains and rows there are, their mean and median length, and the share of rows on long chains."""
    n = rows.groupBy(*chain).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_chains"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_length"), F.percentile("n", 0.5).alias("median_length"), (F.sum(F.when(F.col("n") >= long, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_on_long"))


def mask_union(rows: DataFrame, pixel: list[str], mask: str) -> DataFrame:
    """Whether any mask holds a pixel, how many do, and how many say anything of it."""
    return rows.groupBy(*pixel).agg(F.bool_or(mask).alias(mask), F.count_if(mask).alias("votes"), F.count(F.lit(1)).alias("n"))
