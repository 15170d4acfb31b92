"""Repairing and admitting a data root: incomplete samples, missing poses, predicates a scene, paths, and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .integrity import complete_only, dangling, missing_values, relinked, verdicts
from .sequence import as_of_segments, interpolated_pose


def repaired(samples: DataFrame, sample_data: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples that have a keyframe of every required channel, relinked, their sample_data, and the tokens that were dropped.

    ``sample_data`` has channel; samples have token, scene_token and timestamp.
    """
    keys = sample_data.where("is_key_frame").select("sample_token", "channel")
    whole = complete_only(keys, ["sample_token"], "channel", required).select("sample_token").distinct()
    kept = samples.join(whole, samples["token"] == whole["sample_token"], "left_semi")
    kept = relinked(kept.drop("prev", "next"), ["scene_token"], ["timestamp", "token"])
    gone = samples.join(kept.select("token"), "token", "left_anti").select("token")
    return kept, sample_data.join(gone.select(F.col("token").alias("sample_token")), "sample_token", "left_anti"), gone


def with_camera_poses(cameras: DataFrame, scan_poses: DataFrame, scene: str = "scene_token") -> DataFrame:
    """Camera rows that share the scan's pose get one of their own time, interpolated between the scene's scan poses.

    ``cameras`` have scene, t, pose (t, q) and shares_scan_pose; scenes with fewer than two scan poses stay as they are.
    """
    many = scan_poses.groupBy(scene).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(scene)
    todo = cameras.where("shares_scan_pose").join(many, scene, "left_semi")
    rest = cameras.where("NOT shares_scan_pose").unionByName(cameras.where("shares_scan_pose").join(many, scene, "left_anti"))
    found = as_of_segments(todo.drop("pose"), scan_poses.select(scene, "t", "pose"), [scene], "t", ["pose"])
    found = found.withColumn("pose", interpolated_pose(F.col("t"), F.col("t0"), F.col("t1"), F.col("pose_0"), F.col("pose_1")))
    return rest.withColumn("interpolated", F.lit(False)).unionByName(found.select(*todo.columns).withColumn("interpolated", F.lit(True)))


def scene_predicates(tables: dict[str, DataFrame], files: DataFrame, required: list[str], longest_gap_us: int) -> DataFrame:
    """scene_token, predicate, n_offenders and passed for every scene: channels complete, files there, token graph closed, chain whole, sweeps without gaps.

    ``tables`` are the metadata tables with channel in sample_data; ``files`` has the filename of what is there.
    """
    sample = tables["sample"].select(F.col("token").alias("sample_token"), "scene_token")
    data = tables["sample_data"].join(sample, "sample_token", "left")
    scenes = tables["scene"].select(F.col("token").alias("scene_token"))
    lacking = missing_values(data.where("is_key_frame").select("scene_token", "sample_token", "channel"), ["scene_token", "sample_token"], "channel", required).where(F.size("missing") > 0)
    bare = sample.join(data.where("is_key_frame").select("sample_token"), "sample_token", "left_anti")
    gone = data.join(files.select("filename"), "filename", "left_anti")
    loose = dangling(data, "ego_pose_token", tables["ego_pose"], "token", blank_ok=False).select("scene_token")
    loose = loose.unionByName(dangling(data, "calibrated_sensor_token", tables["calibrated_sensor"], "token", blank_ok=False).select("scene_token"))
    for link in ("prev", "next"):
        loose = loose.unionByName(dangling(tables["sample"], link, tables["sample"], "token").select("scene_token"))
    n = tables["sample"].groupBy("scene_token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prev") == "").alias("heads"), F.count_if(F.col("next") == "").alias("tails"))
    told = tables["scene"].select(F.col("token").alias("scene_token"), "nbr_samples").join(n, "scene_token", "left")
    broken = told.where("n IS NULL OR n <> nbr_samples OR heads <> 1 OR tails <> 1").select("scene_token")
    each = Window.partitionBy("scene_token", "channel").orderBy("timestamp")
    gaps = data.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(each)).where(F.col("gap") > longest_gap_us)
    checks = {"channels_complete": lacking.select("scene_token").unionByName(bare.select("scene_token")), "files_resolve": gone.select("scene_token"), "token_graph_closed": loose, "chain_whole": broken, "sweeps_without_gap": gaps.select("scene_token")}
    return verdicts(checks, scenes)


def path_faults(paths: DataFrame, read_only: str) -> DataFrame:
    """name, path and fault of configured paths (name, path, is_output): relative ones, outputs within the read-only root, and names given twice."""
    root = read_only.rstrip("/")
    inside = (F.col("path") == root) | F.col("path").startswith(root + "/")
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    up = F.col("path").rlike(r"(^|/)\.\.(/|$)")
    fault = F.when(~F.col("path").rlike(r"^([a-z][a-z0-9+.-]*:/)?/"), "not absolute").when(up, "leads upwards").when(F.col("is_output") & inside, "output in the read-only root").when(n > 1, "given twice")
    return paths.withColumn("fault", fault).where("fault IS NOT NULL").select("name", "path", "fault")


#: What a run's log says of its stages.
BEGAN, ENDED, FAILED = r"^=+ stage (\S+) ", r"^stage (\S+) done", r"^(?:ERROR|REFUSED|FATAL)"


def run_states(lines: DataFrame, run: str = "run") -> DataFrame:
    """run, stage and state (done, failed or running) of every stage that a log (run, line_no, line) speaks of.

    A stage runs from the line that begins it; a failure is that of the stage that was begun last.
    """
    order = Window.partitionBy(run).orderBy("line_no")
    began, ended = F.regexp_extract("line", BEGAN, 1), F.regexp_extract("line", ENDED, 1)
    rows = lines.select(run, "line_no", F.nullif(began, F.lit("")).alias("began"), F.nullif(ended, F.lit("")).alias("ended"), F.col("line").rlike(FAILED).alias("failed"))
    rows = rows.withColumn("current", F.last("began", ignorenulls=True).over(order))
    stage = F.coalesce("ended", F.when(F.col("failed") | F.col("began").isNotNull(), F.col("current")))
    said = rows.withColumn("stage", stage).where("stage IS NOT NULL").groupBy(run, "stage").agg(F.max(F.when(F.col("ended").isNotNull(), F.col("line_no"))).alias("done_at"), F.max(F.when(F.col("failed"), F.col("line_no"))).alias("failed_at"), F.max(F.when(F.col("began").isNotNull(), F.col("line_no"))).alias("began_at"))
    least = F.lit(-1)
    d, f, b = (F.coalesce(c, least) for c in ("done_at", "failed_at", "began_at"))
    return said.select(run, "stage", F.when((d > f) & (d >= b), "done").when((f > d) & (f >= b), "failed").otherwise("running").alias("state"))
