"""The trackers over streams of files out of order against the trackers over whole scenes."""

import random

from pyspark.sql import functions as F

from scenemill.operators.track import tracked, tracked_images
from scenemill.streaming.tracking import tracked_images_stream, tracked_stream

SOLID = "scene string, keyframe long, index int, t_ns long, name string, x double, y double, z double, w double, l double, h double, yaw double, embedding array<double>, points array<array<double>>"
FLAT = "scene string, frame long, index int, name string, score double, x1 double, y1 double, x2 double, y2 double, frame_area double"
START = 1_700_000_000


def detections():
    rng, rows = random.Random(5), []
    for scene in ("a", "b", "c"):
        for keyframe in range(14):
            for index in range(3):
                if rng.random() < 0.15:
                    continue
                x, y = index * 20 + keyframe * 0.5 + rng.gauss(0, 0.05), rng.gauss(0, 0.05)
                points = [[x + rng.random(), y + rng.random(), 0.0] for _ in range(20)] if index else None
                rows.append((scene, keyframe, index, (START * 10 + keyframe * 5) * 10**8, "car", x, y, 0.5, 2.0, 4.0, 1.5, 0.1, [1.0, 0.0] if index < 2 else None, points))
    return rows


def boxes():
    rng, rows = random.Random(6), []
    for scene in ("a", "b"):
        for frame in range(14):
            for index in range(4):
                if index and rng.random() < 0.25:
                    continue
                x, y = index * 30 + frame + rng.random(), 10 + rng.random()
                rows.append((scene, frame, index, rng.choice(("car", "car", "bus")), round(rng.random(), 3), x, y, x + 20, y + 15, 30_000.0))
    return rows


def streamed(spark, folder, rows, schema, track, want):
    """Three steps a file, neighbouring files exchanged, then one row that only moves the watermark."""
    files = [[r for r in rows if r[1] // 3 == k] for k in (1, 0, 2, 4, 3)]
    files.append([("end", 20_000, *rows[0][2:])])
    for k, part in enumerate(files):
        at = F.timestamp_millis(F.lit(START * 1000).cast("long") + F.col(schema.split()[2]) * 500)
        spark.createDataFrame(part, schema).withColumn("t", at).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(f"{schema}, t timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    out = track(stream)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    got = spark.read.schema(out.schema).parquet(f"{folder}/out").where("scene <> 'end'")
    line = lambda df: sorted(tuple(repr(v) for v in r) for r in df.select(*want.columns).collect())
    assert line(got) == line(want)
    return got


def test_boxes_in_space(spark, tmp_path):
    rows = detections()
    want = tracked(spark.createDataFrame(rows, SOLID), ["scene"]).drop("stable")
    got = streamed(spark, tmp_path, rows, SOLID, lambda s: tracked_stream(s, ["scene"], "t", "5 seconds"), want)
    assert got.where("stable and hits < 3 or not stable and hits >= 3").count() == 0


def test_boxes_in_images(spark, tmp_path):
    rows = boxes()
    want = tracked_images(spark.createDataFrame(rows, FLAT), ["scene"])
    got = streamed(spark, tmp_path, rows, FLAT, lambda s: tracked_images_stream(s, ["scene"], "t", "5 seconds"), want)
    assert got.where("source = 'recovered'").count() > 0
