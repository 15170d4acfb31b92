"""Readers and writers: round trips over folders of many files, broken files, markers and streams."""

import io
import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenemill.sources import clouds, documents, records
from scenemill.sources.files import Files, clear_markers, read_marker, required_upstream, resumed, write_marker
from scenemill.streaming import ledger

PRELABEL = {"sample_token": "s", "instance_token": "i", "category": "car", "frame": "global", "t_ns": 1, "time_base": "unix_ns", "translation_m": [0.0, 1.0, 2.0], "size_wlh_m": [1.0, 2.0, 3.0], "rotation_wxyz": [1.0, 0.0, 0.0, 0.0], "num_lidar_pts": 5, "provenance": {"source": "p", "tier": "flagged"}, "coverage_config": "c", "__schema_version__": "2"}


def write_scenes(root, scenes):
    for name, rows in scenes.items():
        folder = root / "scenes" / name
        folder.mkdir(parents=True)
        (folder / "prelabels.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")


def test_prelabels_of_many_scenes(spark, tmp_path):
    write_scenes(tmp_path, {f"s{k}": [PRELABEL | {"token": f"{k}-{i}"} for i in range(20)] for k in range(12)})
    rows = records.read_prelabels(spark, str(tmp_path), "2")
    assert rows.count() == 240 and rows.first().translation_m == [0.0, 1.0, 2.0]


def test_all_errors_of_all_lines_are_told(spark, tmp_path):
    good = PRELABEL | {"token": "a"}
    write_scenes(tmp_path, {"x": [good, "{not json", PRELABEL | {"token": "b", "__schema_version__": "1"}, PRELABEL | {"token": "c", "frame": "ego"}], "y": [good, PRELABEL | {"token": None}]})
    with pytest.raises(ValueError) as e:
        records.read_prelabels(spark, str(tmp_path), "2")
    told = str(e.value)
    assert told.startswith("5 errors") and all(x in told for x in ("line 2: not valid JSON", "line 3: schema version 1", "line 4: breaks frame", "breaks required", "repeats a"))
    good_rows, errors = records.read_lines(spark, f"{tmp_path}/scenes/*/prelabels.jsonl", records.PRELABEL, "2")
    assert good_rows.count() == 4 and errors.count() == 2


def test_records_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", None if k % 3 else [float(k)]) for k in range(50)], "k long, name string, v array<double>")
    path = str(tmp_path / "out")
    assert records.write_records(rows, path, version="2") == 50
    back = records.read_records(spark, f"{path}/*.json", rows.schema, "2")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(ValueError, match="25 rows break even"):
        records.write_records(rows, path, rules={"even": F.col("k") % 2 == 0})
    assert records.read_records(spark, f"{path}/*.json", rows.schema, "2").count() == 50 and [p.name for p in tmp_path.iterdir()] == ["out"]
    assert records.write_records(rows.limit(0), path, format="parquet") == 0 and spark.read.parquet(path).count() == 0


def test_markers(spark, tmp_path):
    files, folder = Files(spark), str(tmp_path / "stage")
    (tmp_path / "stage").mkdir()
    assert read_marker(files, folder) is None
    write_marker(files, folder, "f1")
    assert read_marker(files, folder)["state"] == "clean" and required_upstream(files, folder, "f1")
    write_marker(files, folder, "f1", ["scene 3 has no poses"])
    assert [p.name for p in (tmp_path / "stage").iterdir() if not p.name.endswith(".crc")] == ["_DONE.degraded"]
    for args in (("f1",), ("f2", True)):
        with pytest.raises(ValueError, match="degraded|other metadata"):
            required_upstream(files, folder, *args)
    assert resumed(files, {"a": folder, "b": str(tmp_path / "none")}, "f1") == {"a": "skip", "b": "run"}
    clear_markers(files, folder)
    with pytest.raises(ValueError, match="whole"):
        required_upstream(files, folder, "f1")
    with pytest.raises(ValueError):
        write_marker(files, folder, "")


def test_clouds(spark, tmp_path):
    rng = np.random.default_rng(1)
    sweeps = {f"c{k}": rng.normal(size=(k * 7, 5)).astype("f4") for k in range(6)}
    for k, (name, p) in enumerate(sweeps.items()):
        (tmp_path / (f"{name}.pcd" if k % 2 else f"{name}.bin")).write_bytes(clouds.pcd_bytes(p) if k % 2 else p.tobytes())
    (tmp_path / "odd.bin").write_bytes(b"x" * 21)
    (tmp_path / "odd.pcd").write_bytes(clouds.pcd_bytes(sweeps["c5"])[:-4])
    with zipfile.ZipFile(tmp_path / "task.zip", "w") as z:
        for name in ("c3", "c4"):
            z.writestr(f"pointcloud/{name}.pcd", clouds.pcd_bytes(sweeps[name]))
    rows = clouds.read_clouds(spark, f"{tmp_path}/*.[bp][ic][nd]").collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[1].split(".")[0] if r.error is None else r.file.rsplit("/", 1)[1], []).append(r)
    for name, p in sweeps.items():
        got = np.array([[r.x, r.y, r.z, r.intensity, r.ring] for r in sorted(by.get(name, []), key=lambda r: r.point_index)], "f4").reshape(-1, 5)
        assert (got == p).all()
    assert all(len(by[n]) == 1 and by[n][0].x is None and by[n][0].error for n in ("odd.bin", "odd.pcd"))
    zipped = clouds.read_archived_clouds(spark, f"{tmp_path}/*.zip")
    assert zipped.count() == 49 and {r.file.split("!")[1] for r in zipped.select("file").distinct().collect()} == {"pointcloud/c3.pcd", "pointcloud/c4.pcd"}
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sample_token string")
    at = lambda *t: spark.createDataFrame([(k, f"{k}.f") for k in t], "sample_token string, file string")
    best = {r.sample_token: (r.file, r.basis) for r in clouds.best_clouds(keys, at("a"), at("a", "b"), at("a", "b", "c")).collect()}
    assert best == {"a": ("a.f", clouds.GROUND_FILTERED), "b": ("b.f", clouds.ARCHIVED), "c": ("c.f", clouds.RAW), "d": (None, clouds.UNAVAILABLE)}


def test_masks_and_labels(spark, tmp_path):
    rng = np.random.default_rng(2)
    planes = rng.random((3, 9, 21)) < 0.4
    held = io.BytesIO()
    np.savez(held, __width_px__=np.array([21]), __height_px__=np.array([9]), __bit_packed__=np.array([1]), CAM=np.packbits(planes, axis=-1))
    (tmp_path / "m.npz").write_bytes(held.getvalue())
    runs = clouds.read_masks(spark, f"{tmp_path}/*.npz")
    back = np.zeros_like(planes)
    for r in runs.collect():
        back[r["mask"], r["row"], r["col_lo"] : r["col_hi"] + 1] = True
    assert (back == planes).all()
    for r in clouds.mask_boxes(runs, ["channel", "mask"]).collect():
        y, x = np.nonzero(planes[r["mask"]])
        assert (r.x1, r.y1, r.x2, r.y2, r.n_px) == (x.min(), y.min(), x.max() + 1, y.max() + 1, len(x))
    points = spark.createDataFrame([(f"b{k % 3}", k // 3, k % 31) for k in range(300)], "blob string, point_index int, label int").repartition(4)
    told = clouds.write_labels(points, "blob", str(tmp_path / "labels"))
    assert {r.n for r in told.collect()} == {100} and clouds.exported_labels(spark, str(tmp_path / "labels"), str(tmp_path / "bins"), "blob") == 3
    assert list((tmp_path / "bins" / "b1.bin").read_bytes()) == [k % 31 for k in range(1, 300, 3)]


def test_release_tables_and_chains(spark, tmp_path):
    rows = {n: spark.createDataFrame([], s) for n, s in documents.TABLES.items()}
    rows["scene"] = spark.createDataFrame([("s1", "one", 3, "a", "c", "l", None), ("s2", "two", 3, "d", "f", "l", None)], documents.TABLES["scene"])
    rows["sample"] = spark.createDataFrame([("a", 1, "", "b", "s1"), ("b", 2, "a", "c", "s1"), ("c", 3, "b", "", "s1"), ("d", 1, "", "e", "s2"), ("e", 2, "d", "x", "s2"), ("f", 3, "e", "", "s2")], documents.TABLES["sample"])
    rows["sensor"] = spark.createDataFrame([("se", "CAM", "camera")], documents.TABLES["sensor"])
    rows["calibrated_sensor"] = spark.createDataFrame([("cs", "se", [0.0], [1.0], [[1.0]])], documents.TABLES["calibrated_sensor"])
    rows["sample_data"] = spark.createDataFrame([("sd", "a", "p", "cs", 1, "jpg", True, "f", 1, 2, "", ""), ("sx", "a", "p", "none", 1, "jpg", True, "f", 1, 2, "", "")], documents.TABLES["sample_data"])
    folder = str(tmp_path)
    assert documents.write_release(spark, rows, folder, {"version": "v1"})["sample"] == 6
    back = documents.read_tables(spark, folder)
    assert documents.fingerprint(back) == documents.fingerprint(rows) != documents.fingerprint(rows | {"sample": rows["sample"].limit(5)})
    assert json.loads((tmp_path / "release_meta.json").read_text())["counts"]["scene"] == 2
    assert {r.token: r.channel for r in documents.channels(back).collect()} == {"sd": "CAM", "sx": None}
    assert sorted((r.scene_token, r.token, r.place) for r in documents.scene_samples(back).collect()) == [("s1", "a", 0), ("s1", "b", 1), ("s1", "c", 2), ("s2", "d", 0), ("s2", "e", 1)]


def test_coco_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a.jpg", "car", [0.0, 0.0, 2.0, 3.0], 0.5), ("d1", "b.jpg", "bus", [1.0, 1.0, 2.0, 2.0], 0.25), ("d2", "a.jpg", "car", [5.0, 5.0, 1.0, 1.0], None)], "document string, file_name string, category string, bbox array<double>, score double")
    documents.write_coco(rows, str(tmp_path / "coco"))
    back = documents.read_coco(spark, str(tmp_path / "coco" / "*.json"))
    key = lambda r: (r.file_name, r.category, r.bbox, r.score)
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, rows.collect()), key=str)
    outlined = rows.withColumn("segmentation", F.array(F.array(*map(F.lit, (0.0, 0.0, 2.0, 0.0, 2.0, 3.0)))))
    documents.write_coco(outlined, str(tmp_path / "outlined"))
    found = [a for f in (tmp_path / "outlined").glob("*.json") for a in json.loads(f.read_text())["annotations"]]
    assert len(found) == 3 and all(a["segmentation"] == [[0.0, 0.0, 2.0, 0.0, 2.0, 3.0]] for a in found)
    assert documents.read_coco(spark, str(tmp_path / "outlined" / "*.json")).count() == 3


def test_cuboid_documents_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([("f0", "t0", 0), ("f1", "t1", 1)], "name string, sample_token string, frame int")
    boxes = spark.createDataFrame([("s", "f0", 0, "car", [1.0, 2.0, 3.0], [1.8, 4.5, 1.6], 0.3, "r1"), ("s", "f1", 1, "bus", [4.0, 5.0, 6.0], [2.5, 9.0, 3.0], -1.0, None)], "scene string, name string, frame int, label string, translation array<double>, size array<double>, yaw double, record_token string")
    documents.cuboid_documents(boxes).write.json(str(tmp_path / "out"))
    back = documents.read_cuboids(spark, str(tmp_path / "out" / "*.json"), frames)
    assert sorted((r.sample_token, r.label, r.translation, r.size, r.yaw, r.record_token) for r in back.collect()) == [("t0", "car", [1.0, 2.0, 3.0], [1.8, 4.5, 1.6], 0.3, "r1"), ("t1", "bus", [4.0, 5.0, 6.0], [2.5, 9.0, 3.0], -1.0, None)]
    with pytest.raises(Exception, match="no frame for item"):
        documents.read_cuboids(spark, str(tmp_path / "out" / "*.json"), frames.where("frame > 5")).collect()


def test_priors_metrics_logs_settings_and_note(spark, tmp_path):
    side = {"mu": 1.5, "sigma": 0.1}
    prior = {"n_instances": 9, "dims": {"w": side, "l": {"mu": 4.0, "sigma": 0.4}, "h": side}}
    (tmp_path / "p.json").write_text(json.dumps({"car": prior}))
    assert documents.read_priors(spark, str(tmp_path / "p.json")).first().mu_l == 4.0
    (tmp_path / "q.json").write_text(json.dumps({"car": prior, "bus": {"n_instances": 0, "dims": prior["dims"]}}))
    with pytest.raises(Exception, match="no usable prior for bus"):
        documents.read_priors(spark, str(tmp_path / "q.json")).collect()
    for run in ("a", "b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps({"n": 5, "all": {"p": 0.5, "name": "x", "deep": {"r": 2}}}))
    found = {(r.run, r.metric, r.value) for r in documents.read_metrics(spark, f"{tmp_path}/[ab]/metrics.json").collect()}
    assert found == {(run, m, v) for run in "ab" for m, v in (("n", 5.0), ("all.p", 0.5), ("all.deep.r", 2.0))}
    (tmp_path / "log.csv").write_text("epoch,  metrics/mAP50\n1, 0.5\n2, 0.75\n")
    assert [tuple(r) for r in documents.read_training_log(spark, str(tmp_path / "log.csv")).collect()] == [(1.0, 0.5), (2.0, 0.75)]
    (tmp_path / "c.yaml").write_text("# all\nstitch:\n  max_gap: 3  # keyframes\n  gates:\n    base: 2.0\nname: 'x y'\n")
    assert {(r.key, r.value) for r in documents.read_settings(spark, str(tmp_path / "c.yaml")).collect()} == {("stitch.max_gap", "3"), ("stitch.gates.base", "2.0"), ("name", "x y")}
    note = documents.delivery_note("chunk", {"Tiers": spark.createDataFrame([("b", 2), ("a", None)], "tier string, n int")})
    assert note.splitlines() == ["# chunk", "", "## Tiers", "| tier | n |", "|---|---|", "| a |  |", "| b | 2 |"]


def test_ledger_stream_keeps_the_last_decision_over_restarts(spark, tmp_path):
    source, book, point = (str(tmp_path / n) for n in ("in", "book", "point"))
    schema = "id string, made_at long, action string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ledger.append_decisions(spark.readStream.schema(schema).parquet(source), book, point).awaitTermination()
    write([("a", 1, "keep"), ("b", 1, "drop"), (None, 1, "x")])
    run()
    write([("a", 2, "drop"), ("b", 0, "keep")])
    run()
    run()
    now = {r.id: r.action for r in ledger.snapshot(spark, book).collect()}
    assert now == {"a": "drop", "b": "drop"} and spark.read.parquet(book).count() == 4


def test_late_records_and_windows_in_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(k, f"s{k % 3}", 1_000 * (k % 3) + (5 if k % 4 else 0), f"2026-01-01 00:00:{k % 40:02d}") for k in range(40)]
    spark.createDataFrame(rows, "k int, sample string, t long, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    samples = spark.createDataFrame([(f"s{k}", 1_000 * k) for k in range(3)], "sample string, true_t long")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    fixed = ledger.corrected_stream(ledger.unrepeated(stream, ["k"], "at", "1 minute"), samples, "sample", "t", "true_t", 2)
    seen = ledger.Heartbeat(time.time)
    spark.streams.addListener(seen)
    fixed.writeStream.format("memory").queryName("fixed").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("fixed").collect()
    assert len(got) == 40 and all(r.t == 1_000 * (r.k % 3) and r.corrected == bool(r.k % 4) for r in got)
    counts = ledger.correction_counts(fixed, "at", "20 seconds")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.n, r.n_corrected) for r in spark.table("counts").collect()) == [(20, 15), (20, 15)]
    assert seen.silent(1e9) == []
    spark.streams.removeListener(seen)
