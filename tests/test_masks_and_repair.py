"""Masks, sweeps of matches, and repairs against brute force."""

import numpy as np
from pyspark.sql import functions as F

from scenemill.operators import assign, evaluate, ground, masks, repair
from scenemill.plans import grouped
from scenemill.sources.clouds import runs_of

from .test_grouped import by_image, taken

FOLDER = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)


def frame(spark, planes):
    rows = [(k, int(r), int(a), int(b)) for k, p in enumerate(planes) for r, a, b in zip(*runs_of(p))]
    return spark.createDataFrame(rows, "mask int, row int, col_lo int, col_hi int")


def painted(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        assert not out[r["mask"], r["row"], r["col_lo"] : r["col_hi"] + 1].any()
        out[r["mask"], r["row"], r["col_lo"] : r["col_hi"] + 1] = True
    return out


def test_grown_and_carved_masks(spark):
    planes, other = RNG.random((4, 12, 20)) < 0.15, RNG.random((4, 12, 20)) < 0.3
    want = np.zeros_like(planes)
    for k, r, c in zip(*np.nonzero(planes)):
        want[k, max(0, r - 2) : r + 3, max(0, c - 2) : c + 3] = True
    assert (painted(masks.grown(frame(spark, planes), ["mask"], 2, 20, 12), planes.shape) == want).all()
    assert (painted(masks.carved(frame(spark, planes), frame(spark, other), ["mask"]), planes.shape) == (planes & ~other)).all()


def test_outlines_enclose_the_mask(spark):
    for _ in range(20):
        plane = RNG.random((8, 9)) < 0.6
        found = masks.outlines(*runs_of(plane))
        assert sum(map(masks.polygon_area, found)) == plane.sum()
        y, x = np.mgrid[0:8, 0:9] + 0.5
        inside = np.zeros(plane.shape, int)
        for p in found:  # crossings of a ray to the right
            for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
                if x0 == x1:
                    inside += ((y > min(y0, y1)) & (y < max(y0, y1)) & (x < x0)).astype(int)
        assert (inside % 2 == plane).all()
    box = np.zeros((30, 30), bool)
    box[5:15, 4:10] = True
    got = masks.polygons(frame(spark, [box]), ["mask"]).collect()
    assert [(sorted(zip(r.polygon[::2], r.polygon[1::2])), r.area) for r in got] == [([(4.0, 5.0), (4.0, 15.0), (10.0, 5.0), (10.0, 15.0)], 60.0)]


def distance_to_outline(q, p):
    nearest = np.inf
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        share = np.clip((q - a) @ (b - a) / max((b - a) @ (b - a), 1e-12), 0, 1)
        nearest = min(nearest, np.hypot(*(q - a - share * (b - a))))
    return nearest


def test_simplified_outlines_stay_near(spark):
    y, x = np.mgrid[0:60, 0:60]
    disc = (x - 30) ** 2 + (y - 28) ** 2 < 22**2
    (whole,) = masks.outlines(*runs_of(disc))
    for tolerance in (0.5, 1.0, 3.0):
        p = masks.simplified(whole, tolerance)
        assert 3 <= len(p) < len(whole) and {tuple(c) for c in p} <= {tuple(c) for c in whole}
        assert all(distance_to_outline(q, p) <= tolerance + 1e-9 for q in whole)
    assert len(masks.simplified(whole, 0.0)) == len(whole)
    line = np.zeros((60, 60), bool)
    line[3, 2:40] = True
    got = {r.mask: r for r in masks.polygons(frame(spark, [disc, line]), ["mask"], tolerance=1.5).collect()}
    assert got[0].area == disc.sum() and len(got[0].polygon) < 2 * len(whole) and 1 not in got


def test_hull_and_mask():
    corners = np.array([[2, 3], [12, 3], [12, 9], [2, 9], [7, 6]], float)
    plane = np.zeros((20, 20), bool)
    plane[3:10, 2:13] = True
    assert masks.hull_iou(corners, *runs_of(plane), 20, 20) == (1.0, 0.0)
    plane[3:10, 7:13] = False
    assert abs(masks.hull_iou(corners, *runs_of(plane), 20, 20)[0] - 35 / 77) < 1e-12
    assert masks.hull_iou(corners[:2], *runs_of(plane), 20, 20) == (None, None)
    for _ in range(30):
        c = RNG.uniform(-3, 23, (6, 2))
        h = masks.hull(np.round(c))
        y, x = np.mgrid[0:20, 0:20]
        inside = np.ones((20, 20), bool)
        for (x0, y0), (x1, y1) in zip(h, np.roll(h, -1, axis=0)):
            inside &= (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) >= -1e-9
        got = np.zeros((20, 20), bool)
        for r, a, b in zip(*masks.hull_rows(c, 20, 20)):
            got[r, a : b + 1] = True
        assert (got == inside).all()


def test_sweep_equals_matching_at_each_threshold(spark):
    pairs = grouped._candidates(spark, FOLDER, 0.1)
    groups = by_image(pairs.collect()).values()
    got = assign.swept_matches(pairs, ["image"], "pred", "gt", "score", "iou", (0.3, 0.5)).collect()
    for t in (0.3, 0.5):
        want = set().union(*(taken([p for p in g if p["iou"] >= t], lambda p: (-p["score"], p["pred"], -p["iou"], p["gt"])) for g in groups))
        assert {(r.image, r.pred, r.gt) for r in got if r.threshold == t} == want
    out = {r.threshold: r for r in grouped.iou_sweep(spark, FOLDER).collect()}
    assert out[0.3].tp == sum(r.threshold == 0.3 for r in got) and abs(out[0.5].precision - out[0.5].tp / out[0.5].n_pred) < 1e-12 and out[0.5].recall <= out[0.3].recall


def test_points_near_the_road(spark):
    rows = [("m", float(x), 0.0, 0.1 * (x % 3), x < 6) for x in range(12)] + [("m", 3.0, 0.0, 2.0, False), ("n", 1.0, 0.0, 0.0, False)]
    got = ground.near_road(spark.createDataFrame(rows, "mask string, x double, y double, z double, anchor boolean"), ["mask"], 5.5, 0.3).collect()
    assert [r.on_plane for r in got if r["mask"] == "n"] == [False] and sum(r.on_plane for r in got) == 12


def test_incomplete_samples_are_dropped_and_links_repaired(spark):
    samples = spark.createDataFrame([(f"s{k}", k, "x", "y", "a" if k < 4 else "b") for k in range(6)], "token string, timestamp long, prev string, next string, scene_token string")
    data = spark.createDataFrame([(f"s{k}", c, True) for k in range(6) for c in ("L", "C") if (k, c) != (2, "C")] + [("s2", "C", False)], "sample_token string, channel string, is_key_frame boolean")
    kept, rest, gone = repair.repaired(samples, data, ["L", "C"])
    assert {(r.token, r.prev, r.next) for r in kept.collect()} == {("s0", "", "s1"), ("s1", "s0", "s3"), ("s3", "s1", ""), ("s4", "", "s5"), ("s5", "s4", "")}
    assert [r.token for r in gone.collect()] == ["s2"] and rest.count() == 10


def test_camera_poses_are_interpolated_where_they_are_the_scans(spark):
    from scenemill.functions import geometry as G

    c = F.col
    still = G.Quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    pose = G.Pose(G.Vec(c("t") * 2.0, F.lit(0.0), F.lit(0.0)), still).struct
    scans = spark.createDataFrame([("a", 0), ("a", 10), ("a", 20), ("b", 0)], "scene_token string, t long").withColumn("pose", pose)
    cameras = spark.createDataFrame([("a", 5, True, 0.0), ("a", 23, True, 20.0), ("a", 7, False, 99.0), ("b", 5, True, 0.0)], "scene_token string, t long, shares_scan_pose boolean, x double")
    cameras = cameras.withColumn("pose", G.Pose(G.Vec(c("x"), F.lit(0.0), F.lit(0.0)), still).struct).drop("x")
    got = {(r.scene_token, r.t): (round(r.pose.t.x, 9), r.interpolated) for r in repair.with_camera_poses(cameras, scans).collect()}
    assert got == {("a", 5): (10.0, True), ("a", 23): (46.0, True), ("a", 7): (99.0, False), ("b", 5): (0.0, False)}


def test_scene_predicates(spark):
    make = spark.createDataFrame
    tables = {
        "scene": make([("a", 2), ("b", 1)], "token string, nbr_samples int"),
        "sample": make([("a0", "a", "", "a1"), ("a1", "a", "a0", ""), ("b0", "b", "", "zz")], "token string, scene_token string, prev string, next string"),
        "sample_data": make([("a0", "L", True, 0, "f0", "p", "c"), ("a1", "L", True, 100, "f1", "p", "c"), ("b0", "R", True, 0, "f9", "q", "c")], "sample_token string, channel string, is_key_frame boolean, timestamp long, filename string, ego_pose_token string, calibrated_sensor_token string"),
        "ego_pose": make([("p",)], "token string"),
        "calibrated_sensor": make([("c",)], "token string"),
    }
    got = {(r.scene_token, r.predicate): r.passed for r in repair.scene_predicates(tables, make([("f0",), ("f1",)], "filename string"), ["L"], 50).collect()}
    assert {k for k, v in got.items() if not v} == {("a", "sweeps_without_gap"), ("b", "channels_complete"), ("b", "files_resolve"), ("b", "token_graph_closed"), ("b", "chain_whole")} and len(got) == 10


def test_paths_and_run_logs(spark):
    paths = spark.createDataFrame([("a", "/data/in", False), ("b", "out", True), ("c", "/data/in/x", True), ("d", "s3a://b/x", True), ("e", "/x/../y", True), ("f", "/o", True), ("f", "/p", True)], "name string, path string, is_output boolean")
    assert {(r.name, r.fault) for r in repair.path_faults(paths, "/data/in").collect()} == {("b", "not absolute"), ("c", "output in the read-only root"), ("e", "leads upwards"), ("f", "given twice")}
    log = ["== stage one ==", "x", "stage one done", "=== stage two ===", "ERROR: no disk", "== stage three ==", "working"]
    rows = spark.createDataFrame([("r", k, line) for k, line in enumerate(log)] + [("q", 0, "== stage one =="), ("q", 1, "ERROR"), ("q", 2, "== stage one =="), ("q", 3, "stage one done")], "run string, line_no int, line string")
    assert {(r.run, r.stage, r.state) for r in repair.run_states(rows).collect()} == {("r", "one", "done"), ("r", "two", "failed"), ("r", "three", "running"), ("q", "one", "done")}
    assert evaluate.rolled_up(rows, ["run"], F.count(F.lit(1)).alias("n")).count() == 3
