"""Clustering, fitting, tracking and ground planes against brute force and known shapes."""

import itertools
import math

import numpy as np
import pytest

from scenemill.functions import boxes as B
from scenemill.operators import assign, cluster, ground, joins, track
from scenemill.plans import spatial

FOLDER = "/root/testdata/sf0.001"
RNG = np.random.default_rng(4)


def plain_dbscan(xy, eps, least):
    """Points in order; each unseen core starts a cluster, which takes all that it reaches."""
    n, label, nxt = len(xy), [None] * len(xy), 0
    near = [[j for j in range(n) if (xy[i, 0] - xy[j, 0]) ** 2 + (xy[i, 1] - xy[j, 1]) ** 2 <= eps * eps] for i in range(n)]
    for i in range(n):
        if label[i] is not None or len(near[i]) < least:
            continue
        label[i], todo = nxt, list(near[i])
        while todo:
            j = todo.pop()
            if label[j] is None:
                label[j] = nxt
                if len(near[j]) >= least:
                    todo += near[j]
        nxt += 1
    return [-1 if x is None else x for x in label]


@pytest.mark.parametrize("seed", range(12))
def test_dbscan_equals_the_plain_form(seed):
    rng = np.random.default_rng(seed)
    xy = np.round(rng.uniform(0, 6, (rng.integers(0, 120), 2)), 1)
    assert cluster.dbscan(xy, 0.5, 3).tolist() == plain_dbscan(xy, 0.5, 3)


def test_dbscan_query(spark):
    points = {}
    for r in spatial.painted_points(spark, FOLDER).collect():
        points.setdefault(r.instance, []).append(r)
    got = {}
    for r in spatial.dbscan_labels(spark, FOLDER).collect():
        got.setdefault(r.instance, {})[r.point_index] = r.label
    assert set(got) == set(points)
    for k, rows in points.items():
        rows.sort(key=lambda r: (r.x, r.y, r.z, r.point_index))
        want = plain_dbscan(np.array([[r.x, r.y] for r in rows]), 0.35, 3)
        assert [got[k][r.point_index] for r in rows] == want


def plain_rectangle(xy):
    """The best angle of a fine grid, point by point."""
    best = None
    for theta in np.arange(0, math.pi / 2, math.radians(0.05)):
        u, v = xy @ [math.cos(theta), math.sin(theta)], xy @ [-math.sin(theta), math.cos(theta)]
        away = np.minimum(np.minimum(u - u.min(), u.max() - u), np.minimum(v - v.min(), v.max() - v))
        score = (1 / np.maximum(away, 0.01)).sum()
        best = (score, theta) if best is None or score > best[0] else best
    return best


@pytest.mark.parametrize("angle", (0.0, 0.3, 0.9, 1.4))
def test_rectangle_finds_the_corner_of_two_faces(angle):
    faces = np.concatenate([np.column_stack([np.linspace(0, 4, 60), np.zeros(60)]), np.column_stack([np.zeros(30), np.linspace(0, 1.8, 30)])])
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    points = faces @ turn.T + [10, -3]
    fit = cluster.rectangle(points)
    off = (fit.theta - angle + math.pi / 4) % (math.pi / 2) - math.pi / 4
    assert abs(off) < math.radians(0.2) and fit.score >= plain_rectangle(points)[0] * 0.999
    box = cluster.box_of(np.column_stack([points, np.linspace(0, 1.5, 90)]), fit)
    assert (round(box.w, 1), round(box.l, 1), round(box.h, 1)) == (1.8, 4.0, 1.5) and not box.yaw_ambiguous
    centre = np.array([2, 0.9]) @ turn.T + [10, -3]
    assert np.allclose([box.x, box.y, box.z], [*centre, 0.75], atol=0.03)
    assert abs((box.yaw - angle + math.pi / 2) % math.pi - math.pi / 2) < math.radians(0.2)


def test_boxes_that_are_unsure_and_second_tries():
    line = np.column_stack([np.linspace(0, 2, 5), np.zeros(5), np.zeros(5)])
    box = cluster.box_of(line, cluster.rectangle(line[:, :2]))
    assert box.clamped == "w,h" and box.yaw_ambiguous and box.w == box.h == 0.05
    near = np.column_stack([np.repeat(np.linspace(0, 1, 10), 5), np.tile(np.linspace(0, 0.4, 5), 10), np.tile([0.0, 1.0], 25)])
    far = near + [6.3, 0, 0]
    both = np.concatenate([near, far, np.column_stack([np.linspace(1, 6.3, 40), np.full(40, 0.2), np.zeros(40)])])
    found = cluster.boxed_instance(both, np.arange(len(both)), both[:, 0] + 20, 0.4, (0.5, 1.2))
    assert found["retried"] and found["rejected"] is None and found["box"].l < 6
    assert cluster.boxed_instance(both[:2], np.arange(2), both[:2, 0], 0.4, None)["status"] == "too_few_points"
    assert cluster.boxed_instance(both[[0, 60, 95, 120]], np.arange(4), np.arange(4.0), 0.01, None)["status"] == "all_noise"


def plain_assignment(cost):
    n, m = cost.shape
    return min(sum(cost[i, c[i]] for i in range(n)) for c in itertools.permutations(range(m), n)) if n <= m else plain_assignment(cost.T)


@pytest.mark.parametrize("seed", range(20))
def test_assignment_costs_the_least(seed):
    rng = np.random.default_rng(seed)
    cost = np.round(rng.uniform(-1, 1, rng.integers(1, 6, 2)), 2)
    i, j = assign.assignment(cost)
    assert len(i) == min(cost.shape) and len(set(j)) == len(j) and abs(cost[i, j].sum() - plain_assignment(cost)) < 1e-9


def sampled_iou(a, b, n=400):
    """Shares of a grid over both boxes."""
    lo, hi = min(a[0], b[0]) - 6, max(a[0], b[0]) + 6
    lo2, hi2 = min(a[1], b[1]) - 6, max(a[1], b[1]) + 6
    x, y = np.meshgrid(np.linspace(lo, hi, n), np.linspace(lo2, hi2, n))

    def inside(q):
        u = (x - q[0]) * math.cos(q[4]) + (y - q[1]) * math.sin(q[4])
        v = (y - q[1]) * math.cos(q[4]) - (x - q[0]) * math.sin(q[4])
        return (abs(u) <= q[3] / 2) & (abs(v) <= q[2] / 2)

    p, q = inside(a), inside(b)
    return (p & q).sum() / max((p | q).sum(), 1)


def test_footprint_overlaps_equal_sampled_ones():
    a = np.column_stack([RNG.uniform(-1, 1, 60), RNG.uniform(-1, 1, 60), RNG.uniform(1, 3, 60), RNG.uniform(2, 5, 60), RNG.uniform(-4, 4, 60)])
    b = np.column_stack([RNG.uniform(-1, 1, 60), RNG.uniform(-1, 1, 60), RNG.uniform(1, 3, 60), RNG.uniform(2, 5, 60), RNG.uniform(-4, 4, 60)])
    for k, iou in enumerate(B.ground_iou(a, b)):
        assert abs(iou - sampled_iou(a[k], b[k])) < 0.03
    assert np.allclose(B.ground_iou(a, a), 1) and B.ground_iou(a[:1], a[:1] + [50, 0, 0, 0, 0])[0] == 0
    flat = np.array([[0, 0, 2, 4, 0.0]])
    assert np.isclose(B.ground_iou(flat, flat + [0, 0, 0, 0, math.pi / 2])[0], 4 / 12) and np.isclose(B.ground_iou(flat, np.array([[1.0, 0, 2, 4, 0]]))[0], 6 / 10)


@pytest.mark.parametrize("solid", (True, False))
def test_assignment_queries(spark, solid):
    got = {}
    for r in (spatial.hungarian_3d if solid else spatial.hungarian_2d)(spark, FOLDER).collect():
        got.setdefault(r.image, []).append(r)
    assert got
    from scenemill.plans import inputs

    rows = {}
    for r in (inputs.solid_boxes if solid else inputs.image_boxes)(spark, FOLDER).collect():
        rows.setdefault(r.image, []).append(r)
    for image, part in rows.items():
        left = [r for r in part if (r["index"] % 2 == 1 if solid else r.odd == 1)]
        right = [r for r in part if r not in left]
        if not left or not right or min(len(left), len(right)) > 4:
            continue
        if solid:
            m = lambda rs: np.array([[r.x * 0.1, r.y * 0.1, r.w, r.l, r.yaw] for r in rs])
            iou = np.array([[B.ground_iou(a[None], b[None])[0] for b in m(right)] for a in m(left)])
            cost = np.where(iou >= 0.05, -iou, 1e6)
        else:
            m = lambda rs: np.array([list(r.box) for r in rs])
            iou = assign.iou_matrix(m(left), m(right))
            cost = np.where(iou >= 0.30, -iou, 1.0)
        want = plain_assignment(cost)
        mine = got.get(image, [])
        pairs = min(cost.shape) - len(mine)
        assert abs(-sum(r.iou for r in mine) + pairs * cost.max() - want) < 1e-3 or abs(want) >= 1e5
        assert len({r.a for r in mine}) == len({r.b for r in mine}) == len(mine)


def plain_filter(measurements, dt, s):
    """The textbook filter with whole matrices."""
    x, p = np.array([*measurements[0][:3], 0, 0, 0, measurements[0][3]]), np.diag([s.initial[0] ** 2] * 3 + [s.initial[1] ** 2] * 3 + [s.initial[2] ** 2])
    h = np.zeros((4, 7))
    h[[0, 1, 2, 3], [0, 1, 2, 6]] = 1
    r = np.diag([s.measured[0] ** 2] * 3 + [s.measured[1] ** 2])
    for z in measurements[1:]:
        f = np.eye(7)
        f[[0, 1, 2], [3, 4, 5]] = dt
        x, p = f @ x, f @ p @ f.T + np.diag([(s.process[0] * dt) ** 2] * 3 + [(s.process[1] * dt) ** 2] * 3 + [(s.process[2] * dt) ** 2])
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        x, p = x + k @ (z - h @ x), (np.eye(7) - k @ h) @ p
    return x, p


def test_filter_equals_the_textbook():
    s = track.Settings()
    seen = [np.array([0.5 * k + RNG.normal() * 0.1, k * 0.1, 0.2, 0.01 * k]) for k in range(12)]
    f = track.Filter(*seen[0], s)
    for z in seen[1:]:
        f.predict(0.5)
        f.update(*z)
    x, p = plain_filter(seen, 0.5, s)
    assert np.allclose(f.x, x) and np.allclose(f.p, p) and abs(f.x[3] - 1.0) < 0.5


def test_registration_finds_a_motion():
    source = RNG.uniform(-2, 2, (300, 3)) * [2, 1, 0.5]
    a = 0.05
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    found = track.register(source, source @ turn.T + [3.0, 1.0, 0.0])
    assert np.allclose(found.rotation, turn, atol=0.02) and np.allclose(found.rotation @ source.mean(0) + found.translation, turn @ source.mean(0) + [3, 1, 0], atol=0.02)
    assert track.register(source[:2], source) is None
    at, away = track.nearest(source[:50] + 0.3, source)
    d = np.linalg.norm(source[:50, None] + 0.3 - source[None], axis=2)
    assert (at == d.argmin(axis=1)).all() and np.allclose(away, d.min(axis=1))


def scene(frames):
    """Columns of boxes given as keyframe -> [(name, x, y)]."""
    rows = [(k, i, *b) for k, boxes in sorted(frames.items()) for i, b in enumerate(boxes)]
    n = len(rows)
    g = {"keyframe": np.array([r[0] for r in rows]), "index": np.array([r[1] for r in rows]), "name": np.array([r[2] for r in rows], object), "x": np.array([r[3] for r in rows], float), "y": np.array([r[4] for r in rows], float)}
    return g | {"t_ns": g["keyframe"] * 500_000_000, "z": np.zeros(n), "w": np.full(n, 2.0), "l": np.full(n, 4.0), "h": np.full(n, 1.5), "yaw": np.zeros(n)}


def test_tracks_live_coast_and_die():
    straight = {k: [("car", k * 0.5, 0.0), ("bus", k * 0.5, 20.0)] for k in range(10)}
    for k in (4, 5):
        straight[k] = straight[k][1:]  # the car is missed twice and comes back
    out = track.track_scene(scene(straight))
    cars = [t for t, r in zip(out["track"], [b for k in sorted(straight) for b in straight[k]]) if r[0] == "car"]
    assert set(cars) == {0} and out["event"].tolist().count("birth") == 2 and out["stable"].all()
    gone = {k: [("car", k * 0.5, 0.0)] for k in (0, 1, 2, 6, 7)}  # missed three times: dead, and born anew
    for k in (3, 4, 5):
        gone[k] = [("bus", 0.0, 50.0)]
    out = track.track_scene(scene(gone))
    assert len({t for t, n in zip(out["track"], scene(gone)["name"]) if n == "car"}) == 2
    other = {0: [("car", 0.0, 0.0)], 1: [("bus", 0.0, 0.0)]}
    assert track.track_scene(scene(other))["event"].tolist() == ["birth", "birth"]


def test_registered_velocity_enters_the_filter():
    cloud = RNG.uniform(-1, 1, (40, 3))
    frames = {k: [("car", k * 1.0, 0.0)] for k in range(4)}
    g = scene(frames)
    plain = track.track_scene(g)
    g["points"] = np.array([*((cloud + [k, 0, 0]).ravel() for k in range(4)), None], object)[:-1]
    seen = track.track_scene(g)
    assert abs(seen["vx"][-1] - 2.0) < abs(plain["vx"][-1] - 2.0) and abs(seen["vx"][-1] - 2.0) < 0.2


def test_tracking_query_gives_every_detection_a_track(spark):
    rows = {(r.scene, r.keyframe, r["index"]) for r in spatial.detections(spark, FOLDER).collect()}
    got = spatial.tracked_boxes(spark, FOLDER).collect()
    assert {(r.scene, r.keyframe, r["index"]) for r in got} == rows and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.scene, r.track), []).append(r)
    assert all(len({r.keyframe for r in t}) == len(t) and sum(r.event == "birth" for r in t) == 1 for t in by.values())


def image_rows(frames):
    rows = [(k, i, *b) for k, boxes in sorted(frames.items()) for i, b in enumerate(boxes)]
    g = {"frame": np.array([r[0] for r in rows]), "index": np.array([r[1] for r in rows]), "name": np.array([r[2] for r in rows], object), "score": np.array([r[3] for r in rows], float), "frame_area": np.full(len(rows), 10_000.0)}
    return g | {c: np.array([r[4][k] for r in rows], float) for k, c in enumerate(("x1", "y1", "x2", "y2"))}


def test_lost_image_boxes_are_recovered_with_decay():
    a, far = (0, 0, 10, 10), (60, 60, 70, 70)
    frames = {k: [("car", 0.9, a), ("bus", 0.8, far)] for k in range(3)} | {k: [("bus", 0.8, far)] for k in (3, 4, 5, 6)}
    out = track.track_images(image_rows(frames))
    back = [(f, h, s) for f, src, h, s in zip(out["frame"], out["source"], out["hops"], out["score"]) if src == "recovered"]
    assert back == [(3, 1, 0.63), (4, 2, 0.441)]  # the third miss drops it
    once = {0: [("car", 0.9, a), ("bus", 0.8, far)], 1: [("bus", 0.8, far)]}
    assert "recovered" not in track.track_images(image_rows(once))["source"]  # one hit is too little evidence
    lost = frames | {3: [("car", 0.5, (1, 1, 11, 11)), ("car", 0.4, (2, 2, 12, 12))]}
    out = track.track_images(image_rows(lost))
    assert not [1 for f, s, n in zip(out["frame"], out["source"], out["name"]) if f == 3 and s == "recovered" and n == "car"]


def test_ground_is_the_road_not_the_mean(spark):
    n = 3000
    reach, turn = RNG.uniform(3, 12, n), RNG.uniform(-math.pi, math.pi, n)
    x, y = reach * np.cos(turn), reach * np.sin(turn)
    z = 0.02 * x - 1.6 + RNG.normal(0, 0.02, n)
    z[::4] += RNG.uniform(0.3, 2, len(z[::4]))
    p = np.column_stack([x, y, z])
    plane, share = ground.ransac(p, 7)
    assert abs(plane.height(0, 0) + 1.6) < 0.03 and abs(plane.height(10, 0) + 1.4) < 0.05 and 0.7 < share < 0.85
    assert ground.ransac(p, 7) == (plane, share)
    g = {"x": x, "y": y, "z": z}
    out = ground.sector_planes(g, "k")
    assert set(out["status"]) == {"fitted"} and sum(out["n"]) == n
    steep = z.copy()
    ahead = np.abs(turn) < math.pi / 8
    steep[ahead] = -1.6 + 0.5 * x[ahead]
    found = ground.sector_planes({"x": x, "y": y, "z": steep}, "k", sectors=8)
    assert "implausible_tilt" in found["status"] and all(abs(h) < 20 for h in found["d"])
    few = ground.sector_planes({"x": x[:100], "y": y[:100], "z": z[:100]}, "k")
    assert set(few["status"]) == {"too_few_points"}


def test_ground_query_equals_its_function(spark):
    points = {}
    for r in spatial.ground_points(spark, FOLDER).collect():
        points.setdefault(r.keyframe, []).append((r.x, r.y, r.z))
    got = {(r.keyframe, r.sector): r for r in spatial.ground_planes(spark, FOLDER).collect()}
    assert len(got) == 8 * len(points)
    for k, p in points.items():
        p = np.array(sorted(p))
        want = ground.sector_planes({"x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}, k)
        for i in range(8):
            assert got[k, i].status == want["status"][i] and abs(got[k, i].d - want["d"][i]) < 1e-5
    kept = {r.event_id for r in spatial.off_ground_points(spark, FOLDER).collect()}
    assert 0 < len(kept) < sum(map(len, points.values()))


PRIOR = ground.Prior((1.8, 0.15), (4.5, 0.4), (1.6, 0.2))


def test_stereo_box_rejects_the_wall_and_stands_on_the_ground():
    rng = np.random.default_rng(1)
    face = np.column_stack([rng.normal(10, 0.03, 400), rng.uniform(-0.9, 0.9, 400), rng.uniform(-0.8, 0.8, 400)])
    wall = np.column_stack([np.full(60, 25.0), rng.uniform(-0.9, 0.9, 60), rng.uniform(-0.8, 0.8, 60)])
    p, stereo = np.concatenate([face, wall]), np.ones(460, bool)
    out = ground.stereo_box(p, stereo, PRIOR, ground.Plane(0, 0, 1, 1.2))
    assert out["status"] == "fit" and abs(out["near"] - 10) < 0.1 and abs(out["z"] - out["h"] / 2 + 1.2) < 1e-9
    assert out["yaw_basis"] == "width_face" and min(out["yaw"], math.pi - out["yaw"]) < 0.1 and abs(out["x"] - 12.25) < 0.2
    beams = np.concatenate([p, np.column_stack([np.full(8, 9.9), np.zeros(8), np.zeros(8)])])
    assert ground.stereo_box(beams, np.arange(468) < 460, PRIOR, ground.Plane(0, 0, 1, 1.2))["lidar_refined"]
    assert ground.stereo_box(p[:10], stereo[:10], PRIOR, ground.FLAT)["status"] == "too_few_stereo"
    assert ground.stereo_box(p + [30, 0, 0], stereo, PRIOR, ground.FLAT)["status"] == "beyond_stereo_cap"
    assert ground.within_prior(0.5, (1.8, 0.15)) == 1.8 and ground.within_prior(5, (1.8, 0.15)) == 2.1 and ground.within_prior(1.9, (1.8, 0.15)) == 1.9


def test_pairing_raises_for_what_is_not_one_to_one(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, who string, v int")
    assert joins.paired(a, a, ["k"], ["who"]).count() == 2
    for b in (a.where("k = 1"), a.unionByName(a.where("k = 1")), a.replace("y", "z")):
        with pytest.raises(Exception, match="counterpart|repeated|identity"):
            joins.paired(a, b, ["k"], ["who"]).collect()
    with pytest.raises(Exception, match="no row for key"):
        joins.looked_up(a, a.where("k = 1").select("k", "v").withColumnRenamed("v", "w"), "k").collect()
