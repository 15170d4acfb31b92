"""Order-dependent operators against brute force over plain rows."""

import numpy as np

from scenemill.operators import assign
from scenemill.plans import grouped, release

FOLDER = "/root/testdata/sf0.001"


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r["image"], []).append(r)
    return out


def test_nms_equals_the_matrix_form(spark):
    rows = assign.nms(grouped._flat(spark, FOLDER), ["image"], ["index"], most=2).collect()
    for part in by_image(rows).values():
        part.sort(key=lambda r: r["index"])
        names = np.array([r["name"] for r in part], object)
        order, by = assign.suppressed(np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in part]), np.array([r["score"] for r in part]), names)
        standing = 0
        for rank, i in enumerate(order):
            want = "kept" if by[i] < 0 else "same_class" if names[i] == names[by[i]] else "cross_class"
            if want == "kept":
                want, standing = "kept" if standing < 2 else "over_cap", standing + 1
            assert (part[i]["rank"], part[i]["fate"], part[i]["kept"]) == (rank, want, want == "kept")


def taken(pairs, key):
    left, right, out = set(), set(), set()
    for p in sorted(pairs, key=key):
        if p["pred"] not in left and p["gt"] not in right:
            left.add(p["pred"])
            right.add(p["gt"])
            out.add((p["image"], p["pred"], p["gt"]))
    return out


def test_greedy_and_consumed_pairs(spark):
    pairs = grouped._candidates(spark, FOLDER, 0.1)
    groups = by_image(pairs.collect()).values()
    got = lambda df: {(r["image"], r["pred"], r["gt"]) for r in df.collect()}
    greedy = assign.greedy_matches(pairs, ["image"], "pred", "gt", "score", "iou", 0.3)
    assert got(greedy) == set().union(*(taken([p for p in g if p["iou"] >= 0.3], lambda p: (-p["score"], p["pred"], -p["iou"], p["gt"])) for g in groups))
    consumed = assign.consumed_pairs(pairs, ["image"], "pred", "gt", "iou")
    assert got(consumed) == set().union(*(taken(g, lambda p: (-p["iou"], p["pred"], p["gt"])) for g in groups))


def test_folds_of_no_rows(spark):
    none = grouped._candidates(spark, FOLDER, 0.1).where("false")
    assert assign.consumed_pairs(none, ["image"], "pred", "gt", "iou").count() == 0
    assert assign.nms(grouped._flat(spark, FOLDER).where("false"), ["image"], ["index"]).count() == 0


def test_stitch_chains_are_paths(spark):
    from scenemill.operators.release import chains_of, stitched

    pieces, scene = release._pieces(spark, FOLDER)
    joins = stitched(pieces, scene, "track")
    links = [(r["scene"], r["before"], r["after"]) for r in joins.collect()]
    assert links and len({x[:2] for x in links}) == len(links) == len({(s, b) for s, _, b in links})
    back = {(s, b): a for s, a, b in links}
    chains = chains_of(pieces, joins, scene, "track").collect()
    assert len(chains) == pieces.count()
    for r in chains:
        head = r["track"]
        while (r["scene"], head) in back:
            head = back[r["scene"], head]
        assert r["chain"] == head


def test_matches_by_class_and_by_distance(spark):
    pairs = grouped._candidates(spark, FOLDER, 0.1).collect()
    from scenemill.plans import inputs, joins

    want = set()
    for g in by_image(pairs).values():
        for k in (0, 1):
            want |= {t[:2] for t in taken([p for p in g if p["pred"] % 2 == k and p["iou"] >= 0.3], lambda p: (-p["score"], p["pred"], -p["iou"], p["gt"]))}
    got = joins.best_overlap_labels(spark, FOLDER).collect()
    assert {(r["image"], r["pred"]) for r in got if r["hit"]} == want and {(r["image"], r["pred"]) for r in got} == {(p["image"], p["pred"]) for p in pairs}

    near = set()
    for part in by_image(inputs.solid_boxes(spark, FOLDER).collect()).values():
        found = [{"image": a["image"], "pred": a["index"], "gt": b["index"], "score": round(a["confidence"], 6), "d": ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5} for a in part if a["index"] % 2 == 1 for b in part if b["index"] % 2 == 0]
        near |= taken([p for p in found if p["d"] <= 15], lambda p: (-p["score"], p["pred"], p["d"], p["gt"]))
    assert {(r["image"], r["pred"], r["gt"]) for r in joins.nearest_matches(spark, FOLDER).collect()} == near
