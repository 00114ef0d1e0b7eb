"""Column expressions against hand-computed values and plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayline.functions import geometry, scoring, text, vectors
from wayline.operators import history
from wayline.operators.matching import greedy, optimal
from wayline.plans.calibration import H, SOURCE, TARGET


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def lits(*values):
    return tuple(F.lit(v) for v in values)


def test_boxes(spark):
    a, b = lits(0, 0, 10, 10), lits(5, 0, 15, 10)
    flat = lits(3, 3, 3, 9)
    got = one(spark, iou=geometry.iou(a, b), same=geometry.iou(a, a), thin=geometry.iou(flat, flat), dist=geometry.distance(*geometry.center(a), *geometry.center(b)), none=geometry.distance(F.lit(None).cast("double"), *lits(1.0, 2.0, 3.0)))
    assert got == {"iou": pytest.approx(1 / 3), "same": 1.0, "thin": 0.0, "dist": 5.0, "none": None}  # a flat box has an area but no intersection


def test_clamping_keeps_a_pixel(spark):
    c = geometry.clamped(lits(-5.7, 3.9, -2.0, 900.0), 100, 50)
    assert tuple(one(spark, **{f"c{i}": v for i, v in enumerate(c)}).values()) == (0, 3, 1, 49)
    edge = geometry.clamped(lits(99, 49, 200, 200), 100, 50)
    assert tuple(one(spark, **{f"c{i}": v for i, v in enumerate(edge)}).values()) == (99, 49, 99, 49)


def test_truncation_is_toward_zero(spark):
    got = one(spark, a=geometry.truncated(F.lit(-2.9)), b=geometry.truncated(F.lit(2.9)), foot=geometry.foot(lits(-5, 0, 2, 7))[0])
    assert got == {"a": -2, "b": 2, "foot": -1}


@pytest.mark.parametrize(("x", "y", "inside"), [(100, 250, True), (550, 250, True), (550, 300, True), (50, 250, False), (0, 480, True), (550, 481, False), (1100, 365, True), (1101, 365, False)])
def test_polygon_has_its_edges(spark, x, y, inside):
    assert one(spark, v=geometry.in_polygon(F.lit(x), F.lit(y), SOURCE))["v"] is inside


def test_without_calibration_all_is_inside_and_nowhere(spark):
    x, y = geometry.project(F.lit(1), F.lit(2), None)
    assert one(spark, i=geometry.in_polygon(F.lit(1), F.lit(2), None), x=x, y=y) == {"i": True, "x": None, "y": None}


def test_homography():
    for (x, y), (u, v) in zip(SOURCE, TARGET, strict=True):
        w = H[6] * x + H[7] * y + H[8]
        assert ((H[0] * x + H[1] * y + H[2]) / w, (H[3] * x + H[4] * y + H[5]) / w) == (pytest.approx(u), pytest.approx(v))
    assert geometry.fit_homography(SOURCE[:3], TARGET[:3]) is None
    assert geometry.fit_homography([[0, 0], [1, 1], [2, 2], [3, 3]], TARGET) is None
    assert geometry.fit_homography(None, TARGET) is None


def test_horizon_has_no_place(spark):
    x, _ = geometry.project(F.lit(1), F.lit(0), [1, 0, 0, 0, 1, 0, 1, 0, -1])
    assert one(spark, x=x) == {"x": None}


def test_calibration_is_what_its_points_fix():
    assert geometry.fit_homography(SOURCE, TARGET) == pytest.approx(H, abs=1e-9)


def test_vectors(spark):
    zero = F.array(*lits(0.0, 0.0))
    a, b = F.array(*lits(3.0, 4.0)), F.array(*lits(4.0, 3.0))
    got = one(spark, n=vectors.normalized(a), z=vectors.normalized(zero), c=vectors.cosine(a, b), cz=vectors.cosine(a, zero), none=vectors.mean_of_best(F.array().cast("array<double>")), best=vectors.mean_of_best(F.array(*lits(0.1, 0.9, 0.5, 0.7))))
    assert got["n"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0] and got["c"] == pytest.approx(0.96) and got["cz"] == 0.0
    assert got["none"] == -1.0 and got["best"] == pytest.approx(0.7)


def test_template_is_an_ordered_mean(spark):
    shape = "site_id long, gid long, ts_ms long, cam_name string, frame_no long, det_idx long, det_id long, emb array<double>"
    rows = spark.createDataFrame([(0, 1, 2, "a", 2, 0, 11, [0.0, 2.0]), (0, 1, 1, "a", 1, 0, 10, [1.0, 0.0]), (1, 1, 1, "a", 1, 0, 12, [0.0, 0.0]), (0, 2, 1, "a", 1, 1, 13, None)], shape)
    length = math.hypot(0.9, 0.1)
    last = {(r["site_id"], r["gid"]): (r["version"], r["template"], len(r["gallery"])) for r in history.vectors_of(rows).collect()}
    assert last[0, 1][0] == 11 and last[0, 1][1] == pytest.approx([0.9 / length, 0.1 / length]) and last[0, 1][2] == 2
    assert last[1, 1] == (12, [0.0, 0.0], 1) and last[0, 2] == (13, None, 0)
    # only what is asked for comes out, as it was then
    asked = spark.createDataFrame([(0, 1, 10)], "site_id long, gid long, version long")
    assert [(r["version"], r["template"]) for r in history.vectors_of(rows, asked).collect()] == [(10, [1.0, 0.0])]


def test_text(spark):
    got = one(
        spark, name=text.safe_name(F.lit("  ../a b*ñ½.mp4 "), F.lit("d")), none=text.safe_name(F.lit("***"), F.lit("d")), ext=text.extension(F.lit("A/b.c.MoV")), hidden=text.extension(F.lit("a/.mp4")),
        device=text.device_index(F.lit("007")), url=text.device_index(F.lit("7a")), label=text.label(F.lit(3), F.lit(None).cast("double"), F.lit(9), True), rate=text.frame_rate(F.lit(0.0)), nan=text.frame_rate(F.lit(float("nan"))),
    )
    assert got == {"name": "..a bñ½.mp4", "none": "d", "ext": ".mov", "hidden": "", "device": 7, "url": None, "label": "GID 3 | L9", "rate": 25.0, "nan": 25.0}


@pytest.mark.parametrize(("json", "ok"), [("[[1,2],[3,4],[5,6],[7,8]]", True), ("[[1,2],[3,4],[5,6]]", False), ("[[1,2],[3,4],[5,6],[7]]", False), ("[1,2,3,4]", False), ('{"a":1}', False), ("", False), ("nope", False), (None, False)])
def test_points(spark, json, ok):
    assert one(spark, v=text.points(F.lit(json).cast("string")).isNotNull())["v"] is ok


def test_scores_at_their_limits(spark):
    none = F.lit(None).cast("double")
    got = one(
        spark, motion=scoring.motion_score(none, F.lit(1), F.lit(1)), far=scoring.motion_score(F.lit(1e6), F.lit(1), F.lit(1)), at=scoring.motion_score(F.lit(0.0), F.lit(1), F.lit(1)), map=scoring.map_score(none), mapfar=scoring.map_score(F.lit(1e6)),
        time=scoring.time_score(F.lit(25000), F.lit(0)), now=scoring.time_score(F.lit(0), F.lit(0)), size=scoring.size_gate(*lits(35, 10, 100, 10)), small=scoring.size_gate(*lits(34, 10, 100, 10)), odd=scoring.size_gate(*lits(0, 10, 100, 10)),
        same=scoring.map_gate(F.lit(True), F.lit(391.0)), other=scoring.map_gate(F.lit(False), F.lit(391.0)), unknown=scoring.map_gate(F.lit(True), none),
    )
    assert got == {"motion": 0.5, "far": pytest.approx(-0.6), "at": 1.0, "map": 0.5, "mapfar": pytest.approx(-0.4), "time": 0.0, "now": 1.0, "size": True, "small": False, "odd": True, "same": False, "other": True, "unknown": True}


def test_prediction_is_a_quarter_second_at_most(spark):
    x, y = scoring.predicted(*[F.lit(v) for v in (2000, 10.0, 0.0, 1000, 0.0, 0.0, 0)])
    stays, _ = scoring.predicted(*[F.lit(v) for v in (2000, 10.0, 0.0, 1000)], *[F.lit(None).cast("double")] * 2, F.lit(None).cast("long"))
    assert one(spark, x=x, y=y, s=stays) == {"x": 12.5, "y": 0.0, "s": 10.0}


def test_overlap_trusts_motion(spark):
    score = lambda over, forced: scoring.pair_score(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(over), F.lit(False), F.lit(0.0), F.lit(forced))
    got = one(spark, a=score(False, True), b=score(True, False), c=score(True, True))
    assert got == {"a": pytest.approx(0.42), "b": pytest.approx(0.56), "c": pytest.approx(0.78)}


@given(st.lists(st.lists(st.floats(-2, 2), min_size=1, max_size=5), min_size=1, max_size=5).filter(lambda m: len({len(r) for r in m}) == 1))
@settings(max_examples=80, deadline=None)
def test_optimal_equals_brute_force(table):
    from itertools import permutations

    m = np.array(table)
    n, k = m.shape
    wide = m if n <= k else m.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    pairs = optimal(m)
    assert len(pairs) == min(n, k) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    assert sum(m[r, c] for r, c in pairs) == pytest.approx(best)


def test_optimal_of_nothing():
    assert optimal(np.zeros((0, 3))) == []


@given(st.lists(st.tuples(st.sampled_from([0.1, 0.5, 0.9]), st.integers(0, 4), st.integers(0, 4)), max_size=15))
@settings(max_examples=80, deadline=None)
def test_greedy_is_a_matching_that_no_better_pair_escapes(pairs):
    chosen = greedy(pairs)
    assert len(set(chosen.values())) == len(chosen)
    rank = {(d, g): max(p for p in pairs if p[1:] == (d, g)) for d, g in chosen.items()}
    for p in pairs:
        if chosen.get(p[1]) != p[2]:
            assert any(r >= p for (d, g), r in rank.items() if d == p[1] or g == p[2])


def test_greedy_ties_go_to_the_larger():
    assert greedy([(0.5, 1, 1), (0.5, 2, 1), (0.5, 2, 3)]) == {2: 3, 1: 1}
