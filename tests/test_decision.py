"""The composed decision against the assigner's own, and state as of a frame: nothing looks ahead, identities die, the cache is bounded."""

import pytest
from pyspark.sql import functions as F

from wayline.operators import asof, decision, frames, history
from wayline.plans.calibration import H, SOURCE
from wayline.sources import detections
from wayline.streaming import identity


def sites(spark, sf):
    d = detections.view(spark, f"/root/testdata/sf{sf}")
    return frames.enriched(frames.confident(d), SOURCE, H).withColumn("site_id", F.substring("cam_name", 5, 1).cast("long") % 2)


def test_relational_decision_equals_the_assigner(spark):
    """Every frame of sf0.01 is decided from what the assigner had assigned before it: holds, tracks, continuity, the matching and the cache all agree with it."""
    s = sites(spark, "0.01").cache()
    assigned = s.join(identity.assign(s).select("det_id", "gid", "score", "overlap", "source"), "det_id").cache()
    want = {r["det_id"]: (r["gid"] if r["source"] != "new" else None, r["source"], r["score"]) for r in assigned.collect()}
    got = {r["det_id"]: (r["gid"], r["source"], r["score"]) for r in decision.decided(s, assigned.drop("source")).collect()}
    assert got.keys() == want.keys() and len(want) > 3000
    assert {v[1] for v in want.values()} >= {"occlusion-hold", "local-track", "batch-match", "new"}
    assert {d: v[:2] for d, v in got.items()} == {d: v[:2] for d, v in want.items()}
    assert all(abs(got[d][2] - want[d][2]) < 1e-9 for d in want)


ROW = "site_id long, det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, tid long, x1 long, y1 long, x2 long, y2 long, gid long, emb array<double>, map_x long, map_y long, score double, overlap boolean"


def rows(spark, own):
    """(det_id, cam, frame, ts, tid, gid, overlap) as assigned rows of one place and look."""
    d = spark.createDataFrame([(0, i, cam, f, 0, ts, tid, 0, 0, 100, 200, gid, [1.0, 0.0], 10, 10, 0.5, over) for i, cam, f, ts, tid, gid, over in own], ROW)
    return frames.enriched(d).withColumns({"map_x": F.lit(10).cast("long"), "map_y": F.lit(10).cast("long")})


def test_holds_begin_and_end(spark):
    """A detection is not held by an overlap that comes later; a hold lasts 0.8 s after the last overlap, or until the next one takes its track."""
    d = rows(spark, [(0, "a", 0, 0, 7, 1, False), (1, "a", 1, 10_000, 7, 1, True), (2, "a", 2, 10_400, 7, 2, True), (3, "a", 3, 11_200, 7, 2, False), (4, "a", 4, 11_201, 7, 2, False), (5, "b", 3, 11_200, 7, 2, False)])
    found = {r["det_id"]: (r["held_gid"], r["until_ms"]) for r in history.held(d.drop("gid"), d.filter("overlap")).collect()}
    assert found == {0: (None, None), 1: (None, None), 2: (1, 10_800), 3: (2, 11_200), 4: (None, None), 5: (None, None)}
    spans = [(r["held_gid"], r["from_ms"], r["until_ms"]) for r in history.holds(d.filter("overlap")).orderBy("from_ms").collect()]
    assert spans == [(1, 10_000, 10_400), (2, 10_400, 11_200)]


def test_tracks_are_known_from_before_only(spark):
    d = rows(spark, [(0, "a", 0, 0, 7, 1, False), (1, "a", 1, 200, 7, 2, False), (2, "a", 2, 25_200, 7, 3, False), (3, "a", 3, 50_201, 7, 4, False), (4, "a", 4, 50_300, None, 5, False), (5, "a", 5, 50_400, None, 6, False)])
    found = {r["det_id"]: r["known_gid"] for r in history.by_local_track(d.drop("gid"), d).collect()}
    assert found == {0: None, 1: 1, 2: 2, 3: None, 4: None, 5: 5}


def test_frame_not_assigned_yet_has_candidates(spark):
    d = rows(spark, [(0, "a", 0, 0, 7, 1, False), (1, "a", 1, 200, 7, 1, False)])
    got = frames.previous(d.filter("frame_no = 1"), d.filter("frame_no = 0")).collect()
    assert [(r["frame_no"], r["gid"], r["score"]) for r in got] == [(1, 1, 2.0)]


def test_identities_die(spark):
    """A camera frame meets identities that were seen at most 25 s before it, on any camera; cameras of one moment take turns."""
    d = rows(spark, [(0, "a", 0, 0, 7, 1, False), (1, "b", 0, 0, 8, 2, False), (2, "a", 1, 25_000, 7, 3, False), (3, "b", 1, 25_001, 7, 3, False)])
    got = {(r["cam_name"], r["frame_no"], r["gid"], r["version"]) for r in history.known_at(d, d).collect()}
    assert got == {("b", 0, 1, 0), ("a", 1, 1, 0), ("a", 1, 2, 1), ("b", 1, 3, 2)}
    # after that long an absence looks begin anew
    looks = rows(spark, [(0, "a", 0, 0, 7, 1, False), (1, "a", 1, 30_000, 7, 1, False)]).withColumn("emb", F.when(F.col("det_id") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    assert [r["template"] for r in history.vectors_of(looks).collect()] == [[0.0, 1.0]]


def test_cache_is_bounded_and_shared(spark):
    """The camera's own sighting drops out once 200 of other cameras have come after it."""
    busy = [(i, "b", i, 100 + i, 1000 + i, 50 + i, False) for i in range(1, 200)]
    for more, gid in ((0, 9), (1, None)):
        d = rows(spark, [(0, "a", 0, 100, 7, 9, False), *busy, *[(500, "c", 0, 300, 5, 5, False)][:more], (900, "a", 1, 400, 8, 9, False)])
        got = [r["gid"] for r in frames.recent_match(d.filter("det_id = 900"), d.filter("det_id < 900")).collect()]
        assert got == ([gid] if gid else [])


@pytest.mark.parametrize("reach", [3, 10, 1000])
def test_latest_before_equals_a_loop(spark, reach):
    import random

    draw = random.Random(reach)
    facts = [(draw.choice(["x", "y", None]), draw.randrange(60), draw.choice("ab"), i) for i in range(120)]
    looks = [(draw.choice(["x", "y", "z", None]), draw.randrange(70), draw.choice("ab"), i) for i in range(80)]
    f = spark.createDataFrame(facts, "k string, ts_ms long, cam_name string, det_id long")
    k = spark.createDataFrame(looks, "k string, ts_ms long, cam_name string, look long")
    got = {r["look"]: r["found"] and r["found"]["det_id"] for r in asof.latest_before(k, f, ["k"], ["det_id"], reach, order=("cam_name",)).collect()}
    want = {}
    for key, ts, cam, i in looks:
        before = [(t, c, d) for q, t, c, d in facts if q == key and (t, c) < (ts, cam)]
        best = max(before, default=None)
        want[i] = best[2] if best and ts - best[0] <= reach else None
    assert got == want


def test_starts_number_rows_in_order(spark):
    d = spark.createDataFrame([("a", f, i) for f in (0, 3, 5000, 9000, 9001) for i in range(f % 4 + 1)] + [("b", 2, 0)], "cam_name string, frame_no long, det_idx long")
    more = spark.createDataFrame([("a", 4, 0), ("c", 0, 0)], "cam_name string, frame_no long, det_idx long")
    got = {(r["cam_name"], r["frame_no"]): r["_start"] for r in asof.starts(d, more).collect()}
    assert got == {("a", 0): 1, ("a", 3): 2, ("a", 4): 6, ("a", 5000): 6, ("a", 9000): 7, ("a", 9001): 8, ("b", 2): 1, ("c", 0): 1}
