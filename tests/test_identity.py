"""The identity assigner: its rules one by one, and a stream that equals the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import frames, history
from wayline.plans.calibration import H, SOURCE
from wayline.sources import detections, registry
from wayline.streaming import identity, sinks
from wayline.streaming.identity import Site

A, B = np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])


def det(tid, box=(0, 0, 100, 200), emb=A, place=(10, 10)):
    size = [max(1, box[2] - box[0]), max(1, box[3] - box[1])]
    return {"tid": tid, "box": box, "size": size, "map": None if place is None else list(place), "unit": emb}


def ids(out):
    return [(o["gid"], o["source"]) for o in out]


def test_new_then_known_by_track():
    s = Site()
    assert ids(s.frame("a", 0, [det(1), det(2, (500, 0, 600, 200), B)])) == [(1, "new"), (2, "new")]
    # the track alone decides, whatever it looks like
    assert ids(s.frame("a", 200, [det(1, emb=B)])) == [(1, "local-track")]


def test_track_of_a_taken_identity_is_forgotten():
    s = Site()
    s.frame("a", 0, [det(1)])
    s.memory.tracks["a", 2] = [1, 0]
    out = s.frame("a", 200, [det(1), det(2, (900, 0, 1000, 200), B, (800, 10))])
    assert ids(out) == [(1, "local-track"), (2, "new")]
    assert s.memory.tracks["a", 2][0] == 2


def test_other_camera_by_looks_and_place():
    s = Site()
    s.frame("a", 0, [det(1)])
    assert ids(s.frame("b", 200, [det(7, emb=A)])) == [(1, "batch-match")]


def test_refused_pair_gets_no_second_choice_but_the_cache():
    s = Site()
    s.frame("a", 0, [det(1)])
    # not alike, far away in the picture, on another camera: below the threshold, and the cache is of the same camera only
    assert ids(s.frame("b", 200, [det(7, (900, 0, 1000, 200), -A, (400, 10))])) == [(2, "new")]


def test_gate_of_one_opens_the_identity_for_all():
    s = Site()
    s.frame("a", 0, [det(1)])
    near, far = det(5, (900, 0, 1000, 200), -A, (10, 10)), det(6, (900, 300, 1000, 500), A, (899, 599))
    assert ids(s.frame("a", 200, [near, far]))[1] == (1, "batch-match")  # far alone would not pass the gate
    s = Site()
    s.frame("a", 0, [det(1)])
    assert ids(s.frame("a", 200, [det(6, (900, 300, 1000, 500), A, (899, 599))])) == [(1, "same-cam-cache")]


def test_idle_limits_are_exclusive():
    for ms, known in ((25_000, True), (25_001, False)):
        s = Site()
        s.frame("a", 0, [det(1)])
        assert (s.frame("a", ms, [det(1)])[0]["source"] == "local-track") is known


def test_hold_outlasts_the_track():
    s = Site()
    s.frame("a", 0, [det(1), det(2, (10, 0, 110, 200), B)])
    assert s.memory.holds["a", 1][1] == 800
    assert ids(s.frame("a", 800, [det(1)])) == [(1, "occlusion-hold")]
    assert ids(s.frame("a", 801, [det(1)])) == [(1, "local-track")]


def test_forced_by_continuity_in_an_overlap():
    s = Site()
    s.frame("a", 0, [det(1), det(2, (500, 0, 600, 200), B, (700, 10))])
    out = s.frame("a", 200, [det(11, (0, 0, 100, 200), B), det(12, (20, 0, 120, 200), B)])
    assert ids(out)[0] == (1, "occlusion-forced")


def test_lost_place_disables_the_gate():
    s = Site()
    s.frame("a", 0, [det(1)])
    s.frame("a", 200, [det(1, place=None)])
    assert s.memory.identities[1]["map"] is None


def test_histories_are_bounded():
    s = Site()
    for i in range(300):
        s.frame("a", i * 10, [det(1)])
    m = s.memory
    assert len(m.rings["a"]) == 60 and len(m.recent) == 200 and len(m.identities[1]["gallery"]) == 6
    for i in range(300):  # a new track each time
        s.frame("a", 3000 + i * 1000, [det(10 + i)])
    assert len(m.tracks) <= 2 * 26


@pytest.fixture(scope="module")
def seen(spark):
    d = detections.view(spark, "/root/testdata/sf0.001")
    return frames.enriched(frames.confident(d), SOURCE, H).withColumn("site_id", F.substring("cam_name", 5, 1).cast("long") % 2).cache()


def test_invariants_over_a_table(seen):
    rows = identity.assign(seen).collect()
    assert len(rows) == seen.count()
    per_frame = {}
    for r in sorted(rows, key=lambda r: (r["ts_ms"], r["cam_name"], r["det_idx"])):
        key = r["site_id"], r["cam_name"], r["frame_no"]
        assert r["gid"] not in per_frame.setdefault(key, set())
        per_frame[key].add(r["gid"])
    for site in (0, 1):
        firsts = list(dict.fromkeys(r["gid"] for r in sorted((r for r in rows if r["site_id"] == site), key=lambda r: (r["ts_ms"], r["cam_name"], r["det_idx"]))))
        assert sorted(firsts) == list(range(1, len(firsts) + 1))


def test_sites_keep_their_identities_apart(spark, seen):
    assigned = identity.assign(seen).collect()
    newest = {}
    for r in sorted(assigned, key=lambda r: (r["ts_ms"], r["det_id"])):
        if r["map_x"] is not None:
            newest[r["site_id"], r["gid"]] = r["map_x"], r["map_y"], r["ts_ms"]
    assert {k[0] for k in newest} == {0, 1} and {g for s, g in newest if s == 0} & {g for s, g in newest if s == 1}  # the same numbers in both
    now = max(t for _, _, t in newest.values())
    want = {(*k, min(max(x, 0), 899), min(max(y, 0), 599), t) for k, (x, y, t) in newest.items() if now - t <= 700}
    from wayline.plans.queries import QUERIES

    assert {tuple(r[c] for c in ("site_id", "gid", "map_x", "map_y", "last_seen_ms")) for r in QUERIES["assigned_map"](spark, "/root/testdata/sf0.001").collect()} == want


def test_rows_without_vector_are_dropped(spark, seen):
    empty = seen.withColumn("emb", F.when(F.col("det_id") % 2 == 0, F.col("emb")))
    assert identity.assign(empty).count() == empty.filter("emb IS NOT NULL").count()
    assert identity.assign(seen.limit(0)).count() == 0


def test_stream_equals_table(spark, seen, tmp_path):
    """Cameras come up to two frames behind each other, and frames in parts; a last row of another site moves the watermark past all of it."""
    whole = {(r["det_id"], r["gid"], r["source"], round(r["score"], 9)) for r in identity.assign(seen).collect()}
    rows = seen.select("site_id", *[c for c in identity.COLUMNS if c != "site_id"])
    last = rows.agg(F.max("frame_no")).first()[0]
    # a row's file: by its frame, but odd detections of cameras 2 and 3 come two frames later
    late = (F.substring("cam_name", 5, 1).cast("long") >= 2) & (F.col("det_idx") % 2 == 1)
    comes = F.col("frame_no") + F.when(late, 2).otherwise(0)
    edges = [-1, last // 3, last // 2, last + 2]
    for i in range(3):
        rows.filter((comes > edges[i]) & (comes <= edges[i + 1])).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    end = rows.limit(1).withColumns({"site_id": F.lit(99).cast("long"), "det_id": F.lit(-1).cast("long"), "ts_ms": F.lit((last + 1000) * 200).cast("long")})
    end.coalesce(1).write.parquet(str(tmp_path / "in/3"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = sinks.to_table(sinks.annotated(identity.assign_stream(stream)), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(300)
    assert query.exception() is None
    got = [(r["det_id"], r["gid"], r["source"], round(r["score"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(whole) and set(got) == whole


def test_idle_site_keeps_counters_only():
    s = Site()
    s.frame("a", 0, [det(1)])
    s.forget()
    assert s.memory.next_gid == 2 and not s.memory.identities and not s.memory.rings


def test_scan_and_live(spark, seen, tmp_path):
    columns = [c.split()[0] for c in detections.SCHEMA.split(", ")]
    seen.select(columns).filter("frame_no < 9").coalesce(1).write.parquet(str(tmp_path / "in"))
    whole = detections.scan(spark, str(tmp_path / "in"))
    query = sinks.to_table(detections.live(spark, str(tmp_path / "in")).drop("emb"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["det_id"] for r in got.collect()) == sorted(r["det_id"] for r in whole.collect()) and got.filter("unix_millis(ts) <> ts_ms").count() == 0


def test_floorplan_is_overwritten(spark, tmp_path):
    path, shape = str(tmp_path / "plan"), "seq long, content binary, width int, height int"
    registry.save_floorplan(spark.createDataFrame([(1, b"a", 10, 20), (2, b"b", 30, 40)], shape), path)
    assert [(r["seq"], r["width"]) for r in spark.read.parquet(path).collect()] == [(2, 30)]
    registry.save_floorplan(spark.createDataFrame([(3, b"c", 50, 60)], shape), path)
    registry.save_floorplan(spark.createDataFrame([], shape), path)
    assert [(r["seq"], r["width"]) for r in spark.read.parquet(path).collect()] == [(3, 50)]


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    assert registry.images(spark, str(tmp_path / "*.png")).first()["image_base64"] == "YWJj"
    none = registry.images(spark, str(tmp_path / "none"))
    assert none.count() == 0
    size = registry.floorplan_size(spark.createDataFrame([], "width int, height int")).first()
    assert (size["width"], size["height"]) == (900, 600)
    files = spark.createDataFrame([("c", "a b!.MP4"), ("d", "x.txt")], "name string, file_name string")
    assert [r["url"] for r in registry.uploads(files, F.lit(5)).collect()] == ["uploads/a b.MP4"]


def test_detector_stage(spark):
    frames_ = spark.createDataFrame([("a", 1, b"x")], "cam_name string, frame_no long, image binary")
    boxes = "array<struct<x1:long,y1:long,x2:long,y2:long,conf:double,tid:long>>"

    def load():
        return lambda images: images.map(lambda i: [{"x1": 0, "y1": 0, "x2": len(i), "y2": 9, "conf": 0.9, "tid": 1}])

    out = detections.unpacked(detections.detected(frames_, load, f"cam_name string, frame_no long, boxes {boxes}"))
    assert [(r["det_idx"], r["x2"]) for r in out.collect()] == [(0, 1)]


def plainly(rows):
    """Identities by one Site for each site over all of its rows in order, without Spark."""
    out, sites, taken = {}, {}, None
    key = lambda r: (r["ts_ms"], r["cam_name"], r["frame_no"])
    for at in sorted({(str(r["site_id"]), key(r)) for r in rows}):
        own = sorted((r for r in rows if (str(r["site_id"]), key(r)) == at), key=lambda r: (r["det_idx"], r["det_id"]))
        site = sites.setdefault(at[0], Site())
        unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
        told = [{"tid": r["tid"], "box": (r["x1"], r["y1"], r["x2"], r["y2"]), "size": [max(1, r["x2"] - r["x1"]), max(1, r["y2"] - r["y1"])], "map": [r["map_x"], r["map_y"]], "unit": unit(r["emb"])} for r in own]
        for r, o in zip(own, site.frame(at[1][1], at[1][0], told), strict=True):
            out[r["det_id"]] = (o["gid"], o["source"], round(o["score"], 9))
    return out


@pytest.fixture(scope="module")
def gaps(seen):
    """Two sites and rows without a site, with idle times of just the limit and of more, some inside one block of the clock and some over several."""
    later = F.when(F.col("frame_no") < 7, 0).when(F.col("frame_no") < 12, 25_000 - 200).when(F.col("frame_no") < 20, 60_000).when(F.col("frame_no") < 25, 85_200).otherwise(700_001)
    third = F.when(F.col("cam_name") != "cam_3", F.col("site_id"))
    return seen.withColumns({"site_id": third, "ts_ms": F.col("ts_ms") + later + F.coalesce(F.col("site_id"), F.lit(0)) * 3001}).cache()


def test_segments_run_apart_and_equal_one_run(gaps):
    known = {(r["site_id"], r["_segment"]) for r in identity.segments(identity.whole(gaps)).select("site_id", "_segment").distinct().collect()}
    rows, begins = [r.asDict() for r in gaps.collect()], set()
    for site in (0, 1, None):
        times = sorted({r["ts_ms"] for r in rows if r["site_id"] == site})
        begins |= {(site, t) for b, t in zip([-(10**9), *times], times, strict=False) if t - b > 25_000}
    assert known == begins and len(begins) == 12
    got = {r["det_id"]: (r["gid"], r["source"], round(r["score"], 9)) for r in identity.assign(gaps).collect()}
    assert got == plainly(rows) and len(got) == len(rows)


def test_parts_of_time_hand_the_memory_on(spark, seen, gaps):
    """Rounds over short parts of time give what one run gives; a part has at most so many rows, and those of one block of the clock."""
    slow = seen.withColumn("ts_ms", F.col("ts_ms") * 20)  # frames are 4 s apart, so there are several blocks, and no gap
    for d in (gaps, slow):
        times = identity.parts(identity.moments(identity.whole(d)), 20)
        per = d.withColumn("_site", F.struct("site_id")).join(times, ["_site", "ts_ms"]).groupBy("_site", "_segment", "_part", F.floor(F.col("ts_ms") / 25_000).alias("b")).count().collect()
        sizes = {}
        for r in per:
            sizes.setdefault((r["_site"]["site_id"], r["_segment"]), {}).setdefault(r["_part"], []).append(r["count"])
        for own in sizes.values():
            assert sorted(own) == list(range(len(own))) and all(sum(x) <= 20 + max(x) for x in own.values())
        assert d is gaps or all(len(own) > 3 for own in sizes.values())
        whole = [(r["det_id"], r["gid"], r["source"], r["score"]) for r in identity.assign(d).collect()]
        assert sorted((r["det_id"], r["gid"], r["source"], r["score"]) for r in identity.assign(d, part_rows=20).collect()) == sorted(whole)
        assert {r[0]: (r[1], r[2], round(r[3], 9)) for r in whole} == plainly([r.asDict() for r in d.collect()])


def test_stream_goes_on_after_a_stop(spark, gaps, tmp_path):
    """Two runs of one query: what the first kept in state is what the second goes on from, over idle times too."""
    rows = gaps.select(identity.COLUMNS)
    end = rows.filter("site_id = 0").limit(1).withColumns({"site_id": F.lit(99).cast("long"), "det_id": F.lit(-1).cast("long"), "ts_ms": F.lit(10_000_000).cast("long")})
    parts = [rows.filter("frame_no < 10"), rows.filter("frame_no >= 10 AND frame_no < 22"), rows.filter("frame_no >= 22"), end]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        if i not in (1, 3):
            continue
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = sinks.to_table(identity.assign_stream(stream, "4 seconds"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination(300)
        assert query.exception() is None
    got = {r["det_id"]: (r["gid"], r["source"], round(r["score"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plainly([r.asDict() for r in rows.collect()])


class Kept:
    """A map state that tells which keys were touched."""

    def __init__(self, held):
        self.held, self.touched, self.gone_through = dict(held), set(), False

    def containsKey(self, key):  # noqa: N802
        self.touched.add(key)
        return key in self.held

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def updateValue(self, key, value):  # noqa: N802
        self.touched.add(key)
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.held.pop(key)

    def iterator(self):
        self.gone_through = True
        return iter(list(self.held.items()))

    def clear(self):
        self.held = {}


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_frame_touches_its_own_keys_only():
    states = {n: Kept({}) for n in ("identities", "tracks", "holds", "rings", "recent")} | {"counters": Held()}
    memory = identity.StoredMemory(states)
    site, plain = Site(memory), Site()
    for s in (site, plain):
        for i in range(8):
            s.frame("ab"[i % 2], i * 200, [det(i * 10 + j, (j * 300, 0, j * 300 + 100, 200), np.eye(3)[j], (j * 90, 10)) for j in range(3)])
    memory.write()
    for n in ("identities", "tracks", "holds", "rings", "recent"):
        states[n].touched, states[n].gone_through = set(), False
    again = identity.StoredMemory(states)
    rows = [det(71, (300, 0, 400, 200), np.eye(3)[1], (90, 10))]
    known = plain.memory.tracks["b", 71][0]
    assert ids(Site(again).frame("b", 1600, rows)) == ids(plain.frame("b", 1600, rows)) == [(known, "local-track")]
    again.write()
    assert states["tracks"].touched == {("b", 71)} and states["rings"].touched == {("b",)} and states["identities"].touched == {(known,)} and len(states["recent"].touched) == 1
    assert not any(states[n].gone_through for n in ("identities", "tracks", "holds", "rings", "recent"))
    # and what is kept equals a memory that never left
    whole = identity.StoredMemory(states)
    assert {g: i["last"] for g, i in whole.identities.items()} == {g: i["last"] for g, i in plain.memory.identities.items()}
    assert dict(whole.tracks.items()) == plain.memory.tracks and dict(whole.rings.items()) == plain.memory.rings
