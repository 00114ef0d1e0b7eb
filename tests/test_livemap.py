"""The live map against the batch form at each watermark, the sink that doesn't grow, and a clip that is played over a clock."""

import os

import pytest
from pyspark.sql import functions as F

from wayline.operators import history
from wayline.sources import camera
from wayline.streaming import livemap, sinks

SHAPE = "site_id long, gid long, ts_ms long, det_id long, map_x long, map_y long"


def moves():
    """Identities that come and go, two sites, positions off the plan, missing ones, ties of time."""
    rows = []
    for i in range(60):
        at = i * 100
        rows += [(0, 1, at, i * 10, 2000 - i, -50 + i)] if i < 20 or i > 45 else []
        rows += [(0, 2, at, i * 10 + 1, i, i), (0, 2, at, i * 10 + 2, i + 1, i)] if i % 9 == 0 else []
        rows += [(1, 1, at, i * 10 + 3, 5, 700)] if i < 4 else []
        rows += [(1, 7, at, i * 10 + 4, None, 3)]
    return rows


def run(spark, tmp_path, every, per_run=1):
    """Feeds the moves in parts; after each run: the map, and the batch form at the watermark of what has come so far."""
    rows, told = moves(), []
    edges = range(0, 6001, 500)
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = [r for r in rows if low <= r[2] < high]
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(SHAPE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = sinks.to_map(livemap.changes(stream, "300 milliseconds"), str(tmp_path / "map"), str(tmp_path / "checkpoint"), once=True, every=every)
        query.awaitTermination(200)
        assert query.exception() is None
        so_far = [r for r in rows if r[2] < high]
        now = max(r[2] for r in so_far if r[4] is not None) + 1 - 300
        latest = history.latest_positions(spark.createDataFrame(so_far, SHAPE), key=("site_id", "gid"))
        want = {tuple(r) for r in history.active(latest, now).collect()}
        got = {tuple(r) for r in sinks.read_map(spark, str(tmp_path / "map")).select("site_id", "gid", "map_x", "map_y", "last_seen_ms").collect()}
        told.append((got, want))
    return told


def test_stream_equals_batch_at_each_watermark(spark, tmp_path):
    told = run(spark, tmp_path, every=3)
    assert [g for g, _ in told] == [w for _, w in told]
    seen = [{r[:2] for r in g} for g, _ in told]
    assert (1, 1) in seen[0] and (1, 1) not in seen[-1] and any((0, 1) in a and (0, 1) not in b for a, b in zip(seen, seen[1:], strict=False))
    assert all(0 <= x <= 899 and 0 <= y <= 599 for g, _ in told for _, _, x, y, _ in g)
    # what is kept doesn't grow with the batches
    folders = {f: [x for x in os.listdir(tmp_path / "map" / f) if "=" in x] for f in ("changes", "snapshots")}
    batches = max(int(x.split("=")[1]) for x in folders["changes"])
    assert batches >= 12 and len(folders["snapshots"]) <= 2 and len(folders["changes"]) <= 6


def test_unfinished_snapshot_is_not_read(spark, tmp_path):
    path, shape = str(tmp_path / "map"), "site_id long, gid long, map_x long, map_y long, last_seen_ms long, gone boolean"
    for n, own in enumerate([[(0, 1, 1, 1, 10, False), (0, 2, 2, 2, 10, False)], [(0, 1, None, None, 10, True)], [(0, 2, 3, 3, 20, False)]]):
        spark.createDataFrame(own, shape).write.parquet(f"{path}/changes/batch={n}")
    spark.createDataFrame([(0, 9, 9, 9, 99)], shape.removesuffix(", gone boolean")).write.parquet(f"{path}/snapshots/upto=2")
    os.remove(f"{path}/snapshots/upto=2/_SUCCESS")
    assert [tuple(r) for r in sinks.read_map(spark, path).collect()] == [(0, 2, 3, 3, 20)]


@pytest.mark.parametrize("loop", [True, False])
def test_clip_goes_on_where_it_stopped(spark, tmp_path, loop):
    clip = spark.createDataFrame([("a", f, 10 * f) for f in range(5)] + [("b", f, f) for f in (0, 1, 2)] + [("a", 2, 99)], "cam_name string, frame_no long, x1 long")
    for _ in range(3):  # each run takes what the clock has: the query is stopped and started
        played = camera.play(spark, clip, fps=10, loop=loop, frames_per_batch=4)
        query = played.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))
        before = 0
        for _ in range(200):
            done = query.lastProgress["batchId"] if query.lastProgress else -1
            if done >= before + 2:
                break
            import time

            time.sleep(0.2)
        query.stop()
    got = sorted((r["cam_name"], r["frame_no"], r["ts_ms"], r["loop"], r["x1"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    last = {c: max(r[1] for r in got if r[0] == c) for c in "ab"}
    want = []
    for cam, own in (("a", {0: [0], 1: [10], 2: [20, 99], 3: [30], 4: [40]}), ("b", {0: [0], 1: [1], 2: [2]})):
        for tick in range(last[cam] + 1):
            if loop or tick < len(own):
                want += [(cam, tick, tick * 100, tick // len(own), x) for x in own[tick % len(own)]]
    assert got == sorted(want) and (last["a"] >= 11 if loop else last == {"a": 4, "b": 2})
    if loop:
        assert abs(last["a"] - last["b"]) == 0


def test_clock_admits_at_the_frame_rate(spark, tmp_path):
    clip = spark.createDataFrame([("a", f) for f in range(3)], "cam_name string, frame_no long")
    query = camera.play(spark, clip, fps=5).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).start()
    import time

    began = time.time()
    while time.time() - began < 25 and spark.table("paced").count() < 8:
        time.sleep(0.5)
    took = time.time() - began
    query.stop()
    assert 8 <= spark.table("paced").agg(F.count("*")).first()[0] <= 5 * (took + 2) + 5
