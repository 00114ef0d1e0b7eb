"""How alike detections and identities are, block by block of time, against a plain loop; and no vectors in what is written on the way."""

import os
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

import __spark_entry__ as entry
from wayline.operators import decision, frames, history
from wayline.sources.tables import shared_folder


def unit(v):
    size = np.linalg.norm(v)
    return v if size < 1e-8 else v / size


def test_appearances_equal_a_loop(spark):
    """Identities over block borders, after gaps on both sides of 25 s, without vectors now and then, and with fewer than three of them."""
    draw, ts, own = random.Random(3), 0, []
    for i in range(150):
        ts += draw.choice([200, 200, 1000, 9000, 24_999, 25_000, 25_001, 26_000] if i % 10 == 0 else [200, 3000])
        own.append((0, i, draw.choice("ab"), i, 0, ts, draw.randrange(3), None if i % 11 == 0 else [draw.gauss(0, 1) for _ in range(4)]))
    d = spark.createDataFrame(own, "site_id long, det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, gid long, emb array<double>")
    gated = history.known_at(d.withColumns({c: F.lit(1).cast("long") for c in ("map_x", "map_y", "box_w", "box_h")}), d.withColumns({c: F.lit(1).cast("long") for c in ("map_x", "map_y", "box_w", "box_h")}))
    got = {(r["frame_no"], r["gid"]): r["looks"][r["frame_no"]] for r in history.appearances(gated, d.drop("emb", "gid"), d, d.drop("gid")).collect()}
    want, known = {}, {}
    for _, det, _, frame, _, at, gid, emb in own:
        for g, (template, gallery, last) in known.items():
            if at - last <= 25_000:
                held = [template, *gallery] if template is not None else []
                scores = sorted((float(h @ unit(np.array(emb))) for h in held), reverse=True)[:3] if emb is not None else []
                want[frame, g] = -1.0 if not held else sum(scores) / len(scores) if scores else None
        template, gallery, last = known.get(gid, (None, [], at))
        if at - last > 25_000:
            template, gallery = None, []
        if emb is not None:
            u = unit(np.array(emb))
            template, gallery = u if template is None else unit(template * 0.9 + u * 0.1), [*gallery, u][-6:]
        known[gid] = (template, gallery, at)
    assert got.keys() == want.keys() and len(want) > 150
    assert None in want.values() and -1.0 in want.values()
    assert all(got[k] is v or abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_no_vectors_are_written_on_the_way(spark):
    """F1 to F4: what was written held a vector for each detection, and all vectors of an identity moved to each frame that faced it."""
    home = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(home))
    for name in ("accept_match", "frame_match", "optimal_assign", "pair_scores"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    made = [spark.read.parquet(f"{home}/{x}") for x in set(os.listdir(home)) - before]
    assert made and not [f.name for df in made for f in df.schema.fields if isinstance(f.dataType, ArrayType)]


def test_more_columns_of_a_matching(spark):
    pairs = spark.createDataFrame([(0, "a", 0, 1, 7, 0.9, True), (0, "a", 0, 1, 8, 0.8, False), (0, "a", 0, 2, 7, 0.7, False), (0, "a", 0, 2, 8, 0.1, False)], "site_id long, cam_name string, frame_no long, det_id long, gid long, score double, accepted boolean")
    rows = decision.matched(pairs.withColumn("det_idx", F.col("det_id"))).collect()
    assert {(r["det_id"], r["gid"], r["accepted"], r["det_idx"]) for r in rows} == {(1, 8, False, 1), (2, 7, False, 2)}


def test_gallery_lengths_are_found_once(spark):
    """each product with a gallery's vector found both lengths anew."""
    plan = entry.queries()["gallery_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    compared = [line for line in plan.splitlines() if "AS similarity" in line]
    assert compared and "SQRT" not in compared[0]


def test_cache_offers_equal_a_loop(spark):
    """offers of the cache, compared as tables, with sizes that don't fit, unknown places (which take nothing off), missing vectors and ages over the window."""
    draw = random.Random(5)
    size = lambda: draw.choice([10, 40, 50, None])
    own = [(0, i, draw.choice("ab"), i, 0, i * 150, draw.randrange(4), draw.choice([None, 10, 300]), 5, size(), size(), None if i % 13 == 0 else [draw.gauss(1, 1) for _ in range(3)]) for i in range(120)]
    d = spark.createDataFrame(own, "site_id long, det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, gid long, map_x long, map_y long, box_w long, box_h long, emb array<double>")
    want = {}
    for _, i, cam, _, _, now, _, x, y, w, h, emb in own:
        for _, j, other, _, _, then, gid, sx, sy, rw, rh, old in own[max(0, i - 7) : i]:
            fits = None in (w, h, rw, rh) or (min(w, rw) / max(w, rw) >= 0.35 and min(h, rh) / max(h, rh) >= 0.35)
            if cam == other and now - then <= 900 and fits and emb and old:
                far = 0.0 if x is None or sx is None else min(np.hypot(x - sx, y - sy) / 390, 1) * 0.10
                score = float(unit(np.array(emb)) @ unit(np.array(old))) - far - (now - then) / 1000 / 12 * 0.08
                if score >= 0.36:
                    want[i, gid, i - j] = score
    got = {(r["det_id"], r["gid"], r["back"]): r["score"] for r in frames.remembered(d, d, window=0.9, cache=7).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    best = {}
    for (i, gid, _), score in want.items():
        best[i] = max(best.get(i, (-9, None)), (score, gid))
    few = frames.remembered(d, d, window=0.9, cache=7, best=True).groupBy("det_id").agg(F.max(F.struct("score", "gid")).alias("m")).collect()
    assert {r["det_id"]: r["m"]["gid"] for r in few} == {i: m[1] for i, m in best.items()}
