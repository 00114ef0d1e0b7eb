"""Global identities over cameras: keyed state of a site, fed frame by frame.

The identity of a detection depends on what was decided before it on any camera of its site, so a site is the key: sites run in
parallel, a site's frames in order. A site that was idle for longer than an identity lives remembers nobody, and in a table its times of activity
run apart too. The same Site runs over a sorted table (assign) and in a stream (assign_stream).
Time is the frame's own (ts_ms), so results can be repeated. In a stream frames wait until the watermark has passed them, and are then taken in
order of time, so cameras may be behind each other by the stated delay, and a frame may come in parts. Later rows are dropped.

Rows without a vector or with coordinates or their time missing are dropped. A null track id counts as the detection's place in the frame. Rows without a
site are a site of their own.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.functions import constants as C
from wayline.operators import asof
from wayline.operators.matching import greedy, optimal
from wayline.sources.tables import folder, written

INPUT = "site_id long, det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, tid long, x1 long, y1 long, x2 long, y2 long, map_x long, map_y long, emb array<double>"
OUTPUT = "site_id long, det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, gid long, score double, source string, overlap boolean, map_x long, map_y long"
COLUMNS = [c.split()[0] for c in INPUT.split(", ")]


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.sqrt((v * v).sum()))
    return v if size < 1e-8 else v / size


def _ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a with each of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.maximum(0, high - low).prod(2)
    areas = [np.maximum(1, x[:, 2:] - x[:, :2]).prod(1) for x in (a, b)]
    return shared / (areas[0][:, None] + areas[1][None] - shared)


def _apart(p: list | None, q: list | None) -> float | None:
    return None if p is None or q is None else float(np.hypot(p[0] - q[0], p[1] - q[1]))


def _sizes_fit(a: list, b: list) -> bool:
    return min(*a, *b) <= 0 or all(min(x, y) / max(x, y) >= C.SIZE_RATIO for x, y in zip(a, b, strict=True))


class Memory:
    """What a site remembers, as plain dicts: identities by id, tracks and holds by (camera, track), rings by camera, the cache's sightings by place; and counters."""

    def __init__(self) -> None:
        self.identities: dict[int, dict] = {}
        self.tracks: dict[tuple, list] = {}
        self.holds: dict[tuple, list] = {}
        self.rings: dict[str, list[dict]] = {}
        self.recent: dict[int, dict] = {}
        self.next_gid, self.last_ms, self.seen, self.swept = 1, -(1 << 62), 0, -(1 << 62)


class Site:
    """A site's rules over its memory. Identities, tracks and holds expire, the cache and the ring of each camera are short; ids count up from 1.

    What has expired counts as gone wherever it is looked up, and is swept out once in a while, so a frame touches only what it is about.
    """

    def __init__(self, memory: Memory | None = None):
        self.memory = Memory() if memory is None else memory
        self.now = self.memory.last_ms

    def forget(self) -> None:
        """After everything has expired: only the counters stay. Rings name identities that can't come back."""
        for held in (self.memory.identities, self.memory.tracks, self.memory.holds, self.memory.rings, self.memory.recent):
            held.clear()

    def sweep(self) -> None:
        """Drop what has expired."""
        m, idle = self.memory, int(C.MAX_IDLE * 1000)
        for held, gone in ((m.identities, lambda i: self.now - i["last"] > idle), (m.tracks, lambda t: self.now - t[1] > idle), (m.holds, lambda h: self.now > h[1])):
            for key in [k for k, v in held.items() if gone(v)]:
                del held[key]
        m.swept = self.now

    def alive(self, gid: int) -> bool:
        known = self.memory.identities.get(gid)
        return known is not None and self.now - known["last"] <= C.MAX_IDLE * 1000

    # ---- one frame

    def frame(self, cam: str, now: int, rows: list[dict]) -> list[dict]:
        """rows in detection order -> gid, score, source and overlap of each."""
        m = self.memory
        if now - m.last_ms > C.MAX_IDLE * 1000:
            self.forget()
        self.now = now
        m.last_ms = max(m.last_ms, now)
        if now - m.swept > C.MAX_IDLE * 1000:
            self.sweep()
        boxes = np.array([r["box"] for r in rows], float).reshape(-1, 4)
        ring = m.rings.get(cam, [])
        over = _ious(boxes, boxes) >= C.OVERLAP_IOU
        np.fill_diagonal(over, False)
        overlap = over.any(1).tolist()
        # continuity is matched over all of a frame, but only overlapping detections keep what it says
        forced = greedy(self._continuations(boxes, ring)) if any(overlap) else {}
        for i, r in enumerate(rows):
            r["overlap"] = overlap[i]
            r["forced"] = forced.get(i) if overlap[i] else None
        used: set[int] = set()
        out: list[dict | None] = [None] * len(rows)

        def settle(i: int, gid: int, score: float, source: str) -> None:
            self._commit(gid, cam, rows[i], now, score)
            used.add(gid)
            out[i] = {"gid": gid, "score": float(score), "source": source, "overlap": rows[i]["overlap"]}

        free = lambda gid: gid not in used and self.alive(gid)
        open_ = [i for i, r in enumerate(rows) if not self._locked(i, r, cam, now, free, settle)]
        if open_:
            open_ = self._matched(open_, rows, cam, now, ring, used, settle)
        still = []
        for i in open_:
            gid, score = self._remembered(rows[i], cam, now, used)
            if gid is None:
                still.append(i)
            else:
                settle(i, gid, score, "same-cam-cache")
        for i in still:
            gid, m.next_gid = m.next_gid, m.next_gid + 1
            settle(i, gid, 1.0, "new")
        for r, o in zip(rows, out, strict=True):
            if o["overlap"]:
                m.holds[cam, r["tid"]] = [o["gid"], now + int(C.HOLD * 1000), o["score"]]
        seen = [{"gid": o["gid"], "box": list(r["box"]), "ts": now} for r, o in zip(rows, out, strict=True)]
        m.rings[cam] = (ring + seen)[-C.RING :]
        return out

    def _continuations(self, boxes: np.ndarray, ring: list[dict]) -> list[tuple[float, int, int]]:
        if not ring or not len(boxes):
            return []
        before = np.array([p["box"] for p in ring], float)
        iou = _ious(boxes, before)
        centers = [(b[:, :2] + b[:, 2:]) / 2 for b in (boxes, before)]
        dist = np.sqrt(((centers[0][:, None] - centers[1][None]) ** 2).sum(2))
        near = (iou >= C.PREVIOUS_IOU) | (dist <= C.CENTER_NEAR)
        score = iou * 2.0 - dist / C.CENTER_NEAR * 0.25
        return [(float(score[i, j]), int(i), ring[j]["gid"]) for i, j in zip(*np.nonzero(near), strict=True)]

    def _locked(self, i: int, r: dict, cam: str, now: int, free, settle) -> bool:  # noqa: ANN001
        """Hold, known track, or forced by continuity, in this order. A track whose identity is dead or taken is forgotten."""
        m = self.memory
        hold = m.holds.get((cam, r["tid"]))
        if hold and now <= hold[1] and free(hold[0]):
            settle(i, hold[0], hold[2], "occlusion-hold")
            return True
        track = m.tracks.get((cam, r["tid"]))
        if track and now - track[1] <= C.MAX_IDLE * 1000:
            if free(track[0]):
                settle(i, track[0], m.identities.get(track[0])["score"], "local-track")
                return True
            del m.tracks[cam, r["tid"]]
        if r["overlap"] and r["forced"] is not None and free(r["forced"]):
            settle(i, r["forced"], 1.0, "occlusion-forced")
            return True
        return False

    def _can(self, identity: dict, r: dict, cam: str, now: int) -> bool:
        if now - identity["last"] > C.MAX_IDLE * 1000 or not _sizes_fit(r["size"], identity["size"]):
            return False
        dist = _apart(r["map"], identity["map"])
        return dist is None or dist <= C.MAP_GATE * (1.5 if identity["cam"] == cam else 2.0)

    def _matched(self, open_: list[int], rows: list[dict], cam: str, now: int, ring: list[dict], used: set[int], settle) -> list[int]:  # noqa: ANN001
        """Optimal matching with the identities that any open row could be; thresholds hold after it, so a refused row gets no second choice."""
        known = {g: identity for g, identity in self.memory.identities.items() if self.alive(g)}
        gids = [g for g in sorted(known) if g not in used and any(self._can(known[g], rows[i], cam, now) for i in open_)]
        if not gids:
            return open_
        parts = [[self._score(rows[i], g, known[g], cam, now, ring) for g in gids] for i in open_]
        done = set()
        for a, b in optimal(np.array([[p[0] for p in line] for line in parts])):
            i, gid, (score, looks) = open_[a], gids[b], parts[a][b]
            same = known[gid]["cam"] == cam
            frozen = rows[i]["overlap"] and rows[i]["forced"] == gid
            if looks >= C.ACCEPT_APPEARANCE or score >= (C.ACCEPT_SAME_CAMERA if same else C.ACCEPT_FORCED if frozen else C.ACCEPT) or (frozen and score >= C.ACCEPT_FORCED):
                settle(i, gid, score, "batch-match")
                done.add(i)
        return [i for i in open_ if i not in done]

    def _score(self, r: dict, gid: int, identity: dict, cam: str, now: int, ring: list[dict]) -> tuple[float, float]:
        alike = np.sort(np.array([identity["template"], *identity["gallery"]]) @ r["unit"])[::-1]
        looks = float(alike[:3].mean())
        past = [p for p in ring if p["gid"] == gid][-2:]
        motion = 0.5
        if past:
            centers = [np.array([p["box"][0] + p["box"][2], p["box"][1] + p["box"][3]]) / 2 for p in past]
            at = centers[-1]
            if len(past) == 2:
                dt = max((past[1]["ts"] - past[0]["ts"]) / 1000, 1e-3)
                at = at + (centers[1] - centers[0]) / dt * min(max((now - past[1]["ts"]) / 1000, 0.0), C.HORIZON)
            b = past[-1]["box"]
            scale = max(C.MIN_MOTION_SCALE, float(np.hypot(b[2] - b[0], b[3] - b[1])) * 0.75)
            own = np.array([r["box"][0] + r["box"][2], r["box"][1] + r["box"][3]]) / 2
            motion = max(-0.6, 1.0 - min(float(np.hypot(*(own - at))) / scale, 1.6))
        dist = _apart(r["map"], identity["map"])
        place = 0.5 if dist is None else max(-0.4, 1.0 - min(dist / (C.MAP_GATE * 1.8), 1.4))
        idle = (now - identity["last"]) / 1000
        shift = C.OVERLAP_SHIFT if r["overlap"] else 0.0
        total = (C.W_APPEARANCE - shift) * looks + (C.W_MOTION + shift) * motion + C.W_MAP * place + C.W_TIME * max(0.0, 1.0 - max(0.0, idle) / C.MAX_IDLE)
        if identity["cam"] == cam:
            total += C.BONUS_SAME_CAMERA + (C.BONUS_JUST_SEEN if idle <= C.JUST_SEEN else 0.0)
        if r["overlap"] and r["forced"] == gid:
            total += C.BONUS_FORCED
        return total, looks

    def _remembered(self, r: dict, cam: str, now: int, used: set[int]) -> tuple[int | None, float]:
        """The best recent sighting on this camera; of equal ones the newest."""
        best, most, m = None, -np.inf, self.memory
        for place in range(m.seen - 1, max(-1, m.seen - 1 - C.CACHE), -1):
            s = m.recent.get(place % C.CACHE)
            age = None if s is None else (now - s["ts"]) / 1000
            if age is None or age > C.RECENT_WINDOW:
                break  # what comes before is older still, or forgotten
            if s["cam"] != cam or s["gid"] in used or not self.alive(s["gid"]) or not _sizes_fit(r["size"], s["size"]):
                continue
            dist = _apart(r["map"], s["map"])
            far = 0.0 if dist is None else min(dist / (C.MAP_GATE * 1.5), 1.0) * 0.10
            score = float(r["unit"] @ s["emb"]) - far - min(age / C.RECENT_WINDOW, 1.0) * 0.08
            if score > most and score >= C.RECENT_LEAST:
                best, most = s["gid"], score
        return best, most

    def _commit(self, gid: int, cam: str, r: dict, now: int, score: float) -> None:
        m = self.memory
        old = m.identities.get(gid)
        template = r["unit"] if old is None else _unit(C.KEEP * old["template"] + (1 - C.KEEP) * r["unit"])
        gallery = [r["unit"]] if old is None else [*old["gallery"], r["unit"]][-C.GALLERY :]
        m.identities[gid] = {"template": template, "gallery": gallery, "cam": cam, "last": now, "map": r["map"], "size": r["size"], "score": float(score)}
        m.tracks[cam, r["tid"]] = [gid, now]
        m.recent[m.seen % C.CACHE] = {"gid": gid, "cam": cam, "emb": r["unit"], "map": r["map"], "size": r["size"], "ts": now}
        m.seen += 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as Site.frame takes them, with what is told of them besides."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "emb"}
        emb = batch.column("emb")
        flat, lengths = emb.flatten().to_numpy(zero_copy_only=False), emb.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(lengths)
        if len(set(lengths.tolist())) == 1 and lengths[0]:
            units = flat.reshape(len(lengths), -1)
            size = np.sqrt((units * units).sum(1))
            units = units / np.where(size < 1e-8, 1.0, size)[:, None]
        else:
            units = [_unit(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        told, (segment, more) = [columns[c] for c in TOLD], [columns.get(c, [None] * batch.num_rows) for c in ("_segment", "_more")]
        boxes = zip(*(columns[c] for c in ("x1", "y1", "x2", "y2")), strict=True)
        placed = (columns[c] for c in ("tid", "det_idx", "map_x", "map_y"))
        for own, box, tid, idx, x, y, unit, at, follows in zip(zip(*told, strict=True), boxes, *placed, units, segment, more, strict=True):
            size = [max(1, box[2] - box[0]), max(1, box[3] - box[1])]
            yield {"own": own, "box": box, "size": size, "tid": idx if tid is None else tid, "map": None if x is None or y is None else [x, y], "unit": unit, "segment": at, "more": follows}


#: Columns of a detection that are passed on, and their types.
TOLD = ["site_id", "det_id", "cam_name", "frame_no", "det_idx", "ts_ms"]
RESULT = pa.schema([(c, pa.string() if c in ("cam_name", "source") else pa.float64() if c == "score" else pa.bool_() if c == "overlap" else pa.int64()) for c in (x.split()[0] for x in OUTPUT.split(", "))])


def _frames(rows: Iterator[dict]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows in order by camera frame: (site, time, camera, frame), rows."""
    for key, own in groupby(rows, lambda r: (r["own"][0], r["own"][5], r["own"][2], r["own"][3])):
        yield key, list(own)


def _told(rows: list[dict], out: list[dict]) -> list[tuple]:
    return [(*r["own"], o["gid"], o["score"], o["source"], o["overlap"], *(r["map"] or (None, None))) for r, o in zip(rows, out, strict=True)]


def _batch(found: list[tuple], schema: pa.Schema = RESULT) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ORDER = ["ts_ms", "cam_name", "frame_no", "det_idx", "det_id"]


def whole(detections: DataFrame) -> DataFrame:
    """The columns and rows that can be assigned."""
    typed = [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in INPUT.split(", "))]
    return detections.select(*typed).filter(" AND ".join(f"{c} IS NOT NULL" for c in ("emb", "x1", "y1", "x2", "y2", "ts_ms")))


def moments(detections: DataFrame, idle: float = C.MAX_IDLE) -> DataFrame:
    """_site, ts_ms, _n detections, and _segment, the time at which their site became active: after an idle time of more than the limit a site remembers nobody.

    Gaps are found between times of a site, in blocks as long as the limit; what a block begins with is carried over from the blocks before it, a row each.
    """
    ms = int(idle * 1000)
    site, block = F.struct("site_id"), F.floor(F.col("ts_ms") / ms)
    times = detections.groupBy("site_id", "ts_ms").agg(F.count("*").alias("_n"))
    found = asof.latest_before(times, times, ["site_id"], [], ms, order=())
    marks = found.select(site.alias("_site"), "ts_ms", "_n", block.alias("_block"), F.when(F.col("found").isNull(), F.col("ts_ms")).alias("_begins"))
    last = marks.groupBy("_site", "_block").agg(F.max("_begins").alias("_last"))
    before = Window.partitionBy("_site").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_site", "_block", F.max("_last").over(before).alias("_carried"))
    inside = Window.partitionBy("_site", "_block").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    known = marks.withColumn("_own", F.max("_begins").over(inside)).join(carried, ["_site", "_block"])
    return known.select("_site", "ts_ms", "_block", "_n", F.coalesce("_own", "_carried").alias("_segment"))


def segments(detections: DataFrame, idle: float = C.MAX_IDLE) -> DataFrame:
    """detections with their _segment."""
    known = moments(detections, idle).select("_site", "ts_ms", "_segment")
    return detections.withColumn("_site", F.struct("site_id")).join(known, ["_site", "ts_ms"]).drop("_site")


def parts(times: DataFrame, rows: int) -> DataFrame:
    """_site, ts_ms, _segment, _part and _more of moments: a segment's parts of time, from 0, and whether one follows.

    A part begins with the block of the clock in which `rows` detections have come since the last one could, so it has at most as many and those of a block.
    """
    along, all_ = Window.partitionBy("_site", "_segment").orderBy("_block"), Window.partitionBy("_site", "_segment")
    blocks = times.groupBy("_site", "_segment", "_block").agg(F.sum("_n").alias("_many"))
    blocks = blocks.withColumn("_full", F.floor((F.sum("_many").over(along) - F.col("_many")) / rows))
    # a block of very many may fill several parts: numbers without gaps
    blocks = blocks.withColumn("_part", F.dense_rank().over(all_.orderBy("_full")) - 1)
    blocks = blocks.withColumn("_more", F.col("_part") < F.max("_part").over(all_)).drop("_many", "_full")
    return times.join(blocks, ["_site", "_segment", "_block"]).select("_site", "ts_ms", "_segment", "_part", "_more")


#: Detections of a site that a task takes before it hands the site's memory on.
PART_ROWS = 50_000


def assign(detections: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Identities over a table. A site's times of activity are dealt to tasks, and each task goes through its own in order, one frame in memory.

    What is longer than part_rows goes in rounds: a task takes one part of a segment's time and what the part before it left in the site's memory, a row, so
    what a task reads doesn't grow with the table. Rounds are as many as the longest segment has parts; all segments and sites share them.
    Ids count within a site: a segment counts from 1, and the numbers that its site's earlier segments took are added afterwards, from a row for each segment.
    """
    schema = RESULT.append(pa.field("_segment", pa.int64())).append(pa.field("_memory", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, bytes] = {}  # a segment's memory comes before its detections

        def facing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                memory = batch.column("_memory")
                if memory.null_count < len(memory):
                    rows = zip(*(batch.column(c).to_pylist() for c in ("site_id", "_segment", "_memory")), strict=True)
                    kept.update({(site_id, segment): raw for site_id, segment, raw in rows if raw is not None})
                    batch = batch.filter(memory.is_null())
                yield batch.drop_columns(["_memory"])

        site, at, more, waiting = None, None, False, []
        left = lambda: [(at[0], *[None] * (len(RESULT) - 1), at[1], pickle.dumps(site.memory))] if more else []
        for key, rows in _frames(_rows(facing())):
            now = (key[0], rows[0]["segment"])
            if site is None or now != at:
                waiting += left()
                raw = kept.pop(now, None)
                site, at, more = Site(pickle.loads(raw) if raw else None), now, rows[0]["more"]
            waiting += [(*t, at[1], None) for t in _told(rows, site.frame(key[2], key[1], rows))]
            if len(waiting) >= 8192:
                yield _batch(waiting, schema)
                waiting = []
        yield _batch(waiting + left(), schema)

    d = whole(detections)
    times = written(parts(moments(d), part_rows), "moments")
    rounds = (times.agg(F.max("_part")).first()[0] or 0) + 1
    dealt = d.withColumn("_site", F.struct("site_id")).join(times, ["_site", "ts_ms"]).drop("_site")
    if rounds > 1:
        dealt = written(dealt.repartition("_part", "site_id", "_segment"), "parts", by="_part")
    at = folder(d.sparkSession, "assigned")
    memory = None
    for k in range(rounds):
        own = dealt.filter(F.col("_part") == k).drop("_part").withColumn("_memory", F.lit(None).cast("binary"))
        if memory is not None:
            own = own.unionByName(memory, allowMissingColumns=True)
        own = own.repartition("site_id", "_segment").sortWithinPartitions("site_id", "_segment", *ORDER)  # a memory has no time, so it is first
        done = own.mapInArrow(run, OUTPUT + ", _segment long, _memory binary")
        done.write.parquet(f"{at}/_part={k}")
        memory = d.sparkSession.read.schema(done.schema).parquet(f"{at}/_part={k}").filter("_memory IS NOT NULL").select("site_id", "_segment", "_memory")
    found = d.sparkSession.read.schema(done.schema).parquet(at).filter("_memory IS NULL").drop("_memory")
    counts = found.groupBy(F.struct("site_id").alias("_site"), "_segment").agg(F.max("gid").alias("_many"))
    before = Window.partitionBy("_site").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_site", "_segment", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_taken"))
    return found.withColumn("_site", F.struct("site_id")).join(shifts, ["_site", "_segment"]).withColumn("gid", F.col("gid") + F.col("_taken")).select(RESULT.names)


class Stored(dict):
    """A dict over a map state. An entry is read when it is first asked for, all of them only when they are gone through, and what was changed is written back."""

    def __init__(self, state, load: Callable[[tuple], object], save: Callable[[object], tuple], key: Callable[[object], tuple] = lambda k: (k,), back: Callable[[tuple], object] = lambda k: k[0]):  # noqa: ANN001
        super().__init__()
        self.state, self.load, self.save, self.key, self.back = state, load, save, key, back
        self.asked: set = set()
        self.changed: set = set()
        self.all = False

    def get(self, key, default=None):  # noqa: ANN001, ANN201
        if key not in self.asked and not self.all:
            self.asked.add(key)
            if self.state.containsKey(self.key(key)):
                super().__setitem__(key, self.load(self.state.getValue(self.key(key))))
        return super().get(key, default)

    def items(self):  # noqa: ANN201
        if not self.all:
            for raw, value in self.state.iterator():
                key = self.back(tuple(raw))
                if key not in self.asked:
                    super().__setitem__(key, self.load(tuple(value)))
            self.all = True
        return super().items()

    def __setitem__(self, key, value) -> None:  # noqa: ANN001
        self.asked.add(key)
        self.changed.add(key)
        super().__setitem__(key, value)

    def __delitem__(self, key) -> None:  # noqa: ANN001
        self.asked.add(key)
        self.changed.add(key)
        super().__delitem__(key)

    def clear(self) -> None:
        super().clear()
        self.state.clear()
        self.asked, self.changed, self.all = set(), set(), True

    def write(self) -> None:
        for key in self.changed:
            if key in self:
                self.state.updateValue(self.key(key), self.save(self[key]))
            elif self.state.containsKey(self.key(key)):
                self.state.removeKey(self.key(key))
        self.changed = set()


_PAIR = {"key": lambda k: (k[0], int(k[1])), "back": lambda k: (k[0], k[1])}
_place = lambda r: (*(r["map"] or (None, None)), *r["size"])
_placed = lambda x, y, w, h: {"map": None if x is None else [x, y], "size": [w, h]}


class StoredMemory(Memory):
    """A site's memory in keyed state: a frame reads and writes its own tracks, its camera's ring and the identities it names."""

    def __init__(self, states: dict) -> None:
        super().__init__()
        self.counters = states["counters"]
        flat = lambda vs: np.concatenate(vs).tolist()
        self.identities = Stored(
            states["identities"],
            lambda v: {"template": np.array(v[0]), "gallery": list(np.array(v[1]).reshape(-1, len(v[0]))), "cam": v[2], "last": v[3], **_placed(*v[4:8]), "score": v[8]},
            lambda i: (i["template"].tolist(), flat(i["gallery"]), i["cam"], int(i["last"]), *_place(i), i["score"]),
        )
        self.tracks = Stored(states["tracks"], list, lambda t: (int(t[0]), int(t[1])), **_PAIR)
        self.holds = Stored(states["holds"], list, lambda h: (int(h[0]), int(h[1]), float(h[2])), **_PAIR)
        self.rings = Stored(
            states["rings"],
            lambda v: [{"gid": g, "box": list(v[1][4 * k : 4 * k + 4]), "ts": t} for k, (g, t) in enumerate(zip(v[0], v[2], strict=True))],
            lambda ring: ([int(p["gid"]) for p in ring], [int(x) for p in ring for x in p["box"]], [int(p["ts"]) for p in ring]),
        )
        self.recent = Stored(
            states["recent"],
            lambda v: {"gid": v[0], "cam": v[1], "emb": np.array(v[2]), **_placed(*v[3:7]), "ts": v[7]},
            lambda r: (int(r["gid"]), r["cam"], r["emb"].tolist(), *_place(r), int(r["ts"])),
        )
        if self.counters.exists():
            self.next_gid, self.last_ms, self.seen, self.swept = self.counters.get()

    @staticmethod
    def declare(handle: StatefulProcessorHandle) -> dict:
        """The states, as they are declared once for a task; they hold the values of the key that is being handled."""
        vector, place = "array<double>", "map_x long, map_y long, w long, h long"
        return {
            "counters": handle.getValueState("counters", "next_gid long, last_ms long, seen long, swept long"),
            "identities": handle.getMapState("identities", "gid long", f"template {vector}, gallery {vector}, cam string, last long, {place}, score double"),
            "tracks": handle.getMapState("tracks", "cam string, tid long", "gid long, at long"),
            "holds": handle.getMapState("holds", "cam string, tid long", "gid long, until long, score double"),
            "rings": handle.getMapState("rings", "cam string", "gids array<long>, boxes array<long>, times array<long>"),
            "recent": handle.getMapState("recent", "place long", f"gid long, cam string, emb {vector}, {place}, at long"),
        }

    def write(self) -> None:
        for held in (self.identities, self.tracks, self.holds, self.rings, self.recent):
            held.write()
        self.counters.update((self.next_gid, self.last_ms, self.seen, self.swept))


def _plain(value):  # noqa: ANN001, ANN202
    """A value of a pandas row as JSON can hold it; what is missing is null."""
    if isinstance(value, (np.ndarray, list)):
        return [float(x) for x in value]
    return None if pd.isna(value) else value.item() if isinstance(value, np.generic) else value


_ARROW = pa.schema([(c, pa.string() if kind == "string" else pa.list_(pa.float64()) if "array" in kind else pa.int64()) for c, kind in (x.split() for x in INPUT.split(", "))])


class SiteProcessor(StatefulProcessor):
    """Frames that wait, by time, and what the site remembers, bounded by expiries and ring lengths; an idle site keeps counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_ms long", "rows string")
        self.states = StoredMemory.declare(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        counters = self.states["counters"]
        done, fresh = counters.get()[1] if counters.exists() else -(1 << 62), {}
        for batch in rows:
            for r in batch[COLUMNS].to_dict("records"):
                if r["ts_ms"] > done:
                    fresh.setdefault(int(r["ts_ms"]), []).append({c: _plain(r[c]) for c in COLUMNS})
        for at, own in fresh.items():
            before = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (json.dumps(before + own),))
        for at in {min(fresh), max(fresh)} if fresh else ():
            self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        times = sorted(t for (t,) in self.waiting.keys())
        ready, idle = [t for t in times if t < now], int(C.MAX_IDLE * 1000)
        memory = StoredMemory(self.states)
        site, found = Site(memory), []
        for at in ready:
            rows = sorted(json.loads(self.waiting.getValue((at,))[0]), key=lambda r: tuple(r[c] for c in ORDER))
            self.waiting.removeKey((at,))
            for frame, own in _frames(_rows([pa.RecordBatch.from_pylist(rows, schema=_ARROW)])):
                found += _told(own, site.frame(frame[2], frame[1], own))
        if found:
            yield _batch(found).to_pandas(integer_object_nulls=True)
        if ready:
            self.handle.registerTimer(memory.last_ms + idle + 1)
        if len(ready) < len(times):
            self.handle.registerTimer(times[len(ready)] + 1)
        elif now > memory.last_ms + idle:
            site.forget()
        memory.write()

    def close(self) -> None:
        pass


def assign_stream(detections: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Identities in a stream of the same columns (RocksDB state store). delay: how far a camera may be behind the newest frame of all; a frame's
    identities come out once the watermark has passed it."""
    # a millisecond later than it is: a stream's watermark starts at zero, and what isn't after the watermark is late
    timed = whole(detections).withColumn("ts", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("ts", delay)
    return timed.groupBy("site_id").transformWithStateInPandas(SiteProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
