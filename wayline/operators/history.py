"""Bounded histories and what is read from them: rings, trails, latest positions, sessions, holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StructField, StructType

from wayline.functions import constants as C
from wayline.functions import geometry, scoring, vectors
from wayline.operators import asof
from wayline.sources.detections import newest

#: Order of sightings: time, then the detection's number.
SEEN = ["ts_ms", "det_id"]


def camera_ring(assigned: DataFrame, n: int = C.RING) -> DataFrame:
    """The last n assignments of each camera."""
    return newest(assigned, n, ["cam_name"], SEEN)


def appended(ring: DataFrame, fresh: DataFrame, n: int = C.RING) -> DataFrame:
    """A ring after more rows have come."""
    return camera_ring(ring.unionByName(fresh), n)


def shared_cache(assigned: DataFrame, n: int = C.CACHE) -> DataFrame:
    """The last n sightings of all cameras together: a top-n, kept by each task before one task ends it."""
    return assigned.orderBy(*[F.desc(c) for c in SEEN]).limit(n)


def recent(assigned: DataFrame, n: int = C.HISTORY) -> DataFrame:
    """The last n sightings of each identity on each camera, with their place, oldest first."""
    kept = newest(assigned, n, ["cam_name", "gid"], SEEN)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("cam_name", "gid").orderBy(*SEEN)))


def predicted_centers(assigned: DataFrame) -> DataFrame:
    """Where each sighting was expected, from the two sightings of its identity on its camera before it."""
    w = Window.partitionBy("cam_name", "gid").orderBy(*SEEN)
    back = lambda c, n: F.lag(c, n).over(w)
    x, y = scoring.predicted(F.col("ts_ms"), back("center_x", 1), back("center_y", 1), back("ts_ms", 1), back("center_x", 2), back("center_y", 2), back("ts_ms", 2))
    return assigned.withColumns({"pred_x": x, "pred_y": y, "last_w": back("box_w", 1), "last_h": back("box_h", 1)})


def latest_positions(positions: DataFrame, width: int = C.MAP_WIDTH, height: int = C.MAP_HEIGHT, key: Sequence[str] = ("gid",)) -> DataFrame:
    """key, map_x, map_y, last_seen_ms: the newest position of each identity over all cameras, moved onto the floorplan. Combines before it shuffles.

    key: what an identity is known by. Ids that assign() gives count within a site, so there it is site_id and gid.
    """
    x, y = geometry.on_map(F.col("map_x"), F.col("map_y"), width, height)
    known = positions.filter(F.col("map_x").isNotNull() & F.col("map_y").isNotNull())
    place = F.struct(x.alias("map_x"), y.alias("map_y"))
    return known.groupBy(*key).agg(F.max_by(place, F.struct(*SEEN)).alias("p"), F.max("ts_ms").alias("last_seen_ms")).select(*key, "p.map_x", "p.map_y", "last_seen_ms")


def active(latest: DataFrame, now_ms: int | None = None, ttl: float = C.MAP_TTL) -> DataFrame:
    """Positions not older than ttl seconds at now, or at the newest of all."""
    if now_ms is not None:
        return latest.filter(F.lit(now_ms) - F.col("last_seen_ms") <= int(ttl * 1000))
    return latest.join(F.broadcast(latest.agg(F.max("last_seen_ms").alias("_now")))).filter(F.col("_now") - F.col("last_seen_ms") <= int(ttl * 1000)).drop("_now")


def trails(positions: DataFrame, n: int = 50, key: Sequence[str] = ("site_id", "gid")) -> DataFrame:
    """Each position with the last n of its identity, oldest first. Ids count within a site."""
    w = Window.partitionBy(*key).orderBy(*SEEN).rowsBetween(1 - n, 0)
    return positions.withColumn("trail", F.collect_list(F.struct("map_x", "map_y")).over(w))


def sessions(assigned: DataFrame, key: list[str], idle: float = C.MAX_IDLE) -> DataFrame:
    """Times during which a key was never idle longer than the limit: key, session, start_ms, end_ms, n."""
    w = Window.partitionBy(*key).orderBy(*SEEN)
    opened = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > int(idle * 1000)).cast("long"), F.lit(0).cast("long"))
    numbered = assigned.withColumn("_new", opened).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(*key, "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))


def recent_counts(assigned: DataFrame, window: float = C.RECENT_WINDOW) -> DataFrame:
    """How many sightings its camera remembers at each sighting, itself included: a range of time.

    A row is dealt to its block of time and to the next, so a range lies within one block and no task sees a camera's whole history.
    """
    ms = int(window * 1000)
    at = F.floor(F.col("ts_ms") / ms)
    dealt = assigned.select("*", F.explode(F.array(at, at + 1)).alias("_block"))
    w = Window.partitionBy("cam_name", "_block").orderBy("ts_ms").rangeBetween(-ms, 0)
    return dealt.withColumn("remembered", F.count("*").over(w)).filter(F.col("_block") == at).drop("_block")


#: A local track: what a camera's tracker calls one object.
TRACK = ("site_id", "cam_name", "tid")


def holds(overlapped: DataFrame, hold: float = C.HOLD) -> DataFrame:
    """When each track was held as whom: site_id, cam_name, tid, held_gid, from_ms, until_ms; holds after from_ms and up to until_ms.

    overlapped: assignments in an overlap. Each holds its track for a while, or until the next one; holds of one identity that follow each other are one.
    """
    own = Window.partitionBy(*TRACK).orderBy(*SEEN)
    ms = int(hold * 1000)
    opens = (F.lag("gid").over(own).eqNullSafe(F.col("gid")) & (F.col("ts_ms") - F.lag("ts_ms").over(own) <= ms)).eqNullSafe(False) | F.lag("ts_ms").over(own).isNull()
    marked = overlapped.select(*TRACK, "gid", *SEEN, opens.cast("int").alias("_opens")).withColumn("_at", F.sum("_opens").over(own))
    spans = marked.groupBy(*TRACK, "_at").agg(F.min("gid").alias("held_gid"), F.min("ts_ms").alias("from_ms"), (F.max("ts_ms") + ms).alias("_end"))
    following = F.lead("from_ms").over(Window.partitionBy(*TRACK).orderBy("_at"))
    return spans.withColumn("until_ms", F.least("_end", F.coalesce(following, "_end"))).drop("_at", "_end")


def held(detections: DataFrame, overlapped: DataFrame, hold: float = C.HOLD, more: Sequence[str] = ()) -> DataFrame:
    """Detections with held_gid and until_ms of the hold that their track has at their frame (null: none), and more columns of the row that made it."""
    found = asof.latest_before(detections, overlapped, TRACK, ["gid", *more], int(hold * 1000), name="_hold")
    named = {"held_gid": F.col("_hold.gid"), "until_ms": F.col("_hold.ts_ms") + int(hold * 1000)} | {f"held_{c}": F.col(f"_hold.{c}") for c in more}
    return found.withColumns(named).drop("_hold")


def by_local_track(detections: DataFrame, assigned: DataFrame, idle: float = C.MAX_IDLE) -> DataFrame:
    """Detections with known_gid and known_ms: the identity that their track had last before their frame, unless it was idle too long."""
    found = asof.latest_before(detections, assigned, TRACK, ["gid"], int(idle * 1000), name="_track")
    return found.withColumns({"known_gid": F.col("_track.gid"), "known_ms": F.col("_track.ts_ms")}).drop("_track")


# ---- identities as known at a frame

_IDENTITY = ["site_id", "gid"]


def known_at(camera_frames: DataFrame, sightings: DataFrame, idle: float = C.MAX_IDLE) -> DataFrame:
    """For each camera frame (site_id, cam_name, frame_no, ts_ms) the identities of its site that are alive right before it, as frames.gate takes them.

    An identity is what its last sighting made it (version: that sighting's det_id), and dies once it has been idle too long: frames meet the identities
    of two blocks of that length, so the work is linear in time.
    """
    ms = int(idle * 1000)
    block = F.floor(F.col("ts_ms") / ms)
    there = sightings.select(*_IDENTITY, F.explode(F.array(block, block + 1)).alias("_block")).distinct()
    at = camera_frames.select(*asof.CAMERA_FRAME, "ts_ms").distinct().withColumn("_block", block)
    looks = at.join(there, ["site_id", "_block"]).drop("_block")
    scores = ["score"] if "score" in sightings.columns else []
    found = asof.latest_before(looks, sightings, _IDENTITY, ["det_id", "cam_name", "map_x", "map_y", "box_w", "box_h", *scores], ms, name="_last").filter("_last IS NOT NULL")
    names = {"version": "det_id", "id_last_cam": "cam_name", "id_last_ms": "ts_ms", "id_map_x": "map_x", "id_map_y": "map_y", "id_box_w": "box_w", "id_box_h": "box_h"} | {f"id_{c}": c for c in scores}
    return found.select(*asof.CAMERA_FRAME, F.col("ts_ms").alias("at_ms"), "gid", *[F.col(f"_last.{v}").alias(k) for k, v in names.items()])


def with_motion(identities: DataFrame, assigned: DataFrame, ring: int = C.RING) -> DataFrame:
    """identities (as known_at gives them) with their last two places in their frame's camera's ring: h_cam (null: not there), h_cx, h_cy, h_ms, h_w, h_h, b_cx, b_cy, b_ms."""
    key = ["site_id", "cam_name", "gid"]
    at = ["site_id", "cam_name", "frame_no"]
    start = asof.starts(assigned, identities, ("site_id", "cam_name"))
    rows = asof.numbered(assigned.select(*at, "det_idx", "det_id", "gid", "ts_ms", "center_x", "center_y", "box_w", "box_h"), start, at)
    rows = asof.latest_before(rows, rows, key, ["center_x", "center_y", "ts_ms"], ring, "_n", (), "_back")
    looks = identities.join(start, at).withColumnRenamed("_start", "_n")
    found = asof.latest_before(looks, rows, key, ["cam_name", "center_x", "center_y", "ts_ms", "box_w", "box_h", "_back"], ring, "_n", (), "_in")
    names = {"h_cam": "cam_name", "h_cx": "center_x", "h_cy": "center_y", "h_ms": "ts_ms", "h_w": "box_w", "h_h": "box_h"}
    back = F.when(F.col("_n") - F.col("_in._back._n") <= ring, F.col("_in._back"))
    past = {f"b_{k}": back[v] for k, v in (("cx", "center_x"), ("cy", "center_y"), ("ms", "ts_ms"))}
    return found.withColumns({k: F.col(f"_in.{v}") for k, v in names.items()} | past).drop("_in", "_n")


def vectors_of(sightings: DataFrame, asked: DataFrame | None = None, idle: float = C.MAX_IDLE, every: int | None = None) -> DataFrame:
    """site_id, gid, version, template, gallery: what an identity looks like after each sighting that is asked for (site_id, gid, version), or after its last.

    every: instead, after its last sighting in each block of so many milliseconds, with that sighting's ts_ms. A template is sequential by its meaning: a task streams
    through its identities in order and holds one template and one gallery. After too long a time without a sighting an identity begins anew.
    """
    ms, every_last = int(idle * 1000), asked is None
    told = ["site_id", "gid", "version", "template", "gallery", *(["ts_ms"] if every else [])]

    def mixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen, template, gallery, version = None, 0, None, [], None
        row = lambda: (*known, version, template, list(gallery), seen)[: len(told)]
        for rows in batches:
            out = []
            for site, gid, det, at, wanted, emb in zip(*(rows[c].tolist() for c in ("site_id", "gid", "det_id", "ts_ms", "_asked")), rows["emb"], strict=True):
                if every_last and known is not None and ((site, gid) != known or (every and at // every != seen // every)):
                    out.append(row())
                if (site, gid) != known or at - seen > ms:
                    known, template, gallery = (site, gid), None, []
                if emb is not None:
                    template, gallery = _seen(template, gallery, _unit(emb))
                seen, version = at, det
                if wanted:
                    out.append(row())
            yield pd.DataFrame(out, columns=told)
        if every_last and known is not None:
            yield pd.DataFrame([row()], columns=told)

    rows = sightings.select(*_IDENTITY, *asof.ORDER, *asof.INSIDE, F.col("emb").cast("array<double>").alias("emb"))
    if every_last:
        rows = rows.withColumn("_asked", F.lit(False))
    else:
        marks = asked.select(*_IDENTITY, F.col("version").alias("det_id"), F.lit(True).alias("_mark")).distinct()
        rows = rows.join(marks, [*_IDENTITY, "det_id"], "left").withColumn("_asked", F.col("_mark").isNotNull()).drop("_mark")
    # many parts for few identities, so that hardly two of them meet in one task
    ordered = (rows.repartition(CHAINS, *_IDENTITY) if every else rows.repartition(*_IDENTITY)).sortWithinPartitions(*_IDENTITY, *asof.ORDER, *asof.INSIDE)
    kinds = [f"{c} {sightings.schema[n].dataType.simpleString()}" for c, n in (("site_id", "site_id"), ("gid", "gid"), ("version", "det_id"))]
    return ordered.mapInPandas(mixed, ", ".join([*kinds, "template array<double>", "gallery array<array<double>>", *(["ts_ms long"] if every else [])]))


#: Parts that identities are dealt to where their vectors are gone through.
CHAINS = 96


def appearances(gated: DataFrame, pending: DataFrame, assigned: DataFrame, embedded: DataFrame, idle: float = C.MAX_IDLE) -> DataFrame:
    """gated (as known_at gives it) with looks: how alike each pending detection of its frame is to the identity as its version left it, by det_id.

    embedded: site_id, det_id, ts_ms, emb of all detections of pending and assigned (a detection may come twice); pending needs none itself. Whoever is alive at a frame
    was seen in the frame's block of time, as long as an identity lives, or in the one before. So a site's block gets its own vectors, and what each identity looked
    like when the block before ended: a vector is moved twice (along its identity, and to its block), and no template is moved to the frames that face it.
    """
    ms = int(idle * 1000)
    block = F.floor(F.col("ts_ms") / ms)
    order = [*asof.ORDER, *asof.INSIDE]
    ends = vectors_of(assigned, idle=idle, every=ms)
    kind = lambda n: F.lit(n).alias("_kind")
    parts = [
        embedded.select("site_id", block.alias("_block"), kind(0), "det_id", F.col("emb").cast("array<double>").alias("emb")),
        assigned.select("site_id", block.alias("_block"), kind(1), "gid", *order),
        ends.select("site_id", (block + 1).alias("_block"), kind(2), "gid", "ts_ms", F.col("version").alias("det_id"), F.concat("template", F.flatten("gallery")).alias("emb")),
        pending.select("site_id", block.alias("_block"), kind(3), "cam_name", "frame_no", "det_id"),
    ]
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part, allowMissingColumns=True)
    asked = gated.withColumn("_block", F.floor(F.col("at_ms") / ms))
    schema = StructType([*gated.schema.fields, StructField("looks", MapType(LongType(), DoubleType()))])
    key = ["site_id", "_block"]
    return asked.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(_comparing(ms), schema)


def _comparing(ms: int):  # noqa: ANN202
    def compared(asked: pa.Table, told: pa.Table) -> pa.Table:
        rows = asked.drop_columns(["_block"])
        seen, sightings, ends, faced = (told.filter(pc.equal(told["_kind"], k)) for k in range(4))
        seen = seen.filter(pc.is_valid(seen["emb"]))
        raw = seen["emb"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        units = raw.reshape(len(seen), -1) if len(seen) else np.zeros((0, 1))
        size = np.sqrt((units * units).sum(1, keepdims=True))
        units = units / np.where(size < vectors.TINY, 1.0, size)
        at = {d: i for i, d in enumerate(seen["det_id"].to_pylist())}
        # what each identity was when the block began, and then after each of its sightings that is asked for
        begun, held, wanted = {}, {}, set(rows["version"].to_pylist())
        for gid, version, ts, own in zip(*(ends[c].to_pylist() for c in ("gid", "det_id", "ts_ms", "emb")), strict=True):
            parts = [] if own is None else list(np.array(own).reshape(-1, units.shape[1] if len(units) else len(own)))
            begun[gid] = (parts[0] if parts else None, parts[1:], ts)
            held[version] = parts
        sightings = sightings.sort_by([(c, "ascending") for c in ("gid", *asof.ORDER, *asof.INSIDE)])
        now, last, template, gallery = None, None, None, []
        for gid, version, ts in zip(*(sightings[c].to_pylist() for c in ("gid", "det_id", "ts_ms")), strict=True):
            if gid != now:
                now, (template, gallery, last) = gid, begun.get(gid, (None, [], None))
            if last is not None and ts - last > ms:
                template, gallery = None, []
            if version in at:
                template, gallery = _seen(template, gallery, units[at[version]])
            last = ts
            if version in wanted:
                held[version] = [] if template is None else [template, *gallery]
        frames: dict[tuple, list[int]] = {}
        for i, frame in enumerate(zip(rows["cam_name"].to_pylist(), rows["frame_no"].to_pylist(), strict=True)):
            frames.setdefault(frame, []).append(i)
        facing: dict[tuple, list[int]] = {}
        for cam, frame, det in zip(*(faced[c].to_pylist() for c in ("cam_name", "frame_no", "det_id")), strict=True):
            facing.setdefault((cam, frame), []).append(det)
        keys, values, versions = [()] * len(rows), [()] * len(rows), rows["version"].to_pylist()
        for frame, own in frames.items():
            dets = facing.get(frame, [])
            there = [d for d in dets if d in at]
            against = [held.get(versions[i], []) for i in own]
            alike = _mean_of_best(against, units[[at[d] for d in there]])
            missing = [d for d in dets if d not in at]
            for i, line, parts in zip(own, alike.tolist(), against, strict=True):
                keys[i], values[i] = there + missing, line + [None if parts else -1.0] * len(missing)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        looks = pa.MapArray.from_arrays(pa.array(offsets), pa.array([k for own in keys for k in own], pa.int64()), pa.array([v for own in values for v in own], pa.float64()))
        return rows.append_column("looks", looks)

    return compared


def _mean_of_best(held: list[list[np.ndarray]], units: np.ndarray, k: int = 3) -> np.ndarray:
    """For each list of vectors the mean of the k best products with each unit (a column); -1 where there is none."""
    many = np.array([len(h) for h in held])
    if not many.any() or not len(units):
        return np.full((len(held), len(units)), -1.0)
    products = np.stack([v for h in held for v in h]) @ units.T
    table = np.full((len(held), max(k, many.max()), len(units)), -np.inf)
    table[np.repeat(np.arange(len(held)), many), np.concatenate([np.arange(n) for n in many])] = products
    best = -np.sort(-table, axis=1)[:, :k]
    counted = np.minimum(many, k)[:, None]
    return np.where(counted > 0, np.where(np.isfinite(best), best, 0.0).sum(1) / np.maximum(counted, 1), -1.0)


def _seen(template: np.ndarray | None, gallery: list[np.ndarray], unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Template and gallery after one more sighting."""
    mixed = unit if template is None else _unit(template * C.KEEP + unit * (1 - C.KEEP))
    return mixed, [*gallery[1 - C.GALLERY :], unit]


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v if size < vectors.TINY else v / size
