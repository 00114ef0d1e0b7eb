"""Operators inside a frame and between a frame and what is known: filters, enrichment, overlaps, candidates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions import constants as C
from wayline.functions import geometry, scoring, vectors
from wayline.operators import asof

FRAME = ["cam_name", "frame_no"]


def confident(detections: DataFrame, least: float = C.CONFIDENCE) -> DataFrame:
    return detections.filter(F.col("conf") >= least)


def enriched(detections: DataFrame, polygon: Sequence[Sequence[float]] | None = None, h: Sequence[float] | None = None) -> DataFrame:
    """Foot, size, center and floorplan position of each detection whose foot is in the camera's region. Cheap columns only: nothing is shuffled."""
    b = geometry.box()
    foot, extent, center = geometry.foot(b), geometry.extent(b), geometry.center(b)
    # generated columns stand for themselves: otherwise each use below would repeat whatever a box's sides are computed from
    found = F.struct(*[c.alias(n) for c, n in zip((*foot, *extent, *center), ("foot_x", "foot_y", "box_w", "box_h", "center_x", "center_y"), strict=True)])
    out = detections.select("*", F.inline(F.array(found)))
    out = out.filter(geometry.in_polygon(F.col("foot_x"), F.col("foot_y"), polygon))
    x, y = geometry.project(F.col("foot_x"), F.col("foot_y"), h)
    return out.withColumns({"map_x": x, "map_y": y})


def with_cameras(detections: DataFrame, cameras: DataFrame) -> DataFrame:
    """Detections with their camera's plane and region (cameras: cam_name, src_pts, h), as columns; a dimension of a row for each camera."""
    return detections.join(cameras, "cam_name", "left")


def overlaps(detections: DataFrame, least: float = C.OVERLAP_IOU) -> DataFrame:
    """Pairs a < b of one frame whose boxes overlap: cam_name, frame_no, a, b, iou. Frames bound the pairs; equality on the frame keeps the join hashed."""
    side = lambda p: detections.select(*FRAME, F.col("det_idx").alias(f"{p}_idx"), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    pairs = side("a").join(side("b"), FRAME).filter("a_idx < b_idx").withColumn("iou", geometry.iou(geometry.box("a_"), geometry.box("b_")))
    return pairs.filter(F.col("iou") >= least).select(*FRAME, F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), "iou")


def overlapping(pairs: DataFrame) -> DataFrame:
    """Each detection in some overlap, once."""
    return pairs.select(*FRAME, F.explode(F.array("a", "b")).alias("det_idx")).distinct()


def flagged(detections: DataFrame) -> DataFrame:
    """Detections with overlap, without a self join: a frame's boxes meet in a window over the frame, which holds few rows."""
    b = F.struct("det_idx", "x1", "y1", "x2", "y2")
    own = geometry.box()
    other = F.filter("_boxes", lambda o: (o["det_idx"] != F.col("det_idx")) & (geometry.iou(own, (o["x1"], o["y1"], o["x2"], o["y2"])) >= C.OVERLAP_IOU))
    return detections.withColumn("_boxes", F.collect_list(b).over(Window.partitionBy(*FRAME))).withColumn("overlap", F.size(other) > 0).drop("_boxes")


def previous(detections: DataFrame, assigned: DataFrame, ring: int = C.RING) -> DataFrame:
    """Candidates for continuity: pairs of a detection and one of the last `ring` assignments of its camera before its frame, which need not be assigned itself.

    assigned: cam_name, frame_no, det_idx, gid and a box. A pair counts if the boxes overlap enough or their centers are near. Rows are
    numbered along each camera, so the ring is a range of numbers, and both sides are dealt by (camera, number / ring):
    a detection looks into two such blocks, never at a camera's whole history.
    """
    start = asof.starts(assigned, detections)
    box = [F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")]
    held = asof.numbered(assigned, start, FRAME).select("cam_name", "_n", "gid", *box, F.floor(F.col("_n") / ring).alias("_block"))
    looks = detections.join(start, FRAME).withColumn("_block", F.explode(F.sequence(F.floor((F.col("_start") - ring) / ring), F.floor((F.col("_start") - 1) / ring))))
    pairs = looks.drop("gid").join(held, ["cam_name", "_block"]).filter((F.col("_n") >= F.col("_start") - ring) & (F.col("_n") < F.col("_start")))
    a, b = geometry.box(), geometry.box("p_")
    pairs = pairs.withColumns({"iou": geometry.iou(a, b), "dist": geometry.distance(*geometry.center(a), *geometry.center(b))})
    pairs = pairs.filter((F.col("iou") >= C.PREVIOUS_IOU) | (F.col("dist") <= C.CENTER_NEAR))
    return pairs.select(*FRAME, "det_idx", "gid", (F.col("iou") * 2.0 - F.col("dist") / C.CENTER_NEAR * 0.25).alias("score"))


def gate(pending: DataFrame, identities: DataFrame, key: Sequence[str] = tuple(asof.CAMERA_FRAME)) -> DataFrame:
    """Identities that some pending detection of the same key could be: once one passes, the identity is scored against all of them."""
    ok = scoring.can_match(F.col("now_ms"), F.col("_cam"), F.col("map_x"), F.col("map_y"), F.col("box_w"), F.col("box_h"))
    own = pending.select(*[F.col(k).alias(f"_{k}") for k in key], "now_ms", F.col("cam_name").alias("_cam"), "map_x", "map_y", "box_w", "box_h")
    for k in key:
        ok = (F.col(k) == F.col(f"_{k}")) & ok
    return identities.join(own, ok, "left_semi")


def scored(pending: DataFrame, identities: DataFrame, key: Sequence[str] = tuple(asof.CAMERA_FRAME)) -> DataFrame:
    """All pairs of pending detections and identities of a key (a camera frame) with their parts and score.

    pending: site_id, det_id, cam_name, now_ms, map_x/y, center_x/y, box_w/h, overlap, forced_gid. identities: site_id, gid, looks (how alike each detection of
    the frame is, as history.appearances gives it), the id_ columns, and the camera and centers of the last sightings (h_cam, h_cx, h_cy, h_ms, h_w, h_h and b_cx, b_cy, b_ms before).
    """
    pairs = pending.join(identities, list(key))
    same = F.col("id_last_cam") == F.col("cam_name")
    known = F.coalesce(F.col("h_cam") == F.col("cam_name"), F.lit(False))
    px, py = scoring.predicted(F.col("now_ms"), F.col("h_cx"), F.col("h_cy"), F.col("h_ms"), F.col("b_cx"), F.col("b_cy"), F.col("b_ms"))
    moved = F.when(known, geometry.distance(F.col("center_x"), F.col("center_y"), px, py))
    pairs = pairs.withColumns(
        {
            "appearance": F.element_at("looks", F.col("det_id")),
            "motion": scoring.motion_score(moved, F.col("h_w"), F.col("h_h")),
            "map": scoring.map_score(geometry.distance(F.col("map_x"), F.col("map_y"), F.col("id_map_x"), F.col("id_map_y"))),
            "time": scoring.time_score(F.col("now_ms"), F.col("id_last_ms")),
            "forced": F.coalesce(F.col("forced_gid") == F.col("gid"), F.lit(False)),
            "same_camera": same,
        }
    )
    idle = scoring.seconds(F.col("now_ms"), F.col("id_last_ms"))
    pairs = pairs.withColumn("score", scoring.pair_score(F.col("appearance"), F.col("motion"), F.col("map"), F.col("time"), F.col("overlap"), F.col("same_camera"), idle, F.col("forced")))
    return pairs.withColumn("accepted", scoring.accept(F.col("appearance"), F.col("score"), F.col("same_camera"), F.col("overlap"), F.col("forced")))


def remembered(detections: DataFrame, sightings: DataFrame, window: float = C.RECENT_WINDOW, cache: int = C.CACHE, best: bool = False) -> DataFrame:
    """What the cache that all cameras of a site share offers each detection at its frame: det_id, gid, score, back (how many sightings ago, from 1).

    The cache holds the site's last `cache` sightings before the frame, and of those the detection's own camera's count, if they are not older than the window.
    Sightings are numbered along the site, so the cache is a range of numbers, and both sides are dealt by (site, camera, number / cache): what meets there, `cache`
    sightings at most, is compared as two tables of vectors. best: only the best offer of each such part, of equal ones the newest.
    """
    start = asof.site_starts(sightings, detections)
    at = ["site_id", *asof.ORDER]
    body = ["ts_ms", "map_x", "map_y", "box_w", "box_h", "emb"]
    keep = [c for c in ("det_idx", "det_id", "gid", "emb", "map_x", "map_y", "box_w", "box_h") if c in sightings.columns]
    rows = asof.numbered(sightings.select(*at, *keep), start, at)
    key = ["site_id", "cam_name", "_block"]
    held = rows.select("site_id", "cam_name", F.floor(F.col("_n") / cache).alias("_block"), "_n", "gid", *body).withColumn("emb", F.col("emb").cast("array<double>"))
    looks = detections.withColumn("emb", F.col("emb").cast("array<double>")).select(*at, "det_id", *body[1:]).join(start, at)
    looks = looks.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_start") - cache) / cache), F.floor((F.col("_start") - 1) / cache))))
    looks = looks.select(*key, "_start", "det_id", *body)
    kinds = f"det_id {detections.schema['det_id'].dataType.simpleString()}, gid {sightings.schema['gid'].dataType.simpleString()}, score double, back long"
    held = held.select(*[F.col(c).alias(f"s_{c}") for c in held.columns])  # both may come from one table
    return looks.groupBy(*key).cogroup(held.groupBy(*[f"s_{c}" for c in key])).applyInArrow(_recalling(int(window * 1000), cache, best), kinds)


def _recalling(window: int, cache: int, best: bool):  # noqa: ANN202
    def recalled(looks: pa.Table, held: pa.Table) -> pa.Table:
        held = held.rename_columns([c.removeprefix("s_") for c in held.column_names]).sort_by([("_n", "descending")])
        looks, held = (t.filter(t["emb"].is_valid()) for t in (looks, held))
        row, column = np.zeros(0, int), np.zeros(0, int)
        score, back = np.zeros((0, 0)), np.zeros((0, 0), int)
        if len(looks) and len(held):
            units = [_units(t) for t in (looks, held)]
            side = lambda c: (_numbers(looks, c)[:, None], _numbers(held, c)[None])
            (w, rw), (h, rh), (x, sx), (y, sy), (now, then) = (side(c) for c in ("box_w", "box_h", "map_x", "map_y", "ts_ms"))
            back = looks["_start"].to_numpy()[:, None] - held["_n"].to_numpy()[None]
            with np.errstate(invalid="ignore", divide="ignore"):
                close = lambda a, b: np.minimum(a, b) / np.maximum(a, b) >= C.SIZE_RATIO
                known = np.minimum(np.minimum(w, h), np.minimum(rw, rh)) > 0
                fits = ~known | (close(w, rw) & close(h, rh))
                far = np.nan_to_num(np.minimum(np.sqrt((x - sx) ** 2 + (y - sy) ** 2) / (C.MAP_GATE * 1.5), 1.0) * 0.10)
            age = (now - then) / 1000.0
            score = units[0] @ units[1].T - far - np.minimum(age / C.RECENT_WINDOW, 1.0) * 0.08
            good = (back >= 1) & (back <= cache) & (now - then <= window) & fits & (score >= C.RECENT_LEAST)
            if best:
                # the newest come first, and so does the first of equal ones
                column = np.where(good, score, -np.inf).argmax(1)
                row = np.flatnonzero(good[np.arange(len(looks)), column])
                column = column[row]
            else:
                row, column = np.nonzero(good)
        found = {"det_id": looks["det_id"].take(pa.array(row)), "gid": held["gid"].take(pa.array(column)), "score": pa.array(score[row, column], pa.float64()), "back": pa.array(back[row, column], pa.int64())}
        return pa.table(found)

    return recalled


def _units(rows: pa.Table) -> np.ndarray:
    v = rows["emb"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(size < vectors.TINY, 1.0, size)


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    """A column as floating point, what is missing as NaN."""
    return rows[column].cast(pa.float64()).to_numpy(zero_copy_only=False)


def recent_match(detections: DataFrame, sightings: DataFrame) -> DataFrame:
    """The best remembered sighting of each detection, of equal ones the newest: det_id, gid, score."""
    best = F.max(F.struct("score", (-F.col("back")).alias("newest"), "gid")).alias("m")
    return remembered(detections, sightings, best=True).groupBy("det_id").agg(best).select("det_id", "m.gid", "m.score")


def attached(detections: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """Detections with the result of the same place in the same frame, null where there is none."""
    return detections.join(results.select(*FRAME, "det_idx", F.col(column)), [*FRAME, "det_idx"], "left")


def alive(rows: DataFrame, identities: DataFrame, key: str = "gid") -> DataFrame:
    return rows.join(identities.select(key).distinct(), key, "left_semi")


def unused(rows: DataFrame, used: DataFrame, key: str | list[str] = "gid") -> DataFrame:
    return rows.join(used, key, "left_anti")


def colored(overlap: Column) -> Column:
    """The box color of a label: orange in an overlap, else green (blue, green, red)."""
    return F.when(overlap, F.array(F.lit(0), F.lit(165), F.lit(255))).otherwise(F.array(F.lit(0), F.lit(255), F.lit(0)))
