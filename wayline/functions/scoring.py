"""Gates and scores of a detection against an identity, as column expressions over columns of both.

Times are milliseconds of the frame. Columns: the detection's are passed in, the identity's have the prefix id_
(id_last_cam, id_last_ms, id_map_x, id_map_y, id_box_w, id_box_h).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from . import geometry


def _between(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def seconds(now_ms: Column, then_ms: Column) -> Column:
    return (now_ms - then_ms).cast("double") / 1000.0


def size_gate(w: Column, h: Column, rw: Column, rh: Column) -> Column:
    """Neither side shrinks or grows too much; unknown or empty sides pass."""
    known = w.isNotNull() & h.isNotNull() & rw.isNotNull() & rh.isNotNull() & (F.least(w, h, rw, rh) > 0)
    close = lambda a, b: F.least(a, b) / F.greatest(a, b) >= C.SIZE_RATIO
    return F.when(known, close(w, rw) & close(h, rh)).otherwise(F.lit(True))


def map_gate(same_camera: Column, dist: Column) -> Column:
    """Not too far on the floorplan; an unknown distance passes."""
    return F.when(dist.isNull(), F.lit(True)).otherwise(dist <= F.when(same_camera, C.MAP_GATE * 1.5).otherwise(C.MAP_GATE * 2.0))


def can_match(now_ms: Column, cam: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    fresh = seconds(now_ms, F.col("id_last_ms")) <= C.MAX_IDLE
    dist = geometry.distance(x, y, F.col("id_map_x"), F.col("id_map_y"))
    return fresh & size_gate(w, h, F.col("id_box_w"), F.col("id_box_h")) & map_gate(F.col("id_last_cam") == cam, dist)


def predicted(now_ms: Column, cx: Column, cy: Column, t_ms: Column, before_cx: Column, before_cy: Column, before_ms: Column) -> tuple[Column, Column]:
    """Where a center that moved from `before` to here is by now, a quarter second ahead at most. Without `before` it stays."""
    dt = F.greatest(seconds(t_ms, before_ms), F.lit(1e-3))
    ahead = _between(seconds(now_ms, t_ms), 0.0, C.HORIZON)
    move = lambda new, old: F.coalesce(new + (new - old) / dt * ahead, new)
    return move(cx, before_cx), move(cy, before_cy)


def motion_score(dist: Column, w: Column, h: Column) -> Column:
    """dist: from the predicted center; w, h: of the last box. Half for an unknown distance."""
    scale = F.greatest(F.lit(C.MIN_MOTION_SCALE), F.sqrt((w * w + h * h).cast("double")) * 0.75)
    return F.when(dist.isNull(), F.lit(0.5)).otherwise(_between(1.0 - F.least(dist / scale, F.lit(1.6)), -0.6, 1.0))


def time_score(now_ms: Column, last_ms: Column) -> Column:
    return 1.0 - _between(seconds(now_ms, last_ms) / C.MAX_IDLE, 0.0, 1.0)


def map_score(dist: Column) -> Column:
    return F.when(dist.isNull(), F.lit(0.5)).otherwise(_between(1.0 - F.least(dist / (C.MAP_GATE * 1.8), F.lit(1.4)), -0.4, 1.0))


def pair_score(appearance: Column, motion: Column, on_map: Column, time: Column, overlap: Column, same_camera: Column, idle: Column, forced: Column) -> Column:
    """Weighted sum with bonuses. An overlapped detection trusts motion more than looks."""
    shift = F.when(overlap, C.OVERLAP_SHIFT).otherwise(0.0)
    total = (C.W_APPEARANCE - shift) * appearance + (C.W_MOTION + shift) * motion + C.W_MAP * on_map + C.W_TIME * time
    same = F.when(same_camera, C.BONUS_SAME_CAMERA + F.when(idle <= C.JUST_SEEN, C.BONUS_JUST_SEEN).otherwise(0.0)).otherwise(0.0)
    return total + same + F.when(overlap & F.coalesce(forced, F.lit(False)), C.BONUS_FORCED).otherwise(0.0)


def accept(appearance: Column, score: Column, same_camera: Column, overlap: Column, forced: Column) -> Column:
    frozen = overlap & F.coalesce(forced, F.lit(False))
    return (appearance >= C.ACCEPT_APPEARANCE) | (same_camera & (score >= C.ACCEPT_SAME_CAMERA)) | (frozen & (score >= C.ACCEPT_FORCED)) | (score >= C.ACCEPT)


def recent_score(similarity: Column, dist: Column, age: Column) -> Column:
    """Similarity to a remembered sighting, less for distance and for age (seconds)."""
    far = F.coalesce(F.least(dist / (C.MAP_GATE * 1.5), F.lit(1.0)) * 0.10, F.lit(0.0))
    return similarity - far - F.least(age / C.RECENT_WINDOW, F.lit(1.0)) * 0.08
