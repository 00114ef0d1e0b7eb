"""A frame's whole decision, composed from the operators: who each detection is, given what was assigned before its frame.

Detections of a camera frame are locked first (hold, known track, forced by continuity), the rest is matched optimally with the identities that pass the gate, what
is refused is looked up in the cache, and what remains is new. All frames are decided at once, each by the state right before it, in joins and
aggregates keyed by the camera frame. Steps that several others read are written to the shared folder, so nothing is computed twice.

detections: site_id, det_id, cam_name, frame_no, det_idx, ts_ms, tid, x1, y1, x2, y2, emb, and what frames.enriched adds. assigned: the same columns
of the detections assigned so far, with gid, score and overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions import constants as C
from wayline.operators import asof, frames, history, matching
from wayline.sources.tables import written

AT = asof.CAMERA_FRAME


def faced(detections: DataFrame, assigned: DataFrame) -> DataFrame:
    """Detections with overlap and forced_gid: continuity is matched greedily over all of a frame, and only overlapping ones keep the result."""
    forced = matching.greedy_frames(frames.previous(detections, assigned))
    both = frames.attached(frames.flagged(detections), forced, "forced_gid")
    both = both.withColumns({"forced_gid": F.when(F.col("overlap"), F.col("forced_gid")), "now_ms": F.col("ts_ms")})
    return written(both, "faced")


def locked(pending: DataFrame, assigned: DataFrame, known: DataFrame) -> DataFrame:
    """AT, det_idx, det_id, gid, score, source of the detections that hold, track or continuity decides. Earlier detections of a frame take identities first."""
    found = history.by_local_track(history.held(pending, assigned.filter("overlap"), more=["score"]), assigned)
    way = lambda place, gid, score, source: F.struct(F.lit(place).alias("place"), F.col(gid).alias("gid"), score.cast("double").alias("score"), F.lit(source).alias("source"))
    ways = F.array(way(0, "held_gid", F.col("held_score"), "occlusion-hold"), way(1, "known_gid", F.lit(None), "local-track"), way(2, "forced_gid", F.lit(1.0), "occlusion-forced"))
    offers = found.select(*AT, "det_idx", "det_id", F.inline(ways)).filter("gid IS NOT NULL")
    # who isn't alive is no offer; a known track passes on its identity's last score
    offers = offers.join(known.select(*AT, "gid", "id_score"), [*AT, "gid"]).withColumn("score", F.coalesce("score", "id_score"))
    listed = offers.groupBy(*AT).agg(F.sort_array(F.collect_list(F.struct("det_idx", "det_id", "place", "gid", "score", "source"))).alias("offers"))
    return listed.select(*AT, F.explode(matching.first_free(F.col("offers"), "det_id", "gid")).alias("m")).select(*AT, "m.det_idx", "m.det_id", "m.gid", "m.score", "m.source")


def candidates(pending: DataFrame, known: DataFrame) -> DataFrame:
    """The identities that are scored against a frame's pending detections: those that some of them could be."""
    return written(frames.gate(pending, known), "gated")


def scored(pending: DataFrame, assigned: DataFrame, gated: DataFrame, embedded: DataFrame) -> DataFrame:
    """All pairs of pending detections and gated identities with their scores. Vectors (embedded: site_id, det_id, ts_ms, emb) meet block by block of time (history.appearances)."""
    full = history.appearances(history.with_motion(gated, assigned), pending, assigned, embedded)
    return frames.scored(pending, full).select(*AT, "det_id", "det_idx", "gid", "appearance", "motion", "map", "time", "score", "accepted")


def matched(pairs: DataFrame) -> DataFrame:
    """The optimal matching of each camera frame: AT, det_id, gid, score, accepted, det_idx; thresholds are judged after it, so a refused pair gets no second choice."""
    return matching.optimal_groups(pairs, AT, "det_id", "gid", "score", ["accepted", "det_idx"])


def from_cache(pending: DataFrame, assigned: DataFrame, settled: DataFrame) -> DataFrame:
    """AT, det_id, gid, score of pending detections that the cache knows. settled (AT, gid): who is taken; each that a frame settles also pushes a sighting out."""
    offers = frames.remembered(pending, assigned).join(pending.select(*AT, "det_id", "det_idx"), "det_id")
    offers = offers.join(settled.select(*AT, "gid"), [*AT, "gid"], "left_anti")
    many = settled.groupBy(*AT).agg(F.count("*").alias("many"))
    row = F.struct("det_idx", "det_id", (-F.col("score")).alias("least"), "back", "gid")
    listed = offers.groupBy(*AT).agg(F.sort_array(F.collect_list(row)).alias("offers")).join(many, AT, "left")
    still = lambda chosen, p: p["back"] + F.coalesce("many", F.lit(0)) + F.size(chosen) <= C.CACHE
    found = listed.select(*AT, F.explode(matching.first_free(F.col("offers"), "det_id", "gid", still)).alias("m"))
    return found.select(*AT, "m.det_id", "m.gid", (-F.col("m.least")).alias("score"))


def decided(detections: DataFrame, assigned: DataFrame) -> DataFrame:
    """AT, det_id, gid, score, source of each detection; gid is null where it is someone new."""
    embedded = detections.select("site_id", "det_id", "ts_ms", "emb")
    told = faced(detections.drop("emb"), assigned)
    known = written(history.known_at(detections, assigned), "known")
    first = written(locked(told, assigned, known).select(*AT, "det_id", "gid", "score", "source"), "locked")
    open_ = told.join(first.select("det_id"), "det_id", "left_anti")
    free = known.join(first.select(*AT, "gid"), [*AT, "gid"], "left_anti")
    second = written(matched(scored(open_, assigned, candidates(open_, free), embedded.unionByName(assigned.select(*embedded.columns)))).filter("accepted").select(*AT, "det_id", "gid", "score", F.lit("batch-match").alias("source")), "matched")
    left = open_.join(second.select("det_id"), "det_id", "left_anti")
    third = from_cache(left.join(embedded.select("det_id", "emb"), "det_id"), assigned, first.unionByName(second)).withColumn("source", F.lit("same-cam-cache"))
    settled = first.unionByName(second).unionByName(third)
    return detections.select(*AT, "det_id").join(settled.select("det_id", "gid", "score", "source"), "det_id", "left").withColumns({"source": F.coalesce("source", F.lit("new")), "score": F.coalesce("score", F.lit(1.0))})
