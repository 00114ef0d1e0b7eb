"""Queries over the shared test tables: one for each operator, all over whole tables. person stands in for an identity where no assigner runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import constants as C
from wayline.functions import geometry, scoring, text, vectors
from wayline.operators import decision, frames, history, matching
from wayline.plans.calibration import H, HEIGHT, SOURCE, TARGET, WIDTH
from wayline.sources import detections, registry
from wayline.sources.tables import written
from wayline.streaming import identity, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the detections view."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(detections.view(spark, sf_dir))
    return f


def registry_query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the registry log."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(registry.log(spark, sf_dir))
    return f


def r6(c: Column) -> Column:
    return F.round(c, 6)


def dealt(d: DataFrame) -> DataFrame:
    """Rows over all cores, where each is much work: they take little room, so few files may hold all of them. What is heavy comes after."""
    return d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism)


def sightings(d: DataFrame) -> DataFrame:
    """All detections with their geometry and a floorplan position, as sightings of their person. Odd and even cameras are two sites."""
    return frames.enriched(d, None, H).withColumns({"gid": F.col("person"), "site_id": F.substring("cam_name", 5, 1).cast("long") % 2})


def consecutive(d: DataFrame) -> DataFrame:
    """Each sighting with the one before it of the same person, as the identity it is held against."""
    w = Window.partitionBy("person").orderBy("ts_ms", "det_id")
    back = lambda c: F.lag(c).over(w)
    s = sightings(d)
    # a floorplan position is missing now and then, as on a camera that is not calibrated
    s = s.withColumns({c: F.when(F.col("det_id") % 7 != 0, F.col(c)) for c in ("map_x", "map_y")})
    names = {"id_last_cam": "cam_name", "id_last_ms": "ts_ms", "id_map_x": "map_x", "id_map_y": "map_y", "id_box_w": "box_w", "id_box_h": "box_h"}
    return s.withColumns({k: back(v) for k, v in names.items()}).filter("id_last_ms IS NOT NULL")


# ---- sources


@query
def scan_detections(d: DataFrame) -> DataFrame:
    return d.select("det_id", "cam_name", "frame_no", "det_idx", "ts_ms", "tid", "x1", "y1", "x2", "y2", "conf")


@query
def scan_replay(d: DataFrame) -> DataFrame:
    return detections.replay(d, 3).select("det_id", "loop", "cam_name", "frame_no", "ts_ms")


@query
def first_frame(d: DataFrame) -> DataFrame:
    return detections.first_frames(d).select("cam_name", "frame_no", "det_idx", "det_id")


@registry_query
def ext_whitelist(log: DataFrame) -> DataFrame:
    return log.filter(text.is_video(F.col("url"))).select("seq", "url", text.extension(F.col("url")).alias("extension"))


@registry_query
def parse_points(log: DataFrame) -> DataFrame:
    p = text.points(F.col("points"))
    return log.select("seq", p.isNotNull().alias("valid"), F.get(F.get(p, F.lit(0)), F.lit(0)).alias("first_x"), F.get(F.get(p, F.lit(3)), F.lit(1)).alias("last_y"))


@registry_query
def calib_valid(log: DataFrame) -> DataFrame:
    p = text.points(F.col("points"))
    return log.select("seq", p.isNotNull().alias("four_points"), geometry.fixes_plane(p).alias("calibrates"))


def _state(log: DataFrame) -> DataFrame:
    state = registry.without_deleted(registry.latest(log.filter("action = 'add'")), log.filter("action = 'delete'"))
    return state.withColumns({"source_type": registry.source_type(F.col("url")), "calibrated": geometry.fixes_plane(text.points(F.col("points")))})


@registry_query
def registry_upsert(log: DataFrame) -> DataFrame:
    return registry.latest(log.filter("action = 'add'")).select("name", "seq", "url")


@registry_query
def registry_delete(log: DataFrame) -> DataFrame:
    return _state(log).select("name", "seq", "url")


@registry_query
def registry_lookup(log: DataFrame) -> DataFrame:
    return registry.lookup(_state(log), "cam_7").select("name", "seq", "url", "source_type")


@registry_query
def registry_listing(log: DataFrame) -> DataFrame:
    return registry.listing(_state(log))


@registry_query
def camera_config(log: DataFrame) -> DataFrame:
    return registry.config(_state(log))


@registry_query
def image_base64(log: DataFrame) -> DataFrame:
    """Contents as base64; a log row's address and points stand in for a file's name and bytes."""
    content = F.concat_ws("|", "url", "points").cast("binary")
    files = registry.encoded(log.select(F.col("seq").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content")))
    return files.select(F.col("path").alias("seq"), "length", "image_base64")


@registry_query
def floorplan_default(log: DataFrame) -> DataFrame:
    """The size of the floorplan that was uploaded last, as its PNG header says, and the default size where none was uploaded."""
    side = lambda least, k: F.lpad(F.hex(least + F.col("seq") * k % 701), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side(300, 7), side(200, 13), F.lit("0802000000")))
    uploads = registry.with_size(log.filter("points LIKE '[[%'").select("seq", png.alias("content")))
    last = uploads.groupBy().agg(F.max_by(F.struct("width", "height"), F.col("seq")).alias("s")).select("s.*")
    found = registry.floorplan_size(last).withColumn("uploaded", F.lit(True))
    return found.unionByName(registry.floorplan_size(last.limit(0)).withColumn("uploaded", F.lit(False))).select("uploaded", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


# ---- projections


@query
def explode_boxes(d: DataFrame) -> DataFrame:
    b = F.struct(F.col("det_idx").alias("at"), "x1", "y1", "x2", "y2")
    packed = d.groupBy("cam_name", "frame_no").agg(F.array_sort(F.collect_list(b)).alias("boxes"))
    return detections.unpacked(packed).select("cam_name", "frame_no", "det_idx", "x1", "y1", "x2", "y2")


@query
def trunc_box(d: DataFrame) -> DataFrame:
    return d.select("det_id", *[geometry.truncated(F.col(c) * F.lit(0.37) - F.lit(50.5)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def foot_point(d: DataFrame) -> DataFrame:
    x, y = geometry.foot(geometry.box())
    return d.select("det_id", x.alias("foot_x"), y.alias("foot_y"))


@query
def local_id(d: DataFrame) -> DataFrame:
    lost = F.when(F.col("det_id") % 5 != 0, F.col("tid"))
    return d.select("det_id", F.coalesce(lost, "det_idx").alias("tid"), F.when(F.col("det_id") % 3 != 0, F.col("conf")).alias("conf"))


@query
def box_wh(d: DataFrame) -> DataFrame:
    w, h = geometry.extent((F.col("x1"), F.col("y1"), F.col("x2") - 100, F.col("y2")))
    return d.select("det_id", w.alias("box_w"), h.alias("box_h"))


@query
def bbox_center(d: DataFrame) -> DataFrame:
    x, y = geometry.center(geometry.box())
    return d.select("det_id", x.alias("center_x"), y.alias("center_y"))


def _shifted() -> tuple[Column, ...]:
    """Boxes partly and wholly outside a frame of 1000 x 300."""
    return F.col("x1") - 60, F.col("y1") + 40, F.col("x2") - 20, F.col("y2") + 40


@query
def clamp_bbox(d: DataFrame) -> DataFrame:
    return d.select("det_id", *[c.alias(n) for c, n in zip(geometry.clamped(_shifted(), 1000, 300), ("x1", "y1", "x2", "y2"), strict=True)])


@query
def crop_rect(d: DataFrame) -> DataFrame:
    b = geometry.box()
    return d.filter(geometry.croppable(b, WIDTH, HEIGHT)).select("det_id", *[c.alias(n) for c, n in zip(geometry.crop(b, WIDTH, HEIGHT), ("x1", "y1", "x2", "y2"), strict=True)])


@query
def min_crop(d: DataFrame) -> DataFrame:
    b = geometry.box()
    # a generated row stands for itself: otherwise each use of a side would repeat all that it is computed from
    sides = F.struct(*[c.alias(n) for c, n in zip(geometry.crop(b, WIDTH, HEIGHT), ("cx1", "cy1", "cx2", "cy2"), strict=True)])
    crops = d.filter(geometry.croppable(b, WIDTH, HEIGHT)).select("det_id", F.inline(F.array(sides)))
    return crops.filter((F.col("cx2") - F.col("cx1") >= C.MIN_CROP) & (F.col("cy2") - F.col("cy1") >= C.MIN_CROP)).select("det_id")


@query
def labels_fmt(d: DataFrame) -> DataFrame:
    conf = F.when(F.col("det_id") % 3 != 0, F.col("conf"))
    return d.select(
        "det_id", text.label(F.col("person"), conf, F.col("tid"), debug=True).alias("label"), text.source_label(F.lit("batch-match"), F.col("conf"), F.col("det_id") % 4 == 0).alias("detail"), F.element_at(frames.colored(F.col("det_id") % 4 == 0), 3).alias("red")
    )


@query
def local_gid(d: DataFrame) -> DataFrame:
    gid = text.local_identity(F.col("cam_name"), F.col("tid"))
    return d.select("det_id", gid.alias("gid"), text.tracker_of(gid).alias("tracker"))


@registry_query
def safe_filename(log: DataFrame) -> DataFrame:
    return log.select("seq", text.safe_name(F.when(F.col("seq") % 9 == 0, "/()/").otherwise(F.col("url")), F.concat(F.lit("video_"), "seq", F.lit(".mp4"))).alias("name"))


@registry_query
def url_kind(log: DataFrame) -> DataFrame:
    return log.select("seq", text.device_index(F.col("url")).cast("string").alias("device"), registry.source_type(F.col("url")).alias("source_type"))


@registry_query
def fps_default(log: DataFrame) -> DataFrame:
    fps = F.when(F.col("seq") % 5 != 0, ((F.col("seq") % 4 - 1) * 10).cast("double"))
    rate = text.frame_rate(F.when(F.col("seq") % 11 == 0, F.lit(float("nan"))).otherwise(fps))
    return log.select("seq", rate.alias("fps"), (1.0 / rate).alias("delay"))


# ---- filters


@query
def conf_filter(d: DataFrame) -> DataFrame:
    return frames.confident(d).select("det_id", "conf")


@query
def polygon_filter(d: DataFrame) -> DataFrame:
    return frames.enriched(frames.confident(d), SOURCE).select("det_id", "foot_x", "foot_y")


@query
def alive_semi(d: DataFrame) -> DataFrame:
    s = sightings(d)
    last = s.groupBy("gid").agg(F.max("ts_ms").alias("last_ms"))
    living = last.join(F.broadcast(s.agg(F.max("ts_ms").alias("now")))).filter(F.col("now") - F.col("last_ms") <= int(C.MAX_IDLE * 1000))
    return frames.alive(s, living).select("det_id", "gid")


# ---- geometry and vectors


@registry_query
def homography_fit(log: DataFrame) -> DataFrame:
    """The plane of each action whose points fix one, and its points sent through it."""
    fitted = registry.planes(log.select("seq", "points"), TARGET).filter("h IS NOT NULL")
    points = fitted.select("seq", "h", F.posexplode(text.points(F.col("points"))).alias("i", "p"))
    h, x, y = F.col("h"), F.col("p")[0], F.col("p")[1]
    w = h[6] * x + h[7] * y + h[8]
    return points.select("seq", "i", *[F.round((h[k] * x + h[k + 1] * y + h[k + 2]) / w, 4).alias(n) for k, n in ((0, "x"), (3, "y"))])


def calibration_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection with the registry's action that held for its camera right before its frame, and whether that calibrated it."""
    log = registry.log(spark, sf_dir).withColumn("ts_ms", F.floor(F.col("seq") * 200 / 32))
    d = detections.view(spark, sf_dir).select("det_id", "cam_name", "ts_ms")
    found = registry.valid_at(d, log, 20_000)
    return found.select("det_id", "seq", geometry.fixes_plane(text.points(F.col("points"))).alias("calibrated"))


QUERIES["calibration_at"] = calibration_at


@query
def crop_features(d: DataFrame) -> DataFrame:
    """Appearance of crops of one color each: where the upper and the lower histogram stand, how long both are, and the gray of a corner against the aspect ratio."""
    color = lambda k: F.lpad(F.hex((F.col("det_id") * k) % 256), 2, "0")
    crops = dealt(d.select("det_id")).select("det_id", (24 + F.col("det_id") % 5).alias("h"), (24 + F.col("det_id") % 3).alias("w"), F.concat(color(7), color(13), color(31)).alias("bgr"))
    pixels = F.unhex(F.expr("repeat(bgr, CAST(h * w AS INT))"))
    f = crops.select("det_id", vectors.crop_features(pixels, "h", "w").alias("f"))
    upper, lower = F.slice("f", 1, 192), F.slice("f", 193, 192)
    at = lambda part: (F.array_position(part, F.array_max(part)) - 1).alias
    return f.select("det_id", F.size("f").alias("n"), at(upper)("upper"), at(lower)("lower"), r6(F.element_at("f", -1) / F.element_at("f", 385)).alias("gray"))


@query
def project_floorplan(d: DataFrame) -> DataFrame:
    return frames.enriched(d, None, H).select("det_id", "map_x", "map_y")


def _neighbours(d: DataFrame) -> DataFrame:
    """Pairs of detections that follow each other in a frame."""
    other = d.select("cam_name", "frame_no", (F.col("det_idx") - 1).alias("det_idx"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    return d.join(other, ["cam_name", "frame_no", "det_idx"])


@query
def bbox_iou(d: DataFrame) -> DataFrame:
    return _neighbours(d).select("det_id", geometry.iou(geometry.box(), geometry.box("b_")).alias("iou"))


@query
def center_distance(d: DataFrame) -> DataFrame:
    return _neighbours(d).select("det_id", geometry.distance(*geometry.center(geometry.box()), *geometry.center(geometry.box("b_"))).alias("dist"))


@query
def map_distance(d: DataFrame) -> DataFrame:
    return consecutive(d).select("det_id", geometry.distance(F.col("map_x"), F.col("map_y"), F.col("id_map_x"), F.col("id_map_y")).alias("dist"))


@query
def l2_normalize(d: DataFrame) -> DataFrame:
    raw = F.when(F.col("det_id") % 10 == 0, F.transform("emb", lambda x: x * 0.0)).otherwise(F.col("emb"))
    n = vectors.normalized(raw)
    return d.select("det_id", r6(n[0]).alias("first"), r6(n[63]).alias("last"), r6(vectors.norm(n)).alias("length"))


def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    d = detections.view(spark, sf_dir).select("det_id", "base_id", "emb")
    return d.join(e, F.col("base_id") == F.col("vec_id")).select("det_id", r6(vectors.cosine(F.col("emb"), F.col("embedding"))).alias("similarity"))


QUERIES["cosine_similarity"] = cosine_similarity


@query
def ema_embedding(d: DataFrame) -> DataFrame:
    t = history.vectors_of(d.withColumns({"site_id": F.lit(0), "gid": F.col("person")}))
    return t.select("gid", r6(F.col("template")[0]).alias("first"), r6(F.col("template")[63]).alias("last"))


@query
def gallery_ring(d: DataFrame) -> DataFrame:
    kept = detections.newest(d, C.GALLERY, ["person"], ["ts_ms", "det_id"])
    return kept.select(F.col("person").alias("gid"), "det_id", r6(vectors.normalized(F.col("emb"))[0]).alias("first"))


@query
def gallery_topk(d: DataFrame) -> DataFrame:
    g = vectors.galleries(d, ["person"], ["ts_ms", "det_id"]).withColumnRenamed("person", "gid")
    # lengths are found once for a vector, not for each product
    units = d.select("det_id", "person", vectors.normalized(F.col("emb")).alias("unit"))
    return units.join(g, F.col("person") == F.col("gid")).select("det_id", "gid", r6(vectors.unit_similarity(F.col("unit"), F.lit(None).cast("array<double>"), F.col("gallery"))).alias("similarity"))


def hsv_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pixels = e.select((F.col("event_id") % 32).alias("crop"), (F.col("event_id") * 7 % 180).alias("hue"), (F.col("event_id") * 13 % 256).alias("saturation"), (F.col("event_id") * 31 % 256).alias("value"))
    return vectors.color_histogram(pixels, ["crop"]).select("crop", "bin", r6(F.col("weight")).alias("weight"))


QUERIES["hsv_hist"] = hsv_hist


# ---- joins


@query
def overlap_pairs(d: DataFrame) -> DataFrame:
    return frames.overlaps(d)


@query
def overlap_flags(d: DataFrame) -> DataFrame:
    return frames.overlapping(frames.overlaps(d))


@query
def prev_candidates(d: DataFrame) -> DataFrame:
    return frames.previous(d, d.withColumn("gid", F.col("person")))


@query
def greedy_match(d: DataFrame) -> DataFrame:
    return matching.greedy_frames(frames.previous(d, d.withColumn("gid", F.col("person"))))


def assumed(d: DataFrame) -> DataFrame:
    """All detections as if the truth had been assigned, without vectors: what was known at a frame are the persons of the frames before it, and confidence is their score."""
    return written(frames.flagged(sightings(d.drop("emb"))).withColumn("score", F.col("conf")), "assumed")


def facing(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an assigner faces at every camera frame: its detections, what was assigned, and the identities alive before it that some detection could be."""
    s = assumed(d)
    told = decision.faced(s.drop("gid", "score", "overlap"), s)
    return told, s, decision.candidates(told, history.known_at(s, s))


def scored(d: DataFrame) -> DataFrame:
    told, _, gated = facing(d)
    s = sightings(d)
    return decision.scored(told, s, gated, s)


@query
def candidate_gate(d: DataFrame) -> DataFrame:
    return facing(d)[2].select("cam_name", "frame_no", "gid", "id_last_cam", "id_last_ms")


@query
def pair_scores(d: DataFrame) -> DataFrame:
    return scored(d).select("det_id", "gid", *[r6(F.col(c)).alias(c) for c in ("appearance", "motion", "map", "time", "score")])


@query
def optimal_assign(d: DataFrame) -> DataFrame:
    return decision.matched(scored(d)).select("det_id", "gid", r6(F.col("score")).alias("score"))


@query
def accept_match(d: DataFrame) -> DataFrame:
    """Pairs that their own scores would accept."""
    return scored(d).filter("accepted").select("det_id", "gid")


@query
def frame_match(d: DataFrame) -> DataFrame:
    """Each camera frame's matching with the identities alive: greedy continuity, gate, scores, the best matching, and then the thresholds."""
    return decision.matched(scored(d)).filter("accepted").select("site_id", "cam_name", "frame_no", "det_id", "gid", r6(F.col("score")).alias("score"))


@query
def frame_locks(d: DataFrame) -> DataFrame:
    """What hold, known track and forced continuity decide at each camera frame, before anything is matched."""
    s = assumed(d)
    found = decision.locked(decision.faced(s.drop("gid", "score", "overlap"), s), s, history.known_at(s, s))
    return found.select("cam_name", "frame_no", "det_id", "gid", "score", "source")


@query
def frame_decision(d: DataFrame) -> DataFrame:
    """Each camera frame's whole decision over what the assigner itself had assigned before it."""
    s = frames.enriched(frames.confident(d), SOURCE, H).withColumn("site_id", F.substring("cam_name", 5, 1).cast("long") % 2)
    assigned = written(s.join(identity.assign(s).select("det_id", "gid", "score", "overlap"), "det_id"), "assigned")
    return decision.decided(s, assigned).select("site_id", "cam_name", "frame_no", "det_id", "gid", r6(F.col("score")).alias("score"), "source")


@query
def local_track_join(d: DataFrame) -> DataFrame:
    """Each detection with whom its track was before its frame."""
    s = sightings(d)
    return history.by_local_track(s, s).select("det_id", "known_gid")


@query
def hold_interval_join(d: DataFrame) -> DataFrame:
    s = sightings(d)
    return history.held(s.drop("gid"), frames.flagged(s).filter("overlap")).filter("held_gid IS NOT NULL").select("det_id", "held_gid", "until_ms")


@query
def hold_spans(d: DataFrame) -> DataFrame:
    """When each track was held."""
    return history.holds(frames.flagged(sightings(d)).filter("overlap")).select("cam_name", "tid", "held_gid", "from_ms", "until_ms")


@query
def recent_match(d: DataFrame) -> DataFrame:
    s = sightings(d)
    return frames.recent_match(s, s).select("det_id", "gid", r6(F.col("score")).alias("score"))


@query
def enrich_camera(d: DataFrame) -> DataFrame:
    spark = d.sparkSession
    cameras = spark.createDataFrame([("cam_0", H), ("cam_1", H), ("cam_2", H)], "cam_name string, h array<double>")  # cam_3 is not calibrated
    known = frames.with_cameras(frames.enriched(d).drop("map_x", "map_y"), F.broadcast(cameras))
    x, y = geometry.project(F.col("foot_x"), F.col("foot_y"), F.col("h"))
    return known.select("det_id", F.col("h").isNotNull().alias("calibrated"), F.concat_ws(",", x, y).alias("map_pos"))


@query
def used_anti(d: DataFrame) -> DataFrame:
    """Identities that no detection of a frame on another camera has used: left over on each camera of that frame."""
    used = d.select("frame_no", F.concat(F.lit("cam_"), ((F.substring("cam_name", 5, 1).cast("int") + 1) % 4).cast("string")).alias("cam_name"), "person")
    return frames.unused(d.select("det_id", "frame_no", "cam_name", "person"), used, ["frame_no", "cam_name", "person"]).select("det_id", F.col("person").alias("gid"))


@query
def attach_results(d: DataFrame) -> DataFrame:
    best = frames.previous(d, d.withColumn("gid", F.col("person"))).groupBy("cam_name", "frame_no", "det_idx").agg(F.max("score").alias("best"))
    return frames.attached(d, best, "best").select("det_id", "best")


@query
def pending_except(d: DataFrame) -> DataFrame:
    """Detections of each frame that overlap with none."""
    keys = ["cam_name", "frame_no", "det_idx"]
    return frames.unused(d.select("det_id", *keys), frames.overlapping(frames.overlaps(d)), keys).select("det_id")


# ---- scores


@query
def size_gate(d: DataFrame) -> DataFrame:
    return consecutive(d).select("det_id", scoring.size_gate(F.col("box_w"), F.col("box_h"), F.col("id_box_w"), F.col("id_box_h")).alias("ok"))


@query
def can_match(d: DataFrame) -> DataFrame:
    return consecutive(d).select("det_id", scoring.can_match(F.col("ts_ms"), F.col("cam_name"), F.col("map_x"), F.col("map_y"), F.col("box_w"), F.col("box_h")).alias("ok"))


@query
def time_score(d: DataFrame) -> DataFrame:
    return consecutive(d).select("det_id", r6(scoring.time_score(F.col("ts_ms"), F.col("id_last_ms"))).alias("score"))


@query
def map_score(d: DataFrame) -> DataFrame:
    return consecutive(d).select("det_id", r6(scoring.map_score(geometry.distance(F.col("map_x"), F.col("map_y"), F.col("id_map_x"), F.col("id_map_y")))).alias("score"))


@query
def recent_history(d: DataFrame) -> DataFrame:
    return history.recent(sightings(d)).select("cam_name", "gid", "place", "det_id")


@query
def predict_center(d: DataFrame) -> DataFrame:
    return history.predicted_centers(sightings(d)).select("det_id", r6(F.col("pred_x")).alias("pred_x"), r6(F.col("pred_y")).alias("pred_y"))


@query
def motion_score(d: DataFrame) -> DataFrame:
    p = history.predicted_centers(sightings(d))
    dist = geometry.distance(F.col("center_x"), F.col("center_y"), F.col("pred_x"), F.col("pred_y"))
    return p.select("det_id", r6(scoring.motion_score(dist, F.col("last_w"), F.col("last_h"))).alias("score"))


# ---- histories


@query
def ring60(d: DataFrame) -> DataFrame:
    return history.camera_ring(d).select("cam_name", "det_id", "ts_ms")


@query
def ring200(d: DataFrame) -> DataFrame:
    return history.shared_cache(d.select("cam_name", "det_id", "ts_ms"))


@query
def latest_position(d: DataFrame) -> DataFrame:
    return history.latest_positions(sightings(d))


@query
def annotated_rows(d: DataFrame) -> DataFrame:
    """What is written beside each box; the truth stands in for the identity and confidence for the score."""
    s = frames.flagged(d.drop("emb")).withColumns({"gid": F.col("person"), "source": F.lit("batch-match"), "score": F.col("conf")})
    return sinks.annotated(s).select("det_id", "label", "detail", F.element_at("color", 3).alias("red"))


@query
def active_map(d: DataFrame) -> DataFrame:
    return history.active(history.latest_positions(sightings(d)))


@query
def trail(d: DataFrame) -> DataFrame:
    t = history.trails(sightings(d).select("site_id", "gid", "ts_ms", "det_id", "map_x", "map_y"), 50)
    total = F.aggregate("trail", F.lit(0).cast("long"), lambda s, p: s + p["map_x"])
    return t.select("det_id", "gid", F.size("trail").cast("long").alias("n"), F.element_at("trail", 1)["map_x"].alias("from_x"), total.alias("sum_x"))


@query
def idle_sessions(d: DataFrame) -> DataFrame:
    return history.sessions(d.select(F.col("person").alias("gid"), "ts_ms", "det_id"), ["gid"])


@query
def recent_window(d: DataFrame) -> DataFrame:
    return history.recent_counts(d).select("det_id", "remembered")


@query
def assign_identities(d: DataFrame) -> DataFrame:
    """Identities over all cameras of each site; odd and even cameras are two sites."""
    s = frames.enriched(frames.confident(d), SOURCE, H)
    return identity.assign(s.withColumn("site_id", F.substring("cam_name", 5, 1).cast("long") % 2))


@query
def assigned_map(d: DataFrame) -> DataFrame:
    """From detections to the map: confident and inside the region, identities assigned at each site, the newest position of each while active."""
    s = frames.enriched(frames.confident(d), SOURCE, H)
    assigned = identity.assign(s.withColumn("site_id", F.substring("cam_name", 5, 1).cast("long") % 2))
    return history.active(history.latest_positions(assigned, key=("site_id", "gid")))


@query
def ring_append(d: DataFrame) -> DataFrame:
    """Each camera's ring after a second half of the frames has come to the ring of the first."""
    half = F.col("frame_no") % 2 == 0
    columns = d.select("cam_name", "det_id", "ts_ms", "frame_no")
    return history.appended(history.camera_ring(columns.filter(half)), columns.filter(~half)).select("cam_name", "det_id", "ts_ms")


@query
def global_map(d: DataFrame) -> DataFrame:
    """The flagship: confident detections in the calibrated region, on the floorplan, newest of each identity, while active."""
    s = frames.enriched(frames.confident(d.drop("emb")), SOURCE, H).withColumn("gid", F.col("person"))
    return history.active(history.latest_positions(s))
