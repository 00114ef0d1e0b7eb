"""The registry of cameras: a log of additions and deletions, the state it leads to, and what is shown of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from wayline.functions import constants as C
from wayline.functions import geometry, text
from wayline.operators import asof

LOG = """
SELECT event_id AS seq, concat('cam_', user_id % 40) AS name, CASE WHEN event_id % 17 = 0 THEN 'delete' ELSE 'add' END AS action,
       CASE event_id % 5 WHEN 0 THEN CAST(event_id % 10 AS STRING) WHEN 1 THEN concat('rtsp://host', event_id % 7, '/live')
            WHEN 2 THEN concat('uploads/clip ', event_id % 11, '.MP4') WHEN 3 THEN concat('uploads/clip_', event_id % 11, '.webm')
            ELSE concat('notes/(draft) ', event_id % 11, '.txt') END AS url,
       event_id % 2 = 0 AS loop_video,
       CASE event_id % 7 WHEN 0 THEN '[[100,250],[1000,250],[1200,480],[0,480]]' WHEN 1 THEN '[[1,2],[3,4],[5,6]]' WHEN 2 THEN '[[1,2],[3,4],[5,6],[7]]'
            WHEN 3 THEN '[1,2,3,4]' WHEN 4 THEN '[[0.5,1],[2,3],[4,5],[6,7.25]]' WHEN 5 THEN '' END AS points
FROM {events}
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry actions derived from events."""
    return spark.sql(LOG, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def source_type(url: Column) -> Column:
    return F.when(text.is_video(url), "video").otherwise("camera")


def latest(actions: DataFrame) -> DataFrame:
    """The last action on each name wins; sums up before it shuffles."""
    row = F.struct(*[c for c in actions.columns if c != "name"])
    return actions.groupBy("name").agg(F.max_by(row, F.col("seq")).alias("row")).select("name", "row.*")


def without_deleted(state: DataFrame, deletions: DataFrame) -> DataFrame:
    """Cameras without those deleted after they were added."""
    gone = deletions.groupBy("name").agg(F.max("seq").alias("_gone"))
    return state.join(gone, (state["name"] == gone["name"]) & (gone["_gone"] > state["seq"]), "left_anti")


#: Milliseconds of the clock that are looked through together for changes of the registry.
PART_MS = 600_000


def valid_at(detections: DataFrame, actions: DataFrame, part_ms: int = PART_MS) -> DataFrame:
    """detections with seq, url and points of their camera as the registry had it right before their frame; null where it was not there, or deleted by then.

    actions: name, seq, ts_ms, action, url, points. A change holds for the frames after it, so a stream that reads the log again for each batch, as sinks.per_batch lets it, sees
    the registry of each frame's own time, whenever the batch runs.
    """
    facts = actions.select(F.col("name").alias("cam_name"), "ts_ms", F.col("seq").alias("det_id"), "action", "url", "points")
    found = asof.last_before(detections, facts, ["cam_name"], ["det_id", "action", "url", "points"], part_ms, name="_last")
    there = F.col("_last.action") != "delete"
    return found.withColumns({"seq": F.when(there, F.col("_last.det_id")), "url": F.when(there, F.col("_last.url")), "points": F.when(there, F.col("_last.points"))}).drop("_last")


def planes(rows: DataFrame, target: list[list[float]]) -> DataFrame:
    """rows (points, as text) with h, the plane from their points to the target; fitted once for each distinct text, null where it fixes none."""
    source = text.points(F.col("points"))
    fits = rows.select("points").filter(geometry.fixes_plane(source)).distinct().withColumn("h", _fit(source, F.lit(target).cast("array<array<double>>")))
    return rows.join(fits, "points", "left")


def lookup(state: DataFrame, name: str) -> DataFrame:
    return state.filter(F.col("name") == name)


def listing(state: DataFrame) -> DataFrame:
    """What a list of cameras says of each; calibrated: whether points are valid and fix a plane."""
    badge = F.when(F.col("source_type") == "video", "VIDEO").otherwise("CAMERA")
    loop = F.when(F.col("source_type") == "video", F.when(F.col("loop_video"), "Loop ON").otherwise("Loop OFF"))
    return state.select("name", F.col("url").alias("source"), F.coalesce("source_type", F.lit("camera")).alias("source_type"), badge.alias("badge"), loop.alias("loop_badge"), F.when(F.col("calibrated"), "Calibrated").otherwise("Not Calibrated").alias("calibration_badge"))


def config(state: DataFrame) -> DataFrame:
    """Each camera's configuration as JSON, with its points and whether a plane is known."""
    return state.select("name", F.to_json(F.struct("name", "source_type", "loop_video", F.col("calibrated").alias("has_homography"))).alias("config"))


# ---- files


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their bytes and as base64; a missing folder gives none."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return encoded(files)


def encoded(files: DataFrame) -> DataFrame:
    """files (path, length, content) with the content as base64 in one line."""
    return files.select("path", "length", "content", F.translate(F.base64("content"), "\r\n", "").alias("image_base64"))


def _number(content: Column, at: int, n: int, big: bool) -> Column:
    """A whole number of n bytes at a place (from 0) of binary content."""
    places = range(at, at + n) if big else range(at + n - 1, at - 1, -1)
    return F.conv(F.concat(*[F.hex(F.substring(content, i + 1, 1)) for i in places]), 16, 10).cast("int")


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Size from the frame header of a JPEG, found by going from segment to segment."""
    found = []
    for raw in content:
        size, at = (None, None), 2
        while raw is not None and at + 9 <= len(raw) and raw[at] == 0xFF:
            kind, length = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                size = (int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big"))
                break
            at += 2 + length if kind != 0xFF else 1
        found.append(size)
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")


def with_size(files: DataFrame) -> DataFrame:
    """files (content) with width and height as the image's own header says (PNG, GIF, BMP, JPEG); null for anything else, or a header that is cut off."""
    c = F.col("content")
    begins = lambda text: F.hex(F.substring(c, 1, len(text) // 2)) == text
    kinds = [(begins("89504E470D0A1A0A"), 24, (16, 4, True), (20, 4, True)), (begins("474946383761") | begins("474946383961"), 10, (6, 2, False), (8, 2, False)), (begins("424D"), 26, (18, 4, False), (22, 4, False))]
    size = F.when(begins("FFD8"), _jpeg_size(F.when(begins("FFD8"), c)))
    for is_kind, least, w, h in kinds:
        size = F.when(is_kind & (F.length(c) >= least), F.struct(_number(c, *w).alias("width"), _number(c, *h).alias("height"))).otherwise(size)
    return files.withColumn("_size", size).select("*", "_size.width", "_size.height").drop("_size")


def floorplan_size(found: DataFrame) -> DataFrame:
    """Width and height of the floorplan in found (width, height), the default size if there is none: one row."""
    return found.agg(F.coalesce(F.max("width"), F.lit(C.MAP_WIDTH)).alias("width"), F.coalesce(F.max("height"), F.lit(C.MAP_HEIGHT)).alias("height"))


def uploads(files: DataFrame, seq: Column) -> DataFrame:
    """Uploaded files (name, file_name) that are videos, under a safe name, as registry additions."""
    kept = files.filter(text.is_video(F.col("file_name")))
    name = text.safe_name(F.col("file_name"), F.concat(F.lit("video_"), seq.cast("string"), F.lit(".mp4")))
    return kept.select("name", seq.alias("seq"), F.lit("add").alias("action"), F.concat(F.lit("uploads/"), name).alias("url"), F.lit("video").alias("source_type"))


def save_floorplan(uploaded: DataFrame, path: str) -> None:
    """Of uploaded floorplans (seq, content, width, height) the newest, in place of the one before; without any the one before stays."""
    newest = uploaded.orderBy(F.desc("seq")).limit(1)
    if not newest.isEmpty():
        newest.write.mode("overwrite").parquet(path)


@F.pandas_udf(ArrayType(DoubleType()))
def _fit(source: pd.Series, target: pd.Series) -> pd.Series:
    whole = lambda p: None if p is None else [list(x) for x in p]
    return pd.Series([geometry.fit_homography(whole(s), whole(t)) for s, t in zip(source, target, strict=True)])


def calibrated(cameras: DataFrame) -> DataFrame:
    """cameras (src_pts, dst_pts) with h, the nine coefficients of each plane, null where the points do not fix one. A row for each camera only."""
    return cameras.withColumn("h", _fit("src_pts", "dst_pts"))
