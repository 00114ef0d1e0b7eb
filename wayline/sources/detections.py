"""Detections: the view over the shared test tables, file and stream scans, replay, and pixels through a pandas stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Milliseconds between frames of the view.
FRAME_MS = 200

VIEW = """
WITH base AS (SELECT event_id AS det_id, event_id % 4 AS cam_no, event_id DIV 32 AS frame_no, (event_id % 32) DIV 4 AS det_idx FROM {events}),
p AS (SELECT *, (det_idx + cam_no * 3 + frame_no DIV 40) % 12 AS person FROM base),
g AS (SELECT *, (person * 97 + frame_no * (3 + person % 3 * 4)) % 1100 AS x1, 100 + person % 3 * 20 + frame_no % 7 AS y1,
             CASE WHEN det_id % 53 = 0 THEN 30 ELSE 80 + person * 3 END AS w, 200 + person * 5 AS h
      FROM p WHERE (frame_no DIV 150 + person) % 3 <> 0)
SELECT g.det_id, concat('cam_', g.cam_no) AS cam_name, g.frame_no, g.det_idx, g.frame_no * 200 AS ts_ms, g.person,
       g.person + 100 * (g.frame_no DIV 50) AS tid, g.x1, g.y1, g.x1 + g.w AS x2, g.y1 + g.h AS y2,
       CAST(30 + (g.det_id * 7919) % 70 AS DOUBLE) / 100 AS conf, b.vec_id AS base_id, n.vec_id AS noise_id,
       zip_with(b.embedding, n.embedding, (p, q) -> CAST(p AS DOUBLE) + CAST(q AS DOUBLE) * 0.5D) AS emb
FROM g JOIN {embeddings} b ON b.vec_id = g.person * 30 JOIN {embeddings} n ON n.vec_id = 400 + g.det_id % 97
"""


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections derived from events and embeddings; person is the truth, which no operator may use but as a stand-in for an identity."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings")}
    return spark.sql(VIEW, **tables)


SCHEMA = (
    "det_id long, cam_name string, frame_no long, det_idx long, ts_ms long, tid long, x1 long, y1 long, x2 long, y2 long, conf double, emb array<double>"
)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table of detections."""
    return spark.read.schema(SCHEMA).parquet(path)


def live(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Detections as files arrive. ts is a timestamp, as watermarks need it; the bound on files keeps a backlog from becoming one batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.timestamp_millis("ts_ms"))


def replay(detections: DataFrame, times: int, frame_ms: int = FRAME_MS) -> DataFrame:
    """A clip played several times over: frames and times go on from where the clip of that camera ended."""
    length = detections.groupBy("cam_name").agg((F.max("frame_no") + 1).alias("_length"))
    looped = detections.join(F.broadcast(length), "cam_name").withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    shift = F.col("loop") * F.col("_length")
    return looped.withColumns({"frame_no": F.col("frame_no") + shift, "ts_ms": F.col("ts_ms") + shift * frame_ms}).drop("_length")


def first_frames(detections: DataFrame) -> DataFrame:
    """One look at each camera: the detections of its first frame."""
    first = detections.groupBy("cam_name").agg(F.min("frame_no").alias("frame_no"))
    return detections.join(F.broadcast(first), ["cam_name", "frame_no"], "left_semi")


def unpacked(frames: DataFrame) -> DataFrame:
    """frames (frame key columns, and boxes: array of structs x1, y1, x2, y2, conf, tid) -> a row for each box, with its position det_idx."""
    return frames.select("*", F.posexplode("boxes").alias("det_idx", "_box")).drop("boxes").select("*", "_box.*").drop("_box").withColumn("det_idx", F.col("det_idx").cast("long"))


def detected(frames: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], schema: str) -> DataFrame:
    """Frames through a detector: load() runs once in each task and gives a function from images to lists of boxes.

    Whatever can be filtered by other columns should be filtered before: Spark does not look into this stage.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            yield batch.drop(columns="image").assign(boxes=detector(batch["image"]))

    return frames.mapInPandas(run, schema)


def newest(rows: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each key; Spark keeps only n rows of a key before it shuffles them."""
    back = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")
