"""Cameras as streams: a clip played over a clock, once or for ever, admitted at its frame rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def play(spark: SparkSession, clip: DataFrame, fps: float = 25.0, loop: bool = True, frames_per_batch: int | None = None) -> DataFrame:
    """A clip (cam_name, frame_no from 0, and more) as a stream; each camera begins again after its own last frame, if loop, and else ends.

    The clock is a rate source: its ticks are frames, fps of them a second, and its offset is the next frame, so a query that is started again goes on where
    it stopped, and a frame is never admitted faster than the clip's rate. frames_per_batch: ticks by the batch instead of by the second, for a catch-up.
    Added columns: loop. frame_no and ts_ms count on from loop to loop; frames that no row of the clip has pass without a row.
    """
    if frames_per_batch is None:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(fps)))
    else:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", frames_per_batch).option("numPartitions", 1)
    lengths = clip.groupBy("cam_name").agg((F.max("frame_no") + 1).alias("_length"))
    # a row for each camera and tick: who shows which of its frames
    shown = ticks.load().select(F.col("value").alias("_tick")).join(lengths, F.col("_length") > 0)
    at = shown.select("cam_name", "_tick", (F.col("_tick") % F.col("_length")).alias("frame_no"), F.floor(F.col("_tick") / F.col("_length")).alias("loop"))
    if not loop:
        at = at.filter("loop = 0")
    played = at.join(clip, ["cam_name", "frame_no"])
    return played.withColumns({"frame_no": F.col("_tick"), "ts_ms": F.floor(F.col("_tick") * 1000 / F.lit(float(fps)))}).drop("_tick")
