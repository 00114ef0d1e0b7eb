"""Where streams go: tables of annotated rows, and the map at a steady pace."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.functions import text
from wayline.operators.frames import colored

#: Pace of the map.
MAP_PACE = "80 milliseconds"


def annotated(assigned: DataFrame) -> DataFrame:
    """Assignments with what is written beside each box; vectors are left out."""
    return assigned.select(
        "*", text.label(F.col("gid"), F.lit(None).cast("double"), F.col("det_idx")).alias("label"), text.source_label(F.col("source"), F.col("score"), F.col("overlap")).alias("detail"), colored(F.col("overlap")).alias("color")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False, fps: float | None = None) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint; once: what is there now, then stop. fps: a batch for each frame's time, as a played file has it."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if not once and fps:
        writer = writer.trigger(processingTime=f"{max(1, round(1000 / fps))} milliseconds")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def per_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch through work, which may read tables as they are by then (such as the registry), into a table. A batch that runs again replaces what it had written."""

    def write(rows: DataFrame, batch: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_map(changes: DataFrame, path: str, checkpoint: str, once: bool = False, key: Sequence[str] = ("site_id", "gid"), every: int = 64) -> StreamingQuery:
    """The map as a table that is changed in place: each batch's changes, and after every so many batches a snapshot of the whole map, which replaces what came before it.

    A batch that runs again replaces what it had written. Changes and snapshots go one snapshot later than they could, for whoever reads meanwhile.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        if (batch + 1) % every == 0:
            spark = changed.sparkSession
            older = [n for n in _numbers(spark, f"{path}/snapshots", done=True) if n < batch]
            _merged(spark, path, key, batch).write.mode("overwrite").parquet(f"{path}/snapshots/upto={batch}")
            if older:
                kept = max(older)
                for folder, name, numbers in (("changes", "batch", _numbers(spark, f"{path}/changes")), ("snapshots", "upto", older)):
                    for n in numbers:
                        if n < kept or (n == kept and folder == "changes"):
                            where, files = _folder(spark, f"{path}/{folder}/{name}={n}")
                            files.delete(where, True)

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=MAP_PACE)).start()


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, done: bool = False) -> list[int]:
    """The numbers of a folder's parts; done: of those that were written to their end."""
    where, files = _folder(spark, path)
    if not files.exists(where):
        return []
    found = [x.getPath() for x in files.listStatus(where)]
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if "=" in p.getName() and (not done or files.exists(made(p, "_SUCCESS"))))


def _merged(spark: SparkSession, path: str, key: Sequence[str], upto: int | None = None) -> DataFrame:
    """Of each identity what was last said, without those that are gone: from the newest snapshot and the changes since."""
    snapshots = [n for n in _numbers(spark, f"{path}/snapshots", done=True) if upto is None or n < upto]
    since = snapshots[-1] if snapshots else -1
    batches = [n for n in _numbers(spark, f"{path}/changes", done=True) if n > since and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/snapshots/upto={since}").withColumns({"gone": F.lit(False), "batch": F.lit(since)})] if snapshots else []
    if batches:
        parts.append(spark.read.option("basePath", f"{path}/changes").parquet(*[f"{path}/changes/batch={n}" for n in batches]))
    said = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # a batch may take an identity off and put it on again: the later sighting holds, and being on the map before being gone
    row = F.struct(*[c for c in said.columns if c not in (*key, "batch")])
    last = said.groupBy(*key).agg(F.max_by(row, F.struct("batch", "last_seen_ms", "gone")).alias("row"))
    return last.filter("NOT row.gone").select(*key, "row.*").drop("gone")


def read_map(spark: SparkSession, path: str, key: Sequence[str] = ("site_id", "gid")) -> DataFrame:
    """The map as the changes have left it. What is read is a snapshot, as large as the map, and the few batches since."""
    return _merged(spark, path, key)
