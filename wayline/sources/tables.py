"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it, or the context's checkpoint folder; on one machine a folder of its own, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="wayline-tables-")
        atexit.register(shutil.rmtree, home, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(home)
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: what reads it several times computes it once, and a lost executor costs nothing that came before.

    by: a column whose values have folders of their own, so that who asks for one reads no other.
    """
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
