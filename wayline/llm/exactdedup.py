"""Exact deduplication by a stateful stream over files of documents, in DataFrame operations only.

Two streams follow each other. The first reads new files and logs each row's digest (of its text with A-Z lower-cased), its stable identifier
(doc_id) and its content locator (file and row in it). The second keys its state by digest: the state store, on disk (RocksDB) and checkpointed
to the shared folder, keeps for each digest the largest identifier with its locator and the number of rows. Nothing expires: a copy is
found however late it comes. Both go on from their checkpoints, so a further call reads only files that have come since.

A digest that was seen before is a hit, and hits are checked on full bytes: texts are fetched by locator, and each is compared with the text that the
state names. Rows whose bytes differ leave the group and are grouped among themselves by their whole texts, so results hold for any digest.

Scale: a text is read once for its digest and never shuffled for it; only texts of hits are fetched and meet their group's, whose text is
repeated once for each SHARE of its rows, so that a group of any size is spread. State takes about a hundred bytes for each distinct text. Groups
and rows meet in a plain join on the digest, which Spark splits where one is skewed.

Defined results: a null text counts as empty, and empty texts are equal. A null doc_id is smaller than any other. Of rows with equal text and equal
doc_id the last by (file, row) stays, so exactly one row of a group does. Very long texts are hashed and compared whole. Columns besides doc_id and
text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import BROADCAST_IDS, cut, note, shared_dir

#: The state store that keeps state on disk, without megabytes set aside for each of its many small stores.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Into how many triggers the files that are there are dealt, and the least bytes of a trigger.
TRIGGERS, LEAST = 4, 1 << 20
#: Rows of a group that are compared with one copy of its text.
SHARE = 512


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files of a folder, or one file, as a stream."""
    where, fs = _files(spark, path)
    # a stream over a single file has to name it by a pattern
    named = path if fs.getFileStatus(where).isDirectory() else f"{path[:-1]}[{path[-1]}]"
    share = max(LEAST, -(-fs.getContentSummary(where).getLength() // TRIGGERS))
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(share)).parquet(named)


def _located(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col("text")).alias("text"))


def _schema(spark: SparkSession, path: str) -> StructType:
    own = spark.read.parquet(path).schema
    return StructType([own["doc_id"], own["text"]])


def remember(spark: SparkSession, path: str, home: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Take in the files at path that home has not seen. home: a shared folder for the log of digests, the state and both checkpoints."""
    found = _located(_stream(spark, path, _schema(spark, path))).select("doc_id", "file", "row", digest(F.col("text")).alias("digest"))
    logging = found.writeStream.format("parquet").option("checkpointLocation", f"{home}/log-checkpoint").trigger(availableNow=True)
    logging.start(f"{home}/log").awaitTermination()
    keyed = _stream(spark, f"{home}/log", found.schema).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("best"), F.count("*").alias("n"))
    usual = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it was started with
        state = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state.awaitTermination()


def log(spark: SparkSession, home: str) -> DataFrame:
    """doc_id, file, row, digest of each row taken in."""
    return spark.read.parquet(f"{home}/log")


def groups(spark: SparkSession, home: str) -> DataFrame:
    """What the state holds: digest, best (doc_id, file, row), n."""
    return spark.read.format("statestore").load(f"{home}/state").select("key.digest", F.col("value.max").alias("best"), F.col("value.count").alias("n"))


def differing(spark: SparkSession, path: str, rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, file, row, digest, text of the rows whose bytes are not those of the row that their digest's group names."""
    hits = cut(rows.join(repeated, "digest").select("file", "row", "digest", "n", (F.struct("doc_id", "file", "row") == F.col("best")).alias("named")), "exact-hits")
    own = _located(spark.read.schema(_schema(spark, path)).parquet(path))
    texts = cut(own.join(F.broadcast(hits) if hits.count() <= BROADCAST_IDS else hits, ["file", "row"]), "exact-texts")
    shares = F.floor((F.col("n") - 1) / SHARE).cast("int")
    named = texts.filter("named").select("digest", F.explode(F.sequence(F.lit(0), shares)).alias("share"), F.col("text").alias("named_text"))
    others = texts.filter("NOT named").withColumn("share", F.pmod(F.xxhash64("file", "row"), shares + 1).cast("int"))
    return others.join(named, ["digest", "share"]).filter(F.col("text") != F.col("named_text")).select("doc_id", "file", "row", "digest", "text")


def duplicates(spark: SparkSession, path: str, home: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each document at path: doc_id, keep_id, group_size, kept, digest. home: as in remember; a new one if none is named."""
    if home is None:
        home = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
        note(home)
    remember(spark, path, home, digest)
    rows = log(spark, home)
    if rows.isEmpty():  # no row has come, so there is no state to read
        nothing = rows.withColumns({"best": F.struct("doc_id", "file", "row"), "n": F.lit(1).cast("long")})
        return _told(nothing)
    repeated = cut(groups(spark, home).filter("n > 1"), "exact-groups")
    wrong = cut(differing(spark, path, rows, repeated), "exact-differing")
    found = rows.join(repeated, "digest", "left")
    if not wrong.isEmpty():
        apart = wrong.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("own_best"), F.count("*").alias("own_n"))
        placed = wrong.join(apart, ["digest", "text"]).select("file", "row", "own_best", "own_n")
        less = apart.groupBy("digest").agg(F.sum("own_n").alias("less"))
        found = found.join(less, "digest", "left").join(placed, ["file", "row"], "left")
        found = found.withColumns({"best": F.coalesce("own_best", "best"), "n": F.coalesce("own_n", F.col("n") - F.coalesce("less", F.lit(0)))})
    return _told(found)


def _told(found: DataFrame) -> DataFrame:
    best = F.coalesce("best", F.struct("doc_id", "file", "row"))
    return found.select("doc_id", best["doc_id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.struct("doc_id", "file", "row").eqNullSafe(best).alias("kept"), "digest")
