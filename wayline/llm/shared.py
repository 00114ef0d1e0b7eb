"""Helpers that several operators use: cutting lineage, the fold of a row, word hashing in numpy, a worker's memory."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it: spark.checkpoint.dir, or the context's checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif spark.sparkContext.master.startswith("local["):
            # one machine, one process: its temporary folder is shared by all there is
            home = tempfile.mkdtemp(prefix="wayline-checkpoints-")
            atexit.register(shutil.rmtree, home, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(home)
            named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named.rstrip("/")


_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that gets the folders of what is written inside, by this run alone: other threads and callers have lists of their own, or none."""
    mine: list[str] = []
    token = _RUN.set(mine)
    try:
        yield mine
    finally:
        _RUN.reset(token)


def note(path: str) -> None:
    """Tell the run that is going on, if there is one, of a folder."""
    mine = _RUN.get()
    if mine is not None:
        mine.append(path)


#: Rows and bytes in an Arrow batch where whole texts go to Python.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


#: Shuffle files go as soon as the execution that wrote them has ended.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def cut(df: DataFrame, name: str, texts: bool = False, tidy: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation of what came before.

    texts: df sends whole texts to Python, so while it is written Arrow batches are small: both sides hold a batch or two for each task.
    The setting is the session's, so other queries that start meanwhile in the same session get small batches too, and no other results.
    tidy: what was shuffled for this table is deleted with the end of its writing, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    note(path)
    wanted = (TEXT_BATCH if texts else {}) | (TIDY if tidy else {})
    usual = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders: once a result is written, what led to it goes."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Ids that are broadcast at most (hashed, about 80 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 250_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose doc_id is not among ids (one column)."""
    ids = cut(ids.toDF("id").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(ids, F.col("row.doc_id").eqNullSafe(F.col("id")), "left_anti").select("row.*")


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose doc_id and xxhash64 of the text are not together among rows (id, hash)."""
    rows = cut(rows.toDF("id", "hash").distinct(), "rows")
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.join(rows, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash")), "left_anti").select("row.*")


def within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (one column)."""
    ids = cut(ids.toDF("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out. A null id counts as the text of nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on after a stage, beside the JVM and the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, as many as n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + (_CHUNK >> 1))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: Iterable[str | None], limit: int = _CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of whole texts as UTF-8, each of about limit bytes (a longer text makes its own run): (index of the first, run)."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def joined(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the run, each text followed by a space, and where each text starts in it."""
    buffer = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in run), np.int64, len(run))
    return buffer, np.cumsum(lengths) - lengths


def hashed(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from first up to last of a buffer."""
    up, down = _powers(len(buffer))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * up)])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(run: list[bytes], spaces: np.ndarray = _SPACES, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of the run, and each text's end in that array.

    spaces: which bytes part words. prefix: only so many characters of each word count, and a word as long as that hashes as longer ones do.
    """
    buffer, starts = joined(run)
    space = spaces[buffer]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    if prefix is not None:
        characters = np.append(np.flatnonzero((buffer & 0xC0) != 0x80), np.full(prefix, len(buffer)))
        last = np.minimum(last, characters[np.searchsorted(characters, first) + prefix])
    return hashed(_LOWER[buffer], first, last), np.searchsorted(first, np.append(starts[1:], len(buffer)))
