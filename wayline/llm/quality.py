"""Quality by an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Counts are of runs of ORDER characters, 12 bits each, packed into one long; code points above U+0FFF share the 4096
classes by a hash. Lower orders count in how many contexts a run occurs. Every table (counts, contexts, probabilities) is
a Spark table keyed by the packed run, so it is sharded and grows with the corpus.

Scoring joins counts, not occurrences: each batch of texts asks once for each distinct run in it, the answers come
back to the batch, and the batch's texts, compressed meanwhile, are scored there. A text's perplexity is per
character. Each language's threshold is a quantile of the perplexity, smoothed for short texts, of trusted texts that
the model has not seen.

Scale: what is shuffled is distinct runs of each batch and compressed texts, once. Trusted ids are broadcast up to
BROADCAST_IDS of them and shuffled beyond. The texts are read twice with the same partitions; docs that come from a
shuffle are written out first.

Defined results: null and empty texts have no perplexity and are not rejected. A null language is a group of its own. A
language's threshold is its median plus a quantile of what lies above it; both are its own, drawn towards those of all languages the
more the fewer trusted unseen texts it has. Without any in any language, nothing is rejected. Repeated rows each get their result. Without trusted text every character is equally likely. Very long texts are read whole. Columns besides those
named, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import BROADCAST_IDS, cut, give_back, without

ORDER, BITS = 5, 12
#: Bytes of text in a batch, and what a row counts besides; the quantile, and the characters a text is smoothed by.
BATCH, ROW, QUANTILE, PRIOR = 24 << 20, 64, 0.998, 64
#: Runs that a task gathers before it adds them up.
HELD = 1 << 19
#: As how many texts of a language the figures of all languages count, in its median and in its quantile above the median.
USUAL_WEIGHT, MOST_WEIGHT = 1, 50


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed run that ends at each character of the texts (each begins after ORDER - 1 zeros), and each text's end."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    high = points >= 1 << BITS
    if high.any():
        points[high] = (points[high] * 2654435761 >> 9) & ((1 << BITS) - 1)
    packed = points[: len(points) - ORDER + 1].copy()
    for i in range(1, ORDER):
        packed = (packed << BITS) | points[i : len(points) - ORDER + 1 + i]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + ORDER - 1)
    own = np.ones(len(packed) + ORDER - 1, bool)  # runs that end in padding are no characters
    for i in range(ORDER - 1):
        own[ends - 1 - i] = False
    return packed[own[: len(packed)]], np.cumsum(lengths)


def _parts(texts: Iterable[str | None], limit: int = 1 << 18) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        text = text or ""
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _added(keys: np.ndarray, sums: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their sums, with more of both."""
    keys, sums = np.concatenate([keys, *(k for k, _ in more)]), np.concatenate([sums, *(n for _, n in more)])
    if not len(keys):
        return keys, sums
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums, first)


def counts(docs: DataFrame) -> DataFrame:
    """run, n: how often each run occurs in docs (text). Each task adds up its own before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for part in _parts(batch.column(0).to_pylist()):
                waiting.append(np.unique(runs(part)[0], return_counts=True))
                held += len(waiting[-1][0])
                if held > HELD:
                    keys, sums = _added(keys, sums, waiting)
                    waiting, held = [], 0
                    if len(keys) > 2 * HELD:  # what a task holds stays bounded
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["run", "n"])
                        keys, sums = keys[:0], sums[:0]
        keys, sums = _added(keys, sums, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["run", "n"])
        give_back()

    return docs.select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def _last(run: Column, order: int) -> Column:
    """The last characters of a run, as a run of lower order."""
    return run.bitwiseAND(F.lit((1 << (BITS * order)) - 1).cast("long"))


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many runs have each small count."""
    seen = table.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (seen[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def model(highest: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (run, less: count minus discount) and (context, total, free: mass left to the lower order)."""
    tables, at = [], highest
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            at = cut(at.groupBy(_last(F.col("run"), order).alias("run")).agg(F.count("*").alias("n")), f"quality-n{order}", tidy=True)
        d1, d2, d3 = _discounts(at)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("run", BITS).alias("context")
        tables.append((at.select("run", (F.col("n") - off).alias("less")), at.groupBy(context).agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("free"))))
    return tables[::-1]


def probabilities(asked: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """run, log_p of each distinct run of asked (run): interpolated from the lowest order up."""
    p = None
    for order, (table, contexts) in enumerate(tables, 1):
        if order < ORDER:
            wanted = asked.select(_last(F.col("run"), order).alias("run")).distinct()
        else:
            wanted = asked.select("run").distinct()
        lower = F.col("lower") if p is not None else F.lit(1.0 / (1 << BITS))
        rows = wanted.withColumns({"context": F.shiftright("run", BITS), "suffix": _last(F.col("run"), order - 1)})
        if p is not None:
            rows = rows.join(p.select(F.col("run").alias("suffix"), F.col("p").alias("lower")), "suffix")
        rows = rows.join(table, "run", "left").join(contexts, "context", "left")
        p = rows.select("run", F.when(F.col("total").isNull(), lower).otherwise(F.coalesce("less", F.lit(0.0)) / F.col("total") + F.col("free") * lower).alias("p"))
        p = cut(p, f"quality-p{order}", tidy=True)
    return p.select("run", F.log("p").cast("float").alias("log_p"))


def _batched(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Slices of the task's rows, in order, with the number of the batch they belong to and whether it ends there.

    A batch ends where its texts reach BATCH bytes, so both readings cut alike, however Arrow cuts the rows. Only one slice is held.
    """
    size, k, last = 0, 0, None
    first = TaskContext.get().partitionId() << 24
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + ROW)])
        at = 0
        while at < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(before, before[at] + BATCH - size, "right")))
            if last is not None:
                yield *last, False
            last = first + k, batch.slice(at, end - at)
            size += int(before[end] - before[at])
            at = end
            if size > BATCH:
                yield *last, True
                size, k, last = 0, k + 1, None
    if last is not None:
        yield *last, True


def _asked(docs: DataFrame) -> DataFrame:
    """batch, run: the distinct runs of each batch."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, held = np.zeros(0, np.int64), [], 0
        for batch, rows, end in _batched(batches, 1):
            for part in _parts(rows.column(1).to_pylist()):
                waiting.append(np.unique(runs(part)[0]))
                held += len(waiting[-1])
            if end or held > HELD:
                seen, waiting, held = np.unique(np.concatenate([seen, *waiting])), [], 0
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), batch, np.int64)), pa.array(seen)], ["batch", "run"])
                seen = seen[:0]
        give_back()

    return docs.mapInArrow(ask, "batch long, run long")


def _compressed(docs: DataFrame) -> DataFrame:
    """batch, blob: the rows of each batch as compressed Arrow."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = None
        for batch, rows, end in _batched(batches, 1):
            if sink is None:
                sink = pa.BufferOutputStream()
                squeezed = zstandard.ZstdCompressor(level=3).stream_writer(sink, closefd=False)
                stream = pa.ipc.new_stream(squeezed, rows.schema)
            stream.write_batch(rows)
            if end:
                stream.close()
                squeezed.close()
                blob = pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, sink.tell()], np.int64)), sink.getvalue()])
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), blob.cast(pa.binary())], ["batch", "blob"])
                sink = squeezed = stream = blob = None
        give_back()

    return docs.mapInArrow(squeeze, "batch long, blob binary")


def score(docs: DataFrame, trusted: DataFrame, stored: bool = False) -> DataFrame:
    """doc_id, lang, n_chars and log_ppl of each row of docs (doc_id, text, lang), by a model of the texts of trusted (text).

    docs are read twice and have to be dealt alike, so they are written first; stored: they are a table as it was read, and need not be.
    """
    own = docs.select("doc_id", "text", "lang")
    own = own if stored else cut(own, "quality-docs")
    tables = model(cut(counts(trusted), f"quality-n{ORDER}", texts=True, tidy=True))
    asked = cut(_asked(own), "quality-asked", texts=True, tidy=True)
    answers = asked.join(probabilities(asked, tables), "run").select("batch", "run", "log_p")
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = to_arrow_schema(own.select("doc_id", "lang", F.lit(0).cast("long").alias("n_chars"), F.lit(0.0).alias("log_ppl")).schema)

    def read(blobs: pa.Table, found: pa.Table) -> pa.Table:
        keys, logs = found.column("run").to_numpy(), found.column("log_p").to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        out = [schema.empty_table()]
        for blob in blobs.column("blob"):
            for rows in pa.ipc.open_stream(zstandard.ZstdDecompressor().stream_reader(blob.as_buffer())):
                sums, lengths = [np.zeros(0)], [np.zeros(0, np.int64)]
                for part in _parts(rows.column("text").to_pylist()):
                    packed, ends = runs(part)
                    at = np.minimum(np.searchsorted(keys, packed), max(0, len(keys) - 1))
                    if len(packed) and (not len(keys) or (keys[at] != packed).any()):
                        raise ValueError("the two readings of docs differ: write docs out first")
                    total = np.concatenate([[0.0], np.cumsum(logs[at], dtype=np.float64)]) if len(packed) else np.zeros(1)
                    starts = np.concatenate([[0], ends[:-1]])
                    sums.append(total[ends] - total[starts])
                    lengths.append(ends - starts)
                n = np.concatenate(lengths)
                value = pa.array(-np.concatenate(sums) / np.maximum(n, 1), mask=n == 0)
                out.append(pa.table([rows.column("doc_id"), rows.column("lang"), pa.array(n), value], schema=schema))
        give_back()
        return pa.concat_tables(out)

    # a batch's rows stand in one group of bounded size: its texts and their distinct runs
    return _compressed(own).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(read, f"doc_id {kind}, lang string, n_chars long, log_ppl double")


def judge(docs: DataFrame, labels: DataFrame, calibrate: Column, quantile: float = QUANTILE, stored: bool = False) -> DataFrame:
    """doc_id, lang, perplexity, threshold (of smoothed perplexity) and rejected of each row of docs (doc_id, text, lang).

    labels (doc_id, quality): texts of quality 1 are trusted. calibrate (on doc_id) says which of them set the
    thresholds; the model learns from the others. stored: as in score.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).filter("_quality = 1").select("doc_id")
    taught = good.filter(~calibrate)
    known = F.broadcast(taught) if taught.count() <= BROADCAST_IDS else taught
    scored = cut(score(docs, docs.select("doc_id", "text").join(known, "doc_id", "left_semi"), stored), "quality-scores", tidy=True)
    # a language's figures are one row each
    lang = F.struct("lang")
    unseen = scored.filter("log_ppl IS NOT NULL").join(good.filter(calibrate), "doc_id", "left_semi")

    def levels(rows: DataFrame, value: Column, share: float) -> tuple[DataFrame, DataFrame]:
        level = F.percentile_approx(value, F.lit(share), F.lit(10000))
        return rows.groupBy(lang.alias("_lang")).agg(level.alias("_own"), F.count("*").alias("_n")), rows.agg(level.alias("_all"))

    def with_levels(rows: DataFrame, found: tuple[DataFrame, DataFrame], name: str, base: Column, weight: int) -> DataFrame:
        """A language's level is its own, with the level of all counting as so many more texts."""
        own, every = found
        joined = rows.join(F.broadcast(every)).withColumn("_key", lang).join(F.broadcast(own), F.col("_key") == F.col("_lang"), "left")
        n = F.coalesce("_n", F.lit(0))
        level = (F.coalesce("_own", F.lit(0.0)) * n + F.col("_all") * weight) / (n + weight)
        return joined.withColumn(name, base + level).drop("_key", "_lang", "_own", "_all", "_n")

    # a short text says little: it counts as if PRIOR characters of its language's usual perplexity stood before it
    shrunk = (F.col("log_ppl") * F.col("n_chars") + F.col("_usual") * PRIOR) / (F.col("n_chars") + PRIOR)
    usual = levels(unseen, F.col("log_ppl"), 0.5)
    # how far a text may lie above its language's usual perplexity
    most = levels(with_levels(unseen, usual, "_usual", F.lit(0.0), USUAL_WEIGHT), shrunk - F.col("_usual"), quantile)
    judged = with_levels(with_levels(scored, usual, "_usual", F.lit(0.0), USUAL_WEIGHT), most, "_most", F.col("_usual"), MOST_WEIGHT)
    return judged.select("doc_id", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("_most").alias("threshold"), F.coalesce(shrunk > F.col("_most"), F.lit(False)).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame, calibrate: Column, quantile: float = QUANTILE, stored: bool = False) -> DataFrame:
    """The rows of docs, all columns, that are not rejected; a repeated doc_id goes if all of its rows are rejected."""
    judged = judge(docs, labels, calibrate, quantile, stored)
    return without(docs, judged.groupBy("doc_id").agg(F.min(F.col("rejected").cast("int")).alias("all")).filter("all = 1").select("doc_id"))
