"""Near duplicates by SuperMinHash: signatures, bands, verification on full shingle sets, union-find grouping.

A document's set holds its distinct shingles of k words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), as 64-bit hashes.
SuperMinHash walks through each shingle's random permutation of the signature's places, step by step for all
shingles at once, and stops at the step by which every place is filled: later steps only have larger ranks.

Documents with equal sets are one class. Classes that share a band of the signature form a cluster, buckets that share
a member being one cluster. Each class is first compared with the smallest class of its buckets, which is one pair for each member and
joins most of what is alike. Then every class outside its cluster's largest component is compared with all of the cluster's other
components, in blocks, so that no pair that could join two components is left out. Links are confirmed on the full
sets of both texts: 100 * shared >= percent * all.

Scale: texts are read once for signatures and once more, for members of clusters only. What is shuffled is bands (8
bytes each) and the texts of members; minima of buckets combine before they shuffle, hot keys meet only in joins,
which Spark splits where they are skewed. A cluster of any size is cut into blocks of about BLOCK shingles; a task holds two of
them and returns one link for each component that a class reaches, never all pairs.

Defined results: documents without words have an empty set and are linked with nothing; with fewer than k words the
whole sequence is the one shingle. Rows without a doc_id get no component and are kept; a repeated doc_id joins
whatever its rows are linked to, and each of its rows is returned. Very long texts are compared whole. Columns besides those named, whatever their names,
are not read, and keep_one() returns them as they are. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import chunks, cut, give_back, mix, within, without, word_hashes

#: Places in a band, and the chance that a pair right at the threshold shares no band.
ROWS, MISS = 6, 1e-4
#: Shingles in a block of a cluster.
BLOCK = 1 << 16


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    turns = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    for _, run in chunks(texts):
        words, ends = word_hashes(run)
        whole = sum((words[i : len(words) - k + 1 + i] * turns[i] for i in range(k)), np.zeros(max(0, len(words) - k + 1), np.uint64)) if len(words) >= k else np.zeros(0, np.uint64)
        whole = mix(whole)
        start = 0
        for end in ends.tolist():
            n = end - start
            if n >= k:
                yield np.unique(whole[start : end - k + 1])
            elif n:
                yield mix((words[start:end] * turns[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
            start = end


def signature(elements: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash of a non-empty set of 64-bit hashes: the least rank at each place."""
    n, out = len(elements), np.full(places, np.inf)
    index = None
    for step in range(places):
        draw = mix(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = step + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        to = step + ((draw & np.uint64(0x7FFFFFFF)) * np.uint64(places - step) >> np.uint64(31)).astype(np.int64)
        if step == 0:
            place = first = to
        else:
            if index is None:  # permutations are only needed from the second step on
                index, rows = np.tile(np.arange(places, dtype=np.uint16), (n, 1)), np.arange(n)
                index[rows, first] = 0
            place = index[rows, to].astype(np.int64)
            index[rows, to] = index[rows, step]
        np.minimum.at(out, place, rank)
        if out.max() < step + 1:  # every place is filled: whatever comes later is larger
            break
    return out


def _sign(k: int, bands: int):
    places = bands * ROWS
    turns = mix(np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    which = np.arange(bands, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, low, high, keys = [], [], [], []
                for own in sets(part.column(1).to_pylist(), k):
                    sizes.append(len(own))
                    low.append(int(mix(own).sum(dtype=np.uint64)) - (1 << 63) if len(own) else None)
                    high.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) - (1 << 63) if len(own) else None)
                    if len(own):
                        coded = signature(own, places).view(np.uint64) * turns
                        keys.append(mix(mix(coded.reshape(bands, ROWS).sum(1, dtype=np.uint64)) + which).view(np.int64))
                    else:
                        keys.append(None)
                columns = [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "doc_id", "n", "low", "high", "bands"])
            give_back()

    return sign


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets are alike. texts: doc_id, text, one row for each id."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))  # the hub of many pairs is hashed once
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                keep = []
                for text, other in zip(part["text_a"], sets(part["text_b"].tolist(), k), strict=True):
                    if last[0] != text:
                        last = (text, next(sets([text], k)))
                    shared = len(np.intersect1d(last[1], other, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(last[1]) + len(other) - shared))
                yield part.loc[keep, ["a", "b"]]
            give_back()

    return cut(both.select("a", "b", "text_a", "text_b").mapInPandas(alike, "a long, b long"), "minhash-alike", texts=True)


def _reached(part: pd.DataFrame, k: int, percent: int) -> list[tuple[int, int]]:
    """Links from the outside rows of one cluster to its other components: one for each component that a row reaches."""
    own = list(sets(part["text"].tolist(), k))
    ids, component = part["doc_id"].to_numpy(), part["component"].to_numpy()
    left, right = np.flatnonzero(part["out"]), np.flatnonzero(part["mem"])
    if not len(left) or not len(right):
        return []
    keys = np.concatenate([own[i] for i in right])
    who = np.repeat(np.arange(len(right)), [len(own[i]) for i in right])
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    sizes = np.array([len(own[i]) for i in right])
    found = []
    for i in left:
        low, high = np.searchsorted(keys, own[i], "left"), np.searchsorted(keys, own[i], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())  # the postings of all of its shingles
        shared = np.bincount(who[at], minlength=len(right))
        ok = (shared > 0) & (100 * shared >= percent * (len(own[i]) + sizes - shared)) & (component[right] != component[i])
        for c in np.unique(component[right][ok]):
            found.append((int(ids[i]), int(ids[right][ok & (component[right] == c)].min())))
    return found


def across(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """members (doc_id, n, cluster, component) -> links (a, b) between components of a cluster, such that all that are alike are joined."""
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("many", "component"))["component"].alias("largest"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    open_ = cut(members.join(largest, "cluster").withColumn("out", F.col("component") != F.col("largest")), "minhash-open")
    blocks = open_.groupBy("cluster").agg(F.ceil(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("outs"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("mems"))
    rows = open_.join(blocks, "cluster")
    # small clusters share units, as many as their shingles fill blocks
    units = max(4096, (open_.agg(F.sum("n")).first()[0] or 0) // BLOCK)
    big = F.col("mems") > 1
    part = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    unit = F.concat_ws("/", "cluster", "o", "m")
    columns = ["doc_id", "cluster", "component", "out", "mem", "unit"]
    small = rows.filter(~big).withColumns({"mem": F.lit(True), "unit": F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(units)).cast("string"))}).select(columns)
    outs = rows.filter(big & F.col("out")).withColumn("o", part("o", "outs")).withColumn("m", every("mems")).withColumns({"mem": F.lit(False), "unit": unit}).select(columns)
    mems = rows.filter(big).withColumn("m", part("m", "mems")).withColumn("o", every("outs")).withColumns({"mem": F.lit(True), "out": F.lit(False), "unit": unit}).select(columns)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, part in group.groupby("cluster") for x in _reached(part, k, percent)]
        return pd.DataFrame(found, columns=["a", "b"])

    dealt = small.unionByName(outs).unionByName(mems).join(texts, "doc_id")
    return cut(dealt.groupBy("unit").applyInPandas(compare, "a long, b long"), "minhash-across")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    # a row is known by its id and text together, so that a repeated id may have several texts
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("doc_id", F.xxhash64("id", "text"))
    signed = cut(docs.select("id", "text", "doc_id").mapInArrow(_sign(k, bands_for(percent)), "id long, doc_id long, n long, low long, high long, bands array<long>"), "minhash-signed", texts=True)
    there = signed.filter("n > 0 AND id IS NOT NULL")
    repeated = _repeats(signed, "id")
    # equal sets: one class, known by one of its rows
    classes = cut(there.groupBy("low", "high", "n").agg(F.min("doc_id").alias("a"), F.min("id").alias("first"), F.count("*").alias("copies")), "minhash-classes")
    members = cut(there.join(classes.select(F.col("a").alias("doc_id"), "low", "high", "n"), ["doc_id", "low", "high", "n"], "left_semi").dropDuplicates(["doc_id", "low", "high", "n"]).select("doc_id", "n", F.explode("bands").alias("band")), "minhash-members")
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    hubs = members.select("band", "doc_id").join(buckets, "band").filter("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    pairs = cut(hubs.distinct(), "minhash-pairs")
    cluster = components(pairs)
    texts = within(docs.filter("id IS NOT NULL").select("doc_id", "text"), cluster.select("id"))
    texts = cut(texts.dropDuplicates(["doc_id"]) if repeated else texts, "minhash-texts")
    links = confirm(pairs, texts, k, percent)
    joined = components(links)
    sizes = members.select("doc_id", "n").distinct()
    known = cluster.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")).join(sizes, "doc_id").join(joined.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = across(known, texts, k, percent)
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    # copies and links get the smallest id of their component; the rest stand alone
    told = classes.join(joined.select(F.col("id").alias("a"), "component"), "a", "left").filter("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "a"))
    smallest = told.groupBy("component").agg(F.min("first").alias("component_id"))
    of = told.join(smallest, "component").select("low", "high", "n", "component_id")
    own = signed.join(of, ["low", "high", "n"], "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    if repeated:  # an id's rows join what any of them is linked to
        more = components(own.filter("id IS NOT NULL").select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        own = own.join(more.select("id", "component"), "id", "left").withColumn("component_id", F.coalesce("component", "component_id"))
    return own.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _repeats(rows: DataFrame, column: str = "doc_id") -> bool:
    return not rows.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").isEmpty()


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each group the row with the smallest doc_id stays (of its repeated rows, one of those with the smallest text)."""
    found = cut(near_duplicates(docs, k, percent), "minhash-found")
    kept = without(docs, found.filter("NOT kept").select("doc_id"))
    if not _repeats(found):
        return kept
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = rows.filter("row.doc_id IS NOT NULL").groupBy("row.doc_id").agg(F.min_by("row", F.struct("row.text", F.xxhash64(F.to_json("row")))).alias("row"))
    return own.select("row.*").unionByName(rows.filter("row.doc_id IS NULL").select("row.*"))
